"""The wind-turbine application: sensor records to metrics to valid and invalid ones."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from millrace.operators.quality import validate_measurements
from millrace.operators.transforms import unpivot
from millrace.plans.application import Application, Frames, Stage

MEASUREMENTS = StructType(
    [
        StructField("power", DoubleType(), False),
        StructField("rotorSpeed", DoubleType(), False),
        StructField("windSpeed", DoubleType(), False),
    ]
)
SENSOR_DATA = StructType(
    [
        StructField("deviceId", StringType(), False),
        StructField("timestamp", TimestampType(), False),
        StructField("measurements", MEASUREMENTS, False),
    ]
)
METRIC = StructType(
    [
        StructField("deviceId", StringType(), False),
        StructField("timestamp", TimestampType(), False),
        StructField("name", StringType(), False),
        StructField("value", DoubleType(), False),
    ]
)
INVALID_METRIC = StructType(
    [StructField("metric", METRIC, False), StructField("error", StringType(), False)]
)


def to_metrics(inputs: Frames, config: Mapping[str, Any]) -> Frames:
    """One metric per measurement. `ids` and `measures` name the input columns."""
    return {"out": unpivot(inputs["in"], config["ids"], config["measures"])}


def validate(inputs: Frames, config: Mapping[str, Any]) -> Frames:
    valid, invalid = validate_measurements(inputs["in"])
    return {"valid": valid, "invalid": invalid}


SENSOR_CONFIG = {
    "ids": ("deviceId", "timestamp"),
    "measures": {name: f"measurements.{name}" for name in MEASUREMENTS.names},
}


def turbine_application(config: Mapping[str, Any] = SENSOR_CONFIG) -> Application:
    return Application(
        "sensor-data",
        (
            Stage("metrics", to_metrics, {"in": "sensor-data"}, {"out": "metrics"}, config),
            Stage(
                "validation",
                validate,
                {"in": "metrics"},
                {"valid": "valid-metrics", "invalid": "invalid-metrics"},
            ),
        ),
    )
