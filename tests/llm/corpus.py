"""Small odd inputs shared by the tests: NULLs, empty and long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

CLASHES = (
    "score shard verdict n sid number _id _key _text sig root component_id spans kept ids labels matches "
    "_h _bytes _label words doc held_out piece host path"
).split()

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def frame(spark, rows):
    """`rows` of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in rows], SCHEMA)


def odd_rows(seed=5):
    random.seed(seed)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("st", "nd", "é", "x", "ing")]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    shared = prose(90)
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    long = prose(6_000)
    rows = [
        (1, base),
        (2, " ".join(near)),
        (3, base),
        (4, prose(40) + " " + shared + " " + prose(35)),
        (5, prose(20) + "\n" + shared + " " + prose(50)),
        (6, long + " " + shared),
        (7, None),
        (8, ""),
        (9, " \n\t "),
        (10, "one"),
        (11, "ONE"),
        (12, prose(60)),
        (12, prose(60)),
        (13, prose(30) + "\n" + shared),
        (13, prose(30) + "\n" + shared),
        (None, base),
        (None, None),
        (14, "ab" * 3_000),
        (15, "tail \x00 " + "aaaa " * 400),
        (16, "x" * 20_000),
        (17, "#$% | a | b | c\nLicensed under the X License.\n" + prose(60) + ".\n" + prose(70) + "."),
        (18, "Dup line here.\nDup line here.\n" + prose(80)),
    ]
    # Rows 13 are repeated exactly, rows 12 share an id only.
    rows[14] = rows[13]
    return rows
