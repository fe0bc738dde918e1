"""Codec, landing directories and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.functions import codec, scalars
from millrace.plans.catalog.registry import query, scratch, table, topic_for
from millrace.sources import landing

EVENT = StructType(
    [
        StructField("event_id", LongType(), False),
        StructField("user_id", LongType(), False),
        StructField("event_type", StringType(), False),
    ]
)
PROPS = StructType([StructField("k", LongType(), False)])


def _bodies(spark, folder):
    """Events as JSON text; those of type error lose their last characters."""
    events = table(spark, folder, "events")
    body = codec.encode(EVENT.names)
    damaged = F.when(F.col("event_type") == "error", body.substr(F.lit(1), F.length(body) - 4))
    return events.select(F.coalesce(damaged, body).alias("body"))


_TRIPLE = "SELECT event_id, user_id, event_type FROM events"
_TEXT = """'{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}'"""


@query("json_decode", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_decode(spark, folder):
    events = table(spark, folder, "events").select("event_id", "props")
    return codec.decode_strict(events, "props", PROPS)


@query("json_encode", f"SELECT event_id, {_TEXT} AS body FROM events")
def json_encode(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", codec.encode(EVENT.names).alias("body"))


@query("decode_skip", f"{_TRIPLE} WHERE event_type <> 'error'")
def decode_skip(spark, folder):
    return codec.decode_skip(_bodies(spark, folder), "body", EVENT)


@query(
    "decode_replace",
    f"{_TRIPLE} WHERE event_type <> 'error' UNION ALL SELECT -1, -1, 'unreadable' FROM events WHERE event_type = 'error'",
)
def decode_replace(spark, folder):
    replacement = F.struct(
        F.lit(-1).alias("event_id"), F.lit(-1).alias("user_id"), F.lit("unreadable").alias("event_type")
    )
    return codec.decode_replace(_bodies(spark, folder), "body", EVENT, replacement)


@query(
    "decode_dead_letter",
    f"""SELECT left({_TEXT}, length({_TEXT}) - 4) AS body, 'undecodable' AS reason
        FROM events WHERE event_type = 'error'""",
)
def decode_dead_letter(spark, folder):
    return codec.decode_dead_letter(_bodies(spark, folder), "body", EVENT)[1]


@query(
    "landing_accept_reject",
    "SELECT event_id, coalesce(event_type, '') <> 'error' AS accepted FROM events",
)
def landing_accept_reject(spark, folder):
    path = scratch(spark, "bodies")
    _bodies(spark, folder).write.text(path)
    accepted, rejected = landing.accept_bodies(landing.read_bodies(spark, path), "body", EVENT)
    return _verdicts(accepted, rejected)


@query(
    "body_elements",
    """SELECT event_id // 5 AS body, event_id, true AS accepted FROM events WHERE event_id % 5 <> 2
       UNION ALL SELECT event_id // 5, event_id, false FROM events WHERE event_id % 5 = 2""",
)
def body_elements(spark, folder):
    """Bodies of up to five events each, pretty-printed arrays and objects in a row, of which one element has an
    id that is no number."""
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id")
    number = F.when(F.col("event_id") % 5 == 2, F.concat(F.lit('"no '), "event_id", F.lit('"')))
    number = F.coalesce(number, F.col("event_id").cast("string"))
    element = F.concat(
        F.lit('{\n  "event_id": '), number, F.lit(',\n  "more": '), F.to_json(F.struct("event_type", "user_id")), F.lit("\n}")
    )
    made = events.groupBy(F.floor(F.col("event_id") / 5).alias("body_id")).agg(F.collect_list(element).alias("parts"))
    array = F.concat(F.lit("[\n"), F.array_join("parts", ",\n"), F.lit("\n]\n"))
    body = F.when(F.col("body_id") % 2 == 0, array).otherwise(F.array_join("parts", "\n"))
    bodies = made.select("body_id", body.alias("text"))
    shape = StructType.fromDDL("event_id long NOT NULL")
    accepted, rejected = landing.accept_elements(bodies, "body_id", "text", shape)
    lost = F.regexp_extract("body", r'"event_id": "no (\d+)"', 1).cast("long")
    return accepted.select(F.col("body_id").alias("body"), "event_id", F.lit(True).alias("accepted")).unionByName(
        rejected.select(F.col("body_id").alias("body"), lost.alias("event_id"), F.lit(False).alias("accepted"))
    )


def _verdicts(accepted, rejected):
    """Every record by its id, and whether it was accepted; a reject's id is read off its text."""
    number = F.regexp_extract("body", r'"event_id":(\d+)', 1).cast("long")
    return accepted.select("event_id", F.lit(True).alias("accepted")).unionByName(
        rejected.select(number.alias("event_id"), F.lit(False).alias("accepted"))
    )


_DAMAGED = "SELECT event_id, event_id % 13 <> 0 AS accepted FROM events"


def _land_damaged(spark, folder):
    """Events of which every 13th is cut short in the middle of its file: one per line, spread over lines
    with objects inside that begin lines of their own, and in arrays on one line."""
    events = table(spark, folder, "events")
    path = scratch(spark, "damaged")
    inner = F.array(F.struct(F.lit(-1).alias("event_id")), F.struct(F.lit(-2).alias("event_id")))
    nested = F.to_json(F.struct("event_id", inner.alias("parts"), "user_id", "event_type"))
    body = codec.encode(EVENT.names)
    # A cut behind a comma leaves no trace but that an object cannot follow there.
    behind_comma = F.regexp_extract(body, r'^\{"event_id":\d+,', 0)
    layouts = (
        ("lines", body, body.substr(F.lit(1), F.length(body) - 4), "\n"),
        ("nested", F.replace(nested, F.lit("{"), F.lit("\n{")), F.replace(nested.substr(F.lit(1), F.length(nested) - 4), F.lit("{"), F.lit("\n{")), "\n"),
        ("array", body, behind_comma, ","),
    )
    for n, (name, whole, short, between) in enumerate(layouts):
        text = F.when(F.col("event_id") % 13 == 0, short).otherwise(whole)
        rows = events.where(F.coalesce(F.col("event_id") % 3, F.lit(0)) == n)
        rows.select(text).write.option("lineSep", between).text(f"{path}/{name}")
    return f"{path}/*"


@query("json_framing_damaged", _DAMAGED)
def json_framing_damaged(spark, folder):
    return _verdicts(*landing.ingest_json_checked(spark, _land_damaged(spark, folder), EVENT))


@query("dir_json_ingest_damaged", _DAMAGED)
def dir_json_ingest_damaged(spark, folder):
    """The same as a stream with an outlet for rejects."""
    out = topic_for(spark, spark.createDataFrame([], EVENT), "accepted")
    dead = topic_for(
        spark, spark.createDataFrame([], "path string, position long, body string, reason string"), "rejected"
    )
    landing.ingest_json_stream(
        spark, _land_damaged(spark, folder), EVENT,
        lambda records, batch_id: out.write_batch(records, "ingress", batch_id),
        scratch(spark, "ingress"), max_files_per_trigger=4,
        rejects=lambda frame, batch_id: dead.write_batch(frame, "ingress", batch_id),
    ).awaitTermination()
    return _verdicts(out.read(spark), dead.read(spark))


def _land(spark, folder):
    """Events as files of three layouts: one per line, in a row on one line, and spread
    over several lines inside strings and braces that must not confuse the framing."""
    events = table(spark, folder, "events")
    path = scratch(spark, "landed")
    body = codec.encode(EVENT.names)
    note = F.to_json(
        F.struct(*EVENT.names, F.lit('} "{" \\').alias("note"), F.struct("value").alias("inner"))
    )
    spread = F.regexp_replace(note, r',"', ',\n"')
    # Exhaustive: types of other names, and none, are spread as well.
    layout = (
        F.when(F.col("event_type").isin("view", "click"), "lines")
        .when(F.col("event_type").isin("error", "signup"), "row")
        .otherwise("spread")
    )
    for name, column, between in (("lines", body, "\n"), ("row", body, " "), ("spread", spread, ",\n")):
        events.where(layout == name).select(column).write.option("lineSep", between).text(f"{path}/{name}")
    return path


@query("json_framing", _TRIPLE)
def json_framing(spark, folder):
    return landing.ingest_json(spark, f"{_land(spark, folder)}/*", EVENT)


@query("dir_json_ingest", _TRIPLE)
def dir_json_ingest(spark, folder):
    path = _land(spark, folder)
    out = topic_for(spark, spark.createDataFrame([], EVENT), "ingested", key="user_id")
    landing.ingest_json_stream(
        spark, f"{path}/*", EVENT,
        lambda records, batch_id: out.write_batch(records, "ingress", batch_id),
        scratch(spark, "ingress"), max_files_per_trigger=4,
    ).awaitTermination()
    return out.read(spark)


@query("fingerprint", "SELECT doc_id, base64(unhex(sha256(text))) AS fingerprint FROM documents")
def fingerprint(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", scalars.fingerprint(F.col("text")).alias("fingerprint"))


def _label_sql(text: str) -> str:
    folded = f"replace(replace(lower(strip_accents({text})), '_', '-'), '.', '-')"
    return f"regexp_replace({folded}, '[^-a-z0-9]', '', 'g')"


def _trim_sql(label: str) -> str:
    return f"regexp_replace(regexp_replace({label}, '^-', ''), '-$', '')"


@query(
    "sanitize_label",
    f"SELECT doc_id, {_trim_sql('left(' + _label_sql('text') + ', 63)')} AS label FROM documents",
)
def sanitize_label(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", scalars.dns_label(F.col("text")).alias("label"))


@query(
    "sanitize_subdomain",
    f"""SELECT page_id, regexp_replace(left(array_to_string(list_transform(
            string_split(rtrim(url, '.'), '.'), lambda x: {_trim_sql(_label_sql('x'))}), '.'), 253),
            '[.]$', '') AS subdomain FROM pages""",
)
def sanitize_subdomain(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", scalars.dns_subdomain(F.col("url")).alias("subdomain"))


@query(
    "name_checks",
    r"""SELECT p_partkey,
        regexp_full_match(replace(p_name, ' ', '-'), '[a-z0-9]([-a-z0-9]*[a-z0-9])?') AS label_ok,
        regexp_full_match(p_brand, '[a-zA-Z0-9._\-]+') AND length(p_brand) <= 249 AS topic_ok,
        regexp_full_match(replace(p_name, ' ', '.'), '([\p{L}_$][\p{L}\p{N}_$]*\.)*[\p{L}_$][\p{L}\p{N}_$]*') AS class_ok,
        len(list_filter(string_split(replace(p_name, ' ', '.'), '.'), lambda x: x <> '')) >= 2 AS path_ok,
        regexp_full_match(p_type, '[a-zA-Z]+(-[a-zA-Z\-0-9]+)*') AS key_ok
        FROM part""",
)
def name_checks(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey",
        scalars.is_dns_label(F.translate(name, " ", "-")).alias("label_ok"),
        scalars.is_topic_name(F.col("p_brand")).alias("topic_ok"),
        scalars.is_class_name(F.translate(name, " ", ".")).alias("class_ok"),
        scalars.is_port_path(F.translate(name, " ", ".")).alias("path_ok"),
        scalars.is_config_key(F.col("p_type")).alias("key_ok"),
    )


@query(
    "uuid_check",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN left(h, 8) || '-' || h[9:12] || '-' || h[13:16]
              || '-' || h[17:20] || '-' || h[21:32] END AS id
       FROM (SELECT *, md5(c_name) AS h FROM customer) c""",
)
def uuid_check(spark, folder):
    """Customer digests written as UUIDs, upper case; overdrawn customers keep bare hex."""
    digest = F.upper(F.md5("c_name"))
    parts = [F.substring(digest, *at) for at in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    text = F.when(F.col("c_acctbal") >= 0, F.concat_ws("-", *parts)).otherwise(digest)
    return table(spark, folder, "customer").select(
        "c_custkey", scalars.uuid_or_null(text).alias("id")
    )


@query(
    "regex_check",
    """SELECT l_orderkey, l_linenumber, clock,
              regexp_full_match(clock, '(0[0-9]|1[0-9]|2[0-3]|[0-9]):[0-5][0-9]') AS ok
       FROM (SELECT *, CAST(l_quantity AS INTEGER) || ':' || lpad(l_linenumber::VARCHAR, 2, '0') AS clock
             FROM lineitem) l""",
)
def regex_check(spark, folder):
    minute = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    clock = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":"), minute)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", clock.alias("clock"),
        scalars.matches(clock, scalars.TIME_OF_DAY).alias("ok"),
    )


@query(
    "epoch_millis",
    "SELECT event_id, epoch_us(ts) // 1000 AS millis, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM events",
)
def epoch_millis(spark, folder):
    millis = scalars.epoch_millis(F.col("ts"))
    return table(spark, folder, "events").select(
        "event_id", millis.alias("millis"),
        scalars.instant(millis).cast("timestamp_ntz").alias("at"),
    )


@query(
    "parse_duration",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag
                WHEN 'A' THEN CAST(l_quantity AS BIGINT) * 60000000000
                WHEN 'N' THEN CAST(l_quantity AS BIGINT) * 1000000
                WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) * 3600000000000 END
              END AS nanos FROM lineitem""",
)
def parse_duration(spark, folder):
    """Quantities as durations: minutes, bare numbers (milliseconds), hours, or nonsense."""
    number = F.col("l_quantity").cast("long").cast("string")
    unit = (
        F.when(F.col("l_returnflag") == "A", " minutes")
        .when(F.col("l_returnflag") == "N", "")
        .when(F.col("l_linestatus") == "F", "h")
        .otherwise("lightyears")
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        scalars.duration_nanos(F.concat(number, unit)).alias("nanos"),
    )


@query(
    "parse_memory_size",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag
                WHEN 'A' THEN CAST(l_quantity AS BIGINT) * 1024
                WHEN 'N' THEN CAST(l_quantity AS BIGINT) * 1000000
                WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) * 1099511627776 END
              END AS bytes FROM lineitem""",
)
def parse_memory_size(spark, folder):
    number = F.col("l_quantity").cast("long").cast("string")
    unit = (
        F.when(F.col("l_returnflag") == "A", "k")
        .when(F.col("l_returnflag") == "N", " MB")
        .when(F.col("l_linestatus") == "F", "TiB")
        .otherwise("XB")
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        scalars.memory_bytes(F.concat(number, unit)).cast("long").alias("bytes"),
    )
