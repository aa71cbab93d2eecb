"""JSON-lines captures, the `events` test table, and the normalised event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CAPTURE_SCHEMA, EVENT_KINDS


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines as columns with `seq`, their order. A malformed line fails the read; blank lines are skipped."""
    raw = _texts(spark.read.schema(CAPTURE_SCHEMA).option("mode", "FAILFAST").json(path))
    return raw.withColumn("seq", F.monotonically_increasing_id())


def stream_capture(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream over the files of a folder; `seq` is the event time in this case."""
    raw = _texts(spark.readStream.schema(CAPTURE_SCHEMA).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(folder))
    return raw.withColumn("seq", event_ms(F.col("epoch"), F.col("timestamp")))


def event_ms(epoch: Column, timestamp: Column) -> Column:
    """The numeric epoch, cut to whole milliseconds, or else the ISO-8601 time; an error where there is neither."""
    given = F.coalesce(epoch.cast("long"), F.unix_millis(F.try_to_timestamp(timestamp)))
    return F.coalesce(given, F.raise_error(F.lit("an event has neither epoch nor timestamp")).cast("long"))


def _kind(eventid: Column, field: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in EVENT_KINDS.items() for x in (k, v[field]))), eventid)


def _texts(raw: DataFrame) -> DataFrame:
    """Source and user as text; null where they are nested JSON values. A text that only looks like one stays."""
    scalar = lambda c: F.when(~F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)"), F.variant_get(c, "$", "string"))
    return raw.withColumns({c: scalar(c) for c in ("src_ip", "username")})


def present(text: Column) -> Column:
    """Null where a text is null or empty."""
    return F.when(text != "", text)


def normalize(raw: DataFrame) -> DataFrame:
    """Canonical events; kinds that aren't listed are dropped before their time is looked at."""
    kept = raw.where(F.col("eventid").isin(*EVENT_KINDS))
    ms = event_ms(F.col("epoch"), F.col("timestamp"))
    return kept.select("seq", ms.alias("ts_ms"), present(F.col("src_ip")).alias("source"), present(F.col("username")).alias("actor"), _kind(F.col("eventid"), 0).alias("action"), _kind(F.col("eventid"), 1).alias("outcome"))


def from_events(table: DataFrame) -> DataFrame:
    """The `events` table as canonical events: views are connections, everything else is a login."""
    kind = F.col("event_type")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table.select(
        F.col("event_id").alias("seq"),
        ms.alias("ts_ms"),
        F.col("user_id").alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("actor"),
        F.when(kind == "view", "CONNECT").otherwise("LOGIN").alias("action"),
        F.when(kind.isin("error", "click"), "FAILURE").when(kind.isin("signup", "purchase"), "SUCCESS").otherwise("UNKNOWN").alias("outcome"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
