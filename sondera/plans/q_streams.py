"""Queries that run a real stream over a table, file by file, and end with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import stateful
from .registry import Registry
from .views import table

registry = Registry()
FILES = 4


def streamed(spark, df, name, make):
    """The last state of a stream of df, which comes in FILES files, one a trigger."""
    with scratch.folder(spark, name) as path:
        df.repartition(FILES).write.parquet(f"{path}/in")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        return scratch.kept(stateful.run_to_table(spark, source, make, path).select("key", F.explode("items").alias("item")), f"{name}-read")


@registry("stream_user_quota", "SELECT user_id::VARCHAR AS key, event_id AS item FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value BETWEEN 2 AND 120) WHERE r <= 5")
def quota(spark, sf):
    df = table(spark, sf, "events").where("value between 2 and 120").select("user_id", "event_id")
    return streamed(spark, df, "quota", lambda s: stateful.first_rows(s, "user_id", "event_id", 5))


@registry("stream_reservoir", "SELECT event_type AS key, event_id AS item FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('0|' || event_type || '|' || event_id), event_id) AS r FROM events) WHERE r <= 50")
def reservoir(spark, sf):
    return streamed(spark, table(spark, sf, "events").select("event_type", "event_id"), "reservoir", lambda s: stateful.reservoir(s, "event_type", "event_id", 50))
