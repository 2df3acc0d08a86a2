"""Streaming jobs over the events table, drained to the end."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans import space
from ..plans.storage import shared_folder
from ..streaming import jobs, rollups
from .documents import ORACLE as DOCUMENT_SQL
from .rendered import table
from .rollups import ORACLE as ROLLUP_SQL


def _stream(spark, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def st1_fields(spark, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("event_type").alias("type"), "value", F.from_json("props", "k int").alias("props")))
    docs = _stream(spark, sf_dir).select(F.col("event_id").alias("doc_id"), F.lit("json").alias("format"), body.alias("content"))
    f = space.build(jobs.incremental_summaries(docs)).fields
    return f.select(F.array_join("path", "/").alias("path"), "name", "occurrences", "parent_occurrences", "presence_count", "presence_probability")


def st2_feed(spark, sf_dir: str) -> DataFrame:
    changes = _stream(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("user_id").alias("resource_id"), (F.col("event_id") % 2 == 0).alias("deleted"))
    return jobs.compacted_feed(changes)


def st2_dispatch(spark, sf_dir: str) -> DataFrame:
    """Changes of customers, handed over by hundreds. The sink fails at the third hand-over; the next run goes on there."""
    folder = f"{shared_folder(spark)}/dispatch-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    changes = stream.select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("kind"), F.floor(F.col("c_custkey") / 5).alias("resource_id"), (F.col("c_nationkey") % 2 == 0).alias("deleted"))
    failing = {"now": True}

    def sink(given: list[Row], name: str) -> None:
        if failing["now"] and name.endswith("2"):
            raise ConnectionError("the sink is away")
        lines = [json.dumps(r.asDict() | {"part": int(name.rpartition("-")[2])}) for r in given]
        jobs.write_file(spark, f"{folder}/got/{name}.json", "\n".join(lines).encode())

    try:
        jobs.dispatched(changes, sink, folder, rows=True)
    except StreamingQueryException:
        failing["now"] = False
        jobs.dispatched(changes, sink, folder, rows=True)
    got = spark.read.option("recursiveFileLookup", True).schema("kind string, resource_id long, deleted boolean, seq long, part long").json(f"{folder}/got")
    return got.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def st3_rate(spark, sf_dir: str) -> DataFrame:
    logs = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    return jobs.latest(rollups.request_rate(logs, "event_type", watermark="10 minutes"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {"st1_fields": st1_fields, "st2_feed": st2_feed, "st2_dispatch": st2_dispatch, "st3_rate": st3_rate}
ORACLE = {
    "st1_fields": DOCUMENT_SQL["a2_event_fields"],
    "st2_feed": "select event_type as kind, user_id as resource_id, event_id % 2 = 0 as deleted, min(event_id) as seq from events group by all",
    "st2_dispatch": """
with c as (select min(c_custkey) as seq from customer group by c_mktsegment, c_custkey // 5, c_nationkey % 2 = 0), p as (select seq, (row_number() over (order by seq) - 1) // 100 as part from c)
select part, count(*) as n, min(seq) as first, max(seq) as last from p group by part
""",
    "st3_rate": ROLLUP_SQL["t1_rate"],
}
