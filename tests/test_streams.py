"""Streams that are stopped, fail and go on; sketches of percentiles."""

import datetime
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fieldloom.sources import documents
from fieldloom.streaming import jobs, rollups

CHANGES = "seq long, kind string, resource_id long, deleted boolean"


def appended(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_failing_sink_loses_and_repeats_nothing(spark, tmp_path):
    """The sink fails at each hand-over in turn, before or after it took the changes."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/state"
    rows = [(i, "abc"[i % 3], i // 7, i % 2 == 0) for i in range(53)]
    appended(spark, source, rows[:30], CHANGES)
    stream = lambda: spark.readStream.schema(CHANGES).parquet(source)
    got, failing = [], {"at": set()}

    def sink(batch, name):
        taken = [tuple(r) for r in batch.select("seq", "kind", "resource_id", "deleted").collect()]
        if name not in failing["at"]:
            failing["at"].add(name)
            raise ConnectionError(name)
        got.append((name, taken))

    def drain():
        for _ in range(50):
            try:
                return jobs.dispatched(stream(), sink, folder, limit=10)
            except StreamingQueryException:
                continue
        raise AssertionError("it never ends")

    drain()
    appended(spark, source, rows[30:], CHANGES)
    drain()
    assert [n for n, _ in got] == sorted({n for n, _ in got}) and all(len(t) <= 10 for _, t in got)

    def once(part):
        first = {}
        for r in part:
            first.setdefault(r[1:], r)
        return sorted(first.values())

    assert [r for _, t in got for r in t] == once(rows[:30]) + once(rows[30:])
    assert len(failing["at"]) == len(got)
    jobs.dispatched(stream(), sink, folder, limit=10)  # nothing new
    assert len(got) == len(failing["at"])


def test_identical_changes_across_batches(spark, tmp_path):
    schema = CHANGES + ", at timestamp"
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "a", i % 4, False, start + datetime.timedelta(minutes=i)) for i in range(12)]
    for k in range(0, 12, 3):
        appended(spark, f"{tmp_path}/in", rows[k : k + 3], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    jobs.dispatched(stream, lambda batch, name: got.extend(r.resource_id for r in batch.collect()), f"{tmp_path}/state", within="1 hour")
    assert sorted(got) == [0, 1, 2, 3]


def test_written_batches_are_joined(spark, tmp_path):
    """After so many batches one table is left, and results stay those of one run over all rows."""
    schema, folder, rows = "doc_id long, format string, content string", f"{tmp_path}/sums", []
    key = lambda df: sorted(map(str, df.collect()))
    for i in range(7):
        more = [(10 * i + n, "json", f'{{"a": {n}, "b{i % 3}": "x"}}') for n in range(3)]
        rows += more
        appended(spark, f"{tmp_path}/in", more, schema)
        stream = documents.summaries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        found = jobs.latest(stream, jobs.SUMMARY_KEYS, folder, compact_after=3)
        assert key(found) == key(documents.summaries(spark.createDataFrame(rows, schema)))
        assert len([n for n in os.listdir(f"{folder}/out") if n.startswith("batch=")]) < 3
    assert len(os.listdir(f"{folder}/base")) == 1


def test_batches_write_what_they_change(spark, tmp_path):
    schema, folder = "doc_id long, format string, content string", f"{tmp_path}/sums"
    appended(spark, f"{tmp_path}/in", [(i, "json", f'{{"only{i}": 1}}') for i in range(200)], schema)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    many = jobs.incremental_summaries(stream(), folder).count()
    appended(spark, f"{tmp_path}/in", [(999, "json", '{"only7": 2}')], schema)
    assert jobs.incremental_summaries(stream(), folder).count() == many
    assert spark.read.parquet(f"{folder}/out/batch=1").count() < 15 < many


@pytest.mark.parametrize("slide", [None, "1 minute"])
def test_rank_of_sketched_percentiles(spark, slide):
    r = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=r.randrange(900)), r.choice("ab"), r.lognormvariate(0, 2)) for _ in range(40_000)]
    logs = spark.createDataFrame(rows, "ts timestamp, key string, value double")
    found = rollups.sketched_percentile(logs, "key", "value", 0.9, "5 minutes", slide).collect()
    exact = {(x.start, x.key): x.percentile for x in rollups.duration_percentile(logs, "key", "value", 0.9, "5 minutes", slide).collect()}
    assert {(x.start, x.key) for x in found} == exact.keys()
    for x in found:
        begin = x.start
        held = sorted(v for t, k, v in rows if k == x.key and begin <= t < begin + datetime.timedelta(minutes=5))
        assert x.n == len(held)
        at = sum(v <= x.percentile for v in held) / len(held)
        assert abs(at - 0.9) < 0.035


def test_sketches_of_a_stream(spark, tmp_path):
    """Windows that the watermark has closed give what the batch gives."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=20 * i), "ab"[i % 2], float(i * i % 97)) for i in range(300)]
    schema = "ts timestamp, key string, value double"
    for k in (0, 100, 200):
        appended(spark, f"{tmp_path}/in", rows[k : k + 100], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = rollups.sketched_percentile(stream, "key", "value", watermark="2 minutes")
    query = out.writeStream.outputMode("append").format("memory").queryName("sketches").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("sketches").collect()}
    batch = {tuple(r) for r in rollups.sketched_percentile(spark.createDataFrame(rows, schema), "key", "value").collect()}
    assert got <= batch and len(got) > len(batch) / 2
