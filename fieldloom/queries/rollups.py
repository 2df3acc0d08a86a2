"""Roll-ups over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import rollups
from .rendered import table


def _events(spark, sf_dir: str):
    return table(spark, sf_dir, "events")


QUERIES = {
    "t1_rate": lambda spark, d: rollups.request_rate(_events(spark, d), "event_type"),
    "t1_rate_5m": lambda spark, d: rollups.request_rate(_events(spark, d), "event_type", 300),
    "t2_p95": lambda spark, d: rollups.duration_percentile(_events(spark, d), "event_type", "value").withColumn("percentile", F.round("percentile", 6)),
    "t2_sketched": lambda spark, d: rollups.sketched_percentile(_events(spark, d), "event_type", "value", k=4096),
    "t6_sketched": lambda spark, d: rollups.sketched_percentile(_events(spark, d), "event_type", "value", 0.75, "15 minutes", None, k=4096),
    "t3_error_ratio": lambda spark, d: rollups.error_ratio(_events(spark, d), F.col("event_type") == "error"),
    "t4_field_counts": lambda spark, d: rollups.field_counts(_events(spark, d).withColumn("line", F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.col("props"))), "line", "$.k", "1 hour"),
    "t5_outcomes": lambda spark, d: rollups.outcome_ratio(_events(spark, d).withColumn("line", F.concat(F.lit("cache="), F.when(F.col("user_id") % 3 == 0, "hit").when(F.col("user_id") % 3 == 1, "miss").otherwise(""), F.lit(" "))), "line", "cache=(\\w+)", "hit"),
    "t6_p75": lambda spark, d: rollups.duration_percentile(_events(spark, d), "event_type", "value", 0.75, "15 minutes", None).withColumn("percentile", F.round("percentile", 6)),
}


def _bucket(size: str) -> str:
    return f"time_bucket(interval '{size}', ts, timestamp '1970-01-01')"


ORACLE = {
    "t1_rate": f"select {_bucket('1 minute')} as start, event_type, count(*) / 60 as rate from events group by all",
    "t1_rate_5m": f"select {_bucket('5 minutes')} as start, event_type, count(*) / 300 as rate from events group by all",
    "t2_p95": f"""
with w as (select unnest(generate_series({_bucket('1 minute')} - interval '4 minutes', {_bucket('1 minute')}, interval '1 minute')) as start, event_type, value from events where value is not null)
select start, event_type, round(quantile_cont(value, 0.95), 6) as percentile from w group by all
""",
    "t2_sketched": f"""
with w as (select unnest(generate_series({_bucket('1 minute')} - interval '4 minutes', {_bucket('1 minute')}, interval '1 minute')) as start, event_type, value from events where value is not null)
select start, event_type, count(*) as n, quantile_disc(value, 0.95) as percentile from w group by all
""",
    "t6_sketched": f"select {_bucket('15 minutes')} as start, event_type, count(*) as n, quantile_disc(value, 0.75) as percentile from events where value is not null group by all",
    "t3_error_ratio": f"select {_bucket('5 minutes')} as start, count(*) filter (event_type = 'error') / count(*) as ratio from events group by all",
    "t4_field_counts": f"select {_bucket('1 hour')} as start, json_extract_string(props, '$.k') as value, count(*) as n from events where event_id % 10 <> 0 and props is not null group by all",
    "t5_outcomes": f"select {_bucket('5 minutes')} as start, count(*) as outcomes, count(*) filter (user_id % 3 = 0) / count(*) as ratio from events where user_id % 3 < 2 group by all",
    "t6_p75": f"select {_bucket('15 minutes')} as start, event_type, round(quantile_cont(value, 0.75), 6) as percentile from events where value is not null group by all",
}
