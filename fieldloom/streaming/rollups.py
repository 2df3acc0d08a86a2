"""Time-window roll-ups of request and client logs; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windowed(logs: DataFrame, window: str, slide: str | None, watermark: str | None) -> tuple[DataFrame, Column]:
    logs = logs.withWatermark("ts", watermark) if watermark else logs
    return logs, F.window("ts", window, slide) if slide else F.window("ts", window)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("start"), *[c for c in df.columns if c != "window"])


def request_rate(logs: DataFrame, key: str, seconds: int = 60, watermark: str | None = None) -> DataFrame:
    """start, key, rate: rows a second of each window."""
    logs, w = _windowed(logs, f"{seconds} seconds", None, watermark)
    return _flat(logs.groupBy(w, key).agg((F.count("*") / seconds).alias("rate")))


def duration_percentile(logs: DataFrame, key: str, value: str, p: float = 0.95, window: str = "5 minutes", slide: str | None = "1 minute", exact: bool = True, watermark: str | None = None) -> DataFrame:
    """start, key, percentile; approximate where exact is off (streams and very large groups)."""
    logs, w = _windowed(logs.where(F.col(value).isNotNull()), window, slide, watermark)
    f = F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, p)
    return _flat(logs.groupBy(w, key).agg(f.alias("percentile")))


def sketched_percentile(logs: DataFrame, key: str, value: str, p: float = 0.95, window: str = "5 minutes", slide: str | None = "1 minute", k: int = 200, watermark: str | None = None) -> DataFrame:
    """start, key, n, percentile: the value at rank p, by mergeable sketches. Each row goes into the sketch of one pane, as
    long as the slide; sketches, not rows, are copied into the windows that hold the pane and merged there. A group
    holds k values or so whatever its rows, and the rank is wrong by about 1.7 % at k = 200 (not at all up to k rows)."""
    logs, pane = _windowed(logs.where(F.col(value).isNotNull()), slide or window, None, watermark)
    panes = logs.groupBy(pane.alias("pane"), key).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count("*").alias("n"))
    whole = F.window(F.window_time("pane"), window, slide) if slide else F.window(F.window_time("pane"), window)
    merged = panes.groupBy(whole.alias("window"), key).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))
    return _flat(merged.withColumn("percentile", F.kll_sketch_get_quantile_double("sketch", F.lit(p))).drop("sketch"))


def error_ratio(logs: DataFrame, bad: Column, window: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """start, ratio of bad rows."""
    logs, w = _windowed(logs, window, None, watermark)
    return _flat(logs.groupBy(w).agg((F.count_if(bad) / F.greatest(F.count("*"), F.lit(1e-9))).alias("ratio")))


def field_counts(logs: DataFrame, text: str, path: str, window: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """start, value, n of one field of JSON log lines; lines that don't parse or lack it are left out."""
    logs, w = _windowed(logs.withColumn("value", F.get_json_object(text, path)), window, None, watermark)
    return _flat(logs.where("trim(value) != ''").groupBy(w, "value").agg(F.count("*").alias("n")))


def outcome_ratio(logs: DataFrame, text: str, pattern: str, hit: str, window: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """start, outcomes, ratio: lines in which the pattern captures something, and the share that captures hit."""
    logs, w = _windowed(logs.withColumn("outcome", F.regexp_extract(text, pattern, 1)), window, None, watermark)
    return _flat(logs.where("outcome != ''").groupBy(w).agg(F.count("*").alias("outcomes"), (F.count_if(F.col("outcome") == hit) / F.count("*")).alias("ratio")))
