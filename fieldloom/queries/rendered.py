"""Documents rendered from the relational tables, so that SQL can compute every answer from the flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document an order: id, status, total, priority (every third), items with sku, qty, flag (odd lines)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("qty"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")).alias("flag"))).alias("items")
    )
    body = F.struct(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"),
        "items",
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("json").alias("format"), F.to_json(body).alias("content"))


def order_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML document an order: id as an attribute (even keys) or an element, price, note (empty, nil or mixed)."""
    key = F.col("o_orderkey")
    text = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    note = (
        F.when(key % 5 == 0, F.lit("<note/>"))
        .when(key % 5 == 1, F.lit('<note xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"/>'))
        .when(key % 5 == 2, F.concat(F.lit("<note>pay <b>"), F.col("o_orderstatus"), F.lit("</b> now</note>")))
        .otherwise(F.lit(""))
    )
    content = F.concat(
        F.when(key % 2 == 0, F.concat(F.lit('<order id="'), key.cast("string"), F.lit('">'))).otherwise(F.concat(F.lit("<order>"), text("id", key.cast("string")))),
        text("day", F.date_format("o_orderdate", "yyyy-MM-dd")),
        text("price", F.when(key % 7 == 0, F.concat(F.lit("<amount>"), (F.col("o_custkey") % 10).cast("string"), F.lit(".5</amount>"))).otherwise((F.col("o_custkey") % 10).cast("string"))),
        note,
        F.lit("</order>"),
    )
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit("xml").alias("format"), content.alias("content"))


def customer_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One YAML document a customer, under the single root key customer; every fourth has a list of its nation."""
    content = F.concat(
        F.lit("customer:\n  key: "), F.col("c_custkey").cast("string"),
        F.lit("\n  name: '"), F.col("c_name"), F.lit("'\n  active: "), F.when(F.col("c_nationkey") % 2 == 0, "true").otherwise("false"),
        F.lit("\n  since: 2024-0"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("-01\n  note: null\n"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("  tags: ["), F.col("c_nationkey").cast("string"), F.lit(", "), F.col("c_mktsegment"), F.lit("]\n"))).otherwise(""),
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("yaml").alias("format"), content.alias("content"))


def conversation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a conversation: its turns in order, with role and, for users, the text's length."""
    turn = F.struct("turn", "role", F.when(F.col("role") == "user", F.length("text")).alias("chars"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.lit("json").alias("format"), F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("content"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("event_type").alias("type"), "value", F.from_json("props", "k int").alias("props")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit("json").alias("format"), body.alias("content"))


def party_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed fields: a synonym (by customer key) in one element, a typo and an abbreviation in another."""
    key = F.col("o_custkey")
    party = F.when(key % 3 == 0, "customer").when(key % 3 == 1, "client").otherwise("buyer")
    other = F.when(key % 6 == 0, "tarfif").when(key % 6 == 1, "chg").when(key % 6 == 2, "charge").otherwise("tariff")
    element = lambda name, value: F.concat(F.lit("<"), name, F.lit(">"), value, F.lit("</"), name, F.lit(">"))
    content = F.concat(F.lit("<order><who>"), element(party, key.cast("string")), F.lit("</who><pay>"), element(other, (key % 100).cast("string")), F.lit("</pay></order>"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("xml").alias("format"), content.alias("content"))
