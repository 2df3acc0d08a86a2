"""Benchmark decontamination: a prefix-filtered set join of documents with item windows. DataFrame functions only.

A window is ``window`` consecutive words of an item (a shorter item is one window). A document contains a window
when the words stand there in order. Containment means that every word of the window is in the document, so any of
its words are a necessary prefix; the ``PREFIX`` rarest are taken. The steps are

1. count how often each benchmark word occurs in all documents, which orders the words by rarity;
2. index each window under its rarest words and their places in the window;
3. join the words of all documents with the index; length and position bounds drop windows that would reach over
   either end of the document, and those whose prefix words do not all stand in their places;
4. compare the remaining candidates with the document word by word, and merge their intervals.

Nulls: a null text has no words; a null item text gives no window; a window of an item with null id marks words but
counts for no item. Repeated rows each get the (same) result; an empty table gives no rows or no hits. Very long texts are searched whole.
Words that are equally rare are ordered bytewise. Columns of any name pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keyed, saved, small, table, temporaries, without_rows

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, PREFIX = 13, 2
#: A document is contaminated if a 20th of its words or more are hit.
SHARE = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """One row for each window and item: item_id, words (array), length, span (the words as one string) and its hash."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("w"))
    length = F.least(F.size("w"), F.lit(window))
    return (
        words.where(F.size("w") > 0)
        .select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
        .select("item_id", F.expr("slice(w, at + 1, length)").alias("words"), "length")
        .withColumn("span", F.array_join("words", " "))
        .withColumn("span_id", F.xxhash64("span"))
    )


def rarest_words(docs: DataFrame, windows: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The prefix index: word, place, length, span_id, need; for each window a row for each of its rarest words.

    need is the number of these rows. A window with a word that no document has is in no document and left out.
    """
    tokens = windows.dropDuplicates(["span"]).select("span_id", "length", F.posexplode("words").alias("place", "word"))
    vocabulary = small(saved(tokens.select("word").distinct(), "vocabulary"), 48, F.octet_length("word"))
    counted = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    counts = small(saved(counted, "word-counts"), 56, F.octet_length("word"))
    ordered = tokens.join(counts, "word", "left").groupBy("span_id", "length").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place"))).alias("by_rarity"))
    return (
        ordered.where("by_rarity[0].n > 0")
        .select("span_id", "length", F.least(F.size("by_rarity"), F.lit(prefix)).alias("need"), F.explode(F.slice("by_rarity", 1, prefix)).alias("t"))
        .select("t.word", "t.place", "length", "span_id", "need")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """row_id, row_hash, doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row a document row."""
    rows = keyed(docs, F.col("doc_id"))
    windows = saved(item_windows(benchmark, window), "item-windows")
    index = small(saved(rarest_words(rows, windows), "prefix-index"), 96, F.octet_length("word"))
    placed = rows.select("row_id", "row_hash", words_of(F.col("text")).alias("words"))
    spans = small(saved(windows.dropDuplicates(["span"]).select("span_id", "length", "span"), "spans"), 64, F.octet_length("span"))
    found = (
        placed.select("row_id", "row_hash", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
        .join(index, "word")
        .withColumn("start", F.col("pos") - F.col("place"))
        .where("start >= 0 and start + length <= n_words")
        .groupBy("row_id", "row_hash", "start", "span_id", "need")
        .agg(F.count_distinct("place").alias("places"))
        .where("places = need")
        .join(spans, "span_id")
        .groupBy("row_id", "row_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "length", "span"))).alias("candidates"))
    )
    candidates = saved(found, "window-candidates")
    held = F.expr("aggregate(candidates, 0L, (n, c) -> n + 48 + octet_length(c.span))")
    verified = (
        rows.join(small(candidates, 64, held), ["row_id", "row_hash"], "left")
        .withColumn("words", words_of(F.col("text")))
        .select(
            "row_id",
            "row_hash",
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.expr("filter(coalesce(candidates, array()), c -> array_join(slice(words, c.start + 1, c.length), ' ') = c.span)").alias("hits"),
        )
        .select(
            "row_id",
            "row_hash",
            "doc_id",
            "n_words",
            F.expr(
                """aggregate(hits, struct(0 as reach, 0L as n),
                   (a, h) -> struct(greatest(a.reach, h.start + h.length) as reach,
                                    a.n + greatest(0, h.start + h.length - greatest(a.reach, h.start)) as n)).n"""
            ).alias("n_hit"),
            F.expr("array_distinct(transform(hits, h -> h.span))").alias("spans"),
        )
    )
    verified = saved(verified, "window-hits")
    spans_of_items = windows.where("item_id is not null").select("span", "item_id").distinct()
    items = (
        verified.where(F.size("spans") > 0)
        .select("row_id", "row_hash", F.explode("spans").alias("span"))
        .distinct()
        .join(spans_of_items, "span")
        .groupBy("row_id", "row_hash")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return verified.join(items, ["row_id", "row_hash"], "left").select(
        "row_id",
        "row_hash",
        "doc_id",
        "n_words",
        "n_hit",
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    with temporaries(docs.sparkSession) as kept:
        gone = saved(contamination(docs, benchmark, window, share).where("contaminated").select("row_id", "row_hash"), "contaminated")
        kept.append(gone)
    return without_rows(docs, gone)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_id", "row_hash")


ORACLE = {
    "op10_decontamination": r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
b as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
bw as (
  select item_id, least(len(w), 13) as l, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') as span
  from (select item_id, w, unnest(range(0, len(w) - least(len(w), 13) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct l from bw),
dw as (
  select doc_id, i, l, array_to_string(w[i + 1 : i + l], ' ') as span
  from (select doc_id, w, l, unnest(range(0, len(w) - l + 1)) as i from d, lengths where len(w) >= l)),
hits as (select distinct dw.doc_id, dw.i, dw.l, bw.item_id from dw join bw using (span, l)),
marked as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join marked using (doc_id) left join items using (doc_id)
"""
}
