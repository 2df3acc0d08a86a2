"""Line dedup by winnowing over line hashes. DataFrame functions only.

A line goes if it lies in a run of lines with ``min_words`` words or more that also stands, line by line, at an earlier
position. (Lines without a word don't count; the order of positions is doc_id, null last, then text hash, then line.)
The shortest run that starts at a line and has ``min_words`` words is its *window ahead*, the shortest that ends at it
its *window behind*. The steps are

1. of each window the smallest line hash is selected as its fingerprint (the last one of equal hashes). What a window
   selects depends on its lines alone, so copies of a run select the same lines;
2. selected positions are joined by fingerprint. A window whose fingerprint stands at one position only has no copy,
   and is not looked at again: its lines are neither gathered nor hashed;
3. each joined position is extended both ways, ahead and behind, over all lines of the windows that selected it. Equal
   windows meet through their earliest position, so no pairs of copies are made, however many there are. A repeated run
   is covered, to its first and last line, by its windows ahead and behind;
4. what is not the earliest is deleted, in maximal runs.

Fingerprints of many positions are told apart first and matched without a shuffle by them, so that no task gets all
positions of one. Rows that repeat doc_id and text are one document: neither is the earlier copy. A null text is empty
and stays null; an empty text is one line without words; a very long line is a window by itself. An empty table gives
no rows. Columns of any name pass untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, saved, small, table, temporaries, with_row_key

MIN_WORDS = 50
KEY = ["row_id", "row_hash"]
#: A fingerprint of more positions is matched by a broadcast of such fingerprints, if these are few enough.
HOT_POSITIONS = 1000


def line_hashes(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: key, line number (pos), rank among such lines, words, two hashes."""
    spark = docs.sparkSession
    lines = (
        keyed(docs)
        .select(*KEY, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select(*KEY, "pos", F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.btrim("line", F.lit(" \t\r")).alias("line"))
        .where("words > 0")
        .select(*KEY, "pos", "words", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY)
        .dropDuplicates([*KEY, "pos"])
    )
    in_doc = Window.partitionBy(*KEY).orderBy("pos")
    so_far = F.sum("words").over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("after", so_far).withColumn("rank", F.row_number().over(in_doc) - 1)


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """A row for each window: key, whether it looks ahead, ranks of its first and last line, fingerprint and its rank."""
    in_doc = Window.partitionBy(*KEY)
    frames = {True: in_doc.orderBy("before").rangeBetween(0, min_words - 1), False: in_doc.orderBy("after").rangeBetween(1 - min_words, 0)}
    least = F.struct("h1", (-F.col("rank")).alias("back"))

    def window(ahead: bool):
        over = frames[ahead]
        first, last = (F.col("rank"), F.max("rank").over(over)) if ahead else (F.min("rank").over(over), F.col("rank"))
        return F.struct(F.lit(ahead).alias("ahead"), first.alias("first"), last.alias("last"), F.sum("words").over(over).alias("total"), F.min(least).over(over).alias("least"))

    placed = lines.withColumn("before", F.col("after") - F.col("words")).select(*KEY, window(True).alias("x"), window(False).alias("y"))
    return (
        placed.select(*KEY, F.explode(F.array("x", "y")).alias("w"))
        .where(F.col("w.total") >= min_words)
        .select(*KEY, "w.ahead", "w.first", "w.last", F.col("w.least.h1").alias("mark"), (-F.col("w.least.back")).alias("mark_rank"))
    )


def joined_windows(windows: DataFrame) -> DataFrame:
    """The windows (saved) whose fingerprint stands at several positions."""
    positions = windows.groupBy("mark", *KEY, "mark_rank").agg(F.lit(1).alias("one")).groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    positions = saved(positions, "fingerprint-positions")
    hot = small(positions.where(F.col("n") > HOT_POSITIONS).select("mark"), 24)
    rest = small(positions.where(F.col("n") <= HOT_POSITIONS).select("mark"), 24)
    return windows.join(hot, "mark", "left_semi").unionByName(windows.join(hot, "mark", "left_anti").join(rest, "mark", "left_semi")).drop("mark", "mark_rank")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key and runs (array of struct(first, last), apart and in order) for the documents in which lines go."""
    lines = saved(line_hashes(docs), "line-hashes")
    windows = saved(fingerprints(lines, min_words), "line-windows")
    asked = joined_windows(windows).groupBy(*KEY).agg(F.collect_list(F.struct("ahead", "first", "last")).alias("windows"))
    whole = lines.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "h1", "h2"))).alias("l"))
    each = whole.join(asked, KEY).select(*KEY, F.col("l.pos").alias("p"), F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2"), F.explode("windows").alias("w"))
    part = lambda c: F.xxhash64(F.slice(c, F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + 1))
    place = lambda c: F.element_at("p", F.col(f"w.{c}") + 1)
    extended = saved(each.select(*KEY, place("first").alias("pos"), place("last").alias("end"), "w.ahead", part("h1").alias("g1"), part("h2").alias("g2")), "extended-windows")
    equal = ["ahead", "g1", "g2"]
    earliest = extended.groupBy(*equal).agg(F.min(F.struct(*KEY, "pos")).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    later = extended.join(earliest, equal).where(F.struct(*KEY, "pos") != F.col("earliest")).select(*KEY, "pos", "end")
    by_pos = Window.partitionBy(*KEY).orderBy("pos", "end")
    reach = F.max("end").over(by_pos.rowsBetween(Window.unboundedPreceding, -1))
    return (
        later.withColumn("opens", F.when(F.col("pos") <= reach + 1, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "run")
        .agg(F.min("pos").alias("first"), F.max("end").alias("last"))
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )


#: The lines between the runs, in order.
_KEPT = """flatten(transform(sequence(0, size(__runs)), i -> slice(__lines,
    if(i = 0, 0, __runs[i - 1].last + 1) + 1,
    if(i = size(__runs), size(__lines), __runs[i].first) - if(i = 0, 0, __runs[i - 1].last + 1))))"""


def _cut(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with __lines, __runs (empty if nothing goes) and __kept."""
    with temporaries(docs.sparkSession) as kept:
        runs = saved(repeated_runs(docs, min_words), "line-runs")
        kept.append(runs)
    runs = small(runs, 64, 24 * F.size("runs")).withColumnsRenamed({"row_id": "__row_id", "row_hash": "__row_hash", "runs": "__runs"})
    nothing = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return (
        with_row_key(docs)
        .join(runs, ["__row_id", "__row_hash"], "left")
        .withColumn("__runs", F.coalesce("__runs", nothing))
        .withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
        .withColumn("__kept", F.expr(f"if(size(__runs) = 0, __lines, {_KEPT})"))
    )


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, every row and column, with the later copies of repeated runs cut out of text (and n_chars set to match)."""
    cut = _cut(docs, min_words)
    text = F.when(F.size("__runs") == 0, F.col("text")).otherwise(F.array_join("__kept", "\n"))
    changed = {"text": text, "n_chars": F.when(F.size("__runs") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (first-last,...; from 0), kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = _cut(docs)
    return cut.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_deleted"),
        F.expr("array_join(transform(__runs, r -> concat(r.first, '-', r.last)), ',')").alias("deleted"),
        F.sha2(F.array_join("__kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


#: Brute force: every shortest run of 50 words from a line on or up to a line, by its whole text, without fingerprints or hashes.
_RUNS_SQL = r"""
lines as (
  select doc_id, pos - 1 as pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from docs)),
placed as (
  select *, sum(words) over (partition by doc_id order by pos rows unbounded preceding) - words as before from lines where words > 0),
windows as (
  select true as way, doc_id, pos, max(pos) over ahead as last, sum(words) over ahead as total, list(trim(line, ' ' || chr(9) || chr(13))) over ahead as ls
  from placed window ahead as (partition by doc_id order by before range between current row and 49 following)
  union all
  select false, doc_id, min(pos) over behind, pos, sum(words) over behind, list(trim(line, ' ' || chr(9) || chr(13))) over behind
  from placed window behind as (partition by doc_id order by before + words range between 49 preceding and current row)),
later as (
  select doc_id, pos, last from (
    select *, row_number() over (partition by way, ls order by doc_id, pos) as copy from windows where total >= 50) where copy > 1),
gone as (
  select distinct l.doc_id, p.pos from later l join
    (select doc_id, pos - 1 as pos from (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from docs)) p
    on p.doc_id = l.doc_id and p.pos between l.pos and l.last),
islands as (
  select doc_id, min(pos) as first, max(pos) as last from (
    select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as island from gone) group by doc_id, island),
runs as (select doc_id, string_agg(first || '-' || last, ',' order by first) as deleted from islands group by doc_id),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text, count(*) as n from lines l anti join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id)
"""

ORACLE = {
    "op1_line_dedup": f"""
with docs as (select doc_id, text from documents), {_RUNS_SQL}
select d.doc_id, cast(len(string_split(coalesce(d.text, ''), chr(10))) as bigint) as n_lines,
       cast(len(string_split(coalesce(d.text, ''), chr(10))) - coalesce(k.n, 0) as bigint) as n_deleted,
       coalesce(r.deleted, '') as deleted, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join runs r using (doc_id) left join kept k using (doc_id)
"""
}
