"""WARC archives: a record for each page, and reading them back with a verified chain of record boundaries.

Writing: Spark's text writer puts the record end (two line ends) after each row, so archives are written by Spark on
any file system. Of pages with equal payloads that with the largest page_id is the response, and the others are
revisit records without a payload that refer to it. Only ids and digests are grouped; pages stay where they are read.

Reading: Spark's text reader cuts a file at each version line, in parallel splits. So each piece begins a *candidate*
record, whose Content-Length names the offset of its successor. A version line inside a payload begins a false
candidate. The chain from offset zero decides: in each chunk of CHUNK candidates the tasks follow the successors to
the first one outside the chunk, pointer jumping (each round doubles the stride) joins the chunks of a file, and only
candidates on the chain are records. A payload that holds version lines is put together from its pieces. All digests
are computed anew and compared; a broken chain or payload is an error.

Nulls: a null html is an empty payload; a null page_id is smaller than any other and stays null (null referred ids
too); a null url gives no target. Rows that repeat page_id and payload are the same page, so all of them are responses
if one is. An empty table gives no archives and no rows. Very long payloads are read block by block. Columns of any name
pass untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, saved, small, table

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
RECORDS_PER_FILE, CHUNK = 20_000, 4096
#: Pages don't tell when they were fetched, so by default archives have a fixed date.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NO_ID = -(1 << 63)


def sha1_base32(data: Column) -> Column:
    """Of 40 hexadecimal digits each five are four base-32 digits."""
    hexed = F.sha1(data)
    digits = []
    for i in range(8):
        bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))
    return pages.select(page_id.alias("id"), F.col("url").alias("url"), html.alias("payload")).withColumn("digest", sha1_base32(F.col("payload").cast("binary")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Archives of the pages under path; date is the WARC-Date of their records."""
    every = _payloads(pages)
    ids = saved(every.where(F.octet_length("payload") >= least_bytes).select("id", "digest"), "page-digests")
    shared = ids.groupBy("digest").agg(F.max("id").alias("first"), F.min("id").alias("last")).where("first != last").select("digest", "first")
    revisits = saved(ids.join(shared, "digest").where("id != first").select("id", "digest", "first").distinct(), "revisits")
    rows = every.join(small(revisits, 80), ["id", "digest"], "left")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c).cast("string"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    again = F.col("first").isNotNull()
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), known("id"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Profile", F.when(again, PROFILE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), known("first"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        line("Content-Length", F.when(again, "0").otherwise(F.octet_length("payload").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(again, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark, path: str) -> DataFrame:
    """What stands between version lines: file, block (start of the split), no (order in it), value."""
    read = spark.read.option("lineSep", VERSION).option("pathGlobFilter", "part-*").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), "value")


def candidates(spark, path: str) -> DataFrame:
    """A row for each piece: its offset, the record that would begin there, and its successor's offset."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: *([^\r\n]*)", 1)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    parsed = (
        _pieces(spark, path)
        .withColumn("bytes", F.octet_length("value").cast("long"))
        .withColumn("head", F.when(F.instr("value", END) > 0, head))
        .withColumn("length", number("regexp_extract(head, '(?:^|\r\n)Content-Length: *([0-9]+)', 1)"))
        .withColumn("body", F.octet_length("head") + F.lit(len(END)))
        .withColumn("whole", F.col("bytes") >= F.col("body") + F.col("length") + len(END))
        .withColumn("payload", F.expr("substring(cast(value as binary), cast(body as int) + 1, cast(length as int))"))
        .select(
            "file",
            "block",
            "no",
            "bytes",
            "body",
            "length",
            "whole",
            number("regexp_extract(head, '(?:^|\r\n)WARC-Record-ID: *<urn:page:(-?[0-9]+)>', 1)").alias("page_id"),
            number("regexp_extract(head, '(?:^|\r\n)WARC-Refers-To: *<urn:page:(-?[0-9]+)>', 1)").alias("refers_to"),
            field("WARC-Type").alias("record_type"),
            field("WARC-Target-URI").alias("url"),
            F.regexp_extract("head", r"(?:^|\r\n)WARC-Payload-Digest: *sha1:([A-Z2-7]+)", 1).alias("said_digest"),
            number("regexp_extract(head, '(?:^|\r\n)X-Payload-Length: *([0-9]+)', 1)").alias("said_bytes"),
            F.when(F.col("whole"), sha1_base32(F.col("payload"))).alias("digest"),
        )
    )
    pieces = saved(parsed, "archive-pieces")
    in_file = Window.partitionBy("file").orderBy("block", "no")
    begins = F.sum(F.col("bytes") + len(VERSION)).over(in_file.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") - 2 * len(VERSION)
    placed = pieces.withColumn("offset", begins).withColumn("rank", F.row_number().over(in_file) - 2)
    # the piece before a file's first version line is no candidate: its offset is negative
    return placed.withColumn("next", F.col("offset") + len(VERSION) + F.col("body") + F.col("length") + len(END)).withColumn("chunk", F.floor(F.col("rank") / CHUNK))


_LINKS = "file string, chunk long, offset long, next long, exit long"


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate first leaves the chunk; -1 if it breaks off inside."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    offsets, nexts = pdf["offset"].to_numpy(), pdf["next"].to_numpy()
    at = np.searchsorted(offsets, nexts)
    out = nexts.copy()
    for i in range(len(offsets) - 1, -1, -1):
        if nexts[i] <= offsets[-1]:
            j = at[i]
            out[i] = out[j] if j > i and offsets[j] == nexts[i] else -1
    return pdf.assign(exit=out)


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one chunk on the chain from its entry."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    offsets, nexts, on = pdf["offset"].to_numpy(), pdf["next"].to_numpy(), pdf["entry"].to_numpy().copy()
    at = np.searchsorted(offsets, nexts)
    for i in range(len(offsets)):
        if on[i] and at[i] < len(offsets) and offsets[at[i]] == nexts[i]:
            on[at[i]] = True
    return pdf.loc[on, ["file", "offset"]]


def chain(found: DataFrame) -> DataFrame:
    """file, offset of the candidates that can be reached from the start of their file."""
    links = found.where("next is not null and rank >= 0").select("file", "chunk", "offset", "next")
    exits = saved(links.groupBy("file", "chunk").applyInPandas(_exits, _LINKS), "chunk-exits")
    reached = exits.where("offset = 0").select("file", "offset")
    jump = exits.select("file", "offset", "exit")
    rounds = max(1, (exits.agg(F.max("chunk")).first()[0] or 0) + 1)
    for _ in range((rounds - 1).bit_length()):
        further = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = saved(reached.unionByName(further).distinct(), "reached")
        jump = saved(jump.join(jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("then")), ["file", "exit"]).select("file", "offset", F.col("then").alias("exit")), "jumps")
    entries = exits.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return entries.select("file", "chunk", "offset", "next", "entry").groupBy("file", "chunk").applyInPandas(_reached, "file string, offset long")


def read_archives(spark, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record on the chains."""
    found = saved(candidates(spark, path), "candidates")
    records = saved(found.join(saved(chain(found), "chain"), ["file", "offset"]), "records")
    ends = found.groupBy("file").agg(F.max(F.col("offset") + F.col("bytes") + len(VERSION)).alias("size"))
    broken = records.groupBy("file").agg(F.max("next").alias("last")).join(ends, "file", "right").where("last is null or last != size")
    if not broken.isEmpty():
        raise ValueError(f"the chain of records breaks off in {broken.first()['file']}")
    long = records.where("not whole")
    if not long.isEmpty():
        records = records.where("whole").unionByName(_joined(spark, path, found, long).select(*records.columns))
    full = F.col("record_type") == "response"
    checked = F.when(~full | (F.col("digest") == F.col("said_digest")), F.col("said_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload doesn't match its digest at "), "file", F.lit(":"), F.col("offset").cast("string"))))
    return records.select("page_id", "url", F.when(full, F.col("length")).otherwise(F.col("said_bytes")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def _joined(spark, path: str, found: DataFrame, long: DataFrame) -> DataFrame:
    """The records whose payload holds version lines, with the digest of the payload put together."""
    wanted = long.select("file", F.col("offset").alias("record"), F.col("next").alias("stop"))
    in_file = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    marks = found.select("file", "offset", "block", "no").join(wanted.withColumnRenamed("record", "offset"), ["file", "offset"], "left")
    owner = F.last(F.when(F.col("stop").isNotNull(), F.struct(F.col("offset").alias("record"), "stop")), ignorenulls=True).over(in_file)
    owned = saved(marks.withColumn("o", owner).where("offset < o.stop").select("file", "block", "no", "offset", F.col("o.record").alias("record")), "payload-pieces")
    text = _pieces(spark, path).join(owned, ["file", "block", "no"])
    whole = text.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda p: p["value"]), VERSION).alias("text"))
    rest = long.drop("digest").join(whole.withColumnRenamed("record", "offset"), ["file", "offset"])
    payload = F.expr("substring(cast(text as binary), cast(body as int) + 1, cast(length as int))")
    return rest.withColumn("digest", sha1_base32(payload))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"substr('{BASE32}', ((cast('0x' || substr(h, {5 * i + 1}, 5) as integer) >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

ORACLE = {
    "op4_warc": f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
r as (select *, max(page_id) over (partition by h) as first from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, {_DIGITS} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from r
"""
}
