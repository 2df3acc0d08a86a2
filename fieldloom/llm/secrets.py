"""Secret scan with multipart credential linking. DataFrame functions only.

Base spans are found in the whole text by fixed patterns. Besides them there are weak candidates, which mean little
alone: identities (user, login, client id), opaque tokens and endpoints. An interval join links parts whose scopes
(``REACH`` code points on either side) meet, and a weak candidate is reported only if the complementary parts are
there: a token needs an identifier or an endpoint, an identity needs a secret, an endpoint needs both.

Parts join by buckets of BUCKET code points. Parts of one kind don't overlap and have a least length, so a bucket
holds a bounded number of parts and the join stays in proportion to the parts, whatever a document holds.

Offsets are code points, end exclusive. Nulls: a null text is empty and has no spans; a null doc_id stays null;
repeated rows get equal results; a table without any part gives its rows with no spans, an empty one no rows.
Very long texts are searched whole. Columns of any name pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, saved, small, table

REACH, BUCKET = 200, 256
KEY = ["row_id", "row_hash"]
#: Kind, pattern, the group whose length counts, its least length, role. The first three are the base kinds.
BASE = ("assign", "access", "hex")
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20, "identifier"),
    ("hex", r"([0-9a-f]{24,})", 1, 24, "secret"),  # a run of 24 or more is matched whole, a shorter one never
    ("identity", r"""((?i:user(?:name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, "identifier"),
    ("opaque", r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+)", 1, 20, "secret"),
    ("endpoint", r"""((?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+)""", 1, 8, "endpoint"),
)
KINDS = tuple(p[0] for p in PATTERNS)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """For each match: code points between it and the one before, its own, and those of the group."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    return F.when(
        text.rlike(pattern),
        F.arrays_zip(
            F.transform(F.split(text, pattern, -1), lambda s: F.length(s)).alias("gap"),
            F.transform(whole, lambda s: F.length(s)).alias("size"),
            F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda s: F.length(s)).alias("counted"),
        ),
    )


def parts(docs: DataFrame) -> DataFrame:
    """row key, kind (number), role, start, end of every base and weak part, each once for equal rows."""
    text = F.col("text")
    found = [F.struct(F.lit(i).alias("kind"), F.lit(least).alias("least"), F.lit(role).alias("role"), _matches(text, pattern, group).alias("m")) for i, (_, pattern, group, least, role) in enumerate(PATTERNS)]
    each = keyed(docs).select(*KEY, F.explode(F.array(*found)).alias("k")).where("k.m is not null").select(*KEY, "k.kind", "k.least", "k.role", F.posexplode("k.m").alias("i", "m")).where("m.size is not null")
    each = each.select(*KEY, "kind", "least", "role", "i", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"), F.col("m.counted").alias("counted")).dropDuplicates([*KEY, "kind", "i"])
    so_far = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return each.withColumn("end", end).where("counted >= least").select(*KEY, "kind", "role", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """The base parts, and the weak ones that have their complementary parts in scope and overlap no base part."""
    weak = found.where(F.col("kind") >= len(BASE))

    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / BUCKET), F.floor(high / BUCKET))).alias("bucket")

    near = found.select(*KEY, F.col("kind").alias("k2"), F.col("role").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"), buckets(F.col("start"), F.col("end") - 1))
    scopes = weak.select(*KEY, "kind", "role", "start", "end", buckets(F.greatest(F.col("start") - REACH, F.lit(0)), F.col("end") + REACH))
    met = scopes.join(near, [*KEY, "bucket"]).where("s2 < end + {0} and start < e2 + {0} and not (kind = k2 and start = s2)".format(REACH))
    inside = F.col("s2").__lt__(F.col("end")) & (F.col("start") < F.col("e2"))
    has = lambda role: F.max(((F.col("r2") == role) & ~inside).cast("int")) == 1
    reported = (
        met.groupBy(*KEY, "kind", "role", "start", "end")
        .agg(
            F.max((inside & ((F.col("k2") < len(BASE)) | (F.col("k2") < F.col("kind")))).cast("int")).alias("covered"),
            has("secret").alias("secret"),
            has("identifier").alias("identifier"),
            has("endpoint").alias("endpoint"),
        )
        .where("covered = 0")
        .where("case role when 'secret' then identifier or endpoint when 'identifier' then secret else secret and identifier end")
        .select(*found.columns)
    )
    return found.where(F.col("kind") < len(BASE)).unionByName(reported)


def spans(docs: DataFrame) -> DataFrame:
    """row key and spans (array of start, kind number, end, in that order) for the documents that have any."""
    every = linked(saved(parts(docs), "credential-parts"))
    return every.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = small(saved(spans(docs), "secret-spans"), 64, 40 * F.size("spans"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    said = f"array_join(transform({{}}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return (
        keyed(docs, F.col("doc_id"))
        .drop("text")
        .join(found, KEY, "left")
        .withColumn("spans", F.coalesce("spans", none))
        .select(
            "doc_id",
            *[F.expr(f"size(filter(spans, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
            F.sha2(F.expr(said.format(f"filter(spans, s -> s.kind < {len(BASE)})")).cast("binary"), 256).alias("base_sha256"),
            F.expr(said.format("spans")).alias("spans"),
        )
    )
