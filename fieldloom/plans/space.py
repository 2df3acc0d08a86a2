"""The probability space of a collection, from its additive summaries.

A canonical path depends on the raw path alone, and a canonical variant on raw path and raw shape. So everything here
works on distinct paths and shapes; only provenance goes back to the observations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.names import Lexicon, matched_names
from .storage import stored

PATHS = "array<string>"
#: Of a dictionary that is joined with observations: broadcast up to so many bytes; else keys that are hot, and their parts.
BROADCAST_BYTES, HOT_KEYS, SALTS = 24 << 20, 2000, 64


@dataclass
class Space:
    """documents: how many; fields, distributions, variants: tables; paths: raw to canonical; warnings."""

    summary: DataFrame
    fields: DataFrame
    distributions: DataFrame
    variants: DataFrame
    paths: DataFrame
    shapes: DataFrame


def joined(path: Column) -> Column:
    return F.array_join(path, "/")


def with_share(df: DataFrame, *keys: str) -> DataFrame:
    """count of a distribution's outcomes to count, total and probability."""
    total = F.sum("count").over(Window.partitionBy(*keys))
    return df.withColumn("total", total).withColumn("probability", F.col("count") / F.col("total"))


def _parent(path: str) -> Column:
    return F.slice(path, 1, F.size(path) - 1)


def resolve(summary: DataFrame, lexicon: Lexicon | None, max_names: int = 256) -> tuple[DataFrame, DataFrame]:
    """(raw_path, path, relation of the last name) of all distinct raw paths, and the warnings."""
    spark = summary.sparkSession
    raw = summary.where("what = 'field'").select(F.col("path").alias("raw_path"), F.col("n").alias("occurrences"))
    if lexicon is None:
        return raw.select("raw_path", F.col("raw_path").alias("path"), F.lit("original").alias("relation")), spark.createDataFrame([], "warning string")
    raw = stored(raw, "raw-paths")
    sets = stored(summary.where("what = 'names' and size(items) > 1").select("path", "items"), "name-sets")
    depth = raw.agg(F.max(F.size("raw_path"))).first()[0] or 1  # at most the depth limit
    known = spark.createDataFrame([([], [])], "raw_path array<string>, path array<string>")
    levels, overflow = [], []
    for size in range(1, depth + 1):
        here = raw.where(F.size("raw_path") == size).withColumn("raw_parent", _parent("raw_path")).withColumn("name", F.element_at("raw_path", -1))
        parents = known.select(F.col("raw_path").alias("raw_parent"), F.col("path").alias("parent"))
        here = here.join(parents, "raw_parent")
        counts = here.groupBy("parent", "name").agg(F.sum("occurrences").alias("occurrences"))
        together = sets.where(F.size("path") == size - 1).select(F.col("path").alias("raw_parent"), "items").join(parents, "raw_parent").select("parent", "items").distinct()
        names = stored(matched_names(counts, together, lexicon, max_names), "matched-names")
        level = here.join(names, ["parent", "name"]).select("raw_path", F.concat("parent", F.array("canonical")).alias("path"), "relation")
        known = stored(level, "paths")
        levels.append(known)
        overflow.append(names.where("overflow").select("parent").distinct())
    out, over = levels[0], overflow[0]
    for x, y in zip(levels[1:], overflow[1:]):
        out, over = out.unionByName(x), over.unionByName(y)
    return out, over.select(F.concat(F.lit("name_comparison_limit_reached:"), joined(F.col("parent"))).alias("warning"))


def canonical_shapes(summary: DataFrame, paths: DataFrame, identity: bool) -> DataFrame:
    """raw_path, raw_shape, path, variant_id, kind, children (array of path and variant), n; deepest level first."""
    raw = summary.where("what = 'shape'").select(F.col("path").alias("raw_path"), F.col("a").alias("raw_shape"), F.col("b").alias("kind"), "items", "n")
    pair = F.expr("transform(sequence(0, cast(size(items) / 2 as int) - 1), i -> struct(get(items, 2 * i) as name, get(items, 2 * i + 1) as shape))")
    pairs = F.when(F.size("items") > 0, pair).otherwise(F.array().cast("array<struct<name:string,shape:string>>"))
    raw = raw.withColumn("below", pairs).drop("items")
    if identity:
        children = F.transform("below", lambda c: F.struct(F.concat("raw_path", F.array(c["name"])).alias("path"), c["shape"].alias("variant_id")))
        return raw.select("raw_path", "raw_shape", F.col("raw_path").alias("path"), F.col("raw_shape").alias("variant_id"), "kind", children.alias("children"), "n")
    raw = stored(raw.join(paths.select("raw_path", "path"), "raw_path"), "raw-shapes")
    deepest = raw.agg(F.max(F.size("raw_path"))).first()[0] or 1
    done: DataFrame | None = None
    levels = []
    for size in range(deepest, 0, -1):
        here = raw.where(F.size("raw_path") == size)
        if done is not None:
            each = here.select("raw_path", "raw_shape", F.explode("below").alias("c")).select("raw_path", "raw_shape", F.concat("raw_path", F.array("c.name")).alias("child_path"), F.col("c.shape").alias("child_shape"))
            child = done.select(F.col("raw_path").alias("child_path"), F.col("raw_shape").alias("child_shape"), F.struct("path", "variant_id").alias("child"))
            found = each.join(child, ["child_path", "child_shape"]).groupBy("raw_path", "raw_shape").agg(F.array_sort(F.collect_set("child")).alias("children"))
            here = here.join(found, ["raw_path", "raw_shape"], "left")
        else:
            here = here.withColumn("children", F.lit(None).cast("array<struct<path:array<string>,variant_id:string>>"))
        here = here.withColumn("children", F.coalesce("children", F.array().cast("array<struct<path:array<string>,variant_id:string>>")))
        identifier = F.sha2(F.concat_ws("\u0001", "kind", F.to_json("children")), 256)
        done = stored(here.select("raw_path", "raw_shape", "path", identifier.alias("variant_id"), "kind", "children", "n"), "shapes")
        levels.append(done)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def build(summary: DataFrame, lexicon: Lexicon | None = None, max_names: int = 256) -> Space:
    """summary: the (merged) rows that sources.documents.summaries gives."""
    summary = stored(summary, "summaries")
    paths, warnings = resolve(summary, lexicon, max_names)
    raw = summary.where("what = 'field'").select(F.col("path").alias("raw_path"), "n", "m").join(paths, "raw_path")
    fields = stored(raw.groupBy("path").agg(F.sum("n").alias("occurrences"), F.sum("m").alias("presence_count")), "fields")
    documents = summary.where("what = 'documents'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
    counts = fields.select(F.col("path").alias("parent"), F.col("occurrences").alias("parent_occurrences")).unionByName(documents.select(F.array().cast(PATHS).alias("parent"), F.col("documents").alias("parent_occurrences")))
    fields = (
        fields.withColumn("parent", _parent("path"))
        .join(counts, "parent")
        .select("path", F.sha2(joined(F.col("path")), 256).alias("field_id"), F.element_at("path", -1).alias("name"), "occurrences", "parent_occurrences", "presence_count", (F.col("presence_count") / F.col("parent_occurrences")).alias("presence_probability"))
    )
    types = summary.where("what = 'type'").select(F.col("path").alias("raw_path"), "a", "b", "n").join(paths, "raw_path")
    shapes = canonical_shapes(summary, paths, lexicon is None)
    none = F.lit(None).cast("string")
    parts = [
        raw.groupBy("path", F.element_at("raw_path", -1).alias("value"), "relation").agg(F.sum("n").alias("count")).withColumn("dimension", F.lit("name")),
        types.groupBy("path", F.col("a").alias("value")).agg(F.sum("n").alias("count")).withColumn("relation", none).withColumn("dimension", F.lit("data_type")),
        types.groupBy("path", F.col("b").alias("value")).agg(F.sum("n").alias("count")).withColumn("relation", none).withColumn("dimension", F.lit("representation")),
        shapes.groupBy("path", F.col("variant_id").alias("value")).agg(F.sum("n").alias("count")).withColumn("relation", none).withColumn("dimension", F.lit("variant")),
    ]
    columns = ["path", "dimension", "value", "relation", "count"]
    all_parts = parts[0].select(*columns)
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p.select(*columns))
    variants = shapes.groupBy("path", "variant_id", "kind", "children").agg(F.sum("n").alias("count"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    totals = (
        documents.select("documents", zero.alias("fields"), none.alias("warning"))
        .unionByName(fields.select(zero.alias("documents"), one.alias("fields"), none.alias("warning")))
        .unionByName(warnings.select(zero.alias("documents"), zero.alias("fields"), "warning"))
        .agg(F.sum("documents").alias("documents"), F.sum("fields").alias("fields"), F.array_sort(F.collect_set("warning")).alias("warnings"))
    )
    return Space(totals, fields, with_share(all_parts, "path", "dimension"), with_share(variants, "path"), paths, shapes)


def roots(space: Space) -> DataFrame:
    """Whole-document alternatives: path, variant_id, count, total (documents), probability."""
    documents = F.lit(space.summary.first()["documents"])
    return space.variants.where(F.size("path") == 1).withColumn("total", documents).withColumn("probability", F.col("count") / documents)


def sources(observed: DataFrame, space: Space, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Provenance: path, doc_id, position, name, representation, variant_id; one row an observation.

    The dictionary of raw shapes is broadcast if its size, summed up, allows it. Else both sides are dealt by raw shape,
    and the shapes of more than a HOT_KEYS-th of all rows (so HOT_KEYS at most) into SALTS parts."""
    keys = ["raw_path", "raw_shape"]
    at = stored(space.shapes.select(*keys, "path", "variant_id", "n"), "dictionary")
    texts = sum((F.length(joined(F.col(c))) for c in ("raw_path", "path")), F.length("raw_shape") + F.length("variant_id"))
    held, rows = at.agg(F.coalesce(F.sum(texts + 64), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if held <= broadcast_bytes:
        found = observed.join(F.broadcast(at), keys)
    else:
        hot = F.col("n") * HOT_KEYS > rows
        asked = observed.join(F.broadcast(at.where(hot).select(*keys, F.lit(SALTS).alias("parts"))), keys, "left")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("doc_id", "obs_id"), F.coalesce("parts", F.lit(1)).cast("long"))).drop("parts")
        parts = F.sequence(F.lit(0).cast("long"), F.when(hot, SALTS - 1).otherwise(0).cast("long"))
        found = asked.join(at.withColumn("part", F.explode(parts)), [*keys, "part"])
    return found.select("path", "doc_id", "position", "name", "representation", "variant_id")


def suggested(variants: DataFrame, *keys: str) -> DataFrame:
    """The most frequent alternative of each group, ties by id."""
    order = [F.desc("count"), F.col("variant_id")]
    if not keys:
        return variants.orderBy(*order).limit(1)
    return variants.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")


def serialized(space: Space) -> DataFrame:
    """field_id and one JSON object a field (document-probability-space, version 1); sources are a table of their own."""
    d = space.distributions
    outcome = F.struct(F.col("value"), F.col("count"), F.col("total"), F.col("probability"))
    pick = lambda c, name: F.array_sort(F.collect_list(F.when(c, outcome))).alias(name)
    dimension = F.col("dimension")
    grouped = d.groupBy("path").agg(
        pick((dimension == "name") & (F.col("relation") == "typo"), "typos"),
        pick((dimension == "name") & (F.col("relation") == "alias"), "alternative_names"),
        pick(dimension == "data_type", "data_types"),
        pick(dimension == "representation", "representations"),
    )
    content = space.variants.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("variant_id").alias("id"), "kind", "count", "total", "probability", "children"))).alias("alternatives"))
    whole = space.fields.join(grouped, "path").join(content, "path")
    body = F.struct(
        F.lit("document-probability-space").alias("format"), F.lit(1).alias("version"), F.col("field_id").alias("id"), "name", "path", "occurrences", "parent_occurrences", "presence_count", "presence_probability",
        "typos", "alternative_names", "data_types", "representations", F.struct("alternatives").alias("content"),
    )
    return whole.select("field_id", F.to_json(body).alias("json"))
