"""Consistency of a probability space, and its comparison with labelled collections, as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored

#: Of the places that annotations ask for (position and attribute, without documents): broadcast up to so many bytes.
PLACES_BYTES = 24 << 20


def _path(c: str = "path") -> Column:
    return F.array_join(c, "/")


def _rows(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.alias("key"), detail.cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_violations(fields: DataFrame, distributions: DataFrame) -> DataFrame:
    """check, key, detail of fields and distributions that break their own invariants."""
    f, key = fields, _path()
    sums = distributions.groupBy("path", "dimension").agg(F.sum("count").alias("n"), F.min("total").alias("low"), F.max("total").alias("high"), F.sum("probability").alias("p"), F.count("*").alias("rows"), F.count_distinct("value").alias("values"))
    joined = sums.join(f.select("path", "occurrences"), "path")
    return _union(
        [
            _rows(f.where(F.element_at("path", -1) != F.col("name")), "path_ends_elsewhere", key, F.col("name")),
            _rows(f.where("occurrences < 1 or parent_occurrences < 1 or presence_count < 1"), "count_below_one", key, F.col("occurrences")),
            _rows(f.where(F.col("presence_count") > F.least("occurrences", "parent_occurrences")), "presence_too_large", key, F.col("presence_count")),
            _rows(f.where("not (presence_probability > 0 and presence_probability <= 1)"), "presence_not_a_share", key, F.col("presence_probability")),
            _rows(joined.where("n != occurrences"), "distribution_sum", key, F.col("dimension")),
            _rows(joined.where("low != occurrences or high != occurrences"), "distribution_total", key, F.col("dimension")),
            _rows(joined.where(F.abs(F.col("p") - 1) > 1e-9), "probabilities_sum", key, F.col("dimension")),
            _rows(joined.where("rows != values"), "outcome_repeats", key, F.col("dimension")),
        ]
    )


def source_violations(sources: DataFrame, distributions: DataFrame) -> DataFrame:
    """Distributions that aren't the multiset of the sources, either way."""
    d = distributions.where(F.col("dimension").isin("name", "representation", "variant")).select("path", "dimension", "value", "count")
    pick = [F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value")) for k, c in (("name", "name"), ("representation", "representation"), ("variant", "variant_id"))]
    s = sources.select("path", F.explode(F.array(*pick)).alias("o")).groupBy("path", F.col("o.dimension").alias("dimension"), F.col("o.value").alias("value")).agg(F.count("*").alias("count"))
    return _union([_rows(d.exceptAll(s), "not_in_sources", _path(), F.col("value")), _rows(s.exceptAll(d), "only_in_sources", _path(), F.col("value"))])


def space_violations(fields: DataFrame, variants: DataFrame, documents: int, sources: DataFrame | None = None) -> DataFrame:
    """Parents, denominators, references and roots that don't hold over the whole space."""
    f = fields
    parents = f.select(F.col("path").alias("parent"), F.col("occurrences").alias("expected"))
    nested = f.where(F.size("path") > 1).withColumn("parent", F.slice("path", 1, F.size("path") - 1))
    roots = f.where(F.size("path") == 1)
    references = variants.select("path", "variant_id", F.explode("children").alias("c")).select("path", F.col("c.path").alias("child_path"), F.col("c.variant_id").alias("child_variant"))
    known = variants.select(F.col("path").alias("child_path"), F.col("variant_id").alias("child_variant"))
    parts = [
        _rows(f.groupBy("path").count().where("count > 1"), "path_repeats", _path(), F.col("count")),
        _rows(nested.join(parents, "parent", "left_anti"), "no_parent", _path(), F.col("name")),
        _rows(nested.join(parents, "parent").where("parent_occurrences != expected"), "wrong_denominator", _path(), F.col("expected")),
        _rows(roots.where(F.col("parent_occurrences") != documents), "root_denominator", _path(), F.col("parent_occurrences")),
        _rows(roots.agg(F.sum("occurrences").alias("n")).where(F.coalesce("n", F.lit(0)) != documents), "roots_cover_documents", F.lit(""), F.col("n")),
        _rows(references.join(known, ["child_path", "child_variant"], "left_anti"), "unknown_reference", _path(), _path("child_path")),
        _rows(references.where(F.slice("child_path", 1, F.size("child_path") - 1) != F.col("path")), "reference_elsewhere", _path(), _path("child_path")),
    ]
    if sources is not None:
        # an attribute has its owner's position, an element its parent's with one more
        at = F.when(F.col("representation") == "attribute", F.col("position")).otherwise(F.slice("position", 1, F.size("position") - 1))
        presence = sources.where(F.size("path") > 1).groupBy("path").agg(F.count_distinct("doc_id", at).alias("seen"))
        parts.append(_rows(presence.join(f.select("path", "presence_count"), "path").where("seen != presence_count"), "presence_differs", _path(), F.col("seen")))
        parts.append(_rows(sources.where(F.size("path") == 1).groupBy("doc_id").count().where("count != 1"), "roots_of_document", F.col("doc_id").cast("string"), F.col("count")))
    return _union(parts)


def unreachable_variants(variants: DataFrame) -> DataFrame:
    """path, variant_id of variants that no root leads to: one semi-join a level, from the roots down."""
    depth = variants.agg(F.max(F.size("path"))).first()[0] or 0
    edges = variants.select("path", "variant_id", F.explode("children").alias("c"))
    level = variants.where(F.size("path") == 1).select("path", "variant_id")
    reached = level
    for size in range(1, depth):
        here = edges.where(F.size("path") == size)
        level = here.join(level, ["path", "variant_id"], "left_semi").select("c.path", "c.variant_id").distinct()
        reached = reached.unionByName(level)
    return variants.select("path", "variant_id").join(reached, ["path", "variant_id"], "left_anti")


# ---- labelled collections


def annotated(sources: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (doc_id, position, attribute, role, name, kind) with the path of the field found there, or null.

    attribute is '' for elements. A source that is an attribute is met by position and name. Only sources at places that
    are asked for in any document are shuffled. Both sides are as many rows as the collection has, but their files are small
    (columns that repeat compress well), so Spark would take them for tables to broadcast; merge joins prevent that."""
    place = ["position", "attribute"]
    places = stored(expected.select(*place).distinct(), "places")
    held = places.agg(F.sum(64 + F.coalesce(4 * F.size("position"), F.lit(0)) + F.coalesce(F.octet_length("attribute"), F.lit(0)))).first()[0] or 0
    name = F.when(F.col("representation") == "attribute", F.col("name")).otherwise("")
    found = sources.select("doc_id", "position", name.alias("attribute"), "path")
    if held <= PLACES_BYTES:
        found = found.join(F.broadcast(places), place, "left_semi")
    return expected.join(found.hint("merge"), ["doc_id", *place], "left")


def missing_annotations(matched: DataFrame, dropped: DataFrame) -> DataFrame:
    """Unmatched annotations as normalised (below a dropped position) or missing. dropped: doc_id, position."""
    lost = matched.where("path is null").select("doc_id", "position", "attribute", "role")
    roots = dropped.select("doc_id", F.col("position").alias("above")).distinct()
    below = lost.join(roots.hint("merge"), "doc_id").where(F.slice("position", 1, F.size("above")) == F.col("above")).select("doc_id", "position", "attribute").distinct().withColumn("outcome", F.lit("normalised"))
    return lost.join(below.hint("merge"), ["doc_id", "position", "attribute"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))


def forbidden_merges(matched: DataFrame, forbidden: DataFrame) -> DataFrame:
    """path, left, right: fields that hold both roles of a forbidden pair."""
    roles = matched.where("path is not null").select("path", "role").distinct()
    left = forbidden.join(roles.withColumnRenamed("role", "left"), "left")
    return left.join(roles.withColumnRenamed("role", "right"), ["path", "right"]).select("path", "left", "right").distinct()
