"""Whole results as files: the probability space, its sources, and the evaluation of a labelled collection.

A space is one JSON document (document-probability-space, version 1) with statistics, roots, nodes in the order of
their paths, and warnings. It is written out of range-partitioned rows: one for the head of a node, one for each of its
alternatives, one that closes it. So no row holds a whole node with many alternatives, let alone the document. Each of
these rows is a line of the document, so Spark reads it back by lines. Sources are as many as observations; they stand
beside the document, as JSON lines. A line has two hashes and is some 220 bytes long, so plain lines of a large collection take
many times its own disk; compressed ones (gzip, which every reader of JSON lines opens) hold the same in a few bytes a line.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import write_document
from .space import Space, joined, roots

#: Fixed value of the format: by which rules drafts are made.
RECIPE = "observed-document-v1"
#: How the rows of a section are ordered.
ORDER = ["path", "rank", "after", "variant_id"]
#: What opens and closes statistics, roots, nodes and warnings.
SPACE_FRAME = [
    ('{"format":"document-probability-space","version":1,"statistics":\n', "\n"),
    (',"roots":[\n', "\n]"),
    (',"nodes":[\n', "\n]"),
    (',"warnings":[\n', "\n]}\n"),
]
ALTERNATIVES, NODE_END = '"content":{"alternatives":[', "]}}"

OUTCOME = "struct<value:string,count:long,probability:double>"
SPELLING = "struct<value:string,count:long,probability:double,relation:string>"
NODE = (
    "id string, name string, path array<string>, occurrences long, parent_occurrences long, presence_count long, presence_probability double, "
    f"name_alternatives array<{SPELLING}>, typos array<{SPELLING}>, alternative_names array<{SPELLING}>, data_types array<{OUTCOME}>, representations array<{OUTCOME}>"
)
REFERENCE = "struct<node:string,variant:string>"


def node_id(path: Column) -> Column:
    return F.sha2(joined(path), 256)


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _rows(df: DataFrame, section: int, text: Column, rank: int = 0, item: bool = True, after: Column | None = None) -> DataFrame:
    """Rows of a document: section, the columns of ORDER (path and variant_id are empty if df lacks them), item, text."""
    path = F.col("path") if "path" in df.columns else F.array().cast("array<string>")
    variant = F.col("variant_id") if "variant_id" in df.columns else F.lit("")
    place = [path.alias("path"), F.lit(rank).alias("rank"), (F.lit(0) if after is None else after).cast("long").alias("after"), variant.alias("variant_id")]
    return df.select(F.lit(section).alias("section"), *place, F.lit(item).alias("item"), text.alias("text"))


def _outcomes(dimension: str, *more: str) -> Column:
    """The outcomes of a dimension, most frequent first."""
    kept = ["value", "count", "probability", *more]
    outcome = F.struct((-F.col("count")).alias("after"), *kept)
    by_count = F.array_sort(F.collect_list(F.when(F.col("dimension") == dimension, outcome)))
    return F.transform(by_count, lambda o: F.struct(*[o[c].alias(c) for c in kept]))


def space_rows(space: Space) -> DataFrame:
    """The rows of a space's document."""
    grouped = space.distributions.where("dimension != 'variant'").groupBy("path").agg(
        _outcomes("name", "relation").alias("name_alternatives"), _outcomes("data_type").alias("data_types"), _outcomes("representation").alias("representations")
    )
    named = lambda relation: F.filter("name_alternatives", lambda x: x["relation"] == relation)
    head = _json(
        F.col("field_id").alias("id"), "name", "path", "occurrences", "parent_occurrences", "presence_count", "presence_probability", "name_alternatives",
        named("typo").alias("typos"), named("alias").alias("alternative_names"), "data_types", "representations",
    )
    nodes = space.fields.join(grouped, "path").withColumn("head", head)
    opening = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(f",{ALTERNATIVES}\n"))
    first = space.variants.groupBy("path").agg(F.min(F.struct((-F.col("count")).alias("after"), "variant_id")).alias("first"))
    leads = F.col("first") == F.struct((-F.col("count")).alias("after"), "variant_id")
    children = F.transform("children", lambda c: F.struct(node_id(c["path"]).alias("node"), c["variant_id"].alias("variant")))
    alternative = _json(node_id(F.col("path")).alias("node"), F.col("variant_id").alias("id"), "kind", children.alias("children"), "count", "probability")
    root = _json(node_id(F.col("path")).alias("node"), F.col("variant_id").alias("variant"), "count", "probability")
    warnings = space.summary.select(F.explode("warnings").alias("variant_id"))
    parts = [
        _rows(space.summary, 0, _json("documents", "fields")),
        _rows(roots(space), 1, root, after=-F.col("count")),
        _rows(nodes, 2, opening),
        _rows(space.variants.join(first, "path"), 2, F.concat(F.when(leads, "").otherwise(",\n"), alternative), 1, False, -F.col("count")),
        _rows(nodes, 2, F.lit(f"\n{NODE_END}"), 2, False),
        _rows(warnings, 3, F.regexp_extract(F.to_json(F.array("variant_id")), r"^\[(.*)\]$", 1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_space(space: Space, path: str) -> None:
    write_document(space_rows(space), path, SPACE_FRAME, *ORDER)


def read_space(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """statistics, roots, nodes (without alternatives), alternatives and warnings of a written space."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", ",$", "").alias("value"))
    parsed = lambda test, schema, end="": lines.where(test).select(F.from_json(F.concat("value", F.lit(end)), schema).alias("x")).select("x.*")
    value = F.col("value")
    return {
        "statistics": parsed(value.startswith('{"documents":'), "documents long, fields long"),
        "roots": parsed(value.startswith('{"node":') & value.contains(',"variant":') & ~value.contains(',"kind":'), "node string, variant string, count long, probability double"),
        "nodes": parsed(value.endswith(ALTERNATIVES), NODE, NODE_END),
        "alternatives": parsed(value.startswith('{"node":') & value.contains(',"kind":'), f"node string, id string, kind string, children array<{REFERENCE}>, count long, probability double"),
        "warnings": lines.where(value.startswith('"')).select(F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]").alias("warning")),
    }


def write_sources(sources: DataFrame, folder: str, compression: str = "none") -> None:
    """Provenance (see space.sources) as JSON lines: node, document, position, name, representation, variant. compression:
    none, or a codec of Spark's JSON writer (gzip)."""
    rows = sources.select(node_id(F.col("path")).alias("node"), F.col("doc_id").alias("document"), "position", "name", "representation", F.col("variant_id").alias("variant"))
    rows.write.json(folder, compression=compression)


def write_manifest(path: str, title: str, snapshot: dict, found: DataFrame, drafted: DataFrame, space: Space) -> None:
    """The manifest of an analysis as one JSON document: formats, profile, statistics, the suggested draft, and all root
    alternatives, most frequent first, a line each. found, drafted: see drafts.alternatives; snapshot: resource, id, revision."""
    from .drafts import DIALECTS, manifest

    facts = manifest(found, drafted).first()
    profile = {"syntax": facts["syntax"], "dialect": DIALECTS[facts["syntax"]]}
    head = {
        "contractVersion": 2, "format": "schema-analysis", "title": title, "snapshot": snapshot, "inputFormats": facts["formats"], "profile": profile,
        "statistics": space.summary.select("documents", "fields").first().asDict(), "recipeVersion": RECIPE,
        "suggestedDraft": {"seedId": RECIPE, "suggestedRootAlternativeId": facts["suggested"]},
    }
    frame = [(json.dumps(head, ensure_ascii=False)[:-1] + ',\n"rootAlternatives":[\n', "\n]}\n")]
    write_document(_rows(found.select("id", "count", F.col("id").alias("variant_id")), 0, _json("id", "count"), after=-F.col("count")), path, frame, *ORDER)


#: The lists of an evaluation, in order.
LISTS = ("forbidden_field_merges", "missing_annotations", "normalized_annotations", "invalid_distributions")


def write_evaluation(path: str, scenario: str, space: Space, forbidden: DataFrame, missing: DataFrame, invalid: DataFrame) -> None:
    """The audit of a labelled collection as one JSON document. forbidden: path, left, right; missing: doc_id, position,
    attribute, role, outcome (see checks); invalid: check, key, detail."""
    opening = json.dumps({"scenario": scenario})[:-1]
    frame = [(f'{opening},"statistics":\n', "\n"), *[(f',"{name}":[\n', "\n]") for name in LISTS]]
    frame[-1] = (frame[-1][0], "\n]}\n")
    lost = _json(F.col("doc_id").alias("document"), "position", "attribute", "role")
    key = F.concat_ws("\u0001", F.array_join("position", "."), "attribute", "role")
    parts = [
        _rows(space.summary, 0, _json("documents", "fields")),
        _rows(forbidden, 1, _json("path", "left", "right")),
        *[
            _rows(missing.where(F.col("outcome") == outcome).select("*", key.alias("variant_id")), section, lost, after=F.col("doc_id"))
            for section, outcome in ((2, "missing"), (3, "normalised"))
        ],
        _rows(invalid.select("*", F.concat_ws("\u0001", "key", "check", "detail").alias("variant_id")), 4, _json("check", "key", "detail")),
    ]
    write_document(reduce(DataFrame.unionByName, parts), path, frame, *ORDER)


def write_artefacts(folder: str, name: str, space: Space, sources: DataFrame, forbidden: DataFrame, missing: DataFrame, invalid: DataFrame, compression: str = "none") -> None:
    """<name>.space.json, <name>.sources (a folder of JSON lines; see write_sources for their compression) and <name>.evaluation.json."""
    write_space(space, f"{folder}/{name}.space.json")
    write_sources(sources, f"{folder}/{name}.sources", compression)
    write_evaluation(f"{folder}/{name}.evaluation.json", name, space, forbidden, missing, invalid)
