"""Exports: type shares, spelling maps, AND/OR expressions and XSD text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import selection_violations
from ..plans.numbering import numbered
from ..plans.space import Space, roots
from ..plans.storage import tasks
from ..sources.files import write_document

#: Type names that the expression format has under another name.
EXPORT_TYPES = {"null": "empty", "number": "double"}
XS = "http://www.w3.org/2001/XMLSchema"


def type_shares(distributions: DataFrame) -> DataFrame:
    """path, types (map of type to share): scalar types only, renamed, added up where two get one name, scaled to one."""
    d = distributions.where((F.col("dimension") == "data_type") & (F.col("value") != "parent"))
    name = F.col("value")
    for old, new in EXPORT_TYPES.items():
        name = F.when(F.col("value") == old, new).otherwise(name)
    sums = d.groupBy("path", name.alias("k")).agg(F.sum("count").alias("c"))
    listed = sums.groupBy("path").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("k", "c"))).alias("t"))
    return listed.select("path", F.map_from_entries(F.transform("t", lambda x: F.struct(x["k"], x["c"] / F.col("n")))).alias("types"))


def spelling_maps(distributions: DataFrame) -> DataFrame:
    """path, typos and alternative_names: maps of spelling to probability."""
    d = distributions.where("dimension = 'name'")
    pick = lambda r: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct("value", "probability")))))
    return d.groupBy("path").agg(pick("typo").alias("typos"), pick("alias").alias("alternative_names"))


#: The document of an expression is one object: its entries.
EXPRESSION_FRAME, EXPRESSION_ORDER = [("{\n", "\n}\n")], ["rank", "number"]


def _opened(kind: str, value: Column, probability: Column) -> Column:
    """A part of an expression up to its children; CLOSED ends it."""
    rest = '"minOccurs":1,"maxOccurs":1,"children":['
    return F.concat(F.lit(f'{{"type":"{kind}","value":'), value, F.lit(',"probability":'), probability.cast("string"), F.lit(f",{rest}"))


CLOSED = "]}"


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _entry(key: Column, expression: Column, types: Column, presence: Column | None) -> tuple[Column, Column]:
    """An entry up to its expression's end, and what follows it."""
    text = lambda c: F.coalesce(F.to_json(c), F.lit("{}"))
    after = [F.lit(',"typoSpace":'), text("typos"), F.lit(',"semanticSpace":'), text("alternative_names"), F.lit(',"XSDTypes":'), types, F.lit(',"attributes":{}')]
    if presence is not None:
        after += [F.lit(',"presence_probability":'), presence.cast("string")]
    return F.concat(_quoted(key), F.lit(':{"expression":'), expression), F.concat(*after, F.lit("}"))


def expression_rows(space: Space) -> DataFrame:
    """The AND/OR expression of all root variants as rows of one JSON document (section, rank, number, item, text; see
    sources.files.write_document), with an entry for each node of the expanded trees.

    Entries are called ``context<n>`` in the preorder of all trees. One root variant is its AND, and its entry holds the
    expression (``begin-c``); several variants of one root field are an OR of ANDs, several root fields an OR of leaves
    under ``begin-c/documents-c``. The expression is written a node a row: a node opens its part, and the last node of
    some subtrees closes their parts. So trees of any number and size are numbered, joined and written in parallel.
    """
    tops = roots(space)
    variants, root_fields = tops.agg(F.count("*"), F.count_distinct("path")).first()
    single, one_field = variants == 1, root_fields == 1
    info = space.fields.select("path", "name", "presence_probability").join(type_shares(space.distributions), "path", "left").join(spelling_maps(space.distributions), "path", "left")
    found = numbered(space).join(space.variants.select("path", "variant_id", "kind"), ["path", "variant_id"]).join(info, "path")
    local = F.regexp_extract("name", r"(?s)([^}]*)$", 1)
    parent = F.col("kind") == "fields"
    label = F.concat(local, F.when(parent, "-c").otherwise("-s"))
    top = F.col("depth") == 0
    key = F.concat(F.lit("context"), (F.col("number") - int(single)).cast("string"), F.lit("-c/"), label)
    if single:
        key = F.when(top, F.concat(F.lit("begin-c/"), label)).otherwise(key)
    found = found.withColumn("key", key)
    row = lambda df, rank, number, item, text: df.select(F.lit(0).alias("section"), F.lit(rank).alias("rank"), number.cast("long").alias("number"), F.lit(item).alias("item"), text.alias("text"))

    # the nodes of the expression
    one, empty = F.lit(1.0), F.lit('""')
    body = F.when(F.col("last") > F.col("number"), _opened("AND", empty, one)).otherwise("")
    leaf = _opened("LEAF", _quoted(F.col("key")), F.when(top, F.col("probability")).otherwise(one))
    if single:
        opens = F.when(top, F.when(F.col("last") > F.col("number"), body).otherwise("{}")).otherwise(F.concat(leaf, body))
    else:
        opens = F.concat(F.when(top, _opened("AND", empty, F.col("probability"))).otherwise(leaf) if one_field else leaf, body)
    comma = F.when(F.when(top, F.col("number") > 1).otherwise(F.col("place") > 0), ",").otherwise("")
    # a last node closes itself and the trees that end with it, each with its AND; a single root is its AND alone
    own = F.when(top, "").otherwise(CLOSED) if single else F.lit(CLOSED)
    closes = F.concat(own, F.expr(f"repeat('{CLOSED}', 2 * ends{' - if(ends > 0 AND ends = depth, 1, 0)' if single else ''})"))
    nodes = F.concat(comma, opens, F.when(F.col("last") == F.col("number"), closes).otherwise(""))

    # the entries
    none = F.lit("{}")
    begin, end = _entry(F.col("key"), F.lit(""), F.when(parent, '{"parent":1.0}').otherwise(F.coalesce(F.to_json("types"), none)), F.col("presence_probability"))
    entries = found if not single else found.where(~top)
    parts = [row(found, 1, F.col("number"), False, nodes), row(entries, 3, F.col("number"), True, F.concat(begin, none, end))]
    if single:
        head = found.where(top)
        parts += [row(head, 0, F.lit(0), True, begin), row(head, 2, F.lit(0), False, end)]
    elif variants:
        either = _opened("OR", empty, one)
        if one_field:
            raw = space.distributions.where("dimension = 'data_type'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("value", "probability"))).alias("t"))
            head = info.join(tops.select("path").distinct(), "path").join(raw, "path")
            begin, end = _entry(F.concat(F.lit("begin-c/"), local, F.lit("-c")), either, F.to_json(F.map_from_entries("t")), None)
        else:
            nothing = F.lit(None).cast("map<string,double>")
            head = space.summary.select(nothing.alias("typos"), nothing.alias("alternative_names"))
            begin, end = _entry(F.lit("begin-c/documents-c"), either, F.lit('{"parent":1.0}'), None)
        parts += [row(head, 0, F.lit(0), True, begin), row(head, 2, F.lit(0), False, F.concat(F.lit(CLOSED), end))]
    return reduce(DataFrame.unionByName, parts)


#: A writer gives the rows of a document, its frame, and the columns that order its rows.
Writer = Callable[[Space], tuple[DataFrame, list[tuple[str, str]], list[str]]]


def expression_writer(space: Space) -> tuple[DataFrame, list[tuple[str, str]], list[str]]:
    return expression_rows(space), EXPRESSION_FRAME, EXPRESSION_ORDER


def write_expression(space: Space, path: str, writer: Writer = expression_writer) -> None:
    """The space in the form that writer gives it, as one document."""
    rows, frame, order = writer(space)
    write_document(rows, path, frame, *order)


def alternatives(space: Space) -> DataFrame:
    """Root fields and how their variants combine: one variant is its AND, several are an OR of ANDs."""
    n = F.count("*")
    found = roots(space).groupBy("path").agg(n.alias("variants"), F.when(n > 1, "OR").otherwise("AND").alias("type"), F.sum("probability").alias("probability"))
    return found.select(F.array_join("path", "/").alias("field"), "variants", "type", "probability")


def xsd(selections: DataFrame) -> DataFrame:
    """schema_id, xsd text of the schemas that hold (see scalars.selection_violations). selections: schema_id, id (unique
    over all schemas), parent_id, position, name, kind (object, scalar, attribute), type, min_occurs, max_occurs. A task
    goes through the rows of its schemas in order and holds those of one."""
    wrong = selection_violations(selections).select("id").distinct()
    bad = selections.join(wrong, "id").select("schema_id").distinct()
    columns = ["schema_id", "id", "parent_id", "name", "kind", "type", "min_occurs", "max_occurs"]

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for pdf in it:
            made = []
            for values in zip(*[pdf[c].tolist() for c in columns]):
                r = dict(zip(columns, values))
                if rows and rows[0]["schema_id"] != r["schema_id"]:
                    made.append((int(rows[0]["schema_id"]), _xsd(rows)))
                    rows = []
                rows.append(r)
            yield pd.DataFrame(made, columns=["schema_id", "xsd"])
        if rows:
            yield pd.DataFrame([(int(rows[0]["schema_id"]), _xsd(rows))], columns=["schema_id", "xsd"])

    good = selections.join(bad, "schema_id", "left_anti").repartition(tasks(selections.sparkSession), "schema_id")
    in_order = good.sortWithinPartitions("schema_id", F.asc_nulls_last("position"), F.asc_nulls_last("id"))
    return in_order.select(*columns).mapInPandas(write, "schema_id long, xsd string")


def _xsd(rows: list[dict]) -> str:
    """The text of one schema, whose rows come in order."""
    below: dict[str | None, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent_id"] if isinstance(r["parent_id"], str) else None, []).append(r)
    tag = lambda name: f"{{{XS}}}{name}"
    typed = lambda r: "xs:" + ("string" if r["type"] == "null" else r["type"])

    def write(under: ElementTree.Element, r: dict, bounds: dict[str, str]) -> None:
        e = ElementTree.SubElement(under, tag("element"), {"name": r["name"]} | ({"nillable": "true"} if r["type"] == "null" else {}) | bounds)
        inside = below.get(r["id"], [])
        attributes = [c for c in inside if c["kind"] == "attribute"]
        elements = [c for c in inside if c["kind"] != "attribute"]
        if r["kind"] == "scalar" and not attributes:
            e.set("type", typed(r))
            return
        holder = ElementTree.SubElement(e, tag("complexType"))
        if r["kind"] == "scalar":
            holder = ElementTree.SubElement(ElementTree.SubElement(holder, tag("simpleContent")), tag("extension"), base=typed(r))
        if elements:
            sequence = ElementTree.SubElement(holder, tag("sequence"))
            for c in elements:
                write(sequence, c, {"minOccurs": str(int(c["min_occurs"])), "maxOccurs": str(c["max_occurs"])})
        for c in attributes:
            ElementTree.SubElement(holder, tag("attribute"), name=c["name"], type=typed(c), use="required")

    ElementTree.register_namespace("xs", XS)
    root = ElementTree.Element(tag("schema"), elementFormDefault="qualified", attributeFormDefault="unqualified")
    for r in below.get(None, []):
        write(root, r, {})
    return ElementTree.tostring(root, encoding="unicode")
