"""Schema drafts: one graph a document, counted by digest; graphs as tables of nodes, collections and members.

A document is first a tree of parts, each with what it says, the parts that it points to and its ordered members; one
walk then numbers parts, members and collections, those below before those above. Names keep the order of the
document, so documents that differ in it have different drafts."""

from __future__ import annotations

import base64
import binascii
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dealt, stored
from ..sources.documents import MAX_DEPTH, XSI, BadDocument, _YAML_TAG, _YAML_TYPES, _no_constant, _one_of_each, _plain, composed_yaml, nil_and_mixed, xml_type

#: Fixed values of the graph format: node kind to the field of its member collection and the kind of its members ...
COLLECTIONS = {"object": ("properties", "property"), "union": ("options", "option"), "xmlComplex": ("attributes", "xmlAttribute"), "xmlGroup": ("particles", "xmlParticle")}
#: ... fields that name another node, in the order in which they are followed ...
LINKS = ("contentNodeId", "particleNodeId", "simpleContentNodeId", "itemsNodeId")
#: ... dialects, and scalar types that are called otherwise.
DIALECTS = {"json": "json-schema-2020-12", "yaml": "json-schema-2020-12", "xml": "xsd-1.0"}
TYPE_NAMES = {"double": "number", "dateTime": "datetime"}
MAX_NODES = 1_000_000
#: Characters of graphs that a worker holds, to give them again to documents that differ in values alone.
HELD_CHARS = 1 << 23


@dataclass
class _Part:
    kind: str
    says: dict = field(default_factory=dict)
    points: dict[str, "_Part | None"] = field(default_factory=dict)
    members: list[tuple[dict, "_Part"]] = field(default_factory=list)


@dataclass(frozen=True)
class _Scalar:
    type: str


def _scalar(kind: str) -> _Part:
    return _Part("scalar", {"scalarType": TYPE_NAMES.get(kind, kind), "constraints": {}})


def _numbered(top: _Part, syntax: str) -> str:
    """The graph of a tree of parts as canonical JSON."""
    nodes: dict[str, dict] = {}
    collections: dict[str, list[dict]] = {}
    made = 0

    def member(kind: str, values: dict, node: str) -> dict:
        nonlocal made
        made += 1
        return {"id": f"member-{made}", "kind": kind, "valueNodeId": node} | values

    def place(part: _Part) -> str:
        entry: dict = {"kind": part.kind} | part.says
        rows, kind = [], ""
        if part.kind in COLLECTIONS:
            name, kind = COLLECTIONS[part.kind]
            if part.kind == "union":  # options are numbered after all that stands below them
                below = [place(p) for _, p in part.members]
                rows = [member(kind, values, node) for (values, _), node in zip(part.members, below)]
            else:
                for values, p in part.members:
                    node = place(p)
                    rows.append(member(kind, values, node))
        entry |= {link: p and place(p) for link, p in part.points.items()}
        if kind:
            at = f"collection-{len(collections) + 1}"
            collections[at] = rows
            entry[name] = {"id": at, "totalItems": len(rows)}
        at = f"node-{len(nodes) + 1}"
        nodes[at] = {"id": at} | entry
        return at

    root = place(top)
    whole = {"rootNodeId": root, "profile": {"syntax": syntax, "dialect": DIALECTS[syntax]}, "nodes": nodes, "collections": collections}
    return json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _Budget:
    """Nodes of the source that are left, and how deep they may stand."""

    def __init__(self, nodes: int = MAX_NODES, depth: int = MAX_DEPTH):
        self.nodes, self.depth = nodes, depth

    def take(self, depth: int) -> None:
        self.nodes -= 1
        if self.nodes < 0 or depth >= self.depth:
            raise BadDocument("too large or too deep for a draft")


class _Shapes:
    """A number for each value, equal for values of one shape: names without order, item shapes as a set, scalars by type.
    Each value is looked at once, however deep it stands."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.known: dict[int, int] = {}

    def of(self, value) -> int:
        if id(value) not in self.known:
            if isinstance(value, dict):
                shape = ("object", frozenset((k, self.of(v)) for k, v in value.items()))
            elif isinstance(value, list):
                shape = ("array", frozenset(map(self.of, value)))
            else:
                shape = ("scalar", TYPE_NAMES.get(value.type, value.type))
            self.known[id(value)] = self.numbers.setdefault(shape, len(self.numbers))
        return self.known[id(value)]


def _typed(value):
    """A JSON value with its scalars replaced by their types."""
    if isinstance(value, dict):
        return {k: _typed(v) for k, v in value.items()}
    return [_typed(v) for v in value] if isinstance(value, list) else _Scalar(_plain(value)[0])


def _data_part(value, budget: _Budget, depth: int = 0, shapes: _Shapes | None = None) -> _Part:
    """An object, array or scalar of JSON or YAML. Items of one shape are one alternative."""
    budget.take(depth)
    shapes = shapes or _Shapes()
    if isinstance(value, dict):
        return _Part("object", {"additionalProperties": False}, {}, [({"name": k, "required": True}, _data_part(v, budget, depth + 1, shapes)) for k, v in value.items()])
    if not isinstance(value, list):
        return _scalar(value.type)
    ways = {shapes.of(v): v for v in reversed(value)}  # of each shape the first item
    kept = [v for v in value if ways[shapes.of(v)] is v]
    parts = [_data_part(v, budget, depth + 1, shapes) for v in kept]
    items = _scalar("null") if not parts else parts[0] if len(parts) == 1 else _Part("union", {"mode": "anyOf"}, {}, [({"title": f"Variant {i}"}, p) for i, p in enumerate(parts, 1)])
    return _Part("array", {"minItems": 0, "maxItems": None if parts else 0}, {"itemsNodeId": items})


def _name(tag: str) -> dict:
    uri, _, local = tag.rpartition("}")
    return {"namespaceUri": uri[1:] or None, "localName": local}


def _element_part(e: ElementTree.Element, budget: _Budget, depth: int = 0) -> _Part:
    budget.take(depth)
    nil, mixed = nil_and_mixed(e)
    if nil and (len(e) or (e.text or "").strip()):
        raise BadDocument("a nil element has content")
    named = sorted((k, v) for k, v in e.attrib.items() if not k.startswith(XSI))
    content = text = _scalar("null" if nil else xml_type(e.text or ""))
    if named or len(e):
        attributes = [({"name": _name(k), "required": True}, _scalar(xml_type(v))) for k, v in named]
        group = _Part("xmlGroup", {"compositor": "sequence"}, {}, [({"minOccurs": 1, "maxOccurs": 1}, _element_part(c, budget, depth + 1)) for c in e]) if len(e) else None
        content = _Part("xmlComplex", {"mixed": mixed}, {"particleNodeId": group, "simpleContentNodeId": None if group else text}, attributes)
    return _Part("xmlElement", {"name": _name(e.tag), "nillable": nil}, {"contentNodeId": content})


#: Graphs by syntax and skeleton.
_written: dict[tuple, str] = {}
_held_chars = 0


def _once(key: tuple, write: Callable[[], str]) -> str:
    """What write gives, taken from the held graphs if one of this key is there."""
    global _held_chars
    if key in _written:
        return _written[key]
    text = write()
    if _held_chars + len(text) > HELD_CHARS:
        _written.clear()
        _held_chars = 0
    if len(text) <= HELD_CHARS // 16:
        _written[key] = text
        _held_chars += len(text)
    return text


def _data_key(value) -> tuple | str:
    """All of a typed value."""
    if isinstance(value, dict):
        return ("object", *[(k, _data_key(v)) for k, v in value.items()])
    return ("array", *[_data_key(v) for v in value]) if isinstance(value, list) else value.type


def _element_key(e: ElementTree.Element, depth: int = 0) -> tuple:
    """All of an element but its texts and values, of which only the types count."""
    if depth > MAX_DEPTH:
        raise BadDocument("too large or too deep for a draft")
    named = sorted((k, xml_type(v)) for k, v in e.attrib.items() if not k.startswith(XSI))
    return (e.tag, *nil_and_mixed(e), xml_type(e.text or ""), tuple(named), *[_element_key(c, depth + 1) for c in e])


def draft_json(content: str) -> str:
    value = _typed(json.loads(content, object_pairs_hook=_one_of_each, parse_constant=_no_constant))
    return _once(("json", _data_key(value)), lambda: _numbered(_data_part(value, _Budget()), "json"))


def draft_yaml(content: str) -> str:
    import yaml

    _, root = composed_yaml(content, preserve_root=True)  # rejects what the reader rejects: aliases, tags, names, limits

    def typed(node):
        if isinstance(node, yaml.MappingNode):
            return {k.value: typed(v) for k, v in node.value}
        if isinstance(node, yaml.SequenceNode):
            return [typed(v) for v in node.value]
        kind = _YAML_TYPES[node.tag.removeprefix(_YAML_TAG)]
        return _Scalar("null" if kind == "string" and not node.value.strip() else kind)

    value = typed(root)
    return _once(("yaml", _data_key(value)), lambda: _numbered(_data_part(value, _Budget()), "yaml"))


def draft_xml(content: str) -> str:
    root = ElementTree.fromstring(content)
    write = lambda: _numbered(_element_part(root, _Budget()), "xml")
    try:
        key = ("xml", _element_key(root))
    except BadDocument:
        return write()  # what is wrong is said in the order of the elements
    return _once(key, write)


WRITERS: dict[str, Callable[[str], str]] = {"json": draft_json, "yaml": draft_yaml, "xml": draft_xml}


def drafts(docs: DataFrame, writers: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """doc_id, format, graph (canonical JSON), digest, error of each document."""
    writers = WRITERS | (writers or {})

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc_id, kind, content in zip(pdf["doc_id"], pdf["format"], pdf["content"]):
                try:
                    out.append((doc_id, kind, writers[kind](content), None))
                except (ValueError, KeyError, TypeError, RecursionError, ElementTree.ParseError) as e:
                    out.append((doc_id, kind, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "format", "graph", "error"])

    rows = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "format", "content")).mapInPandas(write, "doc_id long, format string, graph string, error string")
    return rows.withColumn("digest", F.sha2("graph", 256))


def alternatives(drafted: DataFrame) -> DataFrame:
    """id, count, doc_id (the first that has it) of each different draft; only digests are shuffled."""
    sums = drafted.where("graph is not null").groupBy("digest").agg(F.count("*").alias("count"), F.min("doc_id").alias("doc_id"))
    return sums.select(F.concat(F.lit("alternative-"), F.substring("digest", 1, 24)).alias("id"), "count", "doc_id", "digest")


def graphs_of(found: DataFrame, drafted: DataFrame) -> DataFrame:
    """The graphs of the alternatives, fetched from their first documents."""
    return found.join(drafted.where("graph is not null").select("doc_id", "digest", "graph"), ["doc_id", "digest"])


def manifest(found: DataFrame, drafted: DataFrame) -> DataFrame:
    """One row: input formats, syntax, documents, errors, the suggested alternative and how many there are."""
    formats = drafted.agg(F.array_sort(F.collect_set("format")).alias("formats"), F.count("*").alias("documents"), F.count("error").alias("errors"))
    top = found.agg(F.min(F.struct((-F.col("count")).alias("n"), "id")).alias("top"), F.count("*").alias("alternatives"))
    syntax = F.when(F.array_contains("formats", "xml"), "xml").when(F.array_contains("formats", "json"), "json").otherwise("yaml")
    both = formats.unionByName(top, allowMissingColumns=True)
    whole = both.agg(*[F.max(c).alias(c) for c in both.columns])  # each column is set in one of the two rows
    return whole.select("formats", syntax.alias("syntax"), "documents", "errors", "alternatives", F.col("top.id").alias("suggested"), (-F.col("top.n")).alias("suggested_count"))


def exploded(graphs: DataFrame) -> dict[str, DataFrame]:
    """nodes (schema_id, id, data), collections (schema_id, id) and members (schema_id, collection_id, position, id,
    data) of graphs (schema_id, graph), which are written first: each table is made out of them anew when it is read."""
    graphs = stored(graphs.select("schema_id", "graph"), "graphs")
    nodes = graphs.select("schema_id", F.explode(F.from_json(F.get_json_object("graph", "$.nodes"), "map<string,string>")).alias("id", "data"))
    every = graphs.select("schema_id", F.explode(F.from_json(F.get_json_object("graph", "$.collections"), "map<string,string>")).alias("id", "items"))
    members = every.select("schema_id", F.col("id").alias("collection_id"), F.posexplode(F.from_json("items", "array<string>")).alias("position", "data"))
    members = members.select("schema_id", "collection_id", F.col("position").cast("long").alias("position"), F.get_json_object("data", "$.id").alias("id"), "data")
    return {"nodes": nodes, "collections": every.select("schema_id", "id"), "members": members}


def rebuilt(tables: dict[str, DataFrame]) -> DataFrame:
    """schema_id and, in order, the members of each collection, as exploded() was given them."""
    m = tables["members"].groupBy("schema_id", "collection_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "data"))), lambda x: x["data"]).alias("items"))
    return tables["collections"].withColumnRenamed("id", "collection_id").join(m, ["schema_id", "collection_id"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def repeated_names(members: DataFrame) -> DataFrame:
    """schema_id, collection_id, name that more than one property or attribute of a collection has."""
    kind, get = F.get_json_object("data", "$.kind"), lambda p: F.coalesce(F.get_json_object("data", p), F.lit(""))
    name = F.when(kind == "property", get("$.name")).otherwise(F.concat(F.lit("{"), get("$.name.namespaceUri"), F.lit("}"), get("$.name.localName")))
    return members.where(kind.isin("property", "xmlAttribute")).groupBy("schema_id", "collection_id", name.alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def edges(tables: dict[str, DataFrame]) -> DataFrame:
    """schema_id, parent, child: nodes by their members and by direct references."""
    nodes = tables["nodes"]
    named = lambda paths: F.explode(F.filter(F.array(*[F.get_json_object("data", p) for p in paths]), lambda x: x.isNotNull()))
    direct = nodes.select("schema_id", F.col("id").alias("parent"), named([f"$.{f}" for f in LINKS]).alias("child"))
    of = nodes.select("schema_id", F.col("id").alias("parent"), named([f"$.{f}.id" for f, _ in COLLECTIONS.values()]).alias("collection_id"))
    value = F.get_json_object("data", "$.valueNodeId").alias("child")
    return direct.unionByName(tables["members"].join(of, ["schema_id", "collection_id"]).select("schema_id", "parent", value))


def subtrees(found: DataFrame) -> DataFrame:
    """schema_id, ids, sizes: the nodes of each graph (edges: schema_id, parent, child) in preorder and how many nodes the
    subtree of each has, so that a subtree is a stretch of ids; null if the graph is no forest."""

    @F.pandas_udf("struct<ids:array<string>,sizes:array<int>>")
    def labels(graphs: pd.Series) -> pd.DataFrame:
        rows = [_preorder([(e["parent"], e["child"]) for e in g]) for g in graphs]
        return pd.DataFrame({"ids": [r and r[0] for r in rows], "sizes": [r and r[1] for r in rows]})

    graphs = found.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("parent", "child"))).alias("edges"))
    return graphs.select("schema_id", labels("edges").alias("l")).select("schema_id", "l.ids", "l.sizes")


def _preorder(pairs: list[tuple[str, str]]) -> tuple[list[str], list[int]] | None:
    below: dict[str, list[str]] = {}
    for parent, child in pairs:
        below.setdefault(parent, []).append(child)
    children = {c for _, c in pairs}
    if len(children) < len(pairs):
        return None  # a node below two others
    ids: list[str] = []
    sizes: dict[str, int] = {}
    pending = [(top, False) for top in sorted(below.keys() - children, reverse=True)]
    while pending:
        node, done = pending.pop()
        if done:
            sizes[node] = 1 + sum(sizes[c] for c in below.get(node, ()))
            continue
        ids.append(node)
        pending.append((node, True))
        pending += [(c, False) for c in reversed(below.get(node, ()))]
    return (ids, [sizes[i] for i in ids]) if len(ids) == len(below.keys() | children) else None  # else there is a cycle


def contained(found: DataFrame, tops: DataFrame, max_depth: int = 3 * MAX_DEPTH) -> DataFrame:
    """schema_id, ancestor, node: what the subtree of each asked node (tops: schema_id, ancestor) contains, itself
    included. Of a tree it is a stretch of its nodes in preorder, whatever its depth; graphs that are no trees are gone
    through level by level."""
    tops = tops.select("schema_id", "ancestor").distinct()
    labelled = stored(subtrees(found), "subtrees")
    asked = tops.join(labelled, "schema_id", "left").withColumn("at", F.array_position("ids", F.col("ancestor")))
    inside = F.when(F.col("at") > 0, F.slice("ids", F.col("at").cast("int"), F.element_at("sizes", F.col("at").cast("int")))).otherwise(F.array("ancestor"))
    strange = labelled.where("ids is null").select("schema_id")
    simple = asked.join(strange, "schema_id", "left_anti").select("schema_id", "ancestor", F.explode(inside).alias("node"))
    if strange.isEmpty():
        return simple
    return simple.unionByName(_reached(found.join(strange, "schema_id", "left_semi"), tops.join(strange, "schema_id", "left_semi"), max_depth))


def _reached(found: DataFrame, tops: DataFrame, max_depth: int) -> DataFrame:
    """contained() of any graph: level by level from the asked nodes down; a level holds only nodes that were not met before."""
    step = found.select("schema_id", F.col("parent").alias("node"), "child")
    level = stored(tops.select("schema_id", "ancestor", F.col("ancestor").alias("node")), "contained")
    met = level
    for _ in range(max_depth):
        below = level.join(step, ["schema_id", "node"]).select("schema_id", "ancestor", F.col("child").alias("node")).distinct()
        level = stored(below.join(met, ["schema_id", "ancestor", "node"], "left_anti"), "contained")
        if level.isEmpty():
            break
        met = met.unionByName(level)
    return met


def read_cursor(cursor: str, schema: int, revision: str, collection: str, limit: int) -> int:
    """The offset of a cursor that belongs to this page."""
    try:
        said = json.loads(base64.urlsafe_b64decode(cursor))
    except (ValueError, binascii.Error) as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(said, list) or said[:-1] != [schema, revision, collection, limit] or type(said[-1]) is not int or said[-1] < 0:
        raise ValueError("invalid cursor")
    return said[-1]


def page(members: DataFrame, nodes: DataFrame, collection: str, after: int = 0, limit: int = 50, revision: str = "s1") -> DataFrame:
    """One page of a collection in every schema: members from position after on, with the value node's kind and label,
    the total and the cursor of the next page (null on the last; see read_cursor)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    get = lambda p: F.get_json_object("data", p)
    here = members.where(F.col("collection_id") == collection)
    totals = here.groupBy("schema_id").agg(F.count("*").alias("total"))
    label = F.coalesce(get("$.name.localName"), get("$.scalarType"), get("$.kind"))
    value = nodes.select("schema_id", F.col("id").alias("value_id"), get("$.kind").alias("value_kind"), label.alias("label"))
    rows = here.where(F.col("position").between(after, after + limit - 1)).withColumn("value_id", get("$.valueNodeId"))
    rows = rows.join(value, ["schema_id", "value_id"], "left").join(totals, "schema_id")
    said = F.concat(F.lit("["), F.col("schema_id").cast("string"), F.lit(f', "{revision}", "{collection}", {limit}, {after + limit}]'))
    cursor = F.translate(F.base64(said.cast("binary")), "+/", "-_")
    more = F.col("total") > after + limit
    return rows.select("schema_id", "position", "id", "value_kind", "label", "total", F.when(more, cursor).alias("next"))


def member_counts(tables: dict[str, DataFrame], rounds: int = 7) -> DataFrame:
    """schema_id, id, members: direct members of each node and of the nodes behind it (content, particle, simple content
    or items, the first that there is), up to 2 ** rounds nodes or to one that was met before.

    A chain never leaves its graph, so the links of a graph meet in one row and each is followed once."""
    own = [f for f, _ in COLLECTIONS.values()]
    said = F.from_json("data", ", ".join([*(f"{f} string" for f in LINKS), *(f"{f} struct<totalItems: string>" for f in own)]))
    counted = sum((F.coalesce(F.col(f"said.{f}.totalItems").cast("long"), F.lit(0)) for f in own), F.lit(0)).cast("long")
    links = F.struct("id", F.coalesce(*[F.col(f"said.{f}") for f in LINKS]).alias("behind"), counted.alias("members"))
    nodes = tables["nodes"].withColumn("said", said).groupBy("schema_id").agg(F.collect_list(links).alias("links"))

    def follow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            graphs, lists = batch.column("schema_id"), batch.column("links")
            ends, links = lists.offsets.to_pylist(), [lists.values.field(c) for c in ("id", "behind", "members")]
            found: list[int] = []
            for start, end in zip(ends, ends[1:]):
                found += _followed(*[c.slice(start, end - start).to_pylist() for c in links], 2**rounds)
            each = pa.array(np.repeat(np.arange(len(graphs)), np.diff(ends)))
            columns = [graphs.take(each), links[0].slice(ends[0], ends[-1] - ends[0]), pa.array(found, pa.int64())]
            yield pa.record_batch(columns, names=["schema_id", "id", "members"])

    return nodes.mapInArrow(follow, f"schema_id {nodes.schema['schema_id'].dataType.simpleString()}, id string, members long")


def _followed(ids: list[str], behind: list[str | None], members: list[int], most: int) -> list[int]:
    """The members of each node and of those behind it, of most nodes and up to one that was met before."""
    at = dict(zip(ids, range(len(ids))))
    after = [at.get(b, -1) for b in behind]
    length: list[float] = [0] * len(ids)  # of the chain from a node on; endless: it runs into a cycle; -1: being followed
    total = [0] * len(ids)
    for i in range(len(ids)):
        way = []
        while i >= 0 and not length[i]:
            length[i] = -1
            way.append(i)
            i = after[i]
        n, held = (0, 0) if i < 0 else (math.inf, 0) if length[i] < 0 else (length[i], total[i])
        for k in reversed(way):
            n, held = n + 1, held + members[k]
            length[k], total[k] = n, held
    for i in range(len(ids)):
        if length[i] > most:
            met: dict[int, int] = {}
            k = i
            while k >= 0 and k not in met and len(met) < most:
                met[k] = members[k]
                k = after[k]
            total[i] = sum(met.values())
    return total


def created(requests: DataFrame, found: DataFrame, drafted: DataFrame) -> DataFrame:
    """Drafts of analysis alternatives (requests: schema_id, alternative_id, title): schema_id, title, outcome (created or
    not_found) and, of those created, revision s1, syntax, dialect, root_node_id and graph."""
    graphs = graphs_of(found, drafted).select(F.col("id").alias("alternative_id"), "graph")
    rows = requests.join(graphs, "alternative_id", "left")
    there, get = F.col("graph").isNotNull(), lambda p: F.get_json_object("graph", p)
    return rows.select(
        "schema_id", "title", F.when(there, "created").otherwise("not_found").alias("outcome"), F.when(there, F.lit("s1")).alias("revision"),
        get("$.profile.syntax").alias("syntax"), get("$.profile.dialect").alias("dialect"), get("$.rootNodeId").alias("root_node_id"), "graph",
    )


def newest(listing: DataFrame, owner: str | None = None, limit: int = 50) -> DataFrame:
    """A listing (owner, created, ...), newest first, of one owner or, for administrators (None), of all."""
    mine = listing if owner is None else listing.where(F.col("owner") == owner)
    return mine.orderBy(F.desc("created"), "id").limit(limit)

