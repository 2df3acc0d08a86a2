"""Drafts, their tables, and ordered edits."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import changes
from fieldloom.plans import drafts


def graph(text, kind="json"):
    return json.loads((drafts.draft_json if kind == "json" else drafts.draft_xml)(text))


def test_json_graph():
    g = graph('{"b": [1, "x", 2], "a": [], "c": {"d": null}}')
    root = g["nodes"][g["rootNodeId"]]
    members = g["collections"][root["properties"]["id"]]
    assert [m["name"] for m in members] == ["b", "a", "c"] and root["properties"]["totalItems"] == 3
    kinds = [g["nodes"][m["valueNodeId"]] for m in members]
    assert kinds[1]["maxItems"] == 0 and g["nodes"][kinds[1]["itemsNodeId"]]["scalarType"] == "null"
    union = g["nodes"][kinds[0]["itemsNodeId"]]
    assert [m["title"] for m in g["collections"][union["options"]["id"]]] == ["Variant 1", "Variant 2"]
    assert union["kind"] == "union" and union["options"]["totalItems"] == 2
    assert root["id"] == f"node-{len(g['nodes'])}" and g["profile"] == {"syntax": "json", "dialect": "json-schema-2020-12"}
    assert drafts.draft_json('{"a":1,"b":2}') == drafts.draft_json('{"a":5,"b":7}') != drafts.draft_json('{"b":5,"a":7}')


def test_yaml_graph():
    y, j = json.loads(drafts.draft_yaml("a: {b: [1, x], c: ' ', d: 2024-01-02}")), graph('{"a": {"b": [1, "x"], "c": " ", "d": "t"}}')
    types = lambda g: [n.get("scalarType") for n in g["nodes"].values()]
    assert y["collections"] == j["collections"] and types(y) == ["date" if t == "string" and i == 5 else t for i, t in enumerate(types(j))]
    for bad in ("a: &x [1]\nb: *x", "1: a", ""):
        with pytest.raises(ValueError):
            drafts.draft_yaml(bad)


def test_draft_limits():
    with pytest.raises(ValueError):
        drafts.draft_json("[" * 130 + "]" * 130)
    with pytest.raises(ValueError):
        drafts.draft_xml('<a xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="maybe"/>')


def test_cursors():
    text = base64.urlsafe_b64encode(b'[7, "s1", "collection-1", 5, 10]').decode()
    assert drafts.read_cursor(text, 7, "s1", "collection-1", 5) == 10
    for bad in ((text, 7, "s2", "collection-1", 5), (text, 8, "s1", "collection-1", 5), ("?", 7, "s1", "collection-1", 5)):
        with pytest.raises(ValueError):
            drafts.read_cursor(*bad)


def test_xml_rename_and_undo():
    g = graph('<o a="1" b="2"><p/><q/></o>', "xml")
    e = changes.Editor(g)
    before = json.dumps(g, sort_keys=True)
    name = lambda n: {"namespaceUri": None, "localName": n}
    ids = {m["name"]["localName"]: m["id"] for rows in g["collections"].values() for m in rows if "name" in m}
    renames = lambda to: {"kind": "renameXmlName", "target": {"kind": "member", "id": ids["a"]}, "name": name(to)}
    for bad in ([renames("c"), renames("b")], [renames("c"), renames("1x")], [renames("c"), {"kind": "moveMember", "memberId": ids["a"], "targetCollectionId": "collection-9"}]):
        with pytest.raises(changes.Rejected):
            e.apply(bad)
        assert json.dumps(g, sort_keys=True) == before
    e.apply([renames("c"), {"kind": "renameXmlName", "target": {"kind": "node", "id": g["rootNodeId"]}, "name": name("r")}])
    assert g["nodes"][g["rootNodeId"]]["name"]["localName"] == "r"


def test_xml_graph():
    g = graph('<o xmlns="urn:x" id="1"><p>2</p>text<q/></o>', "xml")
    root = g["nodes"][g["rootNodeId"]]
    content = g["nodes"][root["contentNodeId"]]
    assert root["name"] == {"namespaceUri": "urn:x", "localName": "o"} and content["mixed"] and content["attributes"]["totalItems"] == 1
    assert g["nodes"][content["particleNodeId"]]["particles"]["totalItems"] == 2


def rename(member, name):
    return {"kind": "renameProperty", "memberId": member, "name": name}


def test_replay(spark):
    text = drafts.draft_json('{"a": 1, "b": {"c": 2}}')
    g = json.loads(text)
    root = g["nodes"][g["rootNodeId"]]["properties"]["id"]
    ids = {m["name"]: m["id"] for items in g["collections"].values() for m in items}
    inner = next(n["properties"]["id"] for n in g["nodes"].values() if n["kind"] == "object" and n["properties"]["id"] != root)
    move = lambda m, c, before=None: {"kind": "moveMember", "memberId": m, "targetCollectionId": c, "beforeMemberId": before}
    log = [
        ("m1", "s1", [rename(ids["a"], "x")]), ("m1", "s1", [rename(ids["a"], "x")]), ("m1", "s1", [rename(ids["a"], "y")]), ("m2", "s1", [rename(ids["a"], "z")]),
        ("m3", "s2", [rename(ids["a"], "b")]), ("m4", "s2", [rename(ids["a"], "q"), move(ids["b"], inner)]), ("m5", "s2", [move(ids["c"], root, ids["a"])]), ("m6", "s3", [{"kind": "nonsense"}]),
    ]
    rows = [(7, i, m, base, json.dumps(ops)) for i, (m, base, ops) in enumerate(log)] + [(8, 0, "m1", "s1", "[]")]
    frame = spark.createDataFrame(rows, "schema_id long, seq long, mutation_id string, base_revision string, operations string")
    receipts, after = changes.replayed(spark.createDataFrame([(7, text)], "schema_id long, graph string"), frame)
    got = {(r.schema_id, r.seq): (r.outcome, r.revision) for r in receipts.collect()}
    assert [got[7, i] for i in range(8)] == [("accepted", "s2"), ("replayed", "s2"), ("idempotency_conflict", None), ("revision_conflict", None), ("rejected", None), ("rejected", None), ("accepted", "s3"), ("rejected", None)]
    assert got[8, 0] == ("no_schema", None)
    end = after.first()
    final = json.loads(end.graph)
    assert end.revision == "s3" and [m["name"] for m in final["collections"][root]] == ["c", "x", "b"] and final["collections"][inner] == []
    assert final["nodes"][final["rootNodeId"]]["properties"]["totalItems"] == 3


def test_replay_holds_no_whole_log(spark):
    """Receipts come batch by batch, and graph, revision and accepted ids pass from one batch to the next."""
    text = drafts.draft_json('{"a": 1}')
    rows = [(s, i, f"m{i // 2}", f"s{i // 2 + 1}", json.dumps([rename("member-1", f"n{i // 2}")])) for s in (3, 5, 9) for i in reversed(range(40))]
    log = spark.createDataFrame(rows, "schema_id long, seq long, mutation_id string, base_revision string, operations string")
    graphs = spark.createDataFrame([(s, text) for s in (3, 9, 11)], "schema_id long, graph string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        receipts, after = changes.replayed(graphs, log)
        got = sorted((r.schema_id, r.seq, r.outcome, r.revision) for r in receipts.collect())
        ends = {r.schema_id: r.revision for r in after.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = lambda s: [(s, i, "replayed" if i % 2 else "accepted", f"s{i // 2 + 2}") for i in range(40)]
    assert got == known(3) + [(5, i, "no_schema", None) for i in range(40)] + known(9)
    assert ends == {3: "s21", 9: "s21", 11: "s1"}
    assert "CoGroup" not in receipts._jdf.queryExecution().toString()


def test_tables_round_trip(spark):
    text = drafts.draft_json('{"a": [1, {"z": 1}], "b": {"c": 2}}')
    tables = drafts.exploded(spark.createDataFrame([(1, text)], "schema_id long, graph string"))
    back = {r.collection_id: [json.loads(x) for x in r["items"]] for r in drafts.rebuilt(tables).collect()}
    assert back == json.loads(text)["collections"]
    root = json.loads(text)["rootNodeId"]
    inside = {(r.ancestor, r.node) for r in drafts.contained(drafts.edges(tables), spark.createDataFrame([(1, root), (1, "node-1")], "schema_id long, ancestor string")).collect()}
    assert {n for a, n in inside if a == root} == set(json.loads(text)["nodes"]) and {n for a, n in inside if a == "node-1"} == {"node-1"}


def test_subtrees_of_trees_and_other_graphs(spark):
    """Nodes below two others, cycles, chains of a thousand; nodes without edges."""
    pairs = [(1, "a", "b"), (1, "a", "c"), (1, "c", "d"), (2, "a", "b"), (2, "a", "c"), (2, "b", "d"), (2, "c", "d"), (3, "a", "b"), (3, "b", "c"), (3, "c", "b"), (5, "x", "y"), (5, "u", "v")]
    pairs += [(4, f"n{i}", f"n{i + 1}") for i in range(1000)]
    tops = [(1, "a"), (1, "c"), (1, "c"), (1, "none"), (2, "a"), (2, "c"), (3, "a"), (3, "c"), (4, "n0"), (4, "n990"), (5, "u"), (6, "alone")]
    got = {}
    for r in drafts.contained(spark.createDataFrame(pairs, "schema_id long, parent string, child string"), spark.createDataFrame(tops, "schema_id long, ancestor string")).collect():
        got.setdefault((r.schema_id, r.ancestor), []).append(r.node)
    below = {}
    for g, a, b in pairs:
        below.setdefault((g, a), set()).add(b)

    def reach(g, node):
        seen, pending = {node}, [node]
        while pending:
            for c in below.get((g, pending.pop()), ()):
                if c not in seen:
                    seen.add(c)
                    pending.append(c)
        return sorted(seen)

    assert {k: sorted(v) for k, v in got.items()} == {t: reach(*t) for t in tops}


def test_members_behind_chains_and_cycles(spark):
    """Chains of many lengths around powers of two, cycles with a way into them, references to nodes that there aren't."""
    link, size = {}, {}
    for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 40):
        for i in range(n):
            link[f"c{n}-{i}"] = f"c{n}-{i + 1}" if i + 1 < n else None
    for n in (1, 3, 8):
        for i in range(n):
            link[f"r{n}-{i}"] = f"r{n}-{(i + 1) % n}"
        link[f"in{n}"] = f"r{n}-0"
    link["lost"] = "nowhere"
    for i, k in enumerate(sorted(link)):
        size[k] = i % 5 + 1
    rows = [(1, k, json.dumps({"kind": "array", "itemsNodeId": to, "properties": {"id": "c", "totalItems": size[k]}})) for k, to in link.items()]
    nodes = spark.createDataFrame(rows, "schema_id long, id string, data string")

    def total(node, steps):
        seen = []
        while node in link and node not in seen and len(seen) < steps:
            seen.append(node)
            node = link[node]
        return sum(size[n] for n in seen)

    for rounds in (3, 4):
        got = {r.id: r.members for r in drafts.member_counts({"nodes": nodes}, rounds).collect()}
        assert got == {k: total(k, 2**rounds) for k in link}
