"""Folders of documents, and spaces, evaluations and expressions as documents."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import checks, exports
from fieldloom.operators.names import Lexicon
from fieldloom.plans import artefacts, space
from fieldloom.sources import documents as sources
from fieldloom.sources import files


def built(spark, texts, kind="json", lexicon=None):
    docs = spark.createDataFrame([(i, kind, t) for i, t in enumerate(texts)], "doc_id long, format string, content string")
    return docs, space.build(sources.summaries(docs), lexicon)


# ---- folders


TEXT = '<?xml version="1.0" encoding="{}"?><a>é</a>'


@pytest.mark.parametrize(
    "data, kind, want",
    [
        (TEXT.format("latin-1").encode("latin-1"), "xml", "é"),
        (TEXT.format("utf-8").encode(), "xml", "é"),
        (TEXT.format("latin-1").encode("utf-16"), "xml", "é"),  # the mark goes before what is declared
        (TEXT.format("x").encode("utf-16-be"), "xml", "é"),
        ('{"é":1}'.encode("utf-32"), "json", "é"),
        ('{"é":1}'.encode("utf-16-le"), "json", "é"),
        ('{"é":1}'.encode("utf-8-sig"), "json", "é"),
        (b"a: \xe9", "yaml", None),
        (TEXT.format("no-such").encode(), "xml", None),
        (TEXT.format("latin-1").encode("latin-1"), "json", None),  # only XML declares
        (b"", "json", ""),
    ],
)
def test_decoding(data, kind, want):
    text, error = files.decoded(data, kind)
    assert (text is None) == (want is None) == (error is not None) and (want is None or want in text)
    assert text is None or not text.startswith("﻿")


def test_folder_round_trip(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"d{i % 5}/f{i}.{r.choice(['json', 'XML', 'Yml', 'yaml'])}", f"content {i} é\n") for i in range(60)]
    files.write_files(spark.createDataFrame(rows, "path string, content string").repartition(4), f"{tmp_path}/all")
    assert os.path.exists(f"{tmp_path}/all/_SUCCESS") and not [n for _, _, names in os.walk(tmp_path) for n in names if n.startswith(".") and not n.endswith(".crc")]
    found = files.read_files(spark, f"{tmp_path}/all", splitBytes="100")
    assert found.rdd.getNumPartitions() > 5
    got = found.collect()
    assert {(x.path, x.content) for x in got} == set(rows) and len({x.doc_id for x in got}) == 60 and all(x.size == len(x.content.encode()) and x.error is None for x in got)
    ends = {"json": "json", "xml": "xml", "yml": "yaml", "yaml": "yaml"}
    assert all(x.format == ends[x.path.rpartition(".")[2].lower()] and x.name == x.path.split("/")[1] for x in got)
    assert files.read_files(spark, f"{tmp_path}/all", formats="json").count() == sum(p.endswith("json") for p, _ in rows)


def test_folders_with_other_files(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    (tmp_path / "notes").write_text("no ending")
    (tmp_path / ".json").write_text("hidden")
    with pytest.raises(Exception, match="notes"):
        files.read_files(spark, str(tmp_path)).count()
    got = {r.path: (r.format, r.error is None) for r in files.read_files(spark, str(tmp_path), unknown="reject").collect()}
    assert got == {"x.json": ("json", True), "notes": (None, False)}
    assert {r.path: r.format for r in files.read_files(spark, str(tmp_path), unknown="reject", endings='{"json": "yaml"}').collect()}["x.json"] == "yaml"
    (tmp_path / "empty").mkdir()
    assert files.read_files(spark, f"{tmp_path}/empty").count() == 0
    for path in ("../up.json", "", "a//b"):
        with pytest.raises(Exception):  # noqa: B017
            files.write_files(spark.createDataFrame([(path, "x")], "path string, content string"), f"{tmp_path}/out")


def test_documents_in_order(spark, tmp_path):
    """Items of several rows, over many tasks; sections without rows; nothing is left beside the document."""
    rows = spark.range(500).select((F.col("id") % 3).cast("int").alias("section"), (F.col("id") % 2 == 0).alias("item"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("e"), F.col("id") % 5)).alias("text"), F.floor(F.col("id") / 6).alias("at"), "id")
    path = f"{tmp_path}/deep/doc.txt"
    files.write_document(rows.where("section != 1"), path, [("a[", "]"), ("b[", "]"), ("c[", "]")], "at", "id")
    lists = {s: "" for s in range(3)}
    for x in sorted(rows.where("section != 1").collect(), key=lambda x: x.id):
        lists[x.section] += (",\n" if x["item"] and lists[x.section] else "") + x.text
    assert open(path).read() == f"a[{lists[0]}]b[]c[{lists[2]}]" and os.listdir(f"{tmp_path}/deep") == ["doc.txt"]


def test_a_failed_write_leaves_no_document(spark, tmp_path):
    rows = spark.range(40).select(F.when(F.col("id") == 33, 9).otherwise(0).alias("section"), F.lit(True).alias("item"), F.col("id").cast("string").alias("text"), "id")
    with pytest.raises(Exception):  # noqa: B017
        files.write_document(rows, f"{tmp_path}/doc.txt", [("", "")], "id")
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == []


# ---- spaces


ODD = ['{"a\\"b": [1, "x", {"n": null}], "é\\n": 2.5}', '{"a\\"b": [], "k": {"n": true}}', "[]", '{"k": {"n": 1}}'] * 3


def test_space_document(spark, tmp_path):
    docs, s = built(spark, ODD)
    path = f"{tmp_path}/space.json"
    artefacts.write_space(s, path)
    whole = json.load(open(path))
    assert list(whole) == ["format", "version", "statistics", "roots", "nodes", "warnings"]
    assert whole["statistics"] == {"documents": 12, "fields": s.fields.count()} and whole["warnings"] == []
    assert [n["path"] for n in whole["nodes"]] == sorted(n["path"] for n in whole["nodes"])
    nodes = {n["id"]: n for n in whole["nodes"]}
    for r in s.fields.collect():
        n = nodes[r.field_id]
        assert (n["name"], n["path"], n["occurrences"], n["parent_occurrences"], n["presence_count"], n["presence_probability"]) == (r.name, list(r.path), r.occurrences, r.parent_occurrences, r.presence_count, r.presence_probability)
        counts = [sum(o["count"] for o in n[k]) for k in ("name_alternatives", "data_types", "representations")] + [sum(a["count"] for a in n["content"]["alternatives"])]
        assert counts == [r.occurrences] * 4
        ordered = [(-a["count"], a["id"]) for a in n["content"]["alternatives"]]
        assert ordered == sorted(ordered)
        for a in n["content"]["alternatives"]:
            for c in a["children"]:
                assert nodes[c["node"]]["path"][:-1] == n["path"] and c["variant"] in {x["id"] for x in nodes[c["node"]]["content"]["alternatives"]}
    assert sum(r["count"] for r in whole["roots"]) == 12
    back = artefacts.read_space(spark, path)
    assert {n.id: n.asDict(True) for n in back["nodes"].collect()} == {i: {k: v for k, v in n.items() if k != "content"} for i, n in nodes.items()}
    assert back["alternatives"].count() == sum(len(n["content"]["alternatives"]) for n in whole["nodes"]) and back["roots"].count() == len(whole["roots"])


def test_artefacts_of_a_collection(spark, tmp_path):
    """Warnings, typos, and an evaluation in which something is wrong of every kind."""
    lexicon = Lexicon({"granite": 1e6, "meadow": 1e6}, {}, {}, {}, frozenset())
    docs, s = built(spark, ["<barn><granite>1</granite></barn>", "<barn><granit>1</granit></barn>", '<barn><meadow>a<b/>c</meadow></barn>'], "xml", lexicon)
    src = space.sources(sources.errors(sources.observations(docs))[0], s)
    expected = spark.createDataFrame([(0, [0], "", "stone"), (1, [0], "", "slip"), (2, [0, 0], "", "inside"), (2, [5], "", "gone")], "doc_id long, position array<int>, attribute string, role string")
    matched = checks.annotated(src, expected)
    missing = checks.missing_annotations(matched, src.where("name = 'meadow'").select("doc_id", "position"))
    forbidden = checks.forbidden_merges(matched, spark.createDataFrame([("stone", "slip")], "left string, right string"))
    invalid = checks.field_violations(s.fields.withColumn("presence_probability", F.lit(2.0)).where("name = 'barn'"), s.distributions)
    artefacts.write_artefacts(str(tmp_path), "case", s, src, forbidden, missing, invalid)
    audit = json.load(open(tmp_path / "case.evaluation.json"))
    assert audit["scenario"] == "case" and audit["statistics"] == {"documents": 3, "fields": 3}
    assert audit["forbidden_field_merges"] == [{"path": ["barn", "granite"], "left": "stone", "right": "slip"}]
    assert audit["missing_annotations"] == [{"document": 2, "position": [5], "attribute": "", "role": "gone"}] and audit["normalized_annotations"] == [{"document": 2, "position": [0, 0], "attribute": "", "role": "inside"}]
    assert [x["check"] for x in audit["invalid_distributions"]] == ["presence_not_a_share"]
    node = next(n for n in json.load(open(tmp_path / "case.space.json"))["nodes"] if n["name"] == "granite")
    assert [(t["value"], t["relation"]) for t in node["typos"]] == [("granit", "typo")]
    lines = [json.loads(x) for f in os.listdir(tmp_path / "case.sources") if f.endswith("json") for x in open(tmp_path / "case.sources" / f)]
    assert sorted((x["document"], x["position"], x["name"]) for x in lines if x["node"] == node["id"]) == [(0, [0], "granite"), (1, [0], "granit")]


# ---- expressions


def walk(part):
    yield part
    for c in part["children"]:
        yield from walk(c)


def expressed(spark, tmp_path, texts, kind="json"):
    _, s = built(spark, texts, kind)
    path = f"{tmp_path}/{len(os.listdir(tmp_path))}.json"
    exports.write_expression(s, path)
    return s, json.load(open(path))


def test_expression_of_many_variants(spark, tmp_path):
    """Names are numbered in the order in which the expression holds them, and each has an entry."""
    r = random.Random(4)
    texts = [json.dumps({k: r.choice([1, "x", [{"in": 1}], {"in": {"deep": 1}}, {}]) for k in r.sample(["n", "m", 'q"'], 2)}) for _ in range(30)]
    s, whole = expressed(spark, tmp_path, texts)
    tops = space.roots(s).orderBy(F.desc("count"), "variant_id").collect()
    begin = whole.pop("begin-c/$document-c")
    branches = begin["expression"]["children"]
    assert begin["expression"]["type"] == "OR" and [b["type"] for b in branches] == ["AND"] * len(tops) and [b["probability"] for b in branches] == [t.probability for t in tops]
    assert begin["XSDTypes"] == {"parent": 1.0} and "presence_probability" not in begin
    order, trees = [], {(tuple(v.path), v.variant_id): v for v in s.variants.collect()}

    def compare(part, variant):
        """part is a leaf's or branch's children; variant what it must hold."""
        assert len(part["children"]) == (1 if variant.children else 0)
        below = part["children"][0]["children"] if variant.children else []
        assert [c["value"].rpartition("/")[2] for c in below] == [f"{k.path[-1]}-{'c' if trees[tuple(k.path), k.variant_id].kind == 'fields' else 's'}" for k in variant.children]
        for c, k in zip(below, variant.children):
            order.append(c["value"])
            compare(c, trees[tuple(k.path), k.variant_id])

    for b, t in zip(branches, tops):
        order.append(None)
        compare(b, trees[tuple(t.path), t.variant_id])
    numbers = [int(k.partition("-")[0][7:]) for k in whole]
    assert sorted(numbers) == list(range(1, len(order) + 1))
    assert [k and int(k.partition("-")[0][7:]) for k in order] == [None if k is None else i for i, k in enumerate(order, 1)]
    assert all(e["expression"] == {} for e in whole.values())


def test_expression_of_one_variant(spark, tmp_path):
    _, whole = expressed(spark, tmp_path, ["<{urn:x}o><p>1</p></{urn:x}o>".replace("{urn:x}", ""), "<o><p/></o>"], "xml")
    assert whole["begin-c/o-c"]["expression"]["type"] == "AND" and whole["begin-c/o-c"]["presence_probability"] == 1.0
    assert whole["context1-c/p-s"]["XSDTypes"] == {"empty": 0.5, "integer": 0.5}
    _, whole = expressed(spark, tmp_path, ['<x:o xmlns:x="urn:x"/>'], "xml")
    assert whole == {"begin-c/o-s": {"expression": {}, "typoSpace": {}, "semanticSpace": {}, "XSDTypes": {"empty": 1.0}, "attributes": {}, "presence_probability": 1.0}}


def test_expression_of_several_roots(spark, tmp_path):
    _, whole = expressed(spark, tmp_path, ["<o><p/></o>", "<o><p/></o>", "<u/>"], "xml")
    top = whole["begin-c/documents-c"]["expression"]
    assert [(c["type"], c["value"], round(c["probability"], 6)) for c in top["children"]] == [("LEAF", "context1-c/o-c", 0.666667), ("LEAF", "context3-c/u-s", 0.333333)]
    assert {p["value"] for p in walk(top) if p["type"] == "LEAF"} == whole.keys() - {"begin-c/documents-c"}
    assert expressed(spark, tmp_path, [])[1] == {}


def test_shares_of_types_of_one_name(spark):
    """XML's double and JSON's number get one name."""
    docs = spark.createDataFrame([(1, "xml", "<o>1e2</o>"), (2, "yaml", "o: 1.5"), (3, "yaml", "o: x")], "doc_id long, format string, content string")
    s = space.build(sources.summaries(docs))
    assert exports.type_shares(s.distributions).first().types == {"double": 2 / 3, "string": 1 / 3}


def test_another_writer(spark, tmp_path):
    _, s = built(spark, ["{}"])
    writer = lambda s: (s.fields.select(F.lit(0).alias("section"), F.lit(True).alias("item"), F.col("name").alias("text")), [("<", ">")], ["text"])
    exports.write_expression(s, f"{tmp_path}/own", writer)
    assert open(tmp_path / "own").read() == "<$document>"
