"""Work that must be spread over tasks, or must not grow faster than its input."""

import json
import os
import pickle
import sys
import uuid

import pytest
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldloom.operators import changes, checks, exports
from fieldloom.plans import artefacts, drafts
from fieldloom.sources import documents as sources
from fieldloom.sources import files
from fieldloom.streaming import jobs


def naming_reader():
    """A reader whose documents are called by the task that reads them."""

    def read(content):
        return [sources.Observation(-1, (), f"task-{TaskContext.get().partitionId()}", "string", content, "document")]

    return {"any": read}


def test_documents_of_one_partition_are_read_by_many_tasks(spark):
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.lit("any").alias("format"), F.col("id").cast("string").alias("content"))
    assert docs.rdd.getNumPartitions() == 1
    found = sources.observations(docs, naming_reader())
    per_task = {r.name: r["count"] for r in found.groupBy("name").count().collect()}
    assert len(per_task) >= 4 and max(per_task.values()) < 200 and sum(per_task.values()) == 400
    assert sources.summaries(docs, naming_reader()).where("what = 'field'").count() >= 4


def test_documents_of_one_skeleton_are_added_up_once(spark, monkeypatch):
    """Equal but for their values; the rows keep values, positions and documents apart."""
    calls = []
    complete = sources.complete
    monkeypatch.setattr(sources, "complete", lambda found, max_depth: calls.append(1) or complete(found, max_depth))
    sums = sources._Sums()
    for i in range(50):
        sums.document(sources.read_json(json.dumps({"a": i, "b": [{"c": str(i)}] * (1 + i % 2)})), sources.MAX_DEPTH)
    rows = sums.rows()
    assert len(calls) == 2
    held = {tuple(r.path): (r.n, r.m) for r in rows[rows.what == "field"].itertuples()}
    assert held[("$document", "b", "[]", "c")] == (75, 75) and held[("$document", "b", "[]")] == (75, 50)
    docs = spark.createDataFrame([(i, "json", json.dumps({"a": i, "b": [{"c": str(i)}] * (1 + i % 2)}) if i % 5 else "{") for i in range(50)], "doc_id long, format string, content string").coalesce(1)
    got = sorted((r.doc_id, r.obs_id, list(r.position), r.value) for r in sources.observations(docs).where("error is null and name in ('a', 'c')").collect())
    assert got == sorted(
        x for i in range(50) if i % 5 for x in [(i, 1, [0], str(i)), *[(i, 4 + 2 * k, [1, k, 0], str(i)) for k in range(1 + i % 2)]]
    )
    assert sources.observations(docs).where("error is not null and name is null").count() == 10
    few = sources.observations(docs, columns=("doc_id", "name"))
    assert few.columns == ["doc_id", "name", "error"] and few.count() == sources.observations(docs).count()


def test_json_documents_of_one_signature_are_read_once(spark, monkeypatch):
    """The others are only parsed; what is rejected, and what differs in a name, a type or an order, is never taken for another."""
    texts = [json.dumps({"a": i, "b": [{"c": str(i)}] * (1 + i % 2)}) for i in range(50)]
    odd = [
        "{", "[", "1", '""', '" "', '"x"', "null", "true", "1.0", "1e999", "-1e999", "NaN", "[]", "{}", "[[]]", "[{}]", '[["a", 1]]', '{"a": 1}', '{"a": 1.5}', '{"a": true}', '{"a": null}', '{"a": "\\u00a0"}', '{"a": 1, "a": 1}', '{"a": 2, "a": 2}',
        '{"": 1}', '{"a": [1, 2]}', '{"a": [1, "x"]}', '{"a": ["a", 1]}', '{"a": 1, "b": 2}', '{"b": 1, "a": 2}', "[" * 127 + "]" * 127, "[" * 128 + "]" * 128, "[" * 300 + "]" * 300, '{"a":' * 9000 + "1" + "}" * 9000, "[" * 100_000, '{"a": 1e999}', '{"a": 2.0}', "9" * 5000,
    ]
    rows = lambda sums: sorted(map(repr, sums.rows().itertuples(index=False)))
    read, signed = sources._Sums(), sources._Sums()
    for text in 2 * (texts + odd):
        for sums, add in ((read, lambda t: read.document(sources.read_json(t), sources.MAX_DEPTH)), (signed, lambda t: signed.content(t, "JSON", sources.READERS, sources.MAX_DEPTH))):
            try:
                add(text)
            except sources._REJECTED:
                sums.n["errors", (), None, None, None] += 1
    assert rows(signed) == rows(read) and read.n["errors", (), None, None, None] > 20
    calls, whole = [], sources.read_json
    monkeypatch.setattr(sources, "read_json", lambda text: calls.append(1) or whole(text))
    for text in texts:
        signed.content(text, "json", {"json": sources.read_json}, sources.MAX_DEPTH)
    assert len(calls) == 2


def test_limits_of_a_summary_need_no_other_pass(spark):
    docs = spark.createDataFrame([(0, "json", '{"a": [1, 2]}'), (1, "json", "{")], "doc_id long, format string, content string")
    have = sources.held(sources.summaries(docs))
    assert have == {"documents": 2, "nodes": 4, "levels": 3}
    sources.Limits(2, 4, 3).hold(have)
    for what, n in have.items():
        try:
            sources.Limits(**{what: n - 1}).hold(have)
            raise AssertionError(what)
        except sources.OverBudget as e:
            assert e.exceeded == {what: n}


def test_drafts_are_made_by_many_tasks_and_once(spark, tmp_path):
    """A graph is written once, however many of its tables are read."""
    folder = str(tmp_path)

    def write(content):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(TaskContext.get().partitionId()))
        return drafts.draft_json(content)

    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.lit("any").alias("format"), F.lit('{"a": [1]}').alias("content"))
    tables = drafts.exploded(drafts.drafts(docs, {"any": write}).select(F.col("doc_id").alias("schema_id"), "graph"))
    assert drafts.edges(tables).count() == 400 and tables["nodes"].count() == 600
    at = [open(f"{folder}/{name}").read() for name in os.listdir(folder)]
    assert len(at) == 200 and len(set(at)) >= 4


def calls_of(work):
    n = [0]
    sys.setprofile(lambda frame, event, arg: n.__setitem__(0, n[0] + (event == "call" and frame.f_code.co_filename == drafts.__file__)))
    try:
        work()
    finally:
        sys.setprofile(None)
    return n[0]


def test_deep_drafts_take_no_more_than_their_nodes():
    deep = lambda n: "[" * n + '{"a": 1}' + "]" * n
    assert calls_of(lambda: drafts.draft_json(deep(120))) < 2.5 * calls_of(lambda: drafts.draft_json(deep(60)))


def test_drafts_of_one_skeleton():
    """Values, but not types, names, their order, marks or texts of another type, may differ."""
    yaml = ["a: [1, x]\nb: 2", "a: [3, y]\nb: 4", "a: [3, 4]\nb: 4", "b: 4\na: [3, y]"]
    xml = ['<a k="1">x<b/></a>', '<a k="2">y<b/></a>', '<a k="z">y<b/></a>', '<a k="2"><b/></a>', '<a k="2">y<b>1</b></a>']
    for make, texts in ((drafts.draft_yaml, yaml), (drafts.draft_xml, xml)):
        drafts._written.clear()
        made = [make(t) for t in texts]
        assert made[0] == made[1] and len(set(made)) == len(made) - 1
        for text, graph in zip(texts, made):
            drafts._written.clear()
            assert make(text) == graph


def test_chains_need_no_round_of_jobs(spark):
    text = drafts.draft_json("[" * 100 + '{"a": 1, "b": 2}' + "]" * 100)
    tables = drafts.exploded(spark.createDataFrame([(k, text) for k in range(3)], "schema_id long, graph string"))
    sc = spark.sparkContext
    sc.setJobGroup("chains", "")
    found = drafts.member_counts(tables)
    sc.setJobGroup("others", "")
    assert len(sc.statusTracker().getJobIdsForGroup("chains")) == 0
    assert sorted((r.schema_id, r.members, r.n) for r in found.groupBy("schema_id", "members").agg(F.count("*").alias("n")).collect()) == sorted(x for k in range(3) for x in [(k, 0, 2), (k, 2, 101)])


def test_a_log_is_replayed_once(spark):
    graphs = spark.createDataFrame([(1, drafts.draft_json('{"a": 1}'))], "schema_id long, graph string")
    log = spark.createDataFrame([(1, 1, "m", "s1", '[{"kind": "renameProperty", "memberId": "member-1", "name": "b"}]')], "schema_id long, seq long, mutation_id string, base_revision string, operations string")
    receipts, after = changes.replayed(graphs, log)
    assert not any("MapInPandas" in df._jdf.queryExecution().toString() for df in (receipts, after))
    assert receipts.first().outcome == "accepted" and after.first().revision == "s2"


def test_schemas_take_no_group_each(spark):
    one = lambda k, n, up, name, kind, type_: (k, f"{k}/{n}", up and f"{k}/{up - 1}", n, name, kind, type_, 1, "1")
    rows = [r for k in range(40) for r in (one(k, 2, 1, "z", "scalar", "null"), one(k, 0, None, f"e{k}", "object", None), one(k, 1, 1, "a", "scalar", "date"))]
    found = exports.xsd(spark.createDataFrame(rows, "schema_id long, id string, parent_id string, position int, name string, kind string, type string, min_occurs long, max_occurs string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {r.schema_id: r.xsd for r in found.collect()}
    assert len(got) == 40 and all(f'name="e{k}"' in x and x.index('name="a"') < x.index('name="z"') for k, x in got.items())


def test_hand_overs_are_fetched_by_many(spark, tmp_path, monkeypatch):
    """As rows and as tables the same."""
    monkeypatch.setattr(jobs, "HELD_CHANGES", 100)
    schema = "seq long, kind string, resource_id long, deleted boolean"
    spark.createDataFrame([(i, "k", i, False) for i in range(995, -1, -1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {True: [], False: []}
    for rows in (True, False):
        sink = lambda given, name, rows=rows: got[rows].append((name, [r.seq for r in (given if rows else given.collect())]))
        jobs.dispatched(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/state-{rows}", limit=10, rows=rows)
    assert got[True] == got[False] and [s for _, part in got[True] for s in part] == list(range(996)) and len(got[True]) == 100
    jobs.write_file(spark, f"{tmp_path}/file", b"x")
    with pytest.raises(Py4JJavaError):
        jobs.write_file(spark, f"{tmp_path}/file", b"y")


def test_texts_go_to_python_in_small_batches_while_a_table_is_saved(spark):
    """32 MB of texts in one task; the session's settings stay as they were."""
    from fieldloom.llm import common

    def sizes(it):
        for pdf in it:
            yield pdf[["n"]].assign(n=len(pdf)).head(1)

    wide = spark.range(0, 8000, 1, 1).select(F.lit(1).cast("long").alias("n"), F.repeat(F.lit("word "), 800).alias("text"))
    before = {key: spark.conf.get(key, None) for key in common.WHILE_SAVED}
    rows = [r.n for r in common.saved(wide.mapInPandas(sizes, "n long"), "sizes").collect()]
    assert sum(rows) == 8000 and max(rows) <= 1000
    assert {key: spark.conf.get(key, None) for key in common.WHILE_SAVED} == before


def test_annotations_are_not_broadcast(spark, tmp_path):
    """Files of many rows can be small: neither sources nor annotations go to the driver, and places that nobody asks for are not shuffled."""
    spark.range(4000).select(
        (F.col("id") / 4).cast("long").alias("doc_id"), F.array((F.col("id") % 4).cast("int")).alias("position"), F.lit("n").alias("name"),
        F.when(F.col("id") % 4 == 3, "attribute").otherwise("element").alias("representation"), F.array(F.lit("n")).alias("path"),
    ).write.parquet(f"{tmp_path}/sources")
    role = lambda *at, attribute="": F.struct(F.array(*map(F.lit, at)).alias("position"), F.lit(attribute).alias("attribute"), F.lit(f"r{at}").alias("role"))
    spark.range(1000).select(F.col("id").alias("doc_id"), F.explode(F.array(role(0), role(3, attribute="n"), role(2, 5), role(9))).alias("r")).select("doc_id", "r.*").write.parquet(f"{tmp_path}/expected")
    src, expected = spark.read.parquet(f"{tmp_path}/sources"), spark.read.parquet(f"{tmp_path}/expected")
    matched = checks.annotated(src, expected)
    found = checks.missing_annotations(matched, src.where("position = array(2)").select("doc_id", "position"))
    assert {(r.outcome, r.role): r["count"] for r in found.groupBy("outcome", "role").count().collect()} == {("normalised", "r(2, 5)"): 1000, ("missing", "r(9,)"): 1000}
    assert {r.role: r["count"] for r in matched.where("path is not null").groupBy("role").count().collect()} == {"r(0,)": 1000, "r(3,)": 1000}
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and joins and all("LeftSemi" in line for line in joins)


def test_sources_of_an_artefact_can_be_compressed(spark, tmp_path):
    """The same lines, plain and compressed: plain ones are many times the table that they are written from."""
    at = F.array((F.col("id") % 3).cast("int"))
    src = spark.range(0, 20000, 1, 2).select(F.array(F.lit("a"), F.lit("b")).alias("path"), (F.col("id") / 3).cast("long").alias("doc_id"), at.alias("position"), F.lit("b").alias("name"), F.lit("element").alias("representation"), F.sha2(F.lit("v"), 256).alias("variant_id"))
    artefacts.write_sources(src, f"{tmp_path}/plain")
    artefacts.write_sources(src, f"{tmp_path}/packed", "gzip")
    lines = lambda kind: sorted(r.value for r in spark.read.text(f"{tmp_path}/{kind}").collect())
    size = lambda kind: sum(os.path.getsize(f"{tmp_path}/{kind}/{f}") for f in os.listdir(f"{tmp_path}/{kind}"))
    assert lines("plain") == lines("packed") and len(lines("plain")) == 20000
    assert 10 * size("packed") < size("plain")


def test_parts_of_a_document_go_as_they_are_copied(tmp_path):
    """So that the disk never holds a document twice."""
    writer = files.DocumentWriter({"path": f"{tmp_path}/doc.txt", "frame": json.dumps([("[", "]"), ("(", ")")])})
    messages = []
    for task in range(4):
        folder = f"{writer.parts}/{task}"
        os.makedirs(folder)
        for section in (0, 1):
            with open(f"{folder}/{section}", "wb") as f:
                f.write(writer.SEPARATOR + f"{section}{task}".encode())
        messages.append(files.Parts(task, [0, 1], folder))
    left = []
    text = b""
    for piece in writer._pieces(files.opened(str(tmp_path))[0], messages):
        text += piece
        left.append(sum(len(names) for _, _, names in os.walk(writer.parts)))
    assert text == b"[00,\n01,\n02,\n03](10,\n11,\n12,\n13)"
    assert left == [8, 8, 7, 6, 5, 4, 4, 4, 3, 2, 1, 0]


def test_a_folder_of_many_files_is_not_held_by_the_driver(tmp_path, monkeypatch):
    """Neither what tasks tell the driver of files written, nor what it deals out, has a path a file; paths that repeat are still met."""
    rows = [Row(path=f"part-{i % 16}/document-{i}.json", content="{}") for i in range(6000)]
    writer = files.FileWriter({"path": f"{tmp_path}/out"}, ["path", "content"])
    messages = [writer.write(iter(rows[i::5])) for i in range(5)]
    assert len(pickle.dumps(messages)) < 2000
    monkeypatch.setattr(files, "COMPARED", 500)
    writer.commit(messages)
    assert open(f"{tmp_path}/out/_SUCCESS").read() == "6000" and sorted(os.listdir(f"{tmp_path}/out")) == sorted(["_SUCCESS", *(f"part-{i}" for i in range(16))])
    monkeypatch.setattr(files, "PACKED", 1000)
    reader = files.FileReader({"path": f"{tmp_path}/out", "splitBytes": "5000"})
    tasks = reader.partitions()
    assert len(pickle.dumps(tasks)) < 6 * 6000 and 3 <= len(tasks) <= 5
    assert sorted(p for t in tasks for p in t.paths) == sorted(r.path for r in rows) and sorted(x[1] for x in reader.read(tasks[0])) == sorted(tasks[0].paths)

    twice = files.FileWriter({"path": f"{tmp_path}/twice"}, ["path", "content"])
    messages = [twice.write(iter(rows[i::5])) for i in range(5)] + [None, twice.write(iter([])), twice.write(iter(rows[77:78]))]
    with pytest.raises(ValueError, match="one path"):
        twice.commit(messages)
    twice.abort(messages)
    assert not [n for _, _, names in os.walk(f"{tmp_path}/twice") for n in names]


def test_rows_of_one_path_fail_a_write(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 199, F.lit(".json")).alias("path"), F.lit("{}").alias("content"))
    with pytest.raises(Exception, match="one path"):
        files.write_files(rows.repartition(4, "content", "path"), f"{tmp_path}/out")
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if not n.endswith(".crc")]
