"""Every query of the library runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

from fieldloom import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert plain(rows) == plain(tuple(r[i] for i in order) for r in cur.fetchall())


def test_pages_that_are_no_documents(spark, con, sf_dir):
    """s5_bad_documents against another parser."""
    from xml.dom import minidom
    from xml.parsers.expat import ExpatError

    def reads(text):
        try:
            return bool(minidom.parseString((text or "").encode()))
        except ExpatError:
            return False

    pages = [reads(h) for (h,) in con.execute("select html from pages").fetchall()]
    orders = con.execute("select count(*) from orders").fetchone()[0]
    want = {("read", True): sum(pages), ("error", True): len(pages) - sum(pages), ("read", False): orders}
    assert {(r.outcome, r.page): r.documents for r in QUERIES["s5_bad_documents"](spark, sf_dir).collect()} == {k: n for k, n in want.items() if n}


def test_streams_add_up(spark, sf_dir):
    """Two batches of a stream give what one batch gives."""
    from fieldloom.sources import documents
    from fieldloom.streaming.jobs import incremental_summaries

    import tempfile

    folder = tempfile.mkdtemp()
    rows = [(i, "json", f'{{"a": {i}, "b": "x"}}') for i in range(6)]
    schema = "doc_id long, format string, content string"
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(incremental_summaries(stream)) == key(documents.summaries(spark.createDataFrame(rows, schema)))


def test_streams_go_on_in_their_folder(spark, tmp_path):
    """A second run over one folder adds to the first, and a run without new files gives the same again."""
    from fieldloom.sources import documents
    from fieldloom.streaming.jobs import incremental_summaries, latest

    rows = [(i, "json", f'{{"a": {i}, "b": "x"}}') for i in range(6)]
    schema = "doc_id long, format string, content string"
    key = lambda df: sorted(map(str, df.collect()))
    source, folder, counts = f"{tmp_path}/in", f"{tmp_path}/sums", f"{tmp_path}/counts"
    for k, upto in enumerate((3, 6, 6)):
        if k < 2:
            spark.createDataFrame(rows[upto - 3 : upto], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert key(incremental_summaries(stream, folder)) == key(documents.summaries(spark.createDataFrame(rows[:upto], schema)))
        assert [tuple(r) for r in latest(stream.groupBy("format").count(), ["format"], counts).collect()] == [("json", upto)]
