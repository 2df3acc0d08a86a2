"""Periodic runs, the Merkle manifest and nearest neighbours against brute-force versions."""

from __future__ import annotations

import itertools
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from fieldloom.llm import merkle, neighbours, periodic


def slow_runs(words, least_words=6, least_turns=4):
    """Every period at every place, word by word."""
    n, out = len(words), []
    for q in range(1, n // least_turns + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(least_words, least_turns * q) and not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(i + 1, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


turns = st.tuples(st.lists(st.sampled_from("abc"), max_size=8), st.integers(1, 9)).map(lambda x: x[0] * x[1])
lines = st.lists(turns, max_size=6).map(lambda parts: [w.encode() for p in parts for w in p])


@settings(max_examples=300, deadline=None)
@cases(st.lists(lines, min_size=1, max_size=4))
def test_runs_of_many_texts(texts):
    assert [[tuple(r) for r in runs.tolist()] for runs in periodic.search(texts)] == [slow_runs(w) for w in texts]


@settings(max_examples=200, deadline=None)
@cases(st.integers(-5, 10**12), st.integers(0, 60))
def test_planted_repetition(doc_id, n):
    words = [b"%d" % i for i in range(n)]
    h = zlib.crc32(str(doc_id).encode())
    want = list(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    assert periodic.planted(str(doc_id), words) == want
    assert periodic.planted(None, words) == words


def test_periodic_runs_query(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = periodic.planted(str(r.doc_id), (r.text or "").encode().split())
        runs = slow_runs(words[:400]) if len(words) <= 400 else [tuple(x) for x in periodic.runs_of(np.unique(np.array(words, object), return_inverse=True)[1]).tolist()]
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[r.doc_id] = (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())
    got = {r.doc_id: tuple(r)[1:8] for r in periodic.op11_periodic_runs(spark, sf_dir).collect()}
    assert got == want and sum(w[0] for w in want.values()) > 20


def test_very_long_and_odd_texts(spark):
    many = "tick tock " * 300_000
    rows = [(1, many, 0), (2, "a b\x1cc " * 6, 0), (3, "x " * 5, 0), (4, "x " * 6, 0), (5, None, 0), (None, "x " * 6, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 600_000, 2)] and got[1].collapsed == "tick tock" and got[1].n_kept == 2
    assert [tuple(x) for x in got[2].runs] == [(0, 6, 1)]  # only ASCII white space parts words
    assert got[3].runs == [] and [tuple(x) for x in got[4].runs] == [tuple(x) for x in got[None].runs] == [(0, 6, 1)]
    assert got[5].n_words == 0 and got[5].collapsed == ""


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_manifest(rows, fanout=8):
    """Of (key, lang, leaf), in order, by lang: key to (leaf, subroot, root, sha256 of the proof)."""

    def fold(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            run = range(i - i % fanout, min(len(level), i - i % fanout + fanout))
            out += [level[j] for j in run if j != i]
            i //= fanout
        return out

    langs = {}
    for key, lang, leaf in rows:
        langs.setdefault(lang, []).append((key, leaf))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [fold([leaf for _, leaf in langs[x]]) for x in order]
    top = fold([t[-1][0] for t in trees])
    return {k: (leaf, t[-1][0], top[-1][0], h(*siblings(t, i), *siblings(top, n))) for n, (x, t) in enumerate(zip(order, trees)) for i, (k, leaf) in enumerate(langs[x])}


@pytest.mark.parametrize("height, langs", [(1, 3), (1, 70), (2, 1)])
def test_butterfly_over_many_partitions(spark, height, langs):
    """Trees of several rounds, with subtrees that are not full at each of them, and more langs than one node holds."""
    sizes = [700, 65, 64, 9, 8, 1, *[1] * 64][:langs]
    names = [None, "é", "z", "a", "", "A", *[f"x{i:02}" for i in range(64)]][:langs]
    rows = [(1000 * i + n, f"Text {n} of {i}", g, None if n % 3 else "s", n) for i, (g, size) in enumerate(zip(names, sizes)) for n in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = slow_manifest([(d, g, h(part(d), part(s), part(g), part(n), part(t))) for d, t, g, s, n in sorted(rows)])
    got = merkle.manifest(docs, height=height).collect()
    assert {r.row_id: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in got} == want and len(got) == len(rows)
    assert all(r.folded_root == r.root for r in got)


def test_tampering_is_found(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["A", "a", "É", None, "", "xY"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    from pyspark.sql import functions as F

    got = merkle.manifest(docs, F.lower("text"), height=1).collect()
    assert {r.row_id for r in got if r.folded_root != r.root} == {i for i, t, *_ in rows if t and t != t.lower()}
    assert len({r.root for r in got}) == 1


def test_equal_and_null_ids_are_leaves_of_their_own(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1 n_chars", "'x' rank", "'x' node")
    got = merkle.manifest(docs, height=1).collect()
    assert len(got) == len(rows) and all(r.folded_root == r.root for r in got) and len({r.leaf for r in got}) == 4


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (6, 2)])
def test_hilbert_curve_goes_cell_by_cell(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = neighbours.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def slow_nearest(rows, ask, k=20):
    """query_id to its k nearest (score, id), over all rows."""
    rows = list({(i, tuple(v)): None for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    width = max((len(v) for _, v in rows), default=0)
    x = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        x[i, : len(v)] = np.float32(v)
    out = {}
    for i, (q, _) in enumerate(rows):
        if ask(q):
            scores = (x * x[i]).sum(axis=1)
            out[q] = sorted((-s, j) for n, (s, (j, _)) in enumerate(zip(scores.tolist(), rows)) if n != i)[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert found.keys() == want.keys()
    for q, rows in found.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, len(want[q]) + 1))
        assert [x[1:] for x in sorted(rows)] == sorted(x[1:] for x in rows)
    # as good as the true ones: of equal scores any may be found
    good = sum(s <= want[q][-1][0] + 1e-12 for q, rows in found.items() for _, s, _ in rows)
    return good / sum(map(len, want.values()))


def test_nearest_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = neighbours.op13_nearest(spark, sf_dir).collect(), slow_nearest(rows, lambda i: i % 20 == 0)
    assert recall(got, want) == 1  # one page holds them all
    assert all(abs(r.score - (-want[r.query_id][r.rank - 1][0])) < 1e-12 for r in got)
    assert all(r.vec_id == want[r.query_id][r.rank - 1][1] for r in got)


@pytest.mark.parametrize("kind", ["clusters", "lengths", "none"])
def test_recall_over_many_pages(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "PAGE", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    if kind == "clusters":
        x = (0.2 * x + 3 * rng.normal(size=(50, 24))[rng.integers(0, 50, 4000)]).astype(np.float32)
    if kind == "lengths":  # the longest vectors answer most queries
        x *= np.exp(rng.normal(size=(4000, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0").collect()
    assert recall(got, slow_nearest(rows, lambda i: i % 20 == 0)) >= 0.9


def test_common_vectors_ties_and_odd_rows(spark, monkeypatch):
    """A vector that a third of all rows share, repeated rows and ids, unusable and short vectors."""
    monkeypatch.setattr(neighbours, "PAGE", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(600)]
    rows += [(40, [1.0, 2.0, 0.0]), (60, rows[60][1]), (80, [9.0]), (None, [1.0, 1.0, 1.0]), (20_000, None), (20_020, []), (20_040, [0.0, 0.0, 0.0]), (20_060, [1.0, None, 1.0]), (20_080, [float("nan"), 1.0, 1.0]), (20_100, [float("inf"), 1.0, 1.0])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string")
    got = neighbours.nearest(docs, "vec_id % 20 = 0").where("query_id not in (40, 80)").collect()
    want = {q: w for q, w in slow_nearest(rows, lambda i: i % 20 == 0).items() if q not in (40, 80)}
    assert recall(got, want) >= 0.9
    hot = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 300 and r.score == 5.0]
    assert hot == [w[1] for w in want[300] if w[0] == -5.0]


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.nearest(spark.createDataFrame(rows[1:], "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect() == []
