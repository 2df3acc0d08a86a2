"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; on empty
tables; and against a brute-force version on the smallest given tables."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from fieldloom.llm import decontaminate, entry, linededup, packing, pii, quality, secrets, shards, similar, simhash, tokens, toxicity, warc

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, f"first line\n{PASSAGE}\nlast", "en"),
    (2, f"other\n{PASSAGE}\nend 4111 1111 1111 1111 a.b@c.example 10.0.0.1", "en"),
    (2, f"other\n{PASSAGE}\nend 4111 1111 1111 1111 a.b@c.example 10.0.0.1", "en"),
    (3, None, None),
    (4, "", "en"),
    (None, "no id here", "en"),
    (None, None, None),
    (5, "x", "en"),
    (6, LONG + "😀 token = 'abcdefgh'\n\n \t\n" + LONG, "en"),
    (7, LONG + "😀 token = 'abcdefgh'\n\n \t\n" + LONG, "en"),
    (8, "Q" * 20000, "en"),
    (9, "user=bob secret: hunter22hunter22 https://db.example.com/x", "en"),
]


def folder_of(spark, tmp, rows=ROWS, benchmark=((1, PASSAGE), (2, None), (None, "no id here"), (3, "x"))):
    docs = spark.createDataFrame([(i, t, g, "clash", 0, 1, "s", 7, None) for i, t, g in rows], "doc_id long, text string, lang string, word string, n long, pos int, spans string, n_chars long, source string")
    docs.write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1), (7, 1, 0), (4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([(i, "u", t, "x") for i, t, _ in rows], "page_id long, url string, html string, payload string").write.parquet(f"{tmp}/pages.parquet")
    vectors = [(i, None if t is None else [float(len(t)), float(len(t.split())), 1.0], "x") for i, t, _ in rows]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, page string").write.parquet(f"{tmp}/embeddings.parquet")
    return str(tmp)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    return folder_of(spark, tmp_path_factory.mktemp("edge") / "t")


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - {"op13_nearest"}))
def test_edge_rows(spark, edge, name):
    """One row an input row (op8: a piece), equal rows have equal results, nothing crashes."""
    rows = entry.queries()[name](spark, edge).collect()
    ids = sorted((r["page_id" if name == "op4_warc" else "doc_id"] for r in rows), key=str)
    assert ids == sorted((i for i, _, _ in ROWS), key=str) if name != "op8_packing" else set(ids) == {i for i, _, _ in ROWS}
    drop = {"start", "sequence_id", "offset", "record_type", "refers_to", "proof_sha256"}
    twice = [{k: v for k, v in r.asDict().items() if k not in drop} for r in rows if r[0] == 2 or r.asDict().get("doc_id") == 2]
    assert len(twice) < 2 or all(t == twice[0] for t in twice)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert entry.queries()[name](spark, folder_of(spark, tmp_path / "t", rows=[], benchmark=[])).collect() == []


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(map(str, df.select(*columns).collect() and [tuple(r) for r in df.select(*columns).collect()])) == sorted(map(str, cur.fetchall()))


def test_line_dedup_cuts_later_copies(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    out = linededup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert PASSAGE in texts[1] and PASSAGE not in texts[2] and texts[2].startswith("other\nend") and texts[3] is None


def test_line_dedup_deletes_maximal_runs(spark):
    """Runs go to their first and last line, also where these are too short to fill a window of their own."""
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    a, b, c, d = words("a", 10), words("b", 45), words("c", 10), words("d", 20)
    long, short = words("l", 100), words("s", 30)
    rows = [
        (1, "\n".join(["one", a, b, "", c, "two"])),
        (2, "\n".join(["three", a, b, c, "four"])),
        (3, "\n".join([long, short, "x"])),
        (4, "\n".join(["y", long, short])),
        (5, "\n".join([d, d, d, d])),
        (6, "\n".join([d, "z", d])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in linededup.without_repeated_lines(docs).collect()}
    assert kept == dict(rows) | {2: "three\nfour", 4: "y", 5: d}


def test_tokens_match_the_library():
    e = tokens.Encoder(tokens.default_path())
    rng = np.random.default_rng(0)
    parts = list("abzABZ019.,!%'’“—éÉèß ñ̸́=<>|\n\t \x1c\x85İΣςσ한你😀①²ﬁ") + ["<|endoftext|>", "'s", "don't", "=="]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)]
    want = [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.many([t.encode() for t in texts]) == want


def encoded(given, end):
    e = tokens.Encoder(tokens.default_path())
    return {d: np.array([*x.ids, end], "<u4") for (d, _), x in zip(given, e.tokenizer.encode_batch([t or "" for _, t in given], add_special_tokens=False))}


def test_token_shards(spark, sf_dir, given):
    ids, start, want = encoded(given, 2), 0, []
    for d, _ in given:
        want.append((d, start, len(ids[d]), zlib.crc32(ids[d].tobytes())))
        start += len(ids[d])
    assert sorted(map(tuple, shards.op2_token_ids(spark, sf_dir).collect())) == want


def test_many_shards_in_one_partition(spark):
    """Over a thousand shards: the writer's file names no longer sort, the starts must."""
    n = 1100
    docs = spark.createDataFrame([(7 * i - 50, f"w{i} " * (i % 4)) for i in range(n)], "doc_id long, text string")
    path = shards.new_path(spark, "many-shards")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        shards.write_shards(docs, path, tokens.default_path(), shard_bytes=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    start = 0
    for r in sorted(shards.read_shards(spark, path).collect()):
        assert r.start == start
        start += r.n_tokens


def test_packing_certificate(spark, sf_dir):
    rows = packing.op8_packing(spark, sf_dir).collect()
    assert all(r.bound <= r.bins for r in rows) and any(r.bins > 1 for r in rows)


def test_table_of_runs_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_RUNS", 500)
    e = tokens.Encoder(tokens.default_path())
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abcdé'1,."), rng.integers(1, 30))) for _ in range(80)) for _ in range(4)]
        want = [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.many([t.encode() for t in texts]) == want


def test_shard_lookup():
    n = 997
    ids = [np.full(i % 5 + 1, i, "<u2").tobytes() for i in range(n)]
    keys = np.arange(n) * 3 - 100
    s = shards.Shard(shards.pack_shard(keys, np.zeros(n, np.uint8), np.zeros(n, np.uint32), ids, np.dtype("<u2"), 2))
    assert all(s.get(int(k)).tobytes() == ids[i] for i, k in enumerate(keys))
    assert s.get(1) is None and s.get(None) is None and s.get(-100, 1) is None


def test_packing(spark, sf_dir, given):
    ids, rows = encoded(given, 1), packing.op8_packing(spark, sf_dir).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seq[r.sequence_id].append((r.offset, r.length))
    for d, a in ids.items():
        assert sorted(by[d]) == [(k, s, len(a[s : s + 4096]), zlib.crc32(a[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(a), 4096))]
    for parts in seq.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096
    assert len(seq) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_bounds():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, offset = packing.best_fit_decreasing(x, 100)
        assert np.bincount(bins, weights=x).max() <= 100
        assert packing.lower_bound(x, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(g), 42) for g in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir, given):
    fp = {d: brute_fingerprint(t) for d, t in given}
    ids = sorted(fp)
    comp = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {tuple(r) for r in simhash.op9_simhash(spark, sf_dir).collect()} == {(d, f"{fp[d]:016x}", comp[d]) for d in ids}


def test_gray_trees_prune_whole_groups():
    """Every near pair is found, and far fewer pairs of nodes are looked at than there are pairs in groups of equal blocks."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    codes = np.unique(np.concatenate([base, near]))
    top = ~np.uint64(0) << np.uint64(58)
    tree = simhash.GrayTree(codes)
    a, b, looked = simhash.near_pairs(tree, tree, 2, top)
    differ = codes[:, None] ^ codes[None]
    agree = differ & top == 0
    want = {tuple(sorted(p)) for p in np.argwhere((np.bitwise_count(differ) <= 2) & agree).tolist() if p[0] < p[1]}
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)
    assert looked < agree.sum() / 2
    c, d, _ = simhash.near_pairs(simhash.GrayTree(near), simhash.GrayTree(base), 1)
    assert {(int(i), int(j)) for i, j in zip(c, d)} >= {(i, i) for i in range(400)}
    assert len(simhash.near_pairs(simhash.GrayTree(codes[:0]), tree, 2)[0]) == 0


def test_hot_groups_lose_no_link(spark):
    """Many near fingerprints in one group, with a limit that splits it again and again."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
    fps = {int(b) ^ sum(1 << int(i) for i in rng.integers(0, 64, rng.integers(0, 4))) for b in base for _ in range(60)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(0, s) for s in signed.values()], "space long, fp long")
    for limit in (4, 4096):
        found = [(r.a, r.b) for r in simhash.links(df, 2, limit).collect()]
        order = sorted(signed.values())
        full = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
        assert groups(order, found) == groups(order, [(signed[a], signed[b]) for a, b in full])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([(signed[a], signed[b]) for a, b in full], "a long, b long")).collect()}
    want = groups(order, [(signed[a], signed[b]) for a, b in full])
    assert got == {n: r for n, r in want.items() if n != r}


def test_similar_documents(spark):
    words = [f"t{i}" for i in range(300)]
    one = list(words)
    one[150] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(one)), (3, " ".join(words)), (4, " ".join(words[::-1])), (5, "short text"), (6, None), (7, ""), (5, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.without_similar(docs).collect()) == [1, 4, 5, 6]


LIMITS_OF_PAIRS = {
    "listed": {},
    "leaders": {"PAIRS_A_ROW": 0, "LEAST_PAIRS": 0, "LEADER_ROUNDS": 3, "MEETINGS": 3, "LEAST_GAIN": 1, "CELL_PAIRS": 10**9},
    "divided": {"PAIRS_A_ROW": 0, "LEAST_PAIRS": 0, "LEADER_ROUNDS": 0, "LISTED_A_ROW": 0, "CELL_PAIRS": 0, "DIVISIONS": 2, "CELL_SAMPLE": 4},
}


@pytest.mark.parametrize("way", sorted(LIMITS_OF_PAIRS))
def test_similar_documents_are_all_found(spark, given, monkeypatch, way):
    """Truncated, extended and edited copies, copies of copies and common lines, against every pair."""
    for name, value in LIMITS_OF_PAIRS[way].items():
        monkeypatch.setattr(similar, name, value)
    rng = np.random.default_rng(3)
    texts = [t.lower().split() for _, t in given if t and 60 <= len(t.split()) <= 400][:50]
    common = [f"c{i}" for i in range(40)]
    made = list(texts)
    for i, words in enumerate(texts):
        n = len(words)
        edited = list(words)
        edited[n // 3] = edited[n // 2] = "edited"
        made += [words[: int(n * rng.uniform(0.8, 0.95))], words + texts[i - 1][: int(n * rng.uniform(0.02, 0.24))], edited, words[n // 10 :], common + texts[i - 2][:9]]
    made += [common + [f"x{k}" for k in range(j)] for j in range(30)]
    order = rng.permutation(len(made))
    rows = [(int(k), " ".join(made[i])) for k, i in enumerate(order)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    alike = [(i, j) for i, s in enumerate(sets) for j in range(i) if len(s & sets[j]) >= 0.8 * len(s | sets[j])]
    kept = sorted(set(groups(range(len(sets)), alike).values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.without_similar(docs).collect()) == kept


def test_temporaries_go_but_for_what_is_read(spark):
    from pathlib import Path

    from fieldloom.llm.common import saved, shared_folder, temporaries

    there = lambda: {p.name.partition("-")[0] for p in Path(shared_folder(spark)).glob("scope*")}
    with temporaries(spark) as outer:
        a = saved(spark.range(5), "scopea-1")
        with temporaries(spark) as inner:
            b, c = saved(spark.range(6), "scopeb-1"), saved(spark.range(7), "scopec-1")
            kept = b.join(a, "id").select((a["id"] + 1).alias("x"))
            inner.append(kept)
            saved(spark.range(0), "scoped-1")
        assert there() == {"scopea", "scopeb"} and kept.count() == 5
        outer.append(a.where("id > 1"))
    assert there() == {"scopea"} and a.count() == 5
    with pytest.raises(ZeroDivisionError), temporaries(spark):
        saved(spark.range(5), "scopee-1")
        raise ZeroDivisionError
    assert there() == {"scopea"}


def test_pages_of_one_template_make_no_pairs(spark, monkeypatch):
    """Pages of 5 out of 50 paragraphs: unlike, but each shares a paragraph with a tenth of all. Pairs that are looked at
    grow with the pages, not with their square; two copies among them are found."""
    for name, value in (("LEAST_PAIRS", 500), ("CELL_PAIRS", 20), ("LISTED_A_ROW", 0), ("LEAST_GAIN", 0.7)):
        monkeypatch.setattr(similar, name, value)
    looked, possible = [], similar.possible

    def counting(pairs, *more):
        looked[-1] += pairs.distinct().count()
        return possible(pairs, *more)

    monkeypatch.setattr(similar, "possible", counting)
    rng = np.random.default_rng(1)
    paragraphs = [" ".join(f"p{i}w{rng.integers(10**6)}" for _ in range(40)) for i in range(50)]
    for n in (400, 1600):
        looked.append(0)
        texts = ["\n".join(paragraphs[i] for i in rng.choice(50, 5, False)) for _ in range(n)]
        texts[n // 2] = texts[1].replace(" ", "  ")[:-3]
        rows = list(enumerate(texts))
        sets = [frozenset(t.split("\n")) for t in texts]
        first = {}
        kept = [first.setdefault(s if i != n // 2 else sets[1], i) for i, s in enumerate(sets)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r.doc_id for r in similar.without_similar(docs).collect()) == sorted(set(kept))
    assert looked[1] < 8 * looked[0] and looked[1] < 1600**2 / 80  # four times the pages


def test_similar_rows_are_compared_without_passes_over_all_texts(spark, monkeypatch):
    """Near copies in many rounds: no comparison takes the equal rows out of all texts again, and few rounds do."""
    for name, value in (("LEAST_PAIRS", 0), ("PAIRS_A_ROW", 0), ("LEAST_GAIN", 1)):
        monkeypatch.setattr(similar, name, value)
    plans, rounds, verified, opened = [], [], similar.verified, similar.opened
    monkeypatch.setattr(similar, "verified", lambda pairs, texts, *more: plans.append(texts._jdf.queryExecution().analyzed().toString()) or verified(pairs, texts, *more))
    monkeypatch.setattr(similar, "opened", lambda *more: rounds.append(1) or opened(*more))
    words = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(12)] + [(50, " ".join(words)), (51, " ".join(words)), (52, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in similar.without_similar(docs).collect())
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    alike = [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert kept == sorted(set(groups(list(sets), alike).values()))
    assert len(plans) > 1 and not any("LeftAnti" in p for p in plans)
    assert len(rounds) <= 4


def test_copies_with_many_changes_make_no_pairs(spark, monkeypatch):
    """Copies of a page with 1 to 3 changed words are linked, those with 5 to nothing: these meet no copy of their length."""
    for name, value in (("LEAST_PAIRS", 0), ("PAIRS_A_ROW", 0)):
        monkeypatch.setattr(similar, name, value)
    looked, possible = [], similar.possible

    def counting(pairs, *more):
        looked.append(pairs.distinct().count())
        return possible(pairs, *more)

    monkeypatch.setattr(similar, "possible", counting)
    rng = np.random.default_rng(5)
    rows = [(0, [f"t{i}" for i in range(150)])]
    for k in range(1, 161):
        words = list(rows[0][1])
        for i in rng.choice(30, 5 if k % 2 else 1 + k % 3, False):
            words[5 * int(i)] = f"x{k}y{i}"
        rows.append((k, words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in rows]
    alike = [(i, j) for i, s in enumerate(sets) for j in range(i) if len(s & sets[j]) >= 0.8 * len(s | sets[j])]
    kept = sorted(set(groups(range(len(sets)), alike).values()))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.without_similar(docs).collect()) == kept
    assert 80 <= len(kept) <= 85 and sum(looked) < 10 * len(rows)


def test_components_of_stars_take_one_round(spark, monkeypatch):
    written, saved = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, label: written.append(label) or saved(df, label))
    edges = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(20, 21)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 1) for k in range(2, 9)} | {(21, 20)}
    assert written == ["star"] * 2
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(1, 41)}
    assert simhash.components(chain.limit(0)).count() == 0


def test_packing_leaves_no_encoder_in_a_worker(spark):
    packing.packed(spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string"), tokens.default_path()).collect()

    def held(it):
        from fieldloom.llm.tokens import _encoders

        for pdf in it:
            yield pdf.assign(id=len(_encoders))

    assert {r.id for r in spark.range(0, 64, 1, 16).mapInPandas(held, "id long").collect()} == {0}


def test_pii_draws_even_tiny_shares(spark):
    docs = spark.range(1 << 23).selectExpr("id as doc_id", "'x' as text")
    few, some = pii.drawn(docs, 1e-6).count(), pii.drawn(docs, 1 / 64).count()
    assert 1 <= few <= 30 and abs(some / (1 << 17) - 1) < 0.05
    assert pii.drawn(docs.limit(100), 5e-10).count() <= 1 and pii.drawn(docs.limit(100), 1.0).count() == 100


def test_pii_joins_pieces_of_long_spans():
    """A span longer than a window is one span, wherever it lies; one without a seen end is none."""
    assert pii.joined([(20, 64, 2, False, True), (32, 96, 2, True, True), (64, 110, 2, True, False)]) == [(20, 110, 2)]
    assert pii.joined([(32, 40, 2, True, False), (50, 64, 2, False, True), (60, 64, 1, False, True)]) == []
    assert pii.joined([(50, 64, 1, False, True), (32, 70, 3, True, False), (32, 70, 1, True, False)]) == []

    class Digits:
        def decode(self, chars):
            digit = (chars >= ord("0") - 31) & (chars <= ord("9") - 31)
            begins = digit & ~np.c_[np.zeros(len(chars), bool), digit[:, :-1]]
            return np.where(begins, 5, np.where(digit, 6, 0)).astype(np.int8)

    rng = np.random.default_rng(6)
    for n in [*range(6, 40), 55, 63, 64, 65, 100, 500]:
        for before in rng.integers(0, 70, 6).tolist():
            text = "x" * before + "7" * n + "y" * int(rng.integers(0, 70))
            assert pii.decoded([text], Digits()) == [[(before, before + n, 2)]]
    base = sorted((int(a), int(a + k), "ip") for a, k in zip(rng.integers(0, 900, 60), rng.integers(1, 60, 60)))
    spans = [(int(a), int(a + k), 0) for a, k in zip(rng.integers(0, 900, 300), rng.integers(1, 9, 300))]
    assert pii.without_overlaps(spans, base) == [s for s in spans if not any(a < s[1] and s[0] < z for a, z, _ in base)]
    assert pii.without_overlaps(spans, []) == spans


def test_pii(spark, sf_dir, given):
    t = pii.Tagger()
    rng = np.random.default_rng(0)
    chars, tags = rng.integers(1, 90, (3, 7)), rng.integers(0, 9, (3, 7))
    _, g = t.loss(chars, tags)
    for k in t.p:  # gradients against differences
        at = (int(chars[0, 0]), 2) if k == "embed" else tuple(0 for _ in t.p[k].shape)
        old = t.p[k][at]
        t.p[k][at] = old + 1e-5
        up, _ = t.loss(chars, tags)
        t.p[k][at] = old - 1e-5
        down, _ = t.loss(chars, tags)
        t.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
    assert pii.emails("x a@b.c_d@e.fg @ z@q") == [(2, 7), (7, 13)] or pii.emails("x a@b.c_d@e.fg @ z@q")[0] == (2, 7)
    texts = dict(given)
    for r in pii.op3_personal_data(spark, sf_dir).collect():
        s, want = texts[r.doc_id] or "", []
        want += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 12 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        said = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in sorted(want))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_secrets(spark, edge, sf_dir, given):
    spans = {r.doc_id: r.spans for r in secrets.op7_secrets(spark, edge).collect()}
    assert spans[9] == "identity:0:8,assign:9:33,endpoint:34:58" and spans[3] == "" and spans[6].startswith("assign:")
    texts = dict(given)
    for r in secrets.op7_secrets(spark, sf_dir).collect():
        s, want = texts[r.doc_id] or "", []
        want += [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", s) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", s) if len(m[0]) >= 24]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(want))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_secret_links(spark, given):
    """Parts and links against every pair of parts of a text; tokens whose first digit comes late; a text of some MB."""
    rng = np.random.default_rng(8)
    some = ["user=bob", "client_id: c-77", "https://h.example/p?q", "redis://cache", "password = hunter2222", "token:'abc'", "AKIA" + "Q7" * 9, "0f" * 13, "Ab1" * 9, "x" * 90 + "Z" + "y" * 70 + "4", "login: x@y.example", "é😀", "\n"]
    texts = ["".join(rng.choice(some) + " " + "w " * int(rng.integers(0, 160)) for _ in range(rng.integers(1, 14))) for _ in range(150)]
    texts += [t or "" for _, t in given[:300]] + [" ".join(some) + " filler" * 400_000 + " ".join(some)]
    want = {}
    for i, s in enumerate(texts):
        found = [(k, m.start(), m.end(), role) for k, (_, p, g, least, role) in enumerate(secrets.PATTERNS) for m in re.finditer(p, s, re.ASCII) if len(m[g]) >= least]
        spans = [(a, k, z) for k, a, z, _ in found if k < 3]
        for k, a, z, role in found:
            near = [(k2, a2, z2, r2) for k2, a2, z2, r2 in found if k >= 3 and (k2, a2) != (k, a) and a2 < z + secrets.REACH and a < z2 + secrets.REACH]
            over = [n for n in near if n[1] < z and a < n[2]]
            has = {n[3] for n in near if n not in over}
            needs = {"secret": has & {"identifier", "endpoint"}, "identifier": has & {"secret"}, "endpoint": {"secret", "identifier"} <= has}[role]
            if k >= 3 and needs and not any(n[0] < 3 or n[0] < k for n in over):
                spans.append((a, k, z))
        want[i] = sorted(spans)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.spans(docs).collect()}
    assert got == {i: s for i, s in want.items() if s}
    assert {k for s in want.values() for _, k, _ in s} == set(range(len(secrets.KINDS))) and any(z - a > 150 for s in want.values() for a, k, z in s if k == 4)


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    rows = [(i, ("http://é/\r\n", "http://x/\u2028Content-Length: 3\u0085WARC-Type: x")[i % 2] if i % 3 else None, None if i % 9 == 0 else f"<p>é{i % 40}</p>" * (i % 17) + ("WARC/1.0\r\nContent-Length: 5\r\n\r\nabcdefWARC/1.0\r\nx" if i % 5 == 0 else "")) for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    before, chunk = spark.conf.get("spark.sql.files.maxPartitionBytes"), warc.CHUNK
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    warc.CHUNK = 8
    try:
        got = sorted(map(tuple, warc.op4_warc(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        warc.CHUNK = chunk
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert got == sorted((i, len((h or "").encode()), digest(h), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""]) for i, _, h in rows)


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(2)
    unit = lambda v: {t: w / np.sqrt(sum(x * x for x in v.values())) for t, w in v.items()}
    vectors = [unit({int(t): float(rng.random() + 0.1) for t in rng.choice(40, rng.integers(1, 6), False)}) for _ in range(500)]
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    for q in vectors[:60]:
        want = sorted(((-sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors)), key=lambda x: (round(x[0], 9), x[1]))[:7]
        got = index.nearest(q, 7)
        assert np.allclose([s for _, s in got], [-s for s, _ in want if s < 0][: len(got)])


def test_toxicity_and_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in held]) > 0.85
    kept = quality.op6_quality(spark, sf).collect()
    good = [r.kept for r in kept if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed]
    bad = [r.kept for r in kept if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_quality_counts():
    (n, chars, symbols, again, repeated), _, _ = quality.measure("a b c a b c\nx #\nx #\n\n\né".encode())
    assert (n, chars, symbols, again, repeated) == (11, 11, 2, 1, 6)


def test_quality_base_columns(spark, sf_dir, given):
    query = next(f for n, f in entry.queries().items() if n.startswith("op6_"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = query(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        at = defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        repeated = len({j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)})
        lines = text.split("\n")
        again = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (again, repeated)
        assert r.base_failed == (len(words) < 50 or 100 * repeated > 50 * len(words)) and not (r.base_failed and r.kept)


def test_decontamination_keeps_columns(spark, edge):
    docs, items = spark.read.parquet(f"{edge}/documents.parquet"), spark.read.parquet(f"{edge}/benchmark.parquet")
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 6, 7, 8, None}  # 9 has the one-word item, x


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    folder = folder_of(spark, tmp_path / "t", rows=[], benchmark=[])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline(spark, edge, sf_dir):
    import corpus_pipeline

    for folder in (edge, sf_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.saved(stage(spark, docs, folder), name)
            assert docs.columns == columns
        assert 0 < docs.count() <= spark.read.parquet(f"{folder}/documents.parquet").count()
    assert corpus_pipeline.run(spark, sf_dir).columns[:2] == ["doc_id", "piece"]
