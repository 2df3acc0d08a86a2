"""Periodic runs of words, found with the dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical) that is ``least_words`` and
``least_turns * q`` words long or longer, and that no neighbouring word extends. The steps, for many texts at once:

1. the dictionary gives every factor (stretch) of 1, 2, 4, 8, ... words a name, equal ones the same: the name of a
   factor of twice the length is the pair of names of its halves. Factors that stand only once need no name, so the
   levels shrink fast, and they end where nothing repeats;
2. at length L the occurrences of a factor within a stretch of 2L words form an arithmetic progression. So a factor
   whose successor stands at a distance of at most L, and whose successor's successor follows at the same distance,
   proposes that distance as a period; neighbouring places that propose the same distance are one proposal. A run of
   four turns or more of period q proposes q at the smallest L of q words or more;
3. proposals are extended both ways by the names, from long factors to short ones, to the whole stretch that keeps the
   period. Of equal stretches the one with the smallest period stays.

A word is dropped from the collapsed text if any run holds it after that run's first q words.

Words stand between ASCII white space of the UTF-8 text and compare by their bytes. Nothing is shuffled: a text is one
row and is searched whole, many short ones in one pass of arrays, a very long one in a pass by itself (about 100 bytes a
word). A null or empty text has no words and no run; a null doc_id is never planted (see ``planted``); equal rows have
equal results; equally long runs of one text are told apart by start, then period. An empty table gives no rows.
Columns of any name pass untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, table

LEAST_WORDS, LEAST_TURNS = 6, 4
#: Texts are searched together until they have so many words.
WORDS_AT_ONCE = 1 << 17

RUNS = "array<struct<start:long,length:long,period:long>>"


def names_of_factors(words: np.ndarray) -> list[np.ndarray]:
    """For lengths 1, 2, 4, ... the name of the factor at each place, -1 if it stands only once (or passes the end)."""
    named = words.astype(np.int64)
    levels = []
    while True:
        repeats = np.bincount(named[named >= 0]) > 1
        alive = (named >= 0) & repeats[named] if len(repeats) else named >= 0
        levels.append(np.where(alive, named, -1).astype(np.int32))
        length = 1 << (len(levels) - 1)
        here = np.flatnonzero(alive[: max(0, len(words) - length)])
        here = here[alive[here + length]]
        named = np.full(len(words), -1, np.int64)
        if not len(here):
            return levels
        pairs = levels[-1][here].astype(np.int64) << 32 | levels[-1][here + length]
        named[here] = np.unique(pairs, return_inverse=True)[1]


def proposals(level: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, distance) of neighbouring places whose factor of this length stands three times in equal steps."""
    places = np.flatnonzero(level >= 0)
    places = places[np.argsort(level[places], kind="stable")]
    step = np.zeros(len(level), np.int64)  # to the successor; 0: none within length
    near = (level[places[1:]] == level[places[:-1]]) & (places[1:] - places[:-1] <= length)
    step[places[:-1][near]] = (places[1:] - places[:-1])[near]
    at = np.flatnonzero(2 * step > length)  # shorter periods were proposed by shorter factors
    at = at[step[at + step[at]] == step[at]]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (step[at[1:]] != step[at[:-1]])
    return at[opens], step[at[opens]]


def common_length(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words agree from places a and b on (ahead) or up to places a and b."""
    n, found = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length = 1 << k
        while True:  # the longest factor may stand several times in a row, the others once
            x, y = (a + found, b + found) if ahead else (a - found - length + 1, b - found - length + 1)
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
            same = np.zeros(len(a), bool)
            same[inside] = (levels[k][x[inside]] == levels[k][y[inside]]) & (levels[k][x[inside]] >= 0)
            if not same.any():
                break
            found[same] += length
    return found


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period. words: a number for each word."""
    levels = names_of_factors(words)
    found = [proposals(level, 1 << k) for k, level in enumerate(levels)]
    at, period = (np.concatenate(x) for x in zip(*found))
    ahead = common_length(levels, at, at + period, True)
    start = at - common_length(levels, at - 1, at + period - 1, False)
    runs = np.unique(np.stack([start, at + period + ahead - start, period], axis=1).reshape(-1, 3), axis=0)
    first = np.ones(len(runs), bool)  # of equal stretches the smallest period
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first & (runs[:, 1] >= np.maximum(least_words, least_turns * runs[:, 2]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def planted(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the contract plants in a tenth of the documents, by crc32 of the decimal doc_id."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * (1 + (n - a) // p))[: n - a] if p <= n - a else words


def search(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> list[np.ndarray]:
    """The runs of each text (its words), all searched in one array with a word of its own between two texts."""
    sizes = np.array([len(w) for w in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    numbers, kinds = pd.factorize(np.array([x for w in texts for x in w] or [b""], dtype=object))
    line = np.arange(len(kinds), len(kinds) + starts[-1])  # the words between are all different
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    line[inside] = numbers[: sizes.sum()]
    runs = runs_of(line, least_words, least_turns)
    edges = np.searchsorted(runs[:, 0], starts)
    return [runs[a:b] - [s, 0, 0] for a, b, s in zip(edges, edges[1:], starts)]


def _described(doc_ids: list, texts: list[list[bytes]], least_words: int, least_turns: int) -> pd.DataFrame:
    rows = []
    for doc_id, words, runs in zip(doc_ids, texts, search(texts, least_words, least_turns)):
        kept = words if not len(runs) else [w for w, k in zip(words, kept_words(len(words), runs)) if k]
        listed = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
        rows.append((doc_id, len(words), listed, len(kept), b" ".join(kept)))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "n_kept", "collapsed"])


def periodic_runs(docs: DataFrame, plant: bool = False, least_words: int = LEAST_WORDS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), n_kept, collapsed (the kept words, joined by single spaces)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, held = [], [], 0
        for pdf in it:
            for doc_id, body in zip(pdf["doc_id"].tolist(), pdf.pop("body")):
                words = body.split()  # of bytes: at ASCII white space only
                if held + len(words) > WORDS_AT_ONCE and texts:
                    yield _described(ids, texts, least_words, least_turns)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(planted(doc_id, words) if plant else words)
                held += len(words) + 1
        if texts:
            yield _described(ids, texts, least_words, least_turns)
        give_back()

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    # the decimal doc_id: pandas would turn a column of longs with nulls into doubles
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), body)
    found = rows.mapInPandas(batches, f"doc_id string, n_words long, runs {RUNS}, n_kept long, collapsed binary")
    return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "collapsed": F.col("collapsed").cast("string")})


#: Longest first; ties by start, then period.
_LONGEST = """array_sort(runs, (a, b) -> CASE
    WHEN a.length != b.length THEN if(a.length > b.length, -1, 1)
    WHEN a.start != b.start THEN if(a.start < b.start, -1, 1)
    ELSE cast(sign(a.period - b.period) AS int) END)"""


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    best = F.get(F.expr(_LONGEST), 0)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
        "n_kept",
    )
