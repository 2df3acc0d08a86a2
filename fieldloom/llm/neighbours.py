"""Nearest neighbours by largest inner product, over several shifted Hilbert curves.

1. Equal vectors are one class, known by a digest and met through its smallest id, so however many rows share a vector,
   it is indexed once.
2. A vector is lifted by a coordinate that brings all to one length, so that the largest inner product of a query is its nearest
   point. For each of ``CURVES`` curves the points are projected to ``DIMENSIONS`` orthogonal random directions, cut into
   cells at quantiles, shifted by a random step, and ordered by the Hilbert key of their cell. Queries take their place in
   the same order. Each order is range-partitioned and ranked by Spark, and cut into pages of ``PAGE`` places.
3. A query looks at the pages of all curves that lie within ``window`` places of its own. Pages that several queries
   look at are read once: the windows of neighbours merge, and each page is multiplied with its visitors.
4. The pages' best are rescored on the original vectors in double precision and merged for each query.

How wide the window must be depends on the data alone, so it is measured: for ``PROBES`` queries at most (those with the
smallest digests) the true neighbours are found among all rows, and the window is the number of places within which
``TARGET`` of these pairs lie on some curve. Clustered vectors need narrow windows; vectors without any structure need a
window in proportion to their number. A query that finds too few rows looks again with a window four times as wide.

The quantiles come from ``FIT_ROWS`` vectors at most, and from 16 MB at most; every row is indexed.

Vectors that are null or zero, or hold nulls, NaN or infinity, and rows without id take no part. Shorter vectors count as
filled up with zeros. Rows that repeat id and vector are one row; rows that repeat an id with another vector are
candidates of their own. Ties go to the smaller id. An empty table gives no rows. Columns of any name pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, saved, small, table
from .ranks import ranked

CURVES, DIMENSIONS, BITS, SEED = 8, 6, 9, 17
PAGE = 2048
PROBES, TARGET = 256, 0.95
FIT_ROWS, FIT_BYTES = 4096, 16 << 20
NEAREST, QUERY_STEP = 20, 20
#: Found candidates are passed on packed; best first.
FOUND = np.dtype([("score", "<f8"), ("first_id", "<i8"), ("c0", "<i8"), ("c1", "<i8")])
#: More are rescored than kept, as products of matrices may round otherwise than rescoring does.
SPARE = 8


class Curves(NamedTuple):
    """What places a vector on the curves."""

    width: int  # components of a vector
    length: float  # of the longest vector
    directions: np.ndarray  # (width + 1, curves * dimensions)
    cuts: np.ndarray  # (curves * dimensions, cells - 1)
    shifts: np.ndarray  # (curves, dimensions)

    def lifted(self, x: np.ndarray, queries: bool) -> np.ndarray:
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        if queries:
            return np.column_stack([x / norms[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(0, self.length**2 - norms**2))]) / self.length

    def keys(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """The Hilbert keys (vectors, curves)."""
        seen = self.lifted(x, queries) @ self.directions
        cells = np.stack([np.searchsorted(c, y, side="right") for c, y in zip(self.cuts, seen.T)], axis=1)
        per_curve = cells.reshape(len(x), *self.shifts.shape) + self.shifts
        return np.stack([hilbert(per_curve[:, i], BITS + 1) for i in range(len(self.shifts))], axis=1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of coordinates below 2 ** bits: from the highest bit down, the cube is
    halved in each direction, and turned as the curve runs through that part."""
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(len(x)):
            upper = (x[i] >> b & 1).astype(bool)
            swapped = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swapped)
            x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x ^ turned:
            key = key << 1 | row >> b & 1
    return key


def vector_rows(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, c0, c1 (the digest of the vector), norm, v (its components as doubles, or as floats if they are floats)."""
    kind = dict(vectors.dtypes)[column]
    dtype = "<f4" if kind == "array<float>" else "<f8"
    numbers = F.col(column) if dtype == "<f4" else F.col(column).cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(numbers, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v")).where(F.col("vec_id").isNotNull() & sound)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.zeros((len(pdf), width), dtype)
            for i, v in enumerate(pdf["v"]):
                x[i, : len(v)] = v
            x += 0.0  # -0 is 0
            wide = x.astype(np.float64)
            marks = np.frombuffer(b"".join(md5(r.tobytes()).digest() for r in x), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "c0": marks[:, 0], "c1": marks[:, 1], "norm": np.sqrt(np.einsum("ij,ij->i", wide, wide)), "v": [r.tobytes() for r in x]})

    return rows.mapInPandas(batches, "vec_id long, c0 long, c1 long, norm double, v binary")


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows of doubles."""
    data = b"".join(column)
    return np.frombuffer(data, "<f4" if len(data) == 4 * width * len(column) else "<f8").reshape(-1, width).astype(np.float64)


def fitted(heads: DataFrame, width: int, length: float) -> Curves:
    """Curves whose cells hold equally many of the sampled vectors."""
    rng = np.random.default_rng(SEED)
    dims = min(DIMENSIONS, width + 1)
    blocks, left = [], CURVES * dims
    while left > 0:  # as many orthogonal directions as there are, then others
        block = np.linalg.qr(rng.normal(size=(width + 1, min(left, width + 1))))[0]
        blocks.append(block)
        left -= block.shape[1]
    cells = 1 << BITS
    curves = Curves(width, length, np.hstack(blocks)[:, : CURVES * dims], np.zeros((CURVES * dims, cells - 1)), rng.integers(0, cells, size=(CURVES, dims)))
    sample = heads.select("v").orderBy("c0", "c1").limit(max(1, min(FIT_ROWS, FIT_BYTES // (8 * width)))).toPandas()
    seen = curves.lifted(matrix(sample["v"], width), False) @ curves.directions
    return curves._replace(cuts=np.quantile(seen, np.arange(1, cells) / cells, axis=0).T.copy())


def entries(heads: DataFrame, curves: Curves) -> DataFrame:
    """For each curve a row for each vector and for each query: curve, key, asks (a query's), first_id, c0, c1, v."""

    def placed(pdf: pd.DataFrame, asks: bool) -> pd.DataFrame:
        keys = curves.keys(matrix(pdf["v"], curves.width), asks)
        many = pdf.loc[pdf.index.repeat(keys.shape[1]), ["first_id", "c0", "c1", "v"]]
        return many.assign(curve=np.tile(np.arange(keys.shape[1]), len(pdf)), key=keys.ravel(), asks=asks)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield placed(pdf, False)
            if pdf["asks"].any():
                yield placed(pdf[pdf["asks"]], True)

    return heads.mapInPandas(batches, "curve int, key long, asks boolean, first_id long, c0 long, c1 long, v binary")


def best_of(found: np.ndarray, keep: int) -> np.ndarray:
    """The best of FOUND rows, each candidate once: by score, then smallest id."""
    found = found[np.lexsort((found["c1"], found["c0"], found["first_id"], -found["score"]))]
    names = ["first_id", "c0", "c1"]
    once = np.ones(len(found), bool)
    once[1:] = found[names][1:] != found[names][:-1]
    return found[once][:keep]


def scored(queries: np.ndarray, page: np.ndarray, known: np.ndarray, keep: int) -> list[np.ndarray]:
    """For each query the best rows of a page: FOUND rows. known: FOUND rows of the page, without scores."""
    rough = queries @ page.T
    some = min(len(page), keep + SPARE)
    chosen = np.argpartition(-rough, some - 1, axis=1)[:, :some] if some < len(page) else np.tile(np.arange(len(page)), (len(queries), 1))
    out = []
    for q, c in zip(queries, chosen):
        found = known[c]
        found["score"] = (page[c] * q).sum(axis=1)
        out.append(best_of(found, keep))
    return out


def known_of(pdf: pd.DataFrame) -> np.ndarray:
    known = np.zeros(len(pdf), FOUND)
    for c in ("first_id", "c0", "c1"):
        known[c] = pdf[c].to_numpy()
    return known


def true_neighbours(heads: DataFrame, probes: pd.DataFrame, width: int, keep: int) -> DataFrame:
    """probe, c0, c1: the keep nearest other vectors of each probe, among all."""
    asked, own = matrix(probes["v"], width), known_of(probes)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.zeros(0, FOUND)] * len(asked)
        for pdf in it:
            known, page = known_of(pdf), matrix(pdf["v"], width)
            for a in range(0, len(pdf), PAGE):
                found = scored(asked, page[a : a + PAGE], known[a : a + PAGE], keep + 1)
                best = [best_of(np.concatenate(x), keep + 1) for x in zip(best, found)]
        best = [f[(f["c0"] != o["c0"]) | (f["c1"] != o["c1"])] for f, o in zip(best, own)]
        out = pd.DataFrame(np.concatenate(best))
        yield out.assign(probe=np.repeat(np.arange(len(best)), [len(f) for f in best]))

    found = heads.mapInPandas(batches, "probe int, score double, first_id long, c0 long, c1 long")
    return found.groupBy("probe").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "first_id", "c0", "c1"))), 1, keep).alias("f")).select("probe", F.explode("f").alias("f")).select("probe", "f.c0", "f.c1")


def measured_window(heads: DataFrame, places: DataFrame, width: int, keep: int) -> int:
    """Within how many places TARGET of the probes' true neighbours lie on some curve."""
    probes = heads.where("asks").orderBy("c0", "c1").limit(max(1, min(PROBES, FIT_BYTES // (8 * width)))).toPandas()
    pairs = saved(true_neighbours(heads, probes, width, keep), "true-neighbours")  # PROBES * keep rows at most
    own = heads.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(probes["c0"], probes["c1"]))], "probe int, c0 long, c1 long")
    spots = places.select("curve", "asks", "c0", "c1", "rank")
    asked = spots.where("asks").join(F.broadcast(own), ["c0", "c1"]).select("probe", "curve", F.col("rank").alias("here"))
    there = spots.where("!asks").join(F.broadcast(pairs), ["c0", "c1"])
    gaps = there.join(asked, ["probe", "curve"]).groupBy("probe", "c0", "c1").agg(F.min(F.abs(F.col("rank") - F.col("here"))).alias("gap"))
    return gaps.agg(F.percentile("gap", F.lit(TARGET))).first()[0] or 0


def visited(places: DataFrame, queries: DataFrame, window: int, width: int, keep: int) -> DataFrame:
    """q0, q1, found: what each query (q0, q1, rank, total, curve, v) finds in each page within window."""
    pages = places.where("!asks").select("curve", F.floor(F.col("rank") / PAGE).alias("page"), F.lit(False).alias("asks"), "first_id", "c0", "c1", "v")
    first, last = F.greatest(F.lit(0), F.col("rank") - window), F.least(F.col("total") - 1, F.col("rank") + window)
    looks = F.explode(F.sequence(F.floor(first / PAGE), F.floor(last / PAGE))).alias("page")
    visits = queries.select("curve", looks, F.lit(True).alias("asks"), F.lit(0).cast("long").alias("first_id"), "c0", "c1", "v")
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.unionByName(visits).repartition(n, "curve", "page").sortWithinPartitions("curve", "page", "asks")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, page = None, np.zeros(0, FOUND), np.zeros((0, width))
        for pdf in it:
            edges = [0, *(np.flatnonzero((np.diff(pdf["curve"]) != 0) | (np.diff(pdf["page"]) != 0)) + 1).tolist(), len(pdf)]
            for a, b in zip(edges, edges[1:]):
                part = pdf.iloc[a:b]
                if at != (here := (part["curve"].iloc[0], part["page"].iloc[0])):
                    at, known, page = here, known[:0], page[:0]
                asks = part["asks"].to_numpy()
                if not asks.all():
                    known = np.concatenate([known, known_of(part[~asks])])
                    page = np.concatenate([page, matrix(part.loc[~asks, "v"], width)])
                if asks.any() and len(page):
                    guests = part[asks]
                    for i in range(0, len(guests), 256):
                        some = guests.iloc[i : i + 256]
                        found = scored(matrix(some["v"], width), page, known, keep)
                        yield pd.DataFrame({"q0": some["c0"].to_numpy(), "q1": some["c1"].to_numpy(), "found": [f.tobytes() for f in found]})
        give_back()

    return dealt.mapInPandas(batches, "q0 long, q1 long, found binary")


def merged(found: DataFrame, keep: int) -> DataFrame:
    """q0, q1, first_id, c0, c1, score: the best of all that a query found."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best = None, np.zeros(0, FOUND)

        def rows() -> pd.DataFrame:
            return pd.DataFrame(best).assign(q0=at[0], q1=at[1])

        for pdf in it:
            out = []
            for q0, q1, f in zip(pdf["q0"], pdf["q1"], pdf["found"]):
                if at != (q0, q1):
                    if at:
                        out.append(rows())
                    at, best = (q0, q1), np.zeros(0, FOUND)
                best = best_of(np.concatenate([best, np.frombuffer(f, FOUND)]), keep)
            if out:
                yield pd.concat(out)
        if at:
            yield rows()

    by_query = found.repartition(n, "q0", "q1").sortWithinPartitions("q0", "q1")
    return by_query.mapInPandas(batches, "q0 long, q1 long, first_id long, c0 long, c1 long, score double")


def smallest_ids(ids: DataFrame, keep: int) -> DataFrame:
    """c0, c1, ids: the smallest ids of each vector; Spark cuts each task's rows before it shuffles them."""
    order = F.row_number().over(Window.partitionBy("c0", "c1").orderBy("vec_id"))
    return ids.withColumn("n", order).where(F.col("n") <= keep).groupBy("c0", "c1").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest(vectors: DataFrame, asks: str, k: int = NEAREST, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. asks: the SQL condition on vec_id that makes a row a query."""
    rows = saved(vector_rows(vectors, column), "vector-rows")
    heads = saved(rows.groupBy("c0", "c1").agg(F.min("vec_id").alias("first_id"), F.max(F.expr(asks)).alias("asks"), F.max("norm").alias("norm"), F.first("v").alias("v"), F.octet_length(F.first("v")).alias("bytes")), "vectors")
    many, length, size = heads.agg(F.count_if("asks"), F.max("norm"), F.max("bytes")).first()
    if not many:
        return heads.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = size // (4 if dict(vectors.dtypes)[column] == "array<float>" else 8)
    places = ranked(entries(heads, fitted(heads, width, length)), "curve", ["key", "asks", "c0", "c1"], "hilbert", 4)
    window = max(PAGE, measured_window(heads, places, width, k))
    # of a vector of many rows the k + 1 smallest ids are enough (a query's own goes)
    ids = rows.select("c0", "c1", "vec_id").distinct()
    members = smallest_ids(ids, k + 1)
    queries, result = places.where("asks"), None
    while True:
        found = merged(visited(places, queries, window, width, k + 1), k + 1)
        each = found.join(members, ["c0", "c1"]).select("q0", "q1", F.explode("ids").alias("vec_id"), "score", F.expr("c0 = q0 AND c1 = q1").alias("own"))
        lists = each.groupBy("q0", "q1").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "own"))), 1, k + 1).alias("list"))
        lists = saved(lists, "nearest-lists")
        enough = lists.where(F.size("list") > k)
        short = queries.join(small(enough.select(F.col("q0").alias("c0"), F.col("q1").alias("c1")), 16), ["c0", "c1"], "left_anti")
        whole = window >= places.agg(F.max("total")).first()[0]
        result = (lists if whole else enough) if result is None else result.unionByName(lists if whole else enough)
        if whole or short.isEmpty():
            break
        queries, window = saved(short, "short-queries"), 4 * window
    asked = ids.where(asks).select(F.col("vec_id").alias("query_id"), F.col("c0").alias("q0"), F.col("c1").alias("q1"))
    others = F.slice(F.filter("list", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id")))), 1, k)
    ranked_lists = asked.join(result, ["q0", "q1"]).select("query_id", F.posexplode(others).alias("i", "f"))
    return ranked_lists.select("query_id", (F.col("i") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.far")).alias("score"))


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), f"vec_id % {QUERY_STEP} = 0")
