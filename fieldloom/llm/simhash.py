"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: words between ASCII white space, A-Z lower-cased; word shingles, repeats included, joined by spaces
(fewer words: the whole sequence; none: fingerprint zero); a bit is one if it is set in more than half of the
shingles' XXH64 (seed 42). Texts link if their fingerprints differ in ``max_bits`` bits or fewer.

Search: only distinct fingerprints are searched. By the pigeonhole principle two that link agree in one of
``max_bits + 1`` blocks of bits. For each block the whole set of fingerprints, turned so that the block stands on top,
is sorted by Gray rank and dealt into ranges. In a range neighbours share an upper node that holds the bits in which
both agree (a mask and a pattern), two nodes share a higher node, and so on. Nodes are joined with nodes from the
top down: two nodes whose patterns differ in a bit of the block, or in more than ``max_bits`` bits that both have
fixed, are pruned with all that is below them. So a range costs what its near nodes cost, not a comparison of each
group of equal blocks.

A block's value may be hot (near copies of one page). Where over ``group_limit`` fingerprints share it, they are split
by further bits until no part is larger; each fingerprint then also visits the parts whose bits differ from its own in
max_bits at most. A fingerprint has a bounded number of neighbours (2,080 within two bits), so this stays in
proportion to the input. From each range only links that span its local components are kept; large-star/small-star
rounds join them.

Nulls: a null text is empty; a null doc_id counts as larger than any other and is never a component_id. Equal and
repeated rows share a component. An empty table gives no rows. Very long texts are hashed whole, text by text. Columns
of any name pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, NULL_ID, discard, saved, small, table, text_rows

SHINGLE, MAX_BITS, SEED = 3, 2, 42
GROUP_LIMIT = 2048
FAN_OUT = 2
#: Fingerprints that share a tree, and pairs of nodes that are looked at at once.
RANGE_ROWS, PAIRS_AT_ONCE = 1 << 16, 1 << 18
#: Of a node and its root, two longs each.
EDGE_BYTES = 64
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxh64_digest(b" ".join(words), SEED)
    else:
        digests = b"".join([xxh64_digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))])
    return sum_of_bits(digests)


def sum_of_bits(digests: bytes) -> int:
    """The bits that are set in more than half of the big-endian 64-bit digests."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(rows[:, i], minlength=256) @ BITS_OF_BYTE for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """row_id, row_hash, fp (the fingerprint as a signed long)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fp = np.array([fingerprint(t, shingle) for t in pdf.pop("body")], dtype=np.uint64)
            yield pdf.assign(fp=fp.view(np.int64))

    return text_rows(docs).mapInPandas(batches, "row_id long, row_hash long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Where each value, read as a Gray code, stands in Gray order."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayTree:
    """Codes in Gray order, under nodes of FAN_OUT that hold the bits in which all codes below agree."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        leaves = codes[self.order]
        self.levels = [(np.full(len(leaves), ~np.uint64(0)), leaves)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(mask), FAN_OUT)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)  # bits that are fixed to one in all
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones | zeros, ones))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node its children one level below: (place in nodes, child)."""
        below = len(self.levels[level - 1][0])
        child = nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)
        place, column = np.nonzero(child < below)
        return place, child[place, column]


def near_pairs(a: GrayTree, b: GrayTree, max_bits: int, block: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs (of a, of b) within max_bits that agree in the bits of block, by a join of the trees from the top
    down; and how many pairs of nodes were looked at. For a tree with itself each pair comes once."""
    found_a, found_b, looked = [], [], 0
    if not len(a.order) or not len(b.order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, x, y = stack.pop()
        (mask_a, pattern_a), (mask_b, pattern_b) = a.levels[i], b.levels[j]
        differ = (pattern_a[x] ^ pattern_b[y]) & mask_a[x] & mask_b[y]
        looked += len(x)
        near = (np.bitwise_count(differ) <= max_bits) & (differ & block == 0)
        x, y = x[near], y[near]
        if not i and not j:
            if a is b:
                x, y = x[x < y], y[x < y]
            found_a.append(a.order[x])
            found_b.append(b.order[y])
            continue
        if i >= j:
            place, x = a.children(i, x)
            y, i = y[place], i - 1
            if a is b and i < j:  # the other side comes next
                place, y = b.children(j, y)
                x, j = x[place], j - 1
                x, y = x[x <= y], y[x <= y]
        else:
            place, y = b.children(j, y)
            x, j = x[place], j - 1
        stack += [(i, j, x[k : k + PAIRS_AT_ONCE], y[k : k + PAIRS_AT_ONCE]) for k in range(0, len(x), PAIRS_AT_ONCE)]
    return np.concatenate(found_a or [np.zeros(0, np.int64)]), np.concatenate(found_b or [np.zeros(0, np.int64)]), looked


def spanning(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its local component) for the graph of index pairs (a, b)."""
    label = np.argsort(np.argsort(values, kind="stable"), kind="stable")
    by_rank = np.sort(values)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (before == label).all():
            break
    root = by_rank[label]
    far = root != values
    return values[far], root[far]


def _search(max_bits: int):
    """Rows sorted by (block, depth, lead, part), residents and visitors; yields links that span, with their block."""
    widths = [w for _, w in _blocks(max_bits)]

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Of whole parts of one block and depth."""
        block, visits = int(rows["block"].iloc[0]), rows["visits"].to_numpy()
        width = np.uint64(widths[block % len(widths)])
        left = np.uint64(64) - width
        top = ~np.uint64(0) << left
        turned, fp = rows["turned"].to_numpy().view(np.uint64), rows["fp"].to_numpy().view(np.uint64)
        codes = (turned >> width) | (turned << left)  # the block on top, then the bits by which hot values are parted
        own, guests = np.flatnonzero(~visits), np.flatnonzero(visits)
        # one visit of each: all parts are looked at together, so those who are at home here meet them anyway
        guests = guests[np.unique(fp[guests], return_index=True)[1]]
        guests = guests[~np.isin(fp[guests], fp[own])]
        tree = GrayTree(codes[own])
        a, b, _ = near_pairs(tree, tree, max_bits, top)
        c, d, _ = near_pairs(GrayTree(codes[guests]), tree, max_bits, top)
        ends = np.concatenate([own[a], guests[c]]), np.concatenate([own[b], own[d]])
        kinds, at = np.unique(fp[np.concatenate(ends)], return_inverse=True)
        half = len(ends[0])
        far, root = spanning(kinds, at[:half], at[half:])
        if len(far):
            yield pd.DataFrame({"block": np.full(len(far), block), "a": far.view(np.int64), "b": root.view(np.int64)})

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        section, part = ["block", "depth"], ["block", "depth", "lead", "part"]
        changes = lambda rows, names: np.flatnonzero((rows[names].to_numpy()[1:] != rows[names].to_numpy()[:-1]).any(axis=1)) + 1

        def whole(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            edges = [0, *changes(rows, section).tolist(), len(rows)]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    yield from links(rows.iloc[a:b])

        for pdf in it:
            held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
            if len(held) >= RANGE_ROWS and len(cuts := changes(held, part)):
                yield from whole(held.iloc[: cuts[-1]])
                held = held.iloc[cuts[-1] :]
        if len(held):
            yield from whole(held)

    return batches


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else fp


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of max_bits + 1 blocks that make up the 64 bits."""
    edges = [round(64 * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """space, a, b: links between distinct fingerprints (fp) of one space that span its components; each differs in
    max_bits or fewer. distinct: space (a small number: fingerprints of different spaces never meet), fp."""
    fp, per_space = F.col("fp"), max_bits + 1
    # bits: the block's value; rest: the fingerprint turned so that the bits after the block stand at the top
    choices = [
        F.struct((F.col("space") * per_space + i).alias("block"), _bits(fp, low, width).alias("bits"), F.shiftleft(fp, (64 - low) % 64).bitwiseOR(F.shiftrightunsigned(fp, low) if low else F.lit(0).cast("long")).alias("turned"))
        for i, (low, width) in enumerate(_blocks(max_bits))
    ]
    rows = distinct.select("fp", F.explode(F.array(*choices)).alias("c")).select("fp", "c.*")
    widest = max(w for _, w in _blocks(max_bits))
    parts, left, depth = [], rows, 0
    while True:
        part = _bits(F.shiftrightunsigned("turned", 64 - depth), 0, depth) if depth else F.lit(0).cast("long")
        placed = left.withColumn("part", part)
        hot = None
        if depth + 8 <= 64 - widest:
            over = placed.groupBy("block", "bits", "part").agg(F.count("*").alias("n")).where(F.col("n") > group_limit)
            hot = saved(over.select("block", "bits").distinct(), "hot-groups")
            if hot.isEmpty():
                hot = None
        here = placed if hot is None else placed.join(small(hot, 24), ["block", "bits"], "left_anti")
        here = here.select("block", "bits", F.lit(depth).alias("depth"), "part", F.lit(False).alias("visits"), "fp", "turned")
        parts.append(here)
        if depth:
            masks = [sum(1 << i for i in c) for k in range(1, max_bits + 1) for c in combinations(range(depth), k)]
            there = F.explode(F.array(*[F.lit(m) for m in masks])).alias("m")
            visits = here.select("block", "bits", "depth", "part", "fp", "turned", there).withColumn("there", F.col("part").bitwiseXOR(F.col("m").cast("long")))
            parts.append(visits.where("there < part").select("block", "bits", "depth", F.col("there").alias("part"), F.lit(True).alias("visits"), "fp", "turned"))
        if hot is None:
            break
        left, depth = left.join(small(hot, 24), ["block", "bits"], "left_semi"), depth + 8
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    # in Gray order of the block's bits; a hot value is parted by its further bits
    keys = ["block", "depth", "lead", "part"]
    lead = F.col("bits")
    for shift in (1, 2, 4, 8, 16):
        lead = lead.bitwiseXOR(F.shiftrightunsigned(lead, shift))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = everything.withColumn("lead", lead).drop("bits").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    found = dealt.mapInPandas(_search(max_bits), "block long, a long, b long")
    return found.select(F.floor(F.col("block") / per_space).alias("space"), "a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): the smallest node that can be reached. Star rounds, each written, until
    every node has one edge, to a node that has none to a smaller one."""
    edges = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    rows = edges.count()
    while rows:
        few = (lambda df: F.broadcast(df)) if rows * 2 * EDGE_BYTES <= BROADCAST_BYTES else (lambda df: df)  # a row for each node
        # large star: larger neighbours are tied to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(few(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # small star: smaller neighbours and the node itself are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(few(low), "a")
        after = saved(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "star")
        discard(edges)
        edges = after
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        rows, open_ends = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()
        if not open_ends:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """row_id, row_hash, fp, first_id, first_hash: each row and the first row (by id, then hash) of its component."""
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min(F.struct("row_id", "row_hash")).alias("first")), "distinct-fingerprints")
    roots = saved(components(links(distinct.select(F.lit(0).cast("long").alias("space"), "fp"), max_bits).select("a", "b")), "roots")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = saved(placed, "placed-fingerprints")
    linked = placed.where("fp != root").select("root").distinct()
    firsts = placed.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first").alias("all"))
    final = placed.join(firsts, "root", "left").select("fp", F.coalesce("all", "first").alias("first"))
    return rows.join(final, "fp").select("row_id", "row_hash", "fp", F.col("first.row_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(known("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("first_id").alias("component_id"))
