"""Merkle manifest of a table of documents, by butterfly exchange.

H is the lowercase hex sha256 of its inputs, concatenated, digests as hex text. A leaf is H of doc_id, source, lang,
n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. The leaves of one lang ascend by
doc_id; while a level has several nodes, every ``FANOUT`` consecutive ones become their H. What remains is the lang's subroot; subroots in the order of
lang (null first, bytewise) are joined likewise to the root. The steps are

1. leaves are ranked in their lang (see ranks) and dealt into aligned partitions of FANOUT ** height leaves, each of
   which folds its own leaves into the root of its subtree;
2. butterfly: in each round the FANOUT partitions of an aligned group whose places agree in the digits below swap the
   subtree roots that they hold. Each hashes them to their common ancestor, all of them redundantly, and notes the
   siblings. A subtree that is not full has too few partitions for all partners: its partitions serve several. After
   the last round each partition holds the root and the siblings of its whole way up, so there is no pass downward;
3. the subroots of the langs take part in the same exchange, one lang a partition;
4. each partition joins its own levels with the way up: digests of proofs, and the fold of a leaf along its proof.

State of the exchange is one row a partition (a 4096th of the rows) and is written each round. A row's proof holds
FANOUT - 1 digests a level at most.

Nulls: a null lang is a group of its own; a null doc_id comes after all others. Rows that repeat a doc_id are leaves of
their own, in the order of their leaves, so equal rows stand side by side. Empty and very long texts are hashed
whole. An empty table gives no rows. Columns of any name pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, ascii_lower, give_back, saved, small, table
from .ranks import ranked

FANOUT, HEIGHT = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A tampered row is one whose decimal doc_id has a crc32 that this divides.
TAMPERED = 3


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_part(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree (the lang, null before all), row_id, leaf, other (the leaf of the text as tampered; null: the same)."""
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(tree.alias("tree"), row_id.alias("row_id"), F.unhex(leaf(F.col("text"))).alias("leaf"), F.unhex(leaf(tampered) if tampered is not None else F.lit(None)).alias("other"))
    return rows.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other")))


def h(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def folded(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """The nodes of each level, from these up: so many levels, or until one remains."""
    out = [nodes]
    while levels is None and len(out[-1]) > 1 or levels is not None and len(out) <= levels:
        below = out[-1]
        out.append([h(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def partitions(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each aligned partition: tree, place, places (of the tree), row_ids, leaves, others, node."""
    size = FANOUT**height
    placed = ranked(rows, "tree", ["row_id", "leaf", "other"], "ranked-leaves")
    dealt = placed.select("tree", F.floor(F.col("rank") / size).alias("place"), F.ceil(F.col("total") / size).alias("places"), F.struct("rank", "row_id", "leaf", "other").alias("r"))
    held = dealt.groupBy("tree", "place", "places").agg(F.array_sort(F.collect_list("r")).alias("r"))  # of size rows at most
    held = held.select("tree", "place", "places", F.col("r.row_id").alias("row_ids"), F.col("r.leaf").alias("leaves"), F.col("r.other").alias("others"))

    @F.pandas_udf("string")
    def root(leaves: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([folded([x.hex() for x in own], height if n > 1 else None)[-1][0] for own, n in zip(leaves, places)])

    return held.withColumn("node", root("leaves", "places"))


def exchange(state: DataFrame, label: str) -> DataFrame:
    """The butterfly over tree, place, places, node: tree, place, root (of the tree) and way (for each round the siblings
    to the left and to the right, joined; places of a node alone have none)."""
    empty = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    state = saved(state.select("tree", "place", "places", "node", empty.alias("way")), label)
    done, span = None, 1
    while True:
        ended = state.where(F.ceil(F.col("places") / span) <= 1)
        done = ended if done is None else done.unionByName(ended)
        state = state.where(F.ceil(F.col("places") / span) > 1)
        if state.isEmpty():
            return done.select("tree", "place", F.col("node").alias("root"), "way")
        state = saved(_round(state, span), f"{label}-{span}")
        span *= FANOUT


def _round(state: DataFrame, span: int) -> DataFrame:
    """Each partition swaps nodes of span partitions with those of its group that stand at its place within span."""
    subtree, low = F.floor(F.col("place") / span), F.col("place") % span
    digit, group = F.floor(F.col("place") / span) % FANOUT, F.floor(F.col("place") / (span * FANOUT))
    own = state.select("*", digit.alias("digit"), group.alias("group"), low.alias("low"), F.lit(True).alias("stays"))
    # the last subtree may be too small to have a partition for each partner
    last = F.floor((F.col("places") - 1) / span)
    count = F.col("places") - last * span
    partners = F.explode(F.sequence(F.col("low") + count, F.lit(span - 1).cast("long"), count)).alias("low")
    lent = own.where((subtree == last) & (F.col("digit") > 0) & (F.col("low") + count <= span - 1))
    lent = lent.select(*[c for c in own.columns if c not in ("low", "stays", "way")], F.slice("way", 1, 0).alias("way"), partners, F.lit(False).alias("stays"))
    partner = Window.partitionBy("tree", "group", "low")  # FANOUT rows at most
    met = own.unionByName(lent).withColumn("met", F.array_sort(F.collect_list(F.struct("digit", "node")).over(partner))).where("stays")
    joined = lambda test: F.array_join(F.transform(F.filter("met", test), lambda x: x["node"]), "")
    siblings = F.struct(joined(lambda x: x["digit"] < F.col("digit")).alias("left"), joined(lambda x: x["digit"] > F.col("digit")).alias("right"))
    return met.select("tree", "place", "places", F.sha2(joined(lambda x: F.lit(True)), 256).alias("node"), F.concat("way", F.array(siblings)).alias("way"))


def proofs(held: DataFrame, ways: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each leaf of the partitions: row_id, leaf, root, proof_sha256, folded_root."""

    def of_partition(p) -> Iterator[tuple]:
        own = [bytes(x).hex() for x in p.leaves]
        levels = folded(own, height if p.places > 1 else None)
        upper = [(w["left"], w["right"]) for w in p.way]
        above = "".join(left + right for left, right in upper)
        texts = [above]  # for each node of a level the siblings on its way up
        sides = []
        for level in reversed(levels[:-1]):
            around = []
            for i in range(len(level)):
                first = i - i % FANOUT
                around.append(("".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])))
            texts = [left + right + texts[i // FANOUT] for i, (left, right) in enumerate(around)]
            sides.append(around)
        sides.reverse()
        for i, row_id in enumerate(p.row_ids):
            node, at = own[i] if p.others[i] is None else bytes(p.others[i]).hex(), i
            for around in sides:
                node, at = h([around[at][0], node, around[at][1]]), at // FANOUT
            for left, right in upper:
                node = h([left, node, right])
            yield row_id, own[i], p.root, h([texts[i]]), node

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p in pdf.itertuples(index=False):
                out = pd.DataFrame(of_partition(p), columns=["row_id", "leaf", "root", "proof_sha256", "folded_root"])
                yield out.assign(tree=p.tree, subroot=p.subroot)
        give_back()

    fields = "tree string, row_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return held.drop("node").join(ways, ["tree", "place"]).mapInPandas(batches, fields)


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """tree, row_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf of the text as tampered)."""
    held = saved(partitions(leaves(docs, tampered), height), "leaf-partitions")
    below = saved(exchange(held, "butterfly"), "subroots")
    trees = below.where("place = 0").select(F.lit(0).alias("all"), "tree", F.col("root").alias("node"))
    trees = saved(ranked(trees, "all", ["tree"], "ranked-trees"), "trees")
    above = exchange(trees.select(F.lit("all").alias("tree"), F.col("rank").alias("place"), F.col("total").alias("places"), "node"), "butterfly-trees")
    above = saved(trees.join(above.withColumnRenamed("tree", "every"), F.col("rank") == F.col("place")).select("tree", F.col("node").alias("subroot"), above["root"].alias("top"), above["way"].alias("upper")), "root")
    upper = small(above, 256, F.octet_length("tree") + F.expr("aggregate(upper, 0, (n, x) -> n + length(x.left) + length(x.right) + 32)"))
    ways = below.join(upper, "tree").select("tree", "place", "subroot", F.col("top").alias("root"), F.concat("way", "upper").alias("way"))
    return proofs(held, ways, height)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    changed = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % TAMPERED == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = manifest(table(spark, sf_dir, "documents"), changed)
    doc_id = F.when(F.col("row_id") != NULL_ID, F.col("row_id")).alias("doc_id")
    return found.select(doc_id, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = {
    "op12_merkle": """
WITH RECURSIVE part AS (
    SELECT doc_id, lang, text,
        list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inverse,
        concat(strlen(doc_id::VARCHAR), ':', doc_id,
            coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
            coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
    FROM documents
), leaf AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(inverse, 4294967295) % 3 = 0
            THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM part
), node AS (
    SELECT lang, 0 AS level, pos, n, leaf AS node FROM leaf
    UNION ALL
    SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, level, n, pos // 8
), subroot AS (
    SELECT lang, node, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
    SELECT 0 AS level, pos, n, node FROM subroot
    UNION ALL
    SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, n, pos // 8
), every AS (
    SELECT coalesce('1' || lang, '0') AS tree, level, pos, node FROM node WHERE n > 1
    UNION ALL
    SELECT '', level, pos, node FROM top WHERE n > 1
), grouped AS (
    SELECT tree, level, pos // 8 AS parent, array_agg(node ORDER BY pos) AS nodes FROM every GROUP BY ALL
), place AS (
    SELECT l.doc_id, l.leaf, s.node AS subroot, coalesce(l.other, l.leaf) AS begin, coalesce('1' || l.lang, '0') AS tree, l.pos, s.height, s.pos AS spot
    FROM leaf l JOIN subroot s ON l.lang IS NOT DISTINCT FROM s.lang
), walk AS (
    SELECT doc_id, tree, pos, height, spot, 0 AS step, begin AS folded, '' AS seen FROM place
    UNION ALL
    SELECT w.doc_id, w.tree, w.pos, w.height, w.spot, w.step + 1,
        sha256(list_aggregate(list_concat(list_slice(g.nodes, 1, seat), [w.folded], list_slice(g.nodes, seat + 2, 8)), 'string_agg', '')),
        w.seen || coalesce(list_aggregate(list_concat(list_slice(g.nodes, 1, seat), list_slice(g.nodes, seat + 2, 8)), 'string_agg', ''), '')
    FROM (
        SELECT *, CASE WHEN step < height THEN tree ELSE '' END AS up, CASE WHEN step < height THEN step ELSE step - height END AS level,
            (CASE WHEN step < height THEN pos ELSE spot END) // (8 ** (CASE WHEN step < height THEN step ELSE step - height END))::BIGINT AS here
        FROM walk
    ) w JOIN LATERAL (SELECT w.here % 8 AS seat) ON true
    JOIN grouped g ON g.tree = w.up AND g.level = w.level AND g.parent = w.here // 8
), final AS (
    SELECT doc_id, arg_max(folded, step) AS folded_root, sha256(arg_max(seen, step)) AS proof_sha256 FROM walk GROUP BY doc_id
)
SELECT p.doc_id, p.leaf, p.subroot, t.node AS root, f.proof_sha256, f.folded_root, f.folded_root = t.node AS verified
FROM place p JOIN final f USING (doc_id) JOIN top t ON t.n = 1
"""
}
