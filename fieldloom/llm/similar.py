"""Groups of documents whose five-word shingles resemble each other by 0.8 (Jaccard) or more.

Words stand between ASCII white space, A-Z lower-cased; a text is the set of its word shingles (fewer words: the whole
sequence). Two texts are linked if their sets resemble by ``similarity`` or more; a group is what links join, and its
first row (by id, then text hash) stands for it. The steps are

1. texts of equal words are one class, met through its first row;
2. SimHash: classes whose 64-bit fingerprints differ in ``MAX_BITS`` bits or fewer are found by the Gray-order index
   (see simhash) and compared by their sets; what is linked makes the first groups, large groups of copies above all;
3. what SimHash misses is found by prefix filtering, exactly. Each class is indexed under the first fifth of its
   shingles in one global order, seldom ones first. Of two texts that resemble, the shorter one's first ninth and the
   longer one's first fifth have a shingle in common. What stands before that shingle is not shared, so the place of a
   shingle tells the longest text that may still resemble (its reach). Each shingle is kept apart for classes of lengths, and
   a text stands only in those that it reaches: a copy with many changes has its own shingles first and meets no copy of
   its length. Only pairs across groups are compared, each where its rows first
   meet. While the index holds too many such pairs to list, LEADERS rows of each shingle (the same rows at all
   shingles, those with the fewest shingles of their own first) meet the others there, which joins groups, and are then
   settled. Where that leaves many pairs, as between the pages
   of one template, a shingle's rows are divided by the shingles that are seldom among them, again and again, so that
   only texts that have several seldom shingles in common are listed.

Every link is checked by the whole sets, and groups are joined by star rounds, so no group is ever held in one task
and no pairs are made within a group. The global order comes from a sample; it sets the effort, never the result.

Nulls: a null text is empty, and all empty texts resemble each other; a null doc_id comes last. Rows that repeat
doc_id and text are one row, of which one stays. An empty table gives no rows. Columns of any name pass untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, saved, small, temporaries, text_rows, with_row_key, without_rows
from .simhash import components, links, sum_of_bits

SIMILARITY, SHINGLE, MAX_BITS, SEED = 0.8, 5, 3, 42
#: How much is worked out at once; these change the effort, never the result. One text of SAMPLE tells which shingles
#: are frequent, at most FREQUENT of them are told apart; pairs are listed once they are PAIRS_A_ROW for each row (or
#: LEAST_PAIRS), or after LEADER_ROUNDS; a row meets at most MEETINGS others in one task.
SAMPLE, FREQUENT, PAIRS_A_ROW, LEAST_PAIRS, LEADER_ROUNDS, MEETINGS = 16, 1 << 19, 4, 100_000, 8, 256
#: The most rows of a shingle that meet all others there in one leader round.
LEADERS = 4
#: Leader rounds end when one leaves over LEAST_GAIN of the pairs. Over LISTED_A_ROW pairs for each row are not listed then:
#: shingles of over CELL_PAIRS pairs (and PAIRS_A_ROW for each row) are divided, in an order that CELL_SAMPLE of their rows
#: tell, DIVISIONS times at most and as long as that leaves half of their pairs or fewer.
LEAST_GAIN, LISTED_A_ROW, CELL_PAIRS, DIVISIONS, CELL_SAMPLE = 0.95, 32, 2_000, 6, 256
#: The least of a class of lengths by the least of the next one; 1.0 divided by it is how much longer the next class is.
LENGTHS = 0.9
STEP = np.uint64(0x9E3779B97F4A7C15)
ROW, OTHER = ["row_id", "row_hash"], ["other_id", "other_hash"]


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; of fewer words, of the whole sequence."""
    from xxhash import xxh64_intdigest

    h = np.array([xxh64_intdigest(w, SEED) for w in words] or [0], np.uint64)
    k = min(shingle, len(h))
    n = len(h) - k + 1
    x = np.full(n, len(words) and k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = (x ^ h[i : i + n]) * STEP
            x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def prefix_sizes(n, similarity: float):
    """How many shingles of a text of n stand for it against shorter or equal texts, and against longer or equal ones."""
    probe = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    index = n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1
    return probe, index


def reach(n, place, similarity: float):
    """Of a text of n shingles and one of them, with place others before it that the other text lacks: how many shingles the
    other text may have if it resembles. At the places of the first prefix it is n or more."""
    return np.floor((n - place) * (1 + similarity) / similarity - n + 1e-6).astype(np.int32)


def prefix(shingles: np.ndarray, known: np.ndarray, times: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles in the order (times, shingle), and how many of them aren't known."""
    probe, _ = prefix_sizes(np.array(len(shingles)), similarity)
    often = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        often = np.where(known[at] == shingles, times[at], 0)
    return shingles[np.argsort(often, kind="stable")[: int(probe)]], min(int(probe), int((often == 0).sum()))


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (sorted) that a sample of the texts repeats most, and how often."""

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [shingle_set(b.lower().split(), shingle) for b in pdf["body"]]
            if found:
                yield pd.DataFrame({"shingle": np.concatenate(found)})

    some = texts.where(F.pmod("row_hash", F.lit(SAMPLE)) == 0).mapInPandas(sets, "shingle long")
    counted = saved(some.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2"), "frequent-shingles")
    least, total = None, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("shingles")).collect(), reverse=True):
        total += r.shingles
        if total > FREQUENT:
            break
        least = r.n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counted.where(F.col("n") >= least).toPandas().sort_values("shingle")
    return top["shingle"].to_numpy(), top["n"].to_numpy()


def _row(names: list[str] = ROW) -> Column:
    return F.struct(F.col(names[0]).alias("id"), F.col(names[1]).alias("hash"))


def text_classes(texts: DataFrame, shingle: int) -> DataFrame:
    """row_id, row_hash, n1, n2 (128 bits of the words), fp (the SimHash of the shingle set)."""

    def classes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        def described(body: bytes) -> tuple[bytes, int]:
            words = body.lower().split()
            return xxh3_128_digest(b" ".join(words)), sum_of_bits(shingle_set(words, shingle).astype(">i8").tobytes())

        for pdf in it:
            found = [described(b) for b in pdf.pop("body")]  # text by text: the words of a batch are many times its bytes
            halves = np.frombuffer(b"".join([d for d, _ in found]), "<i8").reshape(-1, 2)
            yield pdf.assign(n1=halves[:, 0], n2=halves[:, 1], fp=np.array([f for _, f in found], np.uint64).view(np.int64))
        give_back()

    return texts.mapInPandas(classes, "row_id long, row_hash long, n1 long, n2 long, fp long")


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (saved) with n, shingles of the row and other_n, others of the other row, from sets (saved: row, n,
    shingles). The set of a row that meets many is dealt to several tasks, so that none gets all of them."""
    met = saved(pairs.groupBy(*OTHER).agg(F.ceil(F.count("*") / MEETINGS).cast("int").alias("tasks")), "candidate-others")
    dealt = pairs.join(small(met, 32), OTHER).withColumn("task", F.pmod(F.xxhash64(*ROW), F.col("tasks")).cast("int"))
    renamed = sets.withColumnsRenamed({**dict(zip(ROW, OTHER)), "n": "other_n", "shingles": "others"})
    copies = renamed.join(small(met, 32), OTHER).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    return dealt.join(sets, ROW).join(copies, [*OTHER, "task"])


def _rows_of(pairs: DataFrame) -> DataFrame:
    return saved(pairs.select(*ROW).unionByName(pairs.select(*[F.col(o).alias(r) for o, r in zip(OTHER, ROW)])).distinct(), "candidate-rows")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """row_id, row_hash, n, shingles of the texts; rows that repeat are one."""

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [shingle_set(b.lower().split(), shingle) for b in pdf.pop("body")]
            yield pdf.assign(n=[len(f) for f in found], shingles=found)
        give_back()

    return texts.mapInPandas(sets, "row_id long, row_hash long, n int, shingles array<long>").dropDuplicates(ROW)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (saved: row_id, row_hash, other_id, other_hash) whose whole sets resemble; saved."""
    with temporaries(texts.sparkSession) as kept:
        asked = texts.join(small(_rows_of(pairs), 24), ROW, "left_semi")
        known = saved(shingle_sets(asked, shingle), "shingle-sets")
        both = F.size(F.array_intersect("shingles", "others"))
        alike = both >= similarity * (F.col("n") + F.col("other_n") - both) - 1e-9
        out = saved(_met(pairs, known).where(alike).select(*ROW, *OTHER), "links")
        kept.append(out)
    return out


def possible(pairs: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that share enough of their prefixes (saved: row, n, shingles that several rows have) to resemble; saved.
    Beyond the prefix that ends first two texts share at most what is left of the one or of the other."""
    with temporaries(prefixes.sparkSession) as kept:
        pairs = saved(pairs.select(*ROW, *OTHER).distinct(), "candidates")
        rest = lambda n: F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1
        common = F.size(F.array_intersect("shingles", "others"))
        enough = common + F.greatest(rest("n"), rest("other_n")) >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("other_n")) - 1e-6
        out = saved(_met(pairs, prefixes).where(enough).select(*ROW, *OTHER), "possible-pairs")
        kept.append(out)
    return out


def _joined(groups: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, root (rows as structs) of the groups that the edges join further."""
    more = edges.select(_row().alias("a"), _row(OTHER).alias("b"))
    if groups is not None:
        more = more.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(more)


def by_fingerprint(reps: DataFrame, max_bits: int) -> DataFrame:
    """Pairs of classes whose fingerprints are equal, or linked by the index; in each, one of them leads its fingerprint."""
    heads = saved(reps.groupBy("fp").agg(F.min(_row()).alias("head")), "fingerprint-heads")
    far = links(heads.select(F.lit(0).cast("long").alias("space"), "fp"), max_bits).select("a", "b")
    names = dict(zip(ROW, OTHER))
    equal = reps.join(heads, "fp").where(_row() != F.col("head")).select(*ROW, F.col("head.id").alias(names["row_id"]), F.col("head.hash").alias(names["row_hash"]))
    ends = far.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    near = ends.select(F.col("x.id").alias("row_id"), F.col("x.hash").alias("row_hash"), F.col("y.id").alias("other_id"), F.col("y.hash").alias("other_hash"))
    return equal.unionByName(near)


def _class(n: Column) -> Column:
    """The class of lengths of texts of n shingles."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / LENGTHS) + 1e-9).cast("int")


def _classes(similarity: float) -> tuple[Column, Column]:
    """The first and the last class of the texts, as long as itself or shorter, that a row (n, reach) may resemble at a shingle."""
    return _class(F.ceil(F.lit(similarity) * F.col("n") - 1e-9)), _class(F.least("n", "reach"))


def _home() -> Column:
    """The row stands for itself: it is met by those that are as long or longer."""
    return (F.col("reach") >= F.col("n")) & (F.col("length") == _class(F.col("n")))


def prefix_index(texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Two saved tables: an index, and row_id, row_hash, n, shingles (those of the row's prefix that several rows have).

    The index has shingle (of one class of lengths), prev (the shingle before it in the text's prefix; itself, if it is the
    first), row_id, row_hash, n (shingles of the text), reach, length (the class), home (it stands for itself against texts as
    long or longer; others meet only those at home), lone (shingles of its prefix that the sample doesn't repeat), where
    rows may meet."""
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, shingle))  # 8 MB at most

    def prefixes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, times = frequent.value
        for pdf in it:
            sets = [shingle_set(b.lower().split(), shingle) for b in pdf["body"]]
            found = [prefix(s, known, times, similarity) for s in sets]
            if found:
                many = [len(p) for p, _ in found]
                before = [np.concatenate([p[:1], p[:-1]]) for p, _ in found]
                rows = {c: np.repeat(pdf[c].to_numpy(), many) for c in ROW}
                n = np.repeat([len(s) for s in sets], many)
                far = reach(n, np.concatenate([np.arange(m) for m in many]), similarity)
                yield pd.DataFrame({"shingle": np.concatenate([p for p, _ in found]), "prev": np.concatenate(before), **rows, "n": n, "reach": far, "lone": np.repeat([k for _, k in found], many)})
        give_back()

    every = saved(texts.mapInPandas(prefixes, "shingle long, prev long, row_id long, row_hash long, n int, reach int, lone int"), "prefixes")
    crowded = every.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1").select("shingle")
    shared = saved(every.join(small(saved(crowded, "crowded-shingles"), 12), "shingle", "left_semi"), "shared-shingles")
    discard(every)
    held = saved(shared.groupBy(*ROW).agg(F.first("n").alias("n"), F.collect_list("shingle").alias("shingles")), "shared-prefixes")
    placed = shared.withColumn("length", F.explode(F.sequence(*_classes(similarity)))).withColumn("home", _home())
    placed = placed.withColumns({c: F.xxhash64(c, "length") for c in ("shingle", "prev")})
    meet = placed.groupBy("shingle").agg(F.count("*").alias("rows"), F.max("home").alias("any")).where("rows > 1 and any").select("shingle")
    index = saved(placed.join(small(saved(meet, "meeting-shingles"), 12), "shingle", "left_semi"), "prefix-index")
    discard(shared)
    return index, held


def _could_be(first: str, second: str, similarity: float) -> Column:
    """Of two rows at a shingle (structs with n, reach): each is within the other's reach, and the shorter one is long enough."""
    a, b = F.col(f"{first}.n"), F.col(f"{second}.n")
    reached = (b <= F.col(f"{first}.reach")) & (a <= F.col(f"{second}.reach"))
    return reached & (F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-6)


def _pair(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{r}").alias(r) for r in ROW] + [F.col(f"{b}.{r}").alias(o) for r, o in zip(ROW, OTHER)]


def opened(index: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with the group of each row; and its open shingles, where rows of different groups meet that have not met
    at the shingle before: how many rows and pairs, and the rows that lead there (the first of each of LEADERS parts)."""
    with temporaries(index.sparkSession) as kept:
        placed = index.drop("group").withColumn("node", _row()).join(small(groups, 40), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("node", "root")
        placed = saved(placed, "placed-index")
        order = F.struct("lone", F.xxhash64(*ROW).alias("o"), F.struct(*ROW, "n", "reach").alias("row"), F.col("group"))
        leads = [f"lead{i}" for i in range(LEADERS)]
        least = [F.min(F.when(F.col("home") & (F.pmod(F.xxhash64(*ROW), F.lit(LEADERS)) == i), order)).alias(c) for i, c in enumerate(leads)]
        cells = saved(placed.groupBy("shingle", "group", "prev").agg(F.count("*").alias("c"), F.count_if("home").alias("h"), *least), "open-cells")
        twice = F.col("h") * (2 * F.col("c") - F.col("h"))  # pairs of c rows and h at home (which meet all), each row with itself too
        counts = [F.sum(c).alias(c) for c in "ch"]
        members = cells.groupBy("shingle", "group").agg(*counts, *[F.min(c).alias(c) for c in leads])
        met = members.groupBy("shingle").agg(*counts, F.sum(twice).alias("own"), *[F.min(c).alias(c) for c in leads])
        # pairs of one group or of one shingle before, without counting pairs of both twice
        both = cells.where("prev != shingle").withColumn("both", twice)
        before = both.groupBy("shingle", "prev").agg(*counts, F.sum("both").alias("both")).groupBy("shingle").agg((F.sum(twice) - F.sum("both")).alias("before"))
        found = met.join(before, "shingle", "left").withColumn("pairs", (twice - F.col("own") - F.coalesce("before", F.lit(0))) / 2)
        met = saved(found.where("pairs > 0").select("shingle", F.col("c").alias("rows"), "pairs", F.array_compact(F.array(*leads)).alias("leads")), "open-shingles")
        kept += [placed, met]
    return placed, met


def listed(placed: DataFrame, at: DataFrame, similarity: float) -> DataFrame:
    """The pairs of rows of different groups at the shingles in at, each where its rows first meet."""
    rows = placed.join(at.select("shingle"), "shingle", "left_semi").select("shingle", "prev", "home", F.struct(*ROW, "n", "reach").alias("x"), F.col("group").alias("x_group"))
    both = rows.where("home").drop("home").join(rows.drop("home").withColumnsRenamed({"prev": "y_prev", "x": "y", "x_group": "y_group"}), "shingle")
    # x is the shorter one, or of equal lengths the first; then both are at home
    longer = (F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (_row(["x.row_id", "x.row_hash"]) < _row(["y.row_id", "y.row_hash"])))
    first = (F.col("prev") != F.col("y_prev")) | (F.col("prev") == F.col("shingle"))
    return both.where((F.col("x_group") != F.col("y_group")) & longer & first & _could_be("x", "y", similarity)).select(*_pair("y", "x"))


def divided(placed: DataFrame, hot: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """An index of the rows at hot shingles (hot: shingle, rows), each shingle divided by another one.

    All rows of a hot shingle have it in common, so it tells nothing there. Two of them that resemble still share one of
    their first shingles in any other order; here it is that of the hot shingle's own rows, those that few of them have
    first, as a sample of CELL_SAMPLE of these rows tells. A new shingle stands for the hot one and the one that divides it."""
    rows = placed.join(small(hot, 24), "shingle").select("shingle", *ROW, "group", "length", F.ceil(F.col("rows") / CELL_SAMPLE).alias("parts"))
    each = rows.join(sets, ROW).select("shingle", *ROW, "n", "group", "length", "parts", F.explode("shingles").alias("inner"))
    drawn = F.pmod(F.xxhash64(*ROW, "shingle"), F.col("parts")) == 0
    times = saved(each.where(drawn).groupBy("shingle", "inner").agg(F.count("*").alias("times")).where("times > 1"), "inner-times")
    of_row = Window.partitionBy("shingle", *ROW).orderBy("times", "inner")
    known = each.join(small(times, 24), ["shingle", "inner"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    whole, place = Window.partitionBy("shingle", *ROW), F.row_number().over(of_row) - 1
    far = F.floor((F.col("n") - F.col("place")) * F.lit((1 + similarity) / similarity) - F.col("n") + 1e-6).cast("int")
    placed = known.withColumns({"place": place, "before": F.coalesce(F.lag("inner").over(of_row), F.col("inner")), "lone": F.count_if(F.col("times") == 0).over(whole).cast("int")})
    placed = placed.where(F.col("place") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9)).withColumn("reach", far)
    placed = placed.where(F.col("length").between(*_classes(similarity))).withColumn("home", _home())
    new = lambda c: F.xxhash64("shingle", c)
    return placed.select(new("inner").alias("shingle"), new("before").alias("prev"), *ROW, "n", "reach", "length", "home", "lone", "group")


def linked_by_prefixes(whole: DataFrame, prefixes: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, root: the groups, joined by all links that the index holds.

    While there are too many pairs to list, LEADERS rows of each shingle meet the others. That settles copies of one page;
    when it no longer helps, unlike texts with much in common are left (pages of one template), and shingles of too many
    pairs are divided. Then all pairs are listed."""
    spark = whole.sparkSession
    index, last = whole, None
    for round_no in range(LEADER_ROUNDS + 1):
        placed, met = opened(index, groups)
        held = met.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
        few = (held.pairs or 0) <= PAIRS_A_ROW * (held.rows or 0) + LEAST_PAIRS
        if few or round_no == LEADER_ROUNDS or (last is not None and held.pairs > LEAST_GAIN * last):
            break
        last = held.pairs
        with temporaries(spark) as kept:
            led = placed.join(met, "shingle").withColumn("here", F.struct(*ROW, "n", "reach"))
            left = saved(led.where("not array_contains(leads.row, here)").select(*[c for c in placed.columns if c != "group"]), "prefix-index")
            each = led.select("here", "group", F.explode("leads").alias("l")).select("here", "group", F.col("l.row").alias("lead"), F.col("l.group").alias("lead_group"))
            found = each.where((F.col("group") != F.col("lead_group")) & _could_be("here", "lead", similarity)).select(*_pair("here", "lead"))
            joined = _joined(groups, verified(possible(found, prefixes, similarity), texts, shingle, similarity))
            kept += [left, joined]
        for old in (placed, met, groups, *([index] if round_no else [])):
            discard(old)
        index, groups = left, joined
    few = few or held.pairs <= LISTED_A_ROW * held.rows
    crowded = F.col("pairs") > PAIRS_A_ROW * F.col("rows") + CELL_PAIRS
    pairs, sets = listed(placed, met if few else met.where(~crowded), similarity), None
    for _ in range(0 if few else DIVISIONS):
        hot = saved(met.where(crowded).select("shingle", "rows", "pairs"), "hot-shingles")
        before = hot.agg(F.sum("pairs")).first()[0]
        if not before:
            break
        if sets is None:
            asked = saved(placed.join(small(hot, 24), "shingle", "left_semi").select(*ROW).distinct(), "hot-rows")
            sets = saved(shingle_sets(texts.join(small(asked, 24), ROW, "left_semi"), shingle), "hot-sets")
        with temporaries(spark) as kept:
            parts, inner = opened(divided(placed, hot, sets, similarity), groups)
            kept += [parts, inner]
        if (inner.agg(F.sum("pairs")).first()[0] or 0) > before / 2:  # copies of one text, which nothing divides
            pairs = pairs.unionByName(listed(placed, hot, similarity))
            break
        placed, met = parts, inner
        pairs = pairs.unionByName(listed(placed, met.where(~crowded), similarity))
    else:
        if not few:  # what can't be divided further
            pairs = pairs.unionByName(listed(placed, met.where(crowded), similarity))
    return _joined(groups, verified(possible(pairs, prefixes, similarity), texts, shingle, similarity))


def similar_rows(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """row_id, row_hash, first_id, first_hash: the rows that aren't the first of their group, and the row that is."""
    texts = text_rows(docs)
    rows = saved(text_classes(texts, shingle), "text-classes")
    reps = saved(rows.groupBy("n1", "n2").agg(F.min(_row()).alias("first"), F.first("fp").alias("fp"), F.count("*").alias("copies")), "first-rows")
    reps = reps.select(F.col("first.id").alias("row_id"), F.col("first.hash").alias("row_hash"), "n1", "n2", "fp", "copies")
    repeated = reps.where("copies > 1").select("n1", "n2", F.col("row_id").alias("first_id"), F.col("row_hash").alias("first_hash"))
    equal = saved(rows.join(small(saved(repeated, "repeated-classes"), 48), ["n1", "n2"]).where("row_id != first_id or row_hash != first_hash").select(*ROW, "first_id", "first_hash").distinct(), "equal-rows")
    # pairs are of first rows alone: comparing them needs no join that takes the equal rows out of all texts
    groups = _joined(None, verified(saved(by_fingerprint(reps, max_bits), "fingerprint-pairs"), texts, shingle, similarity))
    with temporaries(docs.sparkSession) as kept:
        firsts = texts.join(small(equal.select(*ROW), 24), ROW, "left_anti")
        groups = linked_by_prefixes(*prefix_index(firsts, shingle, similarity), groups, texts, shingle, similarity)
        kept.append(groups)
    groups = saved(groups.select(F.col("node.id").alias("first_id"), F.col("node.hash").alias("first_hash"), "root"), "similar-groups")
    far = groups.select(F.col("first_id").alias("row_id"), F.col("first_hash").alias("row_hash"), F.col("root.id").alias("first_id"), F.col("root.hash").alias("first_hash"))
    moved = equal.join(small(groups, 48), ["first_id", "first_hash"], "left").select(*ROW, F.coalesce("root.id", "first_id").alias("first_id"), F.coalesce("root.hash", "first_hash").alias("first_hash"))
    return far.unionByName(moved)


def without_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with their columns, that are the first of their group."""
    with temporaries(docs.sparkSession) as kept:
        gone = saved(similar_rows(docs, shingle, similarity), "similar-rows")
        kept.append(gone)
    return _one_each(without_rows(docs, gone))


def _one_each(docs: DataFrame) -> DataFrame:
    """docs with one of the rows that repeat both doc_id and text: the first in the order of their other columns' hash."""
    keys = text_rows(docs).drop("body")
    twice = saved(keys.groupBy("row_id", "row_hash").count().where("count > 1"), "repeated-rows")
    if twice.isEmpty():
        return docs
    hashed = with_row_key(docs)
    again = small(twice.select(F.col("row_id").alias("__row_id"), F.col("row_hash").alias("__row_hash")), 24)
    keys = ["__row_id", "__row_hash"]
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # these have a hash
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*plain)))
    one = hashed.join(again, keys, "left_semi").withColumn("__n", first).where("__n = 1").drop("__n")
    return hashed.join(again, keys, "left_anti").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
