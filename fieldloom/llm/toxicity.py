"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Fitting (all bounds are parameters): at most ``per_class`` labelled documents of each class are the examples. Terms
are lower-cased words and their prefixes (inflected forms share a stem); the ``max_terms`` terms whose share of toxic
examples is, by the lower end of a Wilson interval, furthest above the base rate are the vocabulary. Document
frequencies of these terms come from all documents.

Scoring: a text is its vector (1 + log tf) * idf over the vocabulary. Examples are numbered in blocks; for each term
and block the index has the largest weight. Blocks are opened in order of their upper bound until the k-th best
cosine is not below the next bound, so the k nearest examples are exact. Their votes, weighted by cosine, and a prior
vote give a raw score; a logistic fit of the examples' leave-one-out votes, weighted to the class counts of all
labelled rows, calibrates it. The evidence lists the nearest examples.

Labels are learnt only from rows outside the held-out fold (crc32 of the id, modulo 5, is 0). Only the text is scored.

Nulls: a null text is empty; an empty text (or one without any term) has no neighbour and gets the calibrated prior;
a null doc_id is not held out. Repeated rows get equal scores. Labels of one class only, or none, tell nothing: then
every score is (nearly) 0. An empty table gives no rows. Very long texts are scored whole (as examples only texts of up to
max_chars serve). Of equally near examples the one with the smaller number counts. Columns of any name pass untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, give_back, saved, table, temporaries, without_rows
from .samples import class_counts, crc_fold, labelled_sample

PER_CLASS, MAX_TERMS, MAX_CHARS = 2500, 1024, 100_000
NEIGHBOURS, BLOCK, PRIOR_VOTE = 15, 64, 0.3
PREFIXES = range(4, 9)
WORD = re.compile(r"[^\W\d_]+")
KEPT_WORDS, HELD_TERMS = 60_000, 150_000


def terms_of(word: str) -> list[str]:
    """A word and, marked by a hyphen, its prefixes."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


class Vocabulary:
    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> dict[int, int]:
        """Term numbers and how often each is in the text."""
        out: Counter = Counter()
        kept, index = self.kept, self.index
        for word, n in Counter(WORD.findall(text.lower())).items():
            if (found := kept.get(word)) is None:
                found = tuple(index[t] for t in terms_of(word) if t in index)
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                kept[word] = found
            for t in found:
                out[t] += n
        return dict(sorted(out.items()))


class BlockMaxIndex:
    """Examples as sparse unit vectors, with the largest weight of each term in each block of examples."""

    def __init__(self, vectors: list[dict[int, float]], terms: int, block: int = BLOCK):
        self.size, self.block = len(vectors), block
        self.blocks = -(-len(vectors) // block)
        self.most = np.zeros((self.blocks, terms))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for i, v in enumerate(vectors):
            for t, w in v.items():
                postings[t].append((i, w))
                self.most[i // block, t] = max(self.most[i // block, t], w)
        self.ids = [np.array([i for i, _ in p], np.int64) for p in postings]
        self.weights = [np.array([w for _, w in p]) for p in postings]
        edges = np.arange(self.blocks + 1) * block
        self.cuts = [np.searchsorted(ids, edges) for ids in self.ids]

    def nearest(self, vector: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The k examples of largest cosine above zero (ties: the smaller number), exactly."""
        if not vector or not self.size:
            return []
        terms = np.fromiter(vector, np.int64)
        weights = np.fromiter(vector.values(), float)
        bounds = self.most[:, terms] @ weights
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < -best[-1][0] - 1e-12):
                break
            scores = np.zeros(self.block)
            for t, w in zip(terms.tolist(), weights.tolist()):
                a, z = self.cuts[t][b], self.cuts[t][b + 1]
                scores[self.ids[t][a:z] - b * self.block] += w * self.weights[t][a:z]
            hits = np.flatnonzero(scores > 0)
            best = sorted(best + [(-s, int(i) + b * self.block) for s, i in zip(scores[hits].tolist(), hits)])[:k]
        return [(i, -s) for s, i in best]


class Model:
    """Vocabulary, idf, index, labels and calibration; small, and sent to the workers as it is."""

    def __init__(self, terms: list[str], frequency: np.ndarray, documents: int, examples: list[tuple[int, dict[int, int], float]], weights: tuple[float, float]):
        self.terms, self.vocabulary = terms, None
        self.idf = np.log((documents + 1) / (frequency + 1)) + 1
        self.ids = [e[0] for e in examples]
        self.y = np.array([e[2] for e in examples])
        self.index = BlockMaxIndex([self.vector(e[1]) for e in examples], len(terms))
        self.prior = float(np.average(self.y, weights=np.where(self.y > 0.5, weights[1], weights[0]))) if len(self.y) else 0.0
        raw, y, w = [self.vote([])], [0.0], [1.0]  # one clean text without evidence, so that even labels don't condemn all
        for i, (_, counts, label) in enumerate(examples):
            near = [(j, s) for j, s in self.index.nearest(self.vector(counts), NEIGHBOURS + 1) if j != i][:NEIGHBOURS]
            raw.append(self.vote(near))
            y.append(label)
            w.append(weights[1] if label > 0.5 else weights[0])
        self.slope, self.shift = logistic(np.array(raw), np.array(y), np.array(w)) if len({e[2] > 0.5 for e in examples}) > 1 else (0.0, -30.0)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def vote(self, near: list[tuple[int, float]]) -> float:
        """The prior counts as one neighbour at cosine PRIOR_VOTE."""
        total = sum(s for _, s in near)
        p = (sum(s * self.y[i] for i, s in near) + PRIOR_VOTE * self.prior) / (total + PRIOR_VOTE)
        p = min(max(p, 1e-3), 1 - 1e-3)
        return float(np.log(p / (1 - p)))

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        if self.vocabulary is None:
            self.vocabulary, self.seen = Vocabulary(self.terms), {}
        counts = self.vocabulary.counts(text)
        key = tuple(counts.items())
        if key not in self.seen:
            near = self.index.nearest(self.vector(counts), NEIGHBOURS)
            p = 1 / (1 + np.exp(-(self.slope * self.vote(near) + self.shift)))
            if len(self.seen) >= 5_000:
                self.seen.clear()
            self.seen[key] = (float(p), near)
        return self.seen[key]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit, by Newton steps with a small ridge."""
    a, w = np.c_[x, np.ones_like(x)], w / w.mean()
    beta = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def choose_terms(sample: DataFrame, max_terms: int) -> list[str]:
    """Terms with a larger share of toxic examples than all examples have, the surest first."""

    def counted(total: Counter, toxic: Counter) -> pd.DataFrame:
        return pd.DataFrame({"term": list(total), "n": list(total.values()), "toxic": [toxic[t] for t in total]}).astype({"term": object, "n": "int64", "toxic": "int64"})

    def distinct(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            total: Counter = Counter()
            toxic: Counter = Counter()
            for text, y in zip(pdf["text"], pdf["y"]):
                found = {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
                total.update(found)
                if y > 0.5:
                    toxic.update(found)
                if len(total) > HELD_TERMS:
                    yield counted(total, toxic)
                    total, toxic = Counter(), Counter()
            yield counted(total, toxic)

    size = sample.agg(F.count("*"), F.sum((F.col("y") > 0.5).cast("long"))).first()
    if not size[0] or not size[1]:
        return []
    base, z2 = size[1] / size[0], 6.25
    p = F.col("toxic") / F.col("n")
    wilson = (p + z2 / (2 * F.col("n")) - F.sqrt(z2 * (p * (1 - p) / F.col("n") + z2 / (4 * F.col("n") * F.col("n"))))) / (1 + z2 / F.col("n"))
    sums = sample.select("text", "y").mapInPandas(distinct, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    sure = sums.where(F.col("toxic") >= 3).withColumn("surplus", wilson - (base + (1 - base) * 0.25)).where("surplus > 0")
    return [r[0] for r in sure.orderBy(F.desc("surplus"), "term").limit(max_terms).collect()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_terms: int = MAX_TERMS, max_chars: int = MAX_CHARS) -> Model:
    train = labels.where((crc_fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1))
    sample = saved(labelled_sample(docs, train, "toxic", per_class, max_chars), "toxicity-examples")
    terms = choose_terms(sample, max_terms)

    def frequencies(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(terms)
        for pdf in it:
            df = np.zeros(len(terms) + 1, np.int64)
            df[-1] = len(pdf)
            for text in pdf["text"]:
                for t in vocabulary.counts(text):
                    df[t] += 1
            yield pd.DataFrame({"term": np.arange(len(df)), "n": df})
        give_back()

    def examples(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(terms)
        for pdf in it:
            counts = [vocabulary.counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "t": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    df = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select(text).mapInPandas(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term
        df[r[0]] = r[1]
    rows = sample.mapInPandas(examples, "doc_id long, y double, t array<int>, n array<int>").collect()  # at most 2 * per_class rows
    rows = sorted((r[0], dict(zip(r[2], r[3])), r[1]) for r in rows)
    rows.sort(key=lambda e: (min(e[1], default=len(terms)), e[0]))  # examples that share their first term share blocks
    held = Counter(bool(e[2] > 0.5) for e in rows)
    known = class_counts(train, "toxic")
    weights = tuple(known.get(c, 0) / max(1, held[bool(c)]) for c in (0, 1))
    return Model(terms, df[:-1].astype(float), int(df[-1]), rows, weights)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """row_id, row_hash, doc_id, score, evidence (example:cosine:label, nearest first)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class and max_terms

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in it:
            out = [m.score(t) for t in pdf.pop("text")]
            evidence = [",".join(f"{m.ids[i]}:{s:.4f}:{m.y[i]:g}" for i, s in near[:5]) for _, near in out]
            yield pdf.assign(score=[p for p, _ in out], evidence=evidence)
        m.vocabulary, m.seen = None, {}
        give_back()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("row_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    out = rows.mapInPandas(score, "row_id long, row_hash long, score double, evidence string")
    return out.withColumn("doc_id", F.when(F.col("row_id") != NULL_ID, F.col("row_id")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with their columns, that score below the threshold."""
    with temporaries(docs.sparkSession) as kept:
        toxic = saved(scores(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("row_id", "row_hash"), "toxic-rows")
        kept.append(toxic)
    return without_rows(docs, toxic)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
