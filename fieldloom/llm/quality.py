"""Quality rules: counts over each text and a hashed n-gram classifier with calibrated probabilities.

Rules (fixed thresholds): a text fails if it has under 50 words, or if over half of its words stand in three-word
windows that occur twice or more in it. Of the rest, a text is kept if its probability of good quality is THRESHOLD
or more.

Classifier: lower-cased words, pairs of neighbours, and runs of 3 to 5 bytes, hashed into 2^BITS weights; each family
is averaged over the text. Logistic regression is trained by numpy on at most ``per_class`` labelled documents of
each class, and a logistic fit on a fifth of them, which training doesn't see, calibrates it.

Nulls: a null or empty text has no words and fails; a null doc_id stays null; repeated rows get equal results. With
labels of one class only, or none, the classifier passes everything. An empty table gives no rows. Very long texts are
scored whole. Columns of any name pass untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .samples import labelled_sample
from .toxicity import logistic

PER_CLASS, MAX_CHARS = 1500, 50_000
BITS, EPOCHS, RATE, RIDGE = 18, 12, 0.5, 1e-7
THRESHOLD, MIN_WORDS, MAX_REPEATED = 0.5, 50, 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three that occurs twice or more."""
    if len(ids) < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    n = np.int64(ids.max()) + 1
    if n < 1 << 21:
        key = (a * n + b) * n + c
    else:
        _, pair = np.unique(a * n + b, return_inverse=True)
        key = pair * n + c
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int((twice | np.r_[False, twice[:-1]] | np.r_[False, False, twice[:-2]]).sum())


def measure(body: bytes) -> tuple[tuple[int, ...], list[bytes], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words and their numbers in the text."""
    words = body.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    joined = b"".join(words)
    seen: set[bytes] = set()
    again = 0
    for line in body.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    counts = (len(words), len(joined.decode(errors="replace")), len(body) - len(body.translate(None, SYMBOLS)), again, repeated_words(ids))
    return counts, list(number), ids


def features(body: bytes, distinct: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """Slots of the words, word pairs and byte runs of a text; one array for each family."""
    shift = np.uint64(64 - BITS)
    if not len(ids):
        return []
    hashed = np.array([zlib.crc32(w.lower()) for w in distinct], np.uint64)[ids] + np.uint64(1)
    with np.errstate(over="ignore"):
        out = [(hashed * ODD) >> shift]
        if len(ids) > 1:
            out.append(((hashed[:-1] * np.uint64(31) + hashed[1:] + np.uint64(7)) * ODD) >> shift)
        raw = np.frombuffer(body, np.uint8).astype(np.uint64)
        run = raw
        for n in range(1, 5):
            if len(raw) <= n:
                break
            run = (run[:-1] << np.uint64(8)) | raw[n:]
            if n >= 2:
                out.append(((run + np.uint64(n << 56)) * ODD) >> shift)
    return out


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, slots: list[np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[s].mean()) for s in slots)

    def probability(self, slots: list[np.ndarray]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30)))


def train(rows: list[tuple[int, str, float]]) -> Classifier:
    """Weights from four fifths of the rows by Adagrad, calibration from the rest. rows: (doc_id, text, y)."""
    data = []
    for doc_id, text, y in sorted(rows):
        body = text.encode(errors="replace")
        _, distinct, ids = measure(body)
        slots = features(body, distinct, ids)
        if slots:
            where, n = np.unique(np.concatenate(slots), return_inverse=True)
            value = np.bincount(n, weights=np.concatenate([np.full(len(s), 1 / len(s)) for s in slots]))
            held = zlib.crc32(str(doc_id).encode()) % 5 == 1  # for calibration, which alone needs the slots as they stand
            data.append((held, where.astype(np.int32), value, float(y > 0.5), slots if held else None))
    weights, bias = np.zeros(1 << BITS), 0.0
    if len({d[3] for d in data}) < 2:
        return Classifier(weights.astype(np.float32), 0.0, 0.0, 30.0)
    squares, order = np.full(1 << BITS, 1e-8), [i for i, d in enumerate(data) if not d[0]]
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            _, where, value, y, _ = data[i]
            p = 1 / (1 + np.exp(-np.clip(bias + weights[where] @ value, -30, 30)))
            g = (p - y) * value + RIDGE * weights[where]
            squares[where] += g * g
            weights[where] -= RATE * g / np.sqrt(squares[where])
            bias -= 0.02 * (p - y)
    model = Classifier(weights.astype(np.float32), bias, 1.0, 0.0)
    check = [d for d in data if d[0]]
    if len({d[3] for d in check}) == 2:
        y = np.array([d[3] for d in check])
        model.slope, model.shift = logistic(np.array([model.margin(d[4]) for d in check]), y, np.ones(len(y)))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Classifier:
    sample = labelled_sample(docs, labels, "quality", per_class, max_chars)
    return train([(r["doc_id"], r["text"], r["y"]) for r in sample.select("doc_id", "text", "y").collect()])  # 2 * per_class texts of max_chars at most


def judged(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, probability, kept; one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in it:
            counts, probability = [], []
            for body in pdf["body"]:
                c, distinct, ids = measure(body)
                counts.append(c)
                probability.append(m.probability(features(body, distinct, ids)))
            out = pd.DataFrame(counts, columns=names)
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
            out["probability"] = probability
            out["kept"] = ~out["base_failed"] & (out["probability"] >= threshold)
            out["doc_id"] = pdf["row_id"].where(pdf["known"]).astype("Int64")
            yield out

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("row_id"), doc_id.isNotNull().alias("known"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    schema = f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, probability double, kept boolean"
    return rows.mapInPandas(judge, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
