"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

Base spans are found in the whole text by fixed patterns and checks. The network is trained by numpy from labelled
spans: windows of a bounded sample of documents, in which everything of the shape of a kind is labelled, also what
fails the check (a mistyped card number or an impossible address is personal data as well). It reads characters,
so it finds such spans from their form and surroundings.

A span of any kind holds a digit or an @. Stretches without either are all outside, so only windows around these
characters are decoded (Viterbi over CRF transitions). Windows overlap by half. Spans that touch an inner edge of their
window are pieces: overlapping ones of a kind are joined, so a span may be longer than a window, and the joined span
counts if pieces saw both its ends. All spans of a text meet in one weighted interval scheduling, which keeps the set of
disjoint spans with the most votes. Base spans stay; a decoded span that overlaps one is dropped.

Nulls: a null text is empty and has no spans; a null doc_id stays null; repeated rows get equal results. With no
training window only base spans are returned; an empty table gives no rows. Very long texts go through the network window
by window. Spans that begin together are ordered as the kinds are listed. Columns of any name pass untouched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
TRAIN_WINDOWS, SAMPLED, EPOCHS, BATCH, RATE = 1200, 20, 8, 32, 0.01
EMBED, HIDDEN = 10, 16
LEAST_SPAN = 6  # the shortest span that the network may add
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# In ip a start inside a run of digits can match only where the run's start does, so such starts are passed over.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, so in time linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def shaped(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes the checks) of everything that has the form of a kind."""
    out = [(a, z, "email", True) for a, z in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        out.append((m.start(), m.end(), "ip", all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            out.append((m.start(), m.end(), "card", luhn(digits)))
    for m in PHONE.finditer(text) if "+" in text else ():
        out.append((m.start(), m.end(), "phone", 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the network


def codes(text: str) -> list[int]:
    """Printable ASCII as it is; other letters, digits, spaces and the rest as one class each; 0 is padding."""
    return [ord(c) - 31 if " " <= c <= "~" else 96 if c.isalpha() else 97 if c.isdigit() else 98 if c.isspace() else 99 for c in text]


SYMBOLS = 100


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; parameters in p."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {"embed": rng.normal(0, 0.3, (SYMBOLS, e)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in ("f", "b"):
            self.p |= {f"{d}x": rng.normal(0, 0.3, (e, 4 * h)), f"{d}h": rng.normal(0, 0.2, (h, 4 * h)), f"{d}c": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, tuple]:
        """x: (windows, steps, embed). Gates are input, forget, output, candidate."""
        n, steps, _ = x.shape
        h = HIDDEN
        xw = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        hs, cs, gates = np.zeros((steps + 1, n, h)), np.zeros((steps + 1, n, h)), np.zeros((steps, n, 4 * h))
        for t in range(steps):
            z = xw[:, t] + hs[t] @ self.p[f"{d}h"]
            g = gates[t]
            g[:, : 3 * h] = sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cs[t + 1] = g[:, h : 2 * h] * cs[t] + g[:, :h] * g[:, 3 * h :]
            hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
        return hs[1:].transpose(1, 0, 2), (x, hs, cs, gates)

    def lstm_back(self, grad: np.ndarray, kept: tuple, d: str, g: dict) -> np.ndarray:
        x, hs, cs, gates = kept
        n, steps, _ = x.shape
        h = HIDDEN
        dz = np.zeros((steps, n, 4 * h))
        dh, dc = np.zeros((n, h)), np.zeros((n, h))
        for t in range(steps - 1, -1, -1):
            i, f, o, c = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            dh = dh + grad[:, t]
            squashed = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - squashed**2)
            dz[t] = np.concatenate([dc * c * i * (1 - i), dc * cs[t] * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - c**2)], axis=1)
            dh = dz[t] @ self.p[f"{d}h"].T
            dc = dc * f
        g[f"{d}x"] = np.einsum("nte,tng->eg", x, dz)
        g[f"{d}h"] = np.einsum("tnh,tng->hg", hs[:-1], dz)
        g[f"{d}c"] = dz.sum((0, 1))
        return dz.transpose(1, 0, 2) @ self.p[f"{d}x"].T

    def emissions(self, chars: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][chars]
        forward, kept_f = self.lstm(x, "f")
        backward, kept_b = self.lstm(x[:, ::-1], "b")
        both = np.concatenate([forward, backward[:, ::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, kept_f, kept_b)

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag sequences, and its gradients."""
        p = self.p
        e, (both, kept_f, kept_b) = self.emissions(chars)
        n, steps, k = e.shape
        alpha, beta = np.zeros((steps, n, k)), np.zeros((steps, n, k))
        alpha[0] = p["first"] + e[:, 0]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            m = x.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))

        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["move"], 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(p["move"] + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(n)
        gold = p["first"][tags[:, 0]] + sum(e[rows, t, tags[:, t]] for t in range(steps)) + sum(p["move"][tags[:, t - 1], tags[:, t]] for t in range(1, steps))
        de = np.exp((alpha + beta - z[:, None]).transpose(1, 0, 2))
        np.subtract.at(de, (rows[:, None], np.arange(steps)[None], tags), 1)
        de /= n
        g: dict = {"first": de[:, 0].sum(0), "bias": de.sum((0, 1)), "out": np.einsum("nth,ntk->hk", both, de)}
        move = np.zeros((k, k))
        for t in range(1, steps):
            move += np.exp(alpha[t - 1][:, :, None] + p["move"] + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.subtract.at(move, (tags[:, t - 1], tags[:, t]), 1)
        g["move"] = move / n
        dboth = de @ p["out"].T
        dx = self.lstm_back(dboth[:, :, :HIDDEN], kept_f, "f", g) + self.lstm_back(dboth[:, ::-1, HIDDEN:], kept_b, "b", g)[:, ::-1]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], chars, dx)
        return float((z - gold).mean()), g

    def train(self, chars: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(1)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for i in range(0, len(order), BATCH):
                _, g = self.loss(chars[order[i : i + BATCH]], tags[order[i : i + BATCH]])
                step += 1
                for k in self.p:
                    d = np.clip(g[k], -5, 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        e, _ = self.emissions(chars)
        n, steps, k = e.shape
        best, back = self.p["first"] + e[:, 0], np.zeros((steps, n, k), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["move"]
            back[t] = paths.argmax(1)
            best = paths.max(1) + e[:, t]
        tags, rows = np.zeros((n, steps), np.int8), np.arange(n)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags


def window_starts(text: str) -> list[int]:
    """Starts of windows, STRIDE apart, that between them see each digit and @ with half a window on either side."""
    out: list[int] = []
    for m in re.finditer(r"[0-9@]+", text):
        low, high = max(0, m.start() - STRIDE) // STRIDE * STRIDE, m.end()
        for s in range(max(low, out[-1] + STRIDE if out else 0), high, STRIDE):
            out.append(s)
    return out


def padded(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WINDOW), np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = codes(t)
    return out


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in one window; an inside tag without a begin opens a span too."""
    out, start, kind = [], 0, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        k, begins = (t - 1) // 2 if t else -1, t % 2 == 1
        if kind >= 0 and (k != kind or begins):
            out.append((start, i, kind))
            kind = -1
        if k >= 0 and kind < 0:
            start, kind = i, k
    return out


def reconcile(spans: Counter) -> list[tuple[int, int, int]]:
    """Of (start, end, kind) with votes, the disjoint ones of the largest sum of votes times length."""
    order = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in order]
    best: list[tuple[int, int]] = [(0, -1)]  # value, chosen span or -1 for none at this place
    for i, s in enumerate(order):
        before = bisect_right(ends, s[0], 0, i)
        take = best[before][0] + spans[s] * (s[1] - s[0])
        best.append((take, i) if take > best[-1][0] else (best[-1][0], -1))
    out, i = [], len(order)
    while i:
        if best[i][1] >= 0:
            s = order[best[i][1]]
            out.append(s)
            i = bisect_right(ends, s[0], 0, best[i][1])
        else:
            i -= 1
    return out[::-1]


def joined(pieces: list[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind) from pieces (start, end, kind, goes on to the left, to the right) of a text.

    Pieces of one kind that overlap are one span; it counts if a piece saw its start and one its end.
    """
    out: list[tuple[int, int, int]] = []
    for kind in sorted({p[2] for p in pieces}):
        start = end = None
        left = right = False
        for a, z, _, l, r in sorted(p[:2] + (0,) + p[3:] for p in pieces if p[2] == kind):
            if end is None or a >= end:
                if end is not None and not (left or right):
                    out.append((start, end, kind))
                start, end, left, right = a, z, l, r
            else:
                left = left and (a > start or l)
                end, right = (z, r) if z > end else (end, right and (z < end or r))
        if end is not None and not (left or right):
            out.append((start, end, kind))
    return out


def drawn(docs: DataFrame, share: float) -> DataFrame:
    """That share of the documents, by 40 bits of a hash, so that it stays above 0 for some 10^12 documents."""
    h = F.xxhash64("doc_id", "text")
    place = F.pmod(h, F.lit(1 << 20)) * (1 << 20) + F.pmod(F.shiftright(h, 20), F.lit(1 << 20))
    return docs.where(place < int(share * (1 << 40)))


def training_windows(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> list[tuple[str, list[int]]]:
    """At most limit windows with their tags, those of smallest hash."""

    def windows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for text in pdf["text"]:
                spans = []
                for a, z, kind, _ in shaped(text):
                    if not spans or a >= spans[-1][1]:
                        spans.append((a, z, KINDS.index(kind)))
                for s in window_starts(text):
                    tags = [0] * WINDOW
                    for a, z, k in spans:
                        if a < s + WINDOW and z > s:
                            for i in range(max(a, s), min(z, s + WINDOW)):
                                tags[i - s] = 2 * k + (1 if i == a else 2)
                    out.append((text[s : s + WINDOW], tags))
            yield pd.DataFrame(out, columns=["text", "tags"])

    # about SAMPLED documents for each window wanted, by hash, so that what is sorted stays bounded
    share = min(1.0, SAMPLED * limit / max(1, docs.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    some = drawn(docs, share).select(text.alias("text")).where(F.col("text").rlike("[0-9@]")).mapInPandas(windows, "text string, tags array<int>")
    rows = some.orderBy(F.xxhash64("text"), "text").limit(limit).collect()
    return [(r[0], list(r[1])) for r in rows]


def fit(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> Tagger | None:
    windows = training_windows(docs, limit)
    if not windows:
        return None
    tagger = Tagger()
    tagger.train(padded([t for t, _ in windows]), np.array([t for _, t in windows]))
    return tagger


def decoded(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """The network's spans of each text."""
    where = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    votes: list[Counter] = [Counter() for _ in texts]
    pieces: list[list] = [[] for _ in texts]

    def vote(i: int, a: int, z: int, k: int) -> None:
        piece = texts[i][a:z]
        a, z = a + len(piece) - len(piece.lstrip()), z - len(piece) + len(piece.rstrip())
        if z - a >= LEAST_SPAN and re.search("[0-9@]", piece):
            votes[i][a, z, k] += 1

    for a in range(0, len(where), 512):
        some = where[a : a + 512]
        tags = tagger.decode(padded([texts[i][s : s + WINDOW] for i, s in some]))
        for (i, s), row in zip(some, tags):
            text = texts[i]
            for x, z, k in tagged_spans(row[: len(text) - s]):
                left, right = x == 0 and s > 0, z == WINDOW and s + WINDOW < len(text)
                if left or right:
                    pieces[i].append((s + x, s + z, k, left, right))
                else:
                    vote(i, s + x, s + z, k)
    for i, cut in enumerate(pieces):
        for a, z, k in joined(cut):
            vote(i, a, z, k)
    return [reconcile(v) for v in votes]


def found(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, spans (array of start, end, kind, base): base spans and the network's, by start and kind."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf["text"].tolist()
            base = [[(a, z, k) for a, z, k, passes in shaped(t) if passes] for t in texts]
            more = decoded(texts, sent.value) if sent.value else [[] for _ in texts]
            out = []
            for b, m in zip(base, more):
                fresh = [(a, z, KINDS[k]) for a, z, k in without_overlaps(m, b)]
                spans = [(a, z, k, True) for a, z, k in b] + [(a, z, k, False) for a, z, k in fresh]
                out.append([{"start": a, "end": z, "kind": k, "base": s} for a, z, k, s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pd.DataFrame({"doc_id": pdf["row_id"].where(pdf["known"]).astype("Int64"), "spans": out})

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("row_id"), doc_id.isNotNull().alias("known"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInPandas(find, "doc_id long, spans array<struct<start:long,end:long,kind:string,base:boolean>>")


def without_overlaps(spans: list[tuple[int, int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of base, which are sorted by start."""
    starts, reach = [a for a, _, _ in base], list(accumulate((z for _, z, _ in base), max))
    return [s for s in spans if not (n := bisect_left(starts, s[1])) or reach[n - 1] <= s[0]]


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = found(docs, fit(docs))
    said = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return spans.select(
        "doc_id",
        *[F.expr(f"size(filter(spans, s -> s.base and s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(said.format("filter(spans, s -> s.base)")).cast("binary"), 256).alias("base_sha256"),
        F.expr(said.format("spans")).alias("spans"),
    )
