"""Encoding with a public tokenizer file, run by run.

A tokenizer file whose normalizer and splitting pattern are the known ones (NORMALIZERS, PATTERN) lower-cases, drops
white space, and never merges over the border between letters and other characters, unless an apostrophe stands there.
So the ids of a plain text, of ASCII and Latin letters, are the ids of its runs of letters and of other characters, one
after the other. A text is cut into runs by whole arrays of bytes, and runs of 24 bytes or fewer are looked up in a
table of runs seen before, by all their bytes. New runs of letters are encoded many at a time, without the normalizer
(they are lower-cased and composed already), and the end-of-word ids part them again. Any other text (special tokens,
marks, other scripts) is parted at white space only. Texts for any other tokenizer file are encoded whole. Every id
comes from the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np

#: Runs and pieces that a worker keeps from task to task (some 20 MB and 10 MB), and the bytes that are cut at once.
KEPT_RUNS, KEPT_PIECES, BYTES_AT_ONCE, TEXTS_AT_ONCE, WORDS_AT_ONCE = 1 << 18, 50_000, 1 << 18, 512, 2000
#: Bytes of a plain text: ASCII, and those of the letters U+00C0 to U+017F ...
PLAIN = bytes(range(128)) + b"\xc3\xc4\xc5" + bytes(range(0x80, 0xC0))
#: ... less special tokens, the signs among these letters, and the capital whose lower case has a mark.
NOT_PLAIN = (b"<|", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
#: The normalizer and the splitting pattern of the files whose texts may be parted early.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
SPACE, LETTER, OTHER = 0, 1, 2
KIND_OF_BYTE = np.full(256, OTHER, np.uint8)
KIND_OF_BYTE[[9, 10, 11, 12, 13, 32]] = SPACE
KIND_OF_BYTE[[0x27, *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
#: The first n bytes of a little-endian word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def parts_early(tokenizer) -> bool:
    """Whether the file normalises and splits in the known way."""
    said = lambda part: json.loads(part.__getstate__()) if part else {}
    steps = [n["type"] for n in said(tokenizer.normalizer).get("normalizers", [])]
    splits = said(tokenizer.pre_tokenizer).get("pretokenizers", [{}])
    return steps == NORMALIZERS and splits[0].get("pattern") == {"Regex": PATTERN} and getattr(tokenizer.model, "end_of_word_suffix", None) == END_OF_WORD


class RunTable:
    """Runs of 24 bytes or fewer (as three words and a length) and their ids, in arrays with open addressing."""

    def __init__(self, limit: int, kind: np.dtype):
        self.limit, self.kind = limit, kind
        self.clear()

    def clear(self) -> None:
        self.size, self.filled = 0, 0
        self.keys, self.first, self.count = np.zeros((1024, 4), np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.again, self.ids = np.zeros(1024, bool), np.zeros(4096, self.kind)
        self.slots = np.full(4096, -1, np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)).sum(axis=1, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(20)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each run, -1 if it isn't there."""
        mask = len(self.slots) - 1
        at = self._hash(keys) & mask
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys).any(axis=1))
        while len(left):
            at[left] = (at[left] + 1) & mask
            found[left] = there = self.slots[at[left]]
            left = left[(there >= 0) & (self.keys[there] != keys[left]).any(axis=1)]
        return found

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = self._hash(self.keys[numbers]) & mask
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of equal slots the last one wins
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], (at[lost] + 1) & mask

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Runs that differ from each other and aren't there yet."""
        count = np.array([len(x) // self.kind.itemsize for x in ids], np.int32)
        n, total = self.size + len(keys), self.filled + int(count.sum())
        grown = lambda a, n: a if len(a) >= n else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])
        self.keys, self.first, self.count, self.again, self.ids = grown(self.keys, n), grown(self.first, n), grown(self.count, n), grown(self.again, n), grown(self.ids, total)
        numbers = np.arange(self.size, n, dtype=np.int32)
        self.keys[numbers], self.count[numbers], self.again[numbers] = keys, count, False
        self.first[numbers] = self.filled + np.cumsum(count) - count
        self.ids[self.filled : total] = np.frombuffer(b"".join(ids), self.kind)
        self.size, self.filled = n, total
        if 2 * n > len(self.slots):
            self.slots = np.full(4 << (n - 1).bit_length(), -1, np.int32)
            numbers = np.arange(n, dtype=np.int32)
        self._place(numbers)

    def make_room(self) -> None:
        """When the runs are too many, those that were met once only go."""
        if self.size <= self.limit:
            return
        kept = np.flatnonzero(self.again[: self.size])
        keys, ids = self.keys[kept], [self.ids[a : a + n].tobytes() for a, n in zip(self.first[kept].tolist(), self.count[kept].tolist())]
        self.clear()
        if len(kept) <= self.limit // 2:
            self.add(keys, ids)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 0xFF00 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.parts = parts_early(self.tokenizer)
        self.words = Tokenizer(self.tokenizer.model)  # for words that need no normalizer
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.runs = RunTable(KEPT_RUNS, self.kind)
        self.pieces: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode(errors="replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Runs of letters: one end-of-word id each."""
        out: list[bytes] = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            ids = np.array(self.words.encode_batch_fast([b" ".join(some).decode().lower()], add_special_tokens=False)[0].ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            if len(stops) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self._encode(some)
        return out

    def _encode_runs(self, runs: list[bytes]) -> list[bytes]:
        letters = [(97 <= r[0] <= 122 or r[0] >= 128) and b"'" not in r for r in runs]
        words = iter(self._encode_words([r for r, a in zip(runs, letters) if a]))
        rest = iter(self._encode([r for r, a in zip(runs, letters) if not a]))
        return [next(words if a else rest) for a in letters]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of plain texts."""
        whole = b" " + b" ".join(texts).lower() + b" " * 8
        starts, ends = runs_of(whole)
        length = ends - starts
        short, long = np.flatnonzero(length <= 24), np.flatnonzero(length > 24)
        self.runs.make_room()
        keys = run_keys(whole, starts[short], ends[short])
        found = self.runs.find(keys)
        self.runs.again[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            at = {whole[a:b]: i for i, a, b in zip(new.tolist(), starts[short[new]].tolist(), ends[short[new]].tolist())}
            self.runs.add(keys[list(at.values())], self._encode_runs(list(at)))
            found[new] = self.runs.find(keys[new])
        first, count = self.runs.first[found], self.runs.count[found].astype(np.int64)
        before = np.cumsum(count) - count
        ids = self.runs.ids[np.repeat(first - before, count) + np.arange(int(count.sum()))]
        sizes = np.zeros(len(starts) + 1, np.int64)
        sizes[short] = count
        if len(long):
            words = [whole[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            kinds = list(dict.fromkeys(words))
            known = dict(zip(kinds, self._encode_runs(kinds)))
            sizes[long] = [len(known[w]) // self.kind.itemsize for w in words]
            after = np.searchsorted(short, long)
            edge = np.append(before, len(ids))[after].tolist()
            parts = [x for a, b, w in zip([0, *edge], edge, words) for x in (ids[a:b].tobytes(), known[w])]
            raw = b"".join([*parts, ids[edge[-1] :].tobytes()])
        else:
            raw = ids.tobytes()
        place = np.cumsum(sizes) - sizes
        texts_at = np.cumsum([1, *[len(t) + 1 for t in texts]])
        cuts = (place[np.searchsorted(starts, texts_at)] * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _pieces(self, texts: list[bytes]) -> list[bytes]:
        """The ids of other texts, parted at white space."""
        known = self.pieces
        parted = [t.split() for t in texts]
        new = [p for p in set().union(*parted) if p not in known]
        known.update(zip(new, self._encode(new)))
        out = [b"".join([known[p] for p in pieces]) for pieces in parted]
        if len(known) > KEPT_PIECES:
            known.clear()
        else:
            for p in new:
                if len(p) > 48:
                    del known[p]
        return out

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts, little-endian, of the type in kind."""
        if not self.parts:
            return self._encode(texts)
        out: list[bytes] = [b""] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            (plain if is_plain(t) else other).append(i)
        for encode, which in ((self._plain, plain), (self._pieces, other)):
            for some in bounded(which, texts):
                for i, ids in zip(some, encode([texts[i] for i in some])):
                    out[i] = ids
        return out

    def each(self, texts: Sequence[bytes]) -> Iterator[bytes]:
        """The ids of text after text, some texts ahead."""
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            yield from self.many(list(texts[i : i + TEXTS_AT_ONCE]))

    def __call__(self, text: bytes) -> bytes:
        return self.many([text])[0]


def is_plain(text: bytes) -> bool:
    if text.translate(None, PLAIN) or any(x in text for x in NOT_PLAIN):
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def bounded(which: list[int], texts: list[bytes]) -> Iterator[list[int]]:
    """Runs of the numbers of texts, each of about BYTES_AT_ONCE."""
    some, size = [], 0
    for i in which:
        some.append(i)
        size += len(texts[i])
        if size >= BYTES_AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def runs_of(whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of lower-cased text that begins and ends with white space."""
    raw = np.frombuffer(whole, np.uint8)
    kind = KIND_OF_BYTE[raw]
    border = kind[1:] != kind[:-1]
    quote = np.flatnonzero(raw == 0x27)
    border[quote[kind[quote - 1] == OTHER] - 1] = False  # no border between an apostrophe and other signs
    border[quote[kind[quote + 1] == OTHER]] = False
    edges = np.flatnonzero(border) + 1
    is_run = kind[edges[:-1]] != SPACE
    return edges[:-1][is_run], edges[1:][is_run]


def run_keys(whole: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All bytes of runs of 24 bytes or fewer, as three words, and the length."""
    words = np.ndarray((len(whole) - 7,), "<u8", whole, 0, (1,))
    n = ends - starts
    keys = np.empty((len(starts), 4), np.uint64)
    keys[:, 0] = words[starts] & FIRST[np.minimum(n, 8)]
    keys[:, 1] = words[np.minimum(starts + 8, len(words) - 1)] & FIRST[np.clip(n - 8, 0, 8)]
    keys[:, 2] = np.where(n > 16, words[np.maximum(ends - 8, 0)], np.uint64(0))
    keys[:, 3] = n
    return keys


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop the encoders of this worker, which lives on beside the tasks of other stages."""
    _encoders.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
