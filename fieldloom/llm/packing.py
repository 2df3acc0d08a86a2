"""Best-fit packing of documents into sequences, certified by lower bounds.

Each text is encoded where it is read; only piece lengths and checksums go on. Pieces shorter than a sequence are
dealt evenly into partitions of about ``group_rows`` pieces. In each partition best-fit decreasing packs them, and
dual-feasible functions give a lower bound of the sequences that any packing of that partition needs:

- if the packing meets the bound, it is certified; all its sequences but the emptiest are final;
- if a gap remains, its sequences with free places are opened again.

The pieces of all opened sequences are exchanged (dealt anew, into fewer partitions) and packed again, until one
partition is left or a round opens as many as it got; the last packing stands even if it misses its bound. Every piece
tells the bound and the number of sequences of the packing that closed its sequence, so bins - bound is known to be the
most that a better packing of that partition could save.

Nulls: a null text is empty, so the document is the end id alone; a null doc_id stays null. Repeated rows are packed
each for itself. An empty table gives no rows. Very long texts are cut into pieces of full length. Pieces of equal length are
packed in the order of their items. Columns of any name pass untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, saved, table
from .tokens import default_path, encoder, forget

LENGTH, END_ID, GROUP_ROWS, ROUNDS = 4096, 1, 8192, 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document."""

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(tokenizer)
        end = np.array([end_id], tokens.kind).tobytes()
        for pdf in it:
            out: list[tuple] = []
            for doc_id, known, found in zip(pdf["row_id"], pdf["known"], tokens.each(pdf["body"])):
                ids = np.frombuffer(found + end, tokens.kind).astype("<u4")
                for k, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    out.append((doc_id if known else None, k, start, len(part), zlib.crc32(part.tobytes())))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})
        del tokens
        forget()
        give_back()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("row_id"), doc_id.isNotNull().alias("known"), text.alias("body")).mapInPandas(encode, PIECE)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that any packing needs: the best of two families of dual-feasible functions."""
    counts = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * x)
    k = np.arange(1, size // 2 + 1)
    # x > size - k counts as one, k <= x <= size - k as x / size, smaller ones as nothing
    best = int((n[-1] - n[size - k] + -(-(s[size - k] - s[k - 1]) // size)).max())
    best = max(best, -(-int(s[-1]) // size))
    for m in range(1, 33):
        whole, rest = np.divmod((m + 1) * x, size)
        weight = np.where(rest == 0, x * m, whole * size)  # times size * m
        best = max(best, -(-int((counts * weight).sum()) // (size * m)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: the longest first, each into the fullest sequence that it fits."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free places
    some, used = 0, 0  # bit f of some: there is a sequence with f free places
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                some ^= 1 << free
        else:
            b, free, used = used, size, used + 1
        bin_of[i], offset[i] = b, size - free
        left = free - n
        if left:
            if not open_bins[left]:
                some |= 1 << left
            open_bins[left].append(b)
    return bin_of, offset


def _pack(size: int, last: bool, round_no: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bin_of, offset = best_fit_decreasing(lengths, size)
        fill = np.bincount(bin_of, weights=lengths)
        final, bound = np.ones(len(fill), bool), lower_bound(lengths, size)
        if not last:
            if len(fill) > bound:
                final = fill == size
            else:
                final[np.argmin(fill)] = False
        sequence = (round_no << 56) + (int(pdf["group"].iloc[0]) << 20) + bin_of
        return pdf.drop(columns=["group", "item"]).assign(sequence_id=sequence, offset=offset, bound=bound, bins=len(fill), final=final[bin_of])

    return pack


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound, bins for each piece."""
    every = saved(pieces(docs, tokenizer, length, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = every.where(F.col("length") == length).select(*every.drop("item").columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bound"), F.lit(1).cast("long").alias("bins"))
    done = [whole]
    left = every.where(F.col("length") < length)
    count, round_no = left.count(), 0
    while count:
        groups = -(-count // group_rows)
        last = groups == 1 or round_no == ROUNDS
        dealt = left.withColumn("group", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(groups)))
        schema = f"{PIECE}, sequence_id long, offset long, bound long, bins long, final boolean"
        result = saved(dealt.groupBy("group").applyInPandas(_pack(length, last, round_no), schema), "packed-round")
        done.append(result.where("final").drop("final"))
        left = result.where("not final").select(*every.drop("item").columns).withColumn("item", F.monotonically_increasing_id())
        before, count, round_no = count, left.count(), round_no + 1
        if count == before:
            round_no = ROUNDS  # nothing was certified: the next round is the last
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_path())
