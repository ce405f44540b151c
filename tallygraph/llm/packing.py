"""Packing along a space-filling curve.

A document's token ids make a hashed vector: every id has a fixed row of random
signs, and the rows of all its tokens add up to DIMS projections.  Scaled by the
square root of the token count and quantised, the projections are a point whose
Hilbert index orders the documents, so neighbours along the curve are alike.  The
token stream in that order is cut every ``length`` tokens; the only sequence that
can be short is the last, padded to a power of two at least its length.

Places come from sums over ranges of the curve (bounds from approximate quantiles
of the sort key, ties broken by hash and place), so no task holds more than one range
and a mass of equal documents is split too. Beyond RANGE_ROWS * MOST_RANGES documents
ranges grow, and the window over one spills.

Defined cases: null and empty texts are one token, the end id; repeated rows are
rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.llm import common

LENGTH, END_ID, DIMS, BITS = 2048, 1, 4, 10
#: The added token of the tokenizer file, which it recognises in texts too.
SPECIAL = {"<|endoftext|>": 50256}
#: Documents a range is planned for, and ranges at most (the bounds go to all tasks).
RANGE_ROWS, MOST_RANGES = 2_000, 100_000

_encoder: dict[str, object] = {}


def encoder(name: str = "byte_bpe_50k"):
    """The vocabulary as an encoder of lists of texts to lists of ids. The ranks
    file of the same vocabulary gives the same ids several times faster, if texts
    are encoded with ``allowed_special="all"``."""
    if name not in _encoder:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoder[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoder[name]


def signs(vocabulary: int, dims: int = DIMS, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each id."""
    return (np.random.default_rng(seed).integers(0, 2, (vocabulary, dims), dtype=np.int8) * 2 - 1).astype(np.int32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, d), each coordinate of so many bits: the
    transpose form of Skilling (2004) on all points at once, then interleaved."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> b & 1)
    return out


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (tokens with the end id), ids (little-endian 16-bit), curve (the
    Hilbert index) and sort: the curve, 11 bits of a hash of ids and key, and 12 bits of
    the row's place in its batch, so that a mass of one row spreads over keys too."""

    def work(batch: pa.RecordBatch) -> dict:
        encode = encoder()
        texts = batch.column(1).fill_null("").to_pylist()
        ids = [np.array([*encode.encode(t, allowed_special="all"), END_ID], np.uint16) for t in texts]
        counts = np.array([len(i) for i in ids])
        table = signs(encode.n_vocab + 1)
        sums = np.add.reduceat(table[np.concatenate(ids)], np.cumsum(counts) - counts, axis=0)
        # Normal quantiles would be even; tanh of the scaled sum is near enough.
        point = ((np.tanh(sums / (2.0 * np.sqrt(counts))[:, None]) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
        curve = hilbert(point)
        tie = np.array([zlib.crc32(i.tobytes()) for i in ids], np.int64) ^ (batch.column(0).cast(pa.int64()).fill_null(0).to_numpy() * 0x9E3779B1 & 0xFFFFFFFF)
        place = np.arange(len(ids)) & 0xFFF
        return {
            "doc_id": batch.column(0),
            "n": pa.array(counts, pa.int64()),
            "ids": pa.array([i.astype("<u2").tobytes() for i in ids], pa.binary()),
            "curve": pa.array(curve, pa.int64()),
            "sort": pa.array(curve << 23 | ((tie * 0x5851F42D) >> 8 & 0x7FF) << 12 | place, pa.int64()),
        }

    return common.arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), text), "doc_id long, n long, ids binary, curve long, sort long", text, work)


def place(tokens: DataFrame) -> DataFrame:
    """Add ``at``: the tokens that stand before a document in curve order."""
    n = tokens.count()
    ranges = int(min(MOST_RANGES, max(8, -(-n // RANGE_ROWS))))
    marks = tokens.agg(F.percentile_approx("sort", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    marks = np.unique(np.array(marks, np.int64))
    spark = tokens.sparkSession

    @F.pandas_udf("int")
    def range_of(s):
        import pandas as pd

        return pd.Series(np.searchsorted(marks, s.to_numpy(np.int64), "right").astype(np.int32))

    common.ship(spark)
    # The sort key, written with the tokens, alone decides the range, so readings agree.
    ranged = tokens.withColumn("range", range_of("sort"))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("_s"))
    offsets = sums.select("range", (F.sum("_s").over(Window.orderBy("range")) - F.col("_s")).alias("_o"))
    w = Window.partitionBy("range").orderBy("sort", "doc_id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("_i", F.sum("n").over(w) - F.col("n")).join(offsets, "range", "left").withColumn("at", F.expr("_i + _o")).drop("_i", "_o")


def pieces(placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document in a sequence."""

    def work(batch: pa.RecordBatch) -> dict:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        n, at = get("n").to_numpy(), get("at").to_numpy()
        first, last = at // length, (at + n - 1) // length
        count = last - first + 1
        row = np.repeat(np.arange(len(n)), count)
        seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(seq * length, at[row]) - at[row]
        stop = np.minimum((seq + 1) * length, at[row] + n[row]) - at[row]
        ids = [np.frombuffer(x.as_py(), "<u2").astype("<u4") for x in get("ids")]
        crc = [zlib.crc32(ids[r][a:b].tobytes()) for r, a, b in zip(row, start, stop)]
        return {
            "doc_id": get("doc_id").take(pa.array(row)),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(stop - start, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(n[row], pa.int64()),
            "sequence_id": pa.array(seq, pa.int64()),
            "offset": pa.array(at[row] + start - seq * length, pa.int64()),
            "curve": get("curve").take(pa.array(row)),
        }

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"
    return common.arrow_map(placed.select("doc_id", "n", "ids", "curve", "at"), schema, "ids", work)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of all documents, packed along the curve (see ``pieces``)."""
    return pieces(place(common.cut(tokenize(df, key, text), "tokens")), length)
