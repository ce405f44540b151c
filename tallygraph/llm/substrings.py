"""Repeated word windows across a corpus, by level-wise doubling.

To find every window of L words that also starts earlier, short windows come first:
L is halved while it is even and more than 5 (20 words: levels 5, 10, 20).  On the
lowest level each window of L words chooses its least-hashed short window, about
one place in eight; equal windows choose equal places, so a window of L words can
repeat only if its choice does.  Windows repeated at one level alone are extended
to twice their length, to the right where the window of L words has room and else
to the left, and all others leave, until the last level hashes whole windows.  Its
equal windows are put in order of document and start: all but the first of them are
repeats.  Levels past L would find nothing new: what a longer window covers, its
windows of L words cover too.  Windows are equal if 96 bits of two independent
hashes of their words agree (10^13 windows: a wrong pair with probability 10^-3).

Equal hashes meet by a range sort on (hash, document, start), which splits a
passage that a third of the corpus shares over as many tasks as it needs; what a
task cannot know, whether its first run began before it, is settled from one row
a task.  Documents whose whole text equals an earlier document's leave after the
lowest level: all of their windows start earlier.

A document is an id with its text: ``doc_id`` and ``row``, a hash of the text. Windows
are in order of id, row and start; one repeats if an equal window stands in a document of smaller
id, or earlier in its own. Documents of one id don't touch each other.

Defined cases: null, empty and short texts (fewer than L words) have no window and
lose nothing, nor do rows with a null id; repeated rows of one id and text are the same document and
give the same result each; different texts of one id are judged each for itself; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

WINDOW, LOWEST = 20, 5
#: Bits of a place in the key that ranks short windows: ties go to the leftmost.
_PLACE = np.uint64((1 << 28) - 1)


def levels(window: int) -> list[int]:
    """Lengths from the lowest level to the window."""
    out = [window]
    while out[0] % 2 == 0 and out[0] > LOWEST:
        out.insert(0, out[0] // 2)
    return out


def _sliding(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + n] for each i (len - n + 1 of them)."""
    size, out = 1, x
    while 2 * size <= n:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(x) - n + 1], out[n - size :]) if size < n else out


def _grams(h: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Hashes of windows of the last length, doubled up from the first."""
    out = words.windows(h, lengths[0])
    for length in lengths[:-1]:
        out = words.double(out, length, length)
    return out


def _choices(w: words.Words, h: np.ndarray, lengths: list[int], level: int) -> np.ndarray:
    """For each full window, by its first word, where its choice on a level starts."""
    n, window = len(h), lengths[-1]
    first = np.arange(n - window + 1)
    if level == len(lengths) - 1:
        return first
    key = (words.windows(h, lengths[0]) & ~_PLACE) | (np.arange(n - lengths[0] + 1).astype(np.uint64) & _PLACE)
    low = _sliding(key, window - lengths[0] + 1, np.minimum)
    start = first + ((low - first.astype(np.uint64)) & _PLACE).astype(np.int64)
    for length in lengths[:level]:
        start = np.where(start + 2 * length <= first + window, start, start - length)
    return start


def _get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _marked(batch: pa.RecordBatch, w: words.Words) -> np.ndarray:
    """Words of the batch, by number, that its lists of places name."""
    lists = _get(batch, "places")
    return lists.flatten().to_numpy() + np.repeat(w.first[:-1], np.diff(lists.offsets.to_numpy()))


def _candidates(df: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """hash, check (of the last level), doc_id, row, at: the windows of a level that full
    windows choose; above the lowest, only those extended from ``places``."""
    last = level == len(lengths) - 1

    def work(batch: pa.RecordBatch) -> dict:
        w = words.Words(*words.buffer(_get(batch, "text")), words.SPACE_WORDS, False)
        n, window = len(w.start), lengths[-1]
        at = np.zeros(0, np.int64)
        hashed, check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if n >= window:
            h = w.hashes()
            left = w.first[1:][w.doc] - np.arange(n)  # words from here to the document's end
            some = left[: n - window + 1] >= window
            if level:
                mark = np.zeros(n, bool)
                mark[_marked(batch, w)] = True
                some &= mark[_choices(w, h, lengths, level - 1)]
            chosen = np.zeros(n, bool)
            chosen[_choices(w, h, lengths, level)[some]] = True
            at = np.flatnonzero(chosen)
            hashed = _grams(h, lengths[: level + 1])[at]
            if last:
                check = _grams(w.hashes(base=words.OTHER), lengths)[at] >> np.uint64(32)
        doc = w.doc[at]
        out = {"hash": pa.array(hashed.view(np.int64)), "doc_id": _get(batch, "doc_id").take(pa.array(doc)), "row": _get(batch, "row").take(pa.array(doc)), "at": pa.array((at - w.first[doc]).astype(np.int32))}
        return out | ({"check": pa.array(check.astype(np.uint32).view(np.int32))} if last else {})

    return common.arrow_map(df, "hash long, doc_id long, row long, at int" + ", check int" * last, "text", work).select("hash", *["check"] * last, "doc_id", "row", "at")


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartitionByRange(*df.columns).sortWithinPartitions(*df.columns)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in hash order, those whose hash stands beside an equal one; also a
    task's first and last rows, which may have theirs in another task."""
    held, held_keep = None, True  # a task's first row is kept
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column(0).to_numpy()
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] = same
        keep[:-1] |= same
        keep[0] |= held_keep
        held, held_keep = batch.slice(len(h) - 1), bool(keep[-1])
        yield batch.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).select(["doc_id", "row", "at"])
    if held is not None:
        yield held.select(["doc_id", "row", "at"])


LATER = "kind byte, hash long, check int, doc_id long, row long, at int"


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (hash, check, doc_id, row, at): kind 0, rows whose hashes have an
    earlier place; 1, rows of a task's first hashes of which only the tasks before know that;
    2 and 3, the first document and the last one's first place of a task's last hashes."""
    names = ["kind", "hash", "check", "doc_id", "row", "at"]
    run = None  # hash, check, first doc of the last run; its last doc and row, their first place; whether it began the task
    for batch in batches:
        h, c, d, w, a = (batch.column(i).to_numpy() for i in range(5))
        if not len(h):
            continue
        start = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        new = start | np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])  # of the hashes, or another document
        opening = np.cumsum(start) == 1  # of the task's first hashes
        if run is None:
            head = opening
        elif run[0] == h[0] and run[1] == c[0]:
            start[0], new[0] = False, (run[3], run[4]) != (d[0], w[0])
            head = opening & run[6]
        else:
            head = np.zeros(len(h), bool)
        at = np.maximum.accumulate(np.where(start, np.arange(len(h)), -1))
        first = np.where(at >= 0, d[at], run[2] if run else 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        place = np.where(at >= 0, a[at], run[5] if run else 0)
        later = (place != a) | (first != d)
        kind = np.where(later, 0, 1).astype(np.int8)
        keep = later | head
        run = (h[-1], c[-1], first[-1], d[-1], w[-1], place[-1], bool(head[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kind, h, c, d, w, a)], names)
    if run is not None:
        kinds = (pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        rows = [(2, *run[:3], 0, 0), (3, *run[:2], *run[3:6])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(map(list, zip(*rows)), kinds)], names)


def _with_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, row, text and the list of places of each document that has some."""
    some = places.groupBy("doc_id", "row").agg(F.collect_set("at").alias("places"))
    may = common.bits_of(places.select("doc_id").distinct(), "doc_id")
    return df.where(common.in_bits(may, F.col("doc_id"))).join(some, ["doc_id", "row"]).select("doc_id", "row", "text", "places")


def repeats(df: DataFrame, again: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, at): every window of ``window`` words of the documents, by its first
    word from 0, whose words also start earlier; but none of the documents ``again``,
    which equal an earlier one as a whole (see ``copies``)."""
    common.ship(df.sparkSession)
    lengths = levels(window)
    places = df
    for level in range(len(lengths) - 1):
        found = _sorted(_candidates(places, lengths, level)).mapInArrow(_repeated, "doc_id long, row long, at int")
        if not level:
            found = found.join(again, ["doc_id", "row"], "left_anti")
        places = _with_places(df, common.cut(found, f"level{level}"))
    if len(lengths) == 1:
        places = df.join(again, ["doc_id", "row"], "left_anti")
    rows = common.cut(_sorted(_candidates(places, lengths, len(lengths) - 1)).mapInArrow(_later, LATER), "later")
    # What only tasks before know: a smaller document of the hashes, or an earlier place of the same one.
    first = rows.where("kind = 2").groupBy("hash", "check").agg(F.min("doc_id").alias("first"))
    same = rows.where("kind = 3").groupBy("hash", "check", "doc_id", "row").agg(F.min("at").alias("before"))
    opened = rows.where("kind = 1").join(first, ["hash", "check"]).join(same, ["hash", "check", "doc_id", "row"], "left")
    edges = opened.where(F.expr("first < doc_id or coalesce(before < at, false)"))
    return rows.where("kind = 0").select("doc_id", "row", "at").unionByName(edges.select("doc_id", "row", "at"))


def copies(df: DataFrame) -> DataFrame:
    """doc_id and row of each document whose whole text is that of a smaller id."""
    digests = df.select("doc_id", "row", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    # Written, so that the join's own exchange can split a mass of copies.
    firsts = common.cut(firsts.select("digest", "first"), "firsts", narrow=True)
    return digests.join(firsts, "digest").where("doc_id <> first").select("doc_id", "row").distinct()


def dedup(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one
    space; with ``texts`` also kept_text."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"))
    schema = "doc_id long, row long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")

    def work(batch: pa.RecordBatch) -> dict:
        w = words.Words(*words.buffer(_get(batch, "text")), words.SPACE_WORDS, False)
        gone = np.zeros(len(w.start) + 1, np.int64)
        if "places" in batch.schema.names:
            at = _marked(batch, w)
            gone += np.bincount(at, minlength=len(gone)) - np.bincount(at + window, minlength=len(gone))
        keep = np.cumsum(gone[:-1]) == 0
        start, end = w.start[keep], w.end[keep]
        # Each kept word and one byte behind it; that byte becomes the space.
        size = end - start + 1
        to = np.cumsum(size)
        data = np.concatenate([w.data, np.zeros(1, np.uint8)])
        out = data[np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - size), size)]
        out[to - 1] = 32
        kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
        ends = np.concatenate([[0], to])[kept]
        raw = out.tobytes()
        parts = [raw[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]
        counts, left = w.counts, np.diff(kept)
        got = {"doc_id": _get(batch, "doc_id"), "row": _get(batch, "row"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(counts - left, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts])}
        return got | ({"kept_text": pa.array([x.decode() for x in parts])} if texts else {})

    named = docs.where("doc_id is not null")
    again = common.cut(copies(named), "copies", narrow=True)
    found = repeats(named, again, window)
    whole = common.arrow_map(docs, schema, "text", work)
    touched = common.arrow_map(_with_places(docs, found), schema, "text", work).dropDuplicates(["doc_id", "row"])
    names = ["n_removed", "kept_sha256"] + ["kept_text"] * texts
    touched = touched.select("doc_id", "row", *[F.col(c).alias(f"_{c}") for c in names])
    again = again.withColumn("_copy", F.lit(True))
    out = whole.join(touched, ["doc_id", "row"], "left").join(again, ["doc_id", "row"], "left")
    is_copy = F.col("_copy").isNotNull() & (F.col("n_words") >= window)
    empty = {"n_removed": F.col("n_words"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept_text": F.lit("")}
    return out.select("doc_id", "n_words", *[F.when(is_copy, empty[c]).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in names])
