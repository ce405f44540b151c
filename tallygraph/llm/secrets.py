"""Secrets by a dynamic program over what guessing them costs.

Base spans come from patterns (an assignment of twelve or more characters, an access
key, a run of sixteen or more hex digits; leftmost and without overlap within a kind; a
match that fails its check is dropped).  The method adds spans of the kind ``value``:
a text behind a credential word and a separator, quoted or not, which the base patterns
cut short or don't reach, if guessing it costs at least ACCEPT bits.

The cost of a value is that of its cheapest segmentation into words, dates, repeats,
keyboard walks and brute-force spans.  A word costs log2(all words / its count) bits, a
bound on its rank in a list by frequency; counts are over all texts of the corpus, values
and words with digits left out.  Capitals and digits or signs in the place of letters cost
a bit each.  A date costs its day, month and year, a repeat (whole units of up to UNIT
characters, at least twice) its unit, at its own cheapest, and its number, a walk over
neighbouring keys its first key and its turns, any other span its characters by class; a
segment costs log2 of the number of kinds besides.  ``matches`` lists the spans that are
not brute force; the program takes the cheapest way to each position in one pass.

The corpus is read twice: once for spans and values, once for the counts of words that
may stand in a distinct value (a fixed-size filter drops the rest before the shuffle).
Values meet the counts by joins on hashes of their stretches of letters.

Defined cases: null and empty texts have no span and the digest of the empty string;
texts of any length are read whole, values too; repeated rows give repeated results;
without values nothing is counted or added; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

KINDS = ("assign", "access", "hex", "value")
#: Bits that a value must cost; letters of a word; characters of a repeat's unit; keys of a walk at least.
ACCEPT, WORD, UNIT, WALK = 40.0, (3, 24), 12, 4
#: Words, dates, repeats, walks, brute force.
SEGMENT = math.log2(5)
#: Bits of a character by class: digits, lower and upper case, signs, anything else.
CLASS = {"digit": math.log2(10), "lower": math.log2(26), "upper": math.log2(26), "sign": math.log2(33), "other": 16.0}
#: A date: 31 days, 12 months, 200 years and its writing.
DAY, YEAR = math.log2(31 * 12 * 200 * 4), math.log2(200)

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential word, a separator, and a quoted text or one up to white space.
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|credentials?|bearer)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"']\S*))""",
    re.ASCII | re.IGNORECASE,
)
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))", re.ASCII)
_YEAR = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)
_LETTERS = re.compile("[a-z\x80-\U0010ffff]+")
#: Digits and signs that stand for letters, and the letters.
_LEET = str.maketrans("013457@$", "oleastas")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> frozenset[str]:
    """Pairs of keys side by side: each row stands half a key or so right of the one above."""
    at = {key: (2 * x + y, y) for y, row in enumerate(_KEYS) for x, key in enumerate(row)}
    return frozenset(a + b for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(y - v) <= 1 and abs(x - u) <= (2 if y == v else 1))


_NEAR = _neighbours()
_START, _TURN = math.log2(sum(map(len, _KEYS))), math.log2(len(_NEAR) / sum(map(len, _KEYS)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans of a text, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values of a text. What is not quoted must mix letters, digits
    and signs, since prose may follow a colon; marks of sentences at its end leave."""
    out = []
    for m in _CONTEXT.finditer(text):
        quoted = m.lastindex < 3
        a, b = m.span(m.lastindex)
        if not quoted:
            value = m[3].rstrip(".,;:!?)]}>\"'")
            b = a + len(value)
            if value.isalpha() or value.isdigit() or not any(c.isalnum() for c in value):
                continue
        if b > a:
            out.append((a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def bits(c: str) -> float:
    if c.isascii():
        return CLASS["digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "sign"]
    return CLASS["other"]


def stretches(value: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-case letters) of each stretch that may be a word."""
    plain = value.translate(_LOWER).translate(_LEET)
    for m in _LETTERS.finditer(plain):
        for a in range(m.start(), m.end() - WORD[0] + 1):
            for b in range(a + WORD[0], min(a + WORD[1], m.end()) + 1):
                yield a, b, plain[a:b]


def matches(value: str, word: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
    """(start, end, bits) of all spans but brute force and repeats; ``word``: bits of stretches that are words."""
    changed = np.concatenate([[0], np.cumsum([c.isupper() or c in "013457@$" for c in value])])
    out = [(a, b, cost + float(changed[b] - changed[a])) for (a, b), cost in word.items()]
    out += [(m.start(1), m.end(1), DAY) for m in _DATE.finditer(value)] + [(m.start(1), m.end(1), YEAR) for m in _YEAR.finditer(value)]
    low, a = value.lower(), 0
    for i in range(1, len(low) + 1):
        if i == len(low) or low[i - 1] + low[i] not in _NEAR:
            if i - a >= WALK:
                turns = sum(ord(low[j + 1]) - ord(low[j]) != ord(low[j + 2]) - ord(low[j + 1]) for j in range(a, i - 2))
                out.append((a, i, _START + math.log2(i - a) + (turns + 1) * _TURN))
            a = i
    return out


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of each maximal stretch of a period, cut to whole units."""
    out, n = [], len(value)
    for unit in range(1, min(UNIT, n // 2) + 1):
        a = 0
        for i in range(unit, n + 1):
            if i == n or value[i] != value[i - unit]:
                times = (i - a) // unit
                if times >= 2:
                    out.append((a, a + times * unit, unit))
                a = i - unit + 1
    return out


def cost(value: str, word: dict[tuple[int, int], float]) -> float:
    """Bits of the cheapest segmentation."""
    found = matches(value, word)
    for a, b, unit in repeats(value):
        inner = {(x - a, y - a): c for (x, y), c in word.items() if a <= x and y <= a + unit} if word else {}
        found.append((a, b, _cheapest(value[a : a + unit], matches(value[a : a + unit], inner)) + math.log2((b - a) // unit)))
    return _cheapest(value, found)


def _cheapest(value: str, found: list[tuple[int, int, float]]) -> float:
    ends: dict[int, list[tuple[int, float]]] = {}
    for a, b, c in found:
        ends.setdefault(b, []).append((a, c + SEGMENT))
    best, brute = [0.0], math.inf  # brute: the cheapest way whose last span is brute force
    for i, c in enumerate(value, 1):
        brute = min(brute, best[-1] + SEGMENT) + bits(c)
        best.append(min([brute, *(best[a] + x for a, x in ends.get(i, ()))]))
    return best[-1]


def _hash(texts: list[str]) -> np.ndarray:
    """Hash of each text as one word, as ``words`` has it."""
    column = pa.array([t.encode() for t in texts], pa.large_binary())
    w = words.Words(*words.buffer(column), np.ones(256, bool), False)
    return w.hashes().view(np.int64)


def _counts(column: pa.Array, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the words that the filter lets pass, their counts, and the number of all words."""
    data, offsets = words.buffer(column)
    data = words.FOLD[data]
    raw = data.tobytes()
    if b":" in raw or b"=" in raw:
        data = data.copy()
        for i, text in enumerate(column.to_pylist()):
            for a, b in values(text) if text else ():
                lo = offsets[i] + len(text[:a].encode())
                data[lo : lo + len(text[a:b].encode())] = 0x20
    w = words.Words(data, offsets, words.ALNUM_WORDS, False)
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    fine = digits[w.end] == digits[w.start]
    h, n = np.unique(w.hashes()[fine].view(np.int64), return_counts=True)
    slot = (h.view(np.uint64) & np.uint64(len(may) * 64 - 1)).astype(np.int64)
    other = ((h.view(np.uint64) >> np.uint64(32)) & np.uint64(len(may) * 64 - 1)).astype(np.int64)
    held = np.ones(len(h), bool)
    for s in (slot, other):
        held &= (may[s >> 6] >> (s & 63) & 1).astype(bool)
    return h[held], n[held], int(fine.sum())


#: Bits of the filter of stretches: 2 MB, whatever the values.
FILTER = 1 << 24


def _filter(hashes: DataFrame) -> np.ndarray:
    slots = F.array(F.expr(f"h & {FILTER - 1}"), F.expr(f"shiftrightunsigned(h, 32) & {FILTER - 1}"))
    rows = hashes.select(F.explode(slots).alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    got, out = common.fetch(rows), np.zeros(FILTER // 64, np.int64)
    out[got["w"]] = got["v"]
    return out


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, row long, starts array<int>, kinds array<int>, ends array<int>, values array<struct<start: int, value: string>>"


def _found(docs: DataFrame) -> DataFrame:
    """Base spans and values of each document, under a number for its row."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                held = [[{"start": a, "value": t[a:b]} for a, b in values(t)] if ":" in t or "=" in t else [] for t in texts]
                counts = [[sum(x[1] == k for x in s) for s in base] for k in range(3)]
                sha = [hashlib.sha256(joined(s).encode()).hexdigest() for s in base]
                rows = pa.array(range(row, row + len(texts)), pa.int64())
                row += len(texts)
                sides = [pa.array([[x[i] for x in s] for s in base], pa.list_(pa.int32())) for i in range(3)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("value", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha), rows, *sides, pa.array(held, kind)], names=[x.split()[0] for x in FOUND.replace("struct<start: int, value: string>", "x").split(", ")])

    return docs.mapInArrow(run, FOUND)


def find(df: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_value (spans
    added), value_bits (of the document's costliest value; null without values)."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = common.cut(_found(docs), "found")
    every = found.select("row", F.explode("values").alias("v")).select("row", "v.start", "v.value")
    distinct = common.cut(every.select("value").distinct(), "values")

    def of_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "value", 1 << 16):
                at, start, end, texts = [], [], [], []
                for i, v in enumerate(part.column(0).to_pylist()):
                    for a, b, t in stretches(v):
                        at.append(i)  # its number, not the value: one long value has many stretches
                        start.append(a)
                        end.append(b)
                        texts.append(t)
                yield pa.RecordBatch.from_pydict({"id": part.column(1).take(pa.array(at, pa.int64())), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "h": pa.array(_hash(texts))})

    named = distinct.withColumn("id", F.xxhash64("value"))
    parts = common.cut(named.mapInArrow(of_value, "id long, start int, end int, h long"), "stretches", narrow=True)
    may = _filter(parts)

    def count(batch: pa.RecordBatch) -> dict:
        h, n, total = _counts(batch.column(0), may)
        return {"h": pa.array([None, *h.tolist()], pa.int64()), "n": pa.array([total, *n.tolist()], pa.int64())}

    counts = common.cut(common.arrow_map(docs.select("text"), "h long, n long", "text", count).groupBy("h").agg(F.sum("n").alias("n")), "counts", narrow=True)
    total = counts.where("h is null").agg(F.sum("n")).first()[0] or 1
    known = parts.join(counts.where("h is not null"), "h").groupBy("id").agg(F.collect_list(F.struct("start", "end", "n")).alias("words"))
    priced = named.join(known, "id", "left").select("value", "words")

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            cheap = [cost(v, {(x["start"], x["end"]): math.log2(total / x["n"]) for x in w or ()}) for v, w in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cheap, pa.float64())], ["value", "bits"])

    costs = common.cut(priced.mapInArrow(price, "value string, bits double"), "costs")
    of_row = every.join(costs, "value").groupBy("row").agg(F.collect_list(F.struct("start", F.length("value").alias("size"), "bits")).alias("more"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, added, top = [], [], []
            for a, k, b, more in zip(*[batch.column(i).to_pylist() for i in range(6, 10)]):
                base = list(zip(a, k, b))
                new = [(x["start"], 3, x["start"] + x["size"]) for x in more or () if x["bits"] >= accept]
                new = [x for x in new if not any(s <= x[0] and x[2] <= e for s, _, e in base)]
                out.append(joined(sorted([*base, *new])))
                added.append(len(new))
                top.append(max((x["bits"] for x in more or ()), default=None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.string()), pa.array(added, pa.int64()), pa.array(top, pa.float64())], names=[*batch.schema.names[:5], "spans", "n_value", "value_bits"])

    out = found.join(of_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "row", "starts", "kinds", "ends", "more")
    return out.mapInArrow(spans, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_value long, value_bits double")
