"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct n-word shingles, as 64-bit hashes.  Register i is
K_i = clip(floor(1 - log_b(min over the set of an Exp(a) hash h_i)), 0, q + 1):
exponentially spaced, truncated minima.  Two sketches merge by their elementwise
maximum, and registers of similar sets agree with probability near their Jaccard
similarity.  Bands of registers find candidate pairs; the likelihood of the
counts of larger, smaller and equal registers, at the known set sizes, estimates
each pair's similarity; pairs that may reach the threshold are verified on the
full sets of the texts.

Groups of any size stay cheap: documents with one set are one class, and inside a
band's bucket classes are first compared with two hubs only (the one that meets most
classes over all bands, and the one of the smallest id).  Classes of buckets that still hold several components are then
joined on the rare shingles that sets so similar must share (a prefix filter),
across components only: every pair that could still join two components is tried.

Defined cases: null and empty texts, and texts without words, have the empty set
and are their own component; with fewer words than n the whole word sequence is
the one shingle; repeated rows share a component; rows of one id and different
texts are compared like any others, each in its own component; a null id is never
a component's id unless all of its rows have none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

#: Register count, rows of registers a band, base, rate and truncation.
REGISTERS, ROWS, BASE, RATE, Q = 96, 4, 1.02, 20.0, (1 << 16) - 2
#: Standard deviations that an estimate may lie below the threshold: of banded pairs
#: (which miss more by their bands), and of pairs that share a rare shingle.
MARGIN, WIDE = 4.5, 6.5

_rng = np.random.default_rng(5)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the first of each."""
    w = words.Words(data, offsets, words.SPACE_WORDS, True)
    h, first = w.hashes(), w.first
    grams = words.windows(h, n)
    out, count = [], np.zeros(len(offsets), np.int64)
    for d in range(len(offsets) - 1):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= n:
            got = np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            got = words.windows(h[lo:hi], int(hi - lo))
        else:
            continue
        out.append(got)
        count[d + 1] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(count)


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, REGISTERS) uint16 registers; documents with no shingle get 0."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, REGISTERS), np.uint16)
    if not len(some):
        return out
    least = np.empty((len(some), REGISTERS), np.uint64)
    at = first[some]
    block = 1 << 17
    cuts = np.unique(np.concatenate([[0], np.searchsorted(at, np.arange(block, len(hashes), block)), [len(some)]]))
    for lo, hi in zip(cuts, cuts[1:]):  # a block of hashes stays in the cache for all registers
        part = hashes[at[lo] : at[hi] if hi < len(some) else len(hashes)]
        starts = at[lo:hi] - at[lo]
        x = np.empty_like(part)
        for i in range(REGISTERS):
            np.multiply(part, _MUL[i], out=x)
            x += _ADD[i]
            x ^= x >> np.uint64(32)
            x *= _MUL[REGISTERS - 1 - i]
            least[lo:hi, i] = np.minimum.reduceat(x, starts)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    out[some] = np.clip(k + (1 << 12), 0, Q + 1)  # the offset keeps small sets off the lower end
    return out


def signatures(df: DataFrame, n: int, key: str, text: str, row: Column) -> DataFrame:
    """doc_id, row, n_shingles, set_a and set_b (128 bits of the set), regs (binary)."""

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = words.buffer(batch.column(2))
        hashes, first = sets(data, offsets, n)
        regs = registers(hashes, first)
        # Sums of two mixes of the members: the same for one set in any order.
        a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(hashes + np.uint64(1)))])
        b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
        return {
            "doc_id": batch.column(0),
            "row": batch.column(1),
            "n_shingles": pa.array(np.diff(first), pa.int64()),
            "set_a": pa.array((a[first[1:]] - a[first[:-1]]).view(np.int64)),
            "set_b": pa.array((b[first[1:]] - b[first[:-1]]).view(np.int64)),
            "regs": pa.array([r.tobytes() for r in regs.astype("<u2")], pa.binary()),
        }

    rows = df.select(F.col(key).cast("long").alias("doc_id"), row.alias("row"), F.col(text).alias("text"))
    return common.arrow_map(rows, "doc_id long, row long, n_shingles long, set_a long, set_b long, regs binary", "text", work)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of register rows a and b of sets of na and nb.

    With u = na/(na+nb-common) and so on, a register of A exceeds B's with
    probability p_b(u - v J), p_b(x) = -log_b(1 - x (b-1)/b) (SetSketch, section 4);
    the log-likelihood over a grid of J is maximised."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1 - 1e-9) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    eq = np.clip(1 - up - down, 1e-9, 1)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(eq)
    return np.take_along_axis(grid, like.argmax(1)[:, None], 1)[:, 0]


def _likely(threshold: float, margin: float) -> Column:
    floor = threshold - margin * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))

    @F.pandas_udf("boolean")
    def likely(a, b, na, nb):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=bool)
        rows = [np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1) for x in (a, b)]
        na, nb = na.to_numpy(float), nb.to_numpy(float)
        fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
        # Registers of sets with similarity J agree with probability J at least.
        fits &= (rows[0] == rows[1]).sum(1) >= floor * REGISTERS
        some = np.flatnonzero(fits)
        fits[some] = estimate(rows[0][some], rows[1][some], na[some], nb[some]) >= floor
        return pd.Series(fits)

    return likely("regs_a", "regs_b", "n_a", "n_b")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, hundredths: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batch: pa.RecordBatch) -> dict:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        b = get("b").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))  # a hub's rows stand together
        mine, first = sets(*words.buffer(get("text_a")), n)
        hubs, hub_first = sets(*words.buffer(get("text_b").take(pa.array(heads))), n)
        ok = np.zeros(len(b), bool)
        for i, j in enumerate(np.repeat(np.arange(len(heads)), np.diff([*heads, len(b)]))):
            x, y = mine[first[i] : first[i + 1]], hubs[hub_first[j] : hub_first[j + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = 100 * both >= hundredths * (len(x) + len(y) - both) and both > 0
        return {"a": get("a").filter(pa.array(ok)), "b": get("b").filter(pa.array(ok))}

    return common.arrow_map(rows.select("a", "b", "text_a", "text_b"), "a long, b long", "text_a", work)


def _prefixes(live: DataFrame, n: int, hundredths: int, slots: int = 1 << 24) -> DataFrame:
    """(rep, comp, n, place, token): the shingles of a set of which two sets that
    reach the threshold must share one, if every set is put in one common order: its
    first len - ceil(threshold * len) + 1. Rare shingles come first; how rare a
    shingle is, is known by its slot in a table of fixed size, which is order enough.
    A shingle alone in its slot is in one set only and can be shared with none."""
    common.ship(live.sparkSession)

    def count(batch: pa.RecordBatch) -> dict:
        hashes, _ = sets(*words.buffer(batch.column(0)), n)
        slot, times = np.unique(hashes & np.uint64(slots - 1), return_counts=True)
        return {"slot": pa.array(slot.astype(np.int32)), "times": pa.array(times, pa.int64())}

    # A slot's count in 4 bits, 2 steps a doubling: 8 MB for all, whatever the rows.
    level = F.least(F.lit(15), F.floor(F.log2("times") * 2)).cast("long").alias("level")
    counts = common.arrow_map(live.select("text"), "slot int, times long", "text", count).groupBy("slot").agg(F.sum("times").alias("times"))
    packed = counts.select("slot", level).groupBy(F.expr("slot div 16").alias("w")).agg(F.bit_or(F.expr("shiftleft(level, 4 * (slot % 16))")).alias("v"))
    got = common.fetch(packed)
    table = np.zeros(slots // 16, "<i8")
    table[got["w"]] = got["v"]
    table = table.view(np.uint8)

    def work(batch: pa.RecordBatch) -> dict:
        hashes, first = sets(*words.buffer(batch.column(2)), n)
        slot = (hashes & np.uint64(slots - 1)).astype(np.int64)
        rare = table[slot >> 1] >> ((slot & 1) * 4).astype(np.uint8) & 15
        size = np.diff(first)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((hashes, rare, doc))
        place = np.arange(len(doc)) - first[doc]
        keep = (place < (size - (size * hundredths + 99) // 100 + 1)[doc]) & (rare[order] > 0)
        place = place[keep]
        doc = pa.array(doc[keep])
        return {"rep": batch.column(0).take(doc), "comp": batch.column(1).take(doc), "n": pa.array(size, pa.int64()).take(doc), "place": pa.array(place, pa.int64()), "token": pa.array(hashes[order][keep].view(np.int64))}

    return common.arrow_map(live.select("rep", "comp", "text"), "rep long, comp long, n long, place long, token long", "text", work)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over links (a, b). Large and
    small stars alternate, each written out; a round at least halves what is left
    of a path, and a hub's row count never meets in one task but as partial minima."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b <= a")
        # Written, so that the join's own exchange can split a hub's edges.
        least = common.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least", narrow=True)
        keep = both.where("b > a") if large else both
        moved = keep.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        if not large:  # the centre itself hangs on the minimum too
            moved = moved.unionByName(least.where("a <> m").select(F.col("a").alias("x"), "m"))
        return common.cut(moved.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "stars", narrow=True)

    edges = common.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while not edges.isEmpty():
        edges = star(star(edges, True), False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")


def row_of(key: str, text: str) -> Column:
    """The number by which a row is known: its id and text, so rows of one id may differ in text."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def near_duplicates(df: DataFrame, n: int = 2, hundredths: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked with it, over any
    number of links of similarity >= hundredths / 100), kept (is it that one?), row (see
    ``row_of``) and component (a number of its own for each, even if ids repeat)."""
    threshold = hundredths / 100
    row = row_of(key, text)
    sigs = common.cut(signatures(df, n, key, text, row), "sigs")
    # One class for each set; its number is the least of its rows'.
    reps = sigs.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low_id"), F.first("regs").alias("regs"))
    reps = common.cut(reps, "reps")
    bands = REGISTERS // ROWS
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(bands)])
    banded = reps.select("rep", "low_id", F.explode(keys).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowd = common.cut(banded.join(sizes, "bucket"), "crowd")
    # A bucket's hubs: the class that meets most others over all bands, which is mostly what
    # the others were made from, and the one of the smallest id.
    central = crowd.join(crowd.groupBy("rep").agg(F.sum("size").alias("meets")), "rep")
    hubs = central.groupBy("bucket").agg(F.max_by("rep", F.struct("meets", -F.col("low_id"), "rep")).alias("high"), F.min(F.struct("low_id", "rep"))["rep"].alias("low"))
    crowd = crowd.select("rep", "bucket")
    pairs = crowd.join(common.cut(hubs, "hubs", narrow=True), "bucket").select(F.col("rep").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    info = reps.select("rep", "regs", "n_shingles")

    def candidates(pairs: DataFrame, margin: float) -> DataFrame:
        rows = pairs.join(info.select(F.col("rep").alias("a"), F.col("regs").alias("regs_a"), F.col("n_shingles").alias("n_a")), "a")
        rows = rows.join(info.select(F.col("rep").alias("b"), F.col("regs").alias("regs_b"), F.col("n_shingles").alias("n_b")), "b")
        common.ship(df.sparkSession)
        return rows.where(_likely(threshold, margin)).select("a", "b")

    pairs = common.cut(candidates(pairs, MARGIN), "pairs")
    members = crowd.select("rep").distinct()
    rows = df.select(row.alias("rep"), F.col(text).alias("text")).where(common.in_bits(common.bits_of(members, "rep"), F.col("rep")))
    texts = common.cut(rows.join(members, "rep").dropDuplicates(["rep"]), "texts")
    links = common.cut(_verified(pairs, texts, n, hundredths), "links")
    comps = common.cut(components(links), "comps", narrow=True)

    # Across components: classes of buckets that hold several, by rare shingles.
    crowd = crowd.join(comps, crowd["rep"] == comps["node"], "left").select("rep", "bucket", F.coalesce("comp", "rep").alias("comp"))
    mixed = crowd.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    live = crowd.join(mixed, "bucket", "left_semi").select("rep", "comp").distinct()
    live = common.cut(texts.join(live, "rep"), "live")
    rare = common.cut(_prefixes(live, n, hundredths), "rare")
    x, y = rare.alias("x"), rare.alias("y")
    # What both sets have from their first common shingle on must make up the overlap.
    need = f"{hundredths} * (x.n + y.n) <= {100 + hundredths} *"
    fits = F.expr(f"{need} (x.n - x.place) and {need} (y.n - y.place)")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp")) & fits)
    tried = across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    # The late links join whole components: only those are walked once more.
    more = _verified(candidates(tried, WIDE), texts, n, hundredths)
    of = live.select("rep", "comp")
    more = more.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = common.cut(components(more), "joined", narrow=True).toDF("comp", "whole")

    classes = reps.drop("regs").join(comps, reps["rep"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "rep"))
    classes = common.cut(classes.join(joined, "comp", "left").select("set_a", "set_b", "n_shingles", "low_id", F.coalesce("whole", "comp").alias("comp")), "classes", narrow=True)
    least = common.cut(classes.groupBy("comp").agg(F.min("low_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least", narrow=True)
    classes = classes.join(least, "comp", "left").select("set_a", "set_b", "n_shingles", F.coalesce("least", "low_id").alias("component_id"), F.col("comp").alias("component"))
    found = sigs.join(classes, ["set_a", "set_b", "n_shingles"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", comp.alias("component_id"), (comp == F.col("doc_id")).alias("kept"), "row", F.coalesce("component", "row").alias("component"))
