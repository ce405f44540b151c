"""Quality classifier: naive Bayes support vectors.

Features of a text are indicators of hashed n-grams: byte 2-, 3- and 4-grams, words
and word pairs (words split at white space).  On the training rows each feature f
gets the log-count ratio r_f = log(p_f / |p|) - log(q_f / |q|), p and q its smoothed
counts in the two classes.  A text is the vector of r over its features, scaled to
unit length (a little less: see SHRINK); a linear hinge-loss model on these is fitted by dual coordinate
descent, classes weighted to equal mass, and a sigmoid on held-back rows turns its
margin into the probability of label 1.

The model is fitted on at most ``SAMPLE`` labelled rows, those of least hash; their
ids go to the executors, their features to one task, so the fit is bounded
whatever the corpus.  Scoring reads every text whole, by numpy over batches.

Defined cases: null and empty texts have no feature and the score of the bias alone;
labels other than 0 and 1, or null, are not used; several labels of one document
each count; with no usable labels of one class every score is the share of label 1
(0.5 without any); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

#: Hashed features, labelled rows at most, texts scored at once.
BITS, SAMPLE, GROUP = 17, 4_000, 32
DIM = 1 << BITS
COST, EPOCHS, SMOOTH = 4.0, 12, 1.0
#: Added to a vector's squared length, so that a few n-grams alone decide little.
SHRINK = 25.0


def _slots(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots and their documents, with repeats."""
    data, offsets = w.data, w.offsets
    n = len(data)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out, owner = [], []
    value = data.astype(np.uint32)
    grams = value
    for size in (2, 3, 4):
        if n < size:
            break
        grams = (grams[: n - size + 1] << np.uint32(8)) | value[size - 1 :]
        inside = doc[: n - size + 1] == doc[size - 1 :]
        h = (grams * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        out.append((h >> np.uint32(32 - BITS))[inside].astype(np.int32))
        owner.append(doc[: n - size + 1][inside])
    h, wd = w.hashes(), w.doc.astype(np.int32)
    out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    owner.append(wd)
    if len(h) > 1:
        pair = words.double(h, 1, 1)
        inside = wd[1:] == wd[:-1]
        out.append((pair >> np.uint64(64 - BITS)).astype(np.int32)[inside])
        owner.append(wd[:-1][inside])
    return np.concatenate(out), np.concatenate(owner)


def features(data: np.ndarray, offsets: np.ndarray):
    """For each group of texts: its first text, and the sorted distinct
    document * DIM + slot of its features."""
    for lo in range(0, len(offsets) - 1, GROUP):
        part = offsets[lo : lo + GROUP + 1]
        w = words.Words(data[part[0] : part[-1]], part - part[0], words.SPACE_WORDS, False)
        flags = np.zeros((len(part) - 1) << BITS, bool)
        slot, owner = _slots(w)
        flags[(owner.astype(np.int64) << BITS) + slot] = True
        yield lo, np.flatnonzero(flags)


class Model:
    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.ratios, self.bias, self.slope, self.shift = weights, ratios, bias, slope, shift
        self.product = weights * ratios
        self.square = ratios * ratios

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for lo, on in features(data, offsets):
            m = min(GROUP, len(out) - lo)
            slot, doc = on & (DIM - 1), on >> BITS
            dot = np.bincount(doc, self.product[slot], m)
            norm = np.sqrt(np.bincount(doc, self.square[slot], m) + SHRINK)
            out[lo : lo + m] = dot / norm
        return out + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.shift, -35, 35)))


def descend(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, dim: int, cost: np.ndarray, epochs: int, seed: int = 2) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM (Hsieh et al. 2008), with
    a bias feature of 1. rows: each text's features; their values are the ratios over
    the vector's length, made anew at each visit to hold one copy of the rows only."""
    rng = np.random.default_rng(seed)
    alpha, w, b = np.zeros(len(y)), np.zeros(dim), 0.0
    length = np.array([_length(ratios[x]) for x in rows])
    diagonal = np.array([ratios[x] @ ratios[x] for x in rows]) / length**2 + 1
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x = rows[i]
            v = ratios[x] / length[i]
            g = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(step))
                w[x] += step * v
                b += step
                alpha[i] = new
        if worst < 1e-4:
            break
    return w, b


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(label 1) by Newton steps on smoothed targets (Platt)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([(margin * (p - t)).sum(), (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(margin * margin * s).sum(), (margin * s).sum()], [(margin * s).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _length(r: np.ndarray) -> float:
    return float(np.sqrt(r @ r + SHRINK))


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: each training text's distinct slots; y: 0 or 1."""
    zero = np.zeros(DIM)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(zero, zero, 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    fold = np.arange(len(y)) % 5 == 4  # a fifth is held back for the sigmoid
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold[:] = False

    def fit(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = np.full((2, DIM), SMOOTH)
        for i in np.flatnonzero(some):
            counts[int(y[i]), rows[i]] += 1
        r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        pick = np.flatnonzero(some)
        share = y[pick].mean()
        cost = np.where(y[pick] == 1, COST / (2 * share), COST / (2 * (1 - share)))
        w, b = descend([rows[i] for i in pick], r, np.where(y[pick] == 1, 1.0, -1.0), DIM, cost, EPOCHS)
        return w, r, b

    w, r, b = fit(~fold)
    held = fold if fold.any() else ~fold
    margin = np.array([w[rows[i]] @ r[rows[i]] / _length(r[rows[i]]) + b for i in np.flatnonzero(held)])
    return Model(w, r, b, *_sigmoid(margin, y[held]))


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """The model from labelled rows of df; ``labels`` (key, quality) holds only rows
    that may be learnt from. One task fits it, as the sample is bounded; the driver
    gets the two arrays of the model only."""
    picked = labels.where("quality in (0, 1)").select(F.col(key).alias("_id"), F.col("quality").cast("int").alias("_y"))
    picked = picked.orderBy(F.xxhash64(F.lit(2), "_id"), "_id", "_y").limit(sample)

    def work(batch: pa.RecordBatch) -> dict:
        got = [None] * batch.num_rows
        for lo, on in features(*words.buffer(batch.column(2))):
            doc = on >> BITS
            edges = np.searchsorted(doc, np.arange(min(GROUP, batch.num_rows - lo) + 1))
            for i in range(len(edges) - 1):
                got[lo + i] = (on[edges[i] : edges[i + 1]] & (DIM - 1)).astype("<i4").tobytes()
        return {"doc_id": batch.column(0), "y": batch.column(1), "slots": pa.array(got, pa.binary())}

    def learn(batches):
        rows, y = [], []
        for batch in batches:
            rows += [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            y += batch.column(1).to_pylist()
        if rows:
            m = train(rows, np.array(y, int))
            yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "ratios": [m.ratios.tobytes()], "rest": [[m.bias, m.slope, m.shift]]})

    # Bounded by the sample, so it goes to every task.
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    got = common.arrow_map(rows.select(F.col("doc_id").cast("long"), "_y", "text"), "doc_id long, y int, slots binary", "text", work)
    got = got.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(2), "doc_id"), "doc_id", "y", "slots")
    got = got.mapInArrow(learn, "weights binary, ratios binary, rest array<double>").collect()
    if not got:
        return train([], np.zeros(0, int))
    return Model(np.frombuffer(got[0].weights), np.frombuffer(got[0].ratios), *got[0].rest)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    arrays = (model.weights.astype(np.float32), model.ratios.astype(np.float32))
    rest = (model.bias, model.slope, model.shift)
    shared = df.sparkSession.sparkContext.broadcast(arrays)  # 2 * DIM floats: 1 MB

    def work(batch: pa.RecordBatch) -> dict:
        w, r = shared.value
        m = Model(w.astype(float), r.astype(float), *rest)
        return {"doc_id": batch.column(0), "score": pa.array(m.scores(*words.buffer(batch.column(1))))}

    return common.arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id long, score double", "text", work)


def keep(df: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of df that score at least the threshold, columns unchanged."""
    arrays = (model.weights.astype(np.float32), model.ratios.astype(np.float32))
    rest = (model.bias, model.slope, model.shift)
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    common.ship(df.sparkSession)

    def run(batches):
        w, r = shared.value
        m = Model(w.astype(float), r.astype(float), *rest)
        for batch in batches:
            for part in common.slices(batch, text):
                good = m.scores(*words.buffer(part.column(part.schema.get_field_index(text)))) >= threshold
                yield part.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
