"""Personal data by a skip-chain conditional random field.

Base spans come from patterns (e-mail, IP, card, phone; leftmost and without
overlap within a kind; a match that fails its check is dropped).  The field adds
spans of the same kinds where a token resembles a base span of its document but no
pattern reaches it, such as a phone number repeated in another layout.

Nodes are white-space tokens with a digit or an at sign; every other token is
clamped to no entity, which splits the chain there exactly.  Potentials are weights
of a token's look by label, a chain matrix between the labels of neighbouring
tokens, and a skip weight that a token and the one of its document's last mention of
the same key gain when they agree, so distant similar tokens share what they know.
The key is an address, or the last seven digits: of the whole base span a token lies
in, of a run of number tokens, or of the token; a mention is such a span, run or
token, and the tokens of two mentions meet from their last ones on.  All weights are fitted together:
the pseudo-likelihood of every token's label given its neighbours', over the whole
corpus, base spans as labels, each token once with its look and once with that
blanked.  Its sufficient statistics are counts of (look, labels
of both chain and both skip neighbours, label), a table of bounded size.  Tokens
that no pattern reaches though their key's group has a base span are unlabelled:
they teach nothing.  For these alone labels are inferred, by sum-product messages
over all edges of a batch of documents in step until they settle, and what reaches
``ACCEPT`` is added, neighbouring tokens of one key as one span.  So what is added
always agrees with a base span of its document.

Defined cases: null and empty texts have no span and the digest of the empty string;
texts of any length are read whole; repeated rows give repeated results; without any
base span in the corpus nothing is added; an empty table gives no rows; other
columns are not read (``redact`` passes them through).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

KINDS = ("email", "ip", "card", "phone")
#: Posterior that a token needs, rounds of messages; steps of the fit, its penalties on
#: the weights of looks and chain (which a few tokens must not decide) and on the skip weight.
ACCEPT, ROUNDS, STEPS, PENALTY = 0.6, 20, 600, (1e-2, 1e-4)
LABELS = len(KINDS) + 1  # the last is no entity
NONE = len(KINDS)
#: A neighbour that is absent or unlabelled.
OPEN = LABELS

# Each is the pattern of its kind in a form that never scans a stretch twice: runs
# begin at their first character, and what follows a run cannot be given back.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIM = re.compile(r"[A-Za-z0-9(+]")
_NUMBER = re.compile(r"[(+]*[0-9][0-9().-]*[.,;:]?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans of a text, sorted."""
    out = []
    done = edge = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        at = m.start()
        edge = max(done, text.rfind("@", done, at) + 1)
        before = text[edge:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        if size:
            out.append((at - size, 0, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _shape(token: str) -> int:
    """A small number for the look of a token: its digits in seven steps, then marks."""
    digits = sum(c.isdigit() for c in token)
    size = sum(digits > x for x in (0, 3, 6, 9, 13, 19))
    marks = ("@" in token, token.count(".") >= 3, token.startswith(("+", "(")), digits == len(token), "-" in token, any(c.isalpha() for c in token))
    return size * 64 + sum(on << i for i, on in enumerate(marks))


SHAPES = 7 * 64
#: Features of each look: one of seven sizes, six marks, and one that is always on.
FEATURES = np.array([[*(size == i for i in range(7)), *(marks >> i & 1 for i in range(6)), 1] for size in range(7) for marks in range(64)], float)


def _key(token: str) -> str:
    """What similar tokens have in common, or nothing."""
    if "@" in token[1:-1]:
        return token.strip("\"'<>()[]{}.,;:!?*#$%&|").lower()
    return _tail(token)


def _tail(token: str) -> str:
    digits = _NOT_DIGIT.sub("", token)
    return digits[-7:] if len(digits) >= 7 else ""


class _Graph:
    """Nodes and edges of a batch of documents."""

    def __init__(self, column: pa.Array):
        data, offsets = words.buffer(column)
        w = words.Words(data, offsets, words.SPACE_WORDS, False)
        sign = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40)
        marks = np.concatenate([np.zeros(1, np.int64), np.cumsum(sign)])
        node = np.flatnonzero(marks[w.end] > marks[w.start])
        chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
        self.doc = np.searchsorted(w.first, node, "right") - 1
        origin = chars[offsets[self.doc]]
        self.start, self.end = chars[w.start[node]] - origin, chars[w.end[node]] - origin
        raw = data.tobytes()
        tokens = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[node], w.end[node])]
        self.tokens = tokens
        self.shape = np.array([_shape(t) for t in tokens], np.int64)
        some = np.unique(self.doc)
        self.texts = {int(d): raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace") for d in some}
        self.spans: dict[int, list] = {d: base_spans(t) for d, t in self.texts.items()}
        n = len(node)
        self.base = np.full(n, NONE)
        keys = [_key(t) for t in tokens]
        for lo, hi in self._runs(node, tokens):
            key = _tail("".join(tokens[lo:hi]))
            keys[lo:hi] = [key or k for k in keys[lo:hi]]
        lo = np.searchsorted(self.doc, some), np.searchsorted(self.doc, some, "right")
        for d, a, b in zip(some, *lo):
            for s, k, e in self.spans[int(d)]:
                i = a + np.searchsorted(self.end[a:b], s, "right")
                j = a + np.searchsorted(self.start[a:b], e)
                self.base[i:j] = k
                if KINDS[k] in ("card", "phone"):
                    keys[i:j] = [_tail(self.texts[int(d)][s:e])] * (j - i)
        near = np.flatnonzero((np.diff(node) == 1) & (np.diff(self.doc) == 0)) if n > 1 else np.zeros(0, np.int64)
        self.chain = np.stack([near, near + 1], 1)
        # Chain neighbours that are words: clamped to no entity.
        self.word = np.stack([node > w.first[self.doc], node + 1 < w.first[self.doc + 1]])
        self.word[0, near + 1] = self.word[1, near] = False
        last: dict[tuple[int, str], list[int]] = {}
        known: dict[tuple[int, str], bool] = {}
        self.group, skip, mention = [None] * n, [], []
        side = np.concatenate([[False], np.isin(np.arange(1, n), near + 1)]) if n else np.zeros(0, bool)
        for i, (d, key) in enumerate(zip(self.doc.tolist(), keys)):
            if not key:
                continue
            self.group[i] = g = (d, key)
            known[g] = known.get(g, False) or self.base[i] != NONE
            if side[i] and self.group[i - 1] == g:
                mention.append(i)
            else:
                mention = [i]
            if i + 1 == n or not side[i + 1] or (d, keys[i + 1]) != g:  # the mention is whole: its tokens meet those of the one before
                skip += zip(reversed(last.get(g, ())), reversed(mention))
                last[g] = mention
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.free = np.array([g is not None and known[g] for g in self.group], bool) & (self.base == NONE)

    def _runs(self, node: np.ndarray, tokens: list[str]) -> list[tuple[int, int]]:
        """Runs (from, to) of at least two number tokens, too short for keys, side by side."""
        number = np.array([bool(_NUMBER.fullmatch(t)) and not _tail(t) for t in tokens], bool)
        joined = number[1:] & number[:-1] & (np.diff(node) == 1) & (np.diff(self.doc) == 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2])]

    def neighbours(self) -> np.ndarray:
        """(4, nodes): labels left, right, of the skip before and after; OPEN if none is known."""
        label = np.where(self.free, OPEN, self.base)
        out = np.full((4, len(label)), OPEN)
        out[:2][self.word] = NONE
        out[0, self.chain[:, 1]], out[1, self.chain[:, 0]] = label[self.chain[:, 0]], label[self.chain[:, 1]]
        out[2, self.skip[:, 1]], out[3, self.skip[:, 0]] = label[self.skip[:, 0]], label[self.skip[:, 1]]
        return out


def _configurations(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Configurations of the labelled tokens, each as one number, and their counts."""
    g = _Graph(column)
    code = g.shape
    for x in g.neighbours():
        code = code * (LABELS + 1) + x
    return np.unique((code * LABELS + g.base)[~g.free], return_counts=True)


class Field:
    """Log potentials: look (features, label), chain (label, label), skip (one number
    that two tokens of a key gain when they agree)."""

    def __init__(self, look: np.ndarray, chain: np.ndarray, skip: float):
        self.look, self.chain, self.skip = look, chain, skip
        self.node = FEATURES @ look

    @classmethod
    def fit(cls, code: np.ndarray, count: np.ndarray) -> Field:
        """Weights of largest penalised pseudo-likelihood, by Adam on the whole table."""
        code, y = np.divmod(code, LABELS)
        near = []
        for _ in range(4):
            code, x = np.divmod(code, LABELS + 1)
            near.insert(0, x)
        # Each counts as it is and once more with its look blanked, so that neighbours
        # alone must tell a label too: else looks, which patterns decide, explain it all.
        x = np.concatenate([FEATURES[code], np.zeros((len(code), FEATURES.shape[1]))])
        share, y, near = np.tile(count, 2) / max(2 * count.sum(), 1), np.tile(y, 2), [np.tile(z, 2) for z in near]
        one = np.eye(LABELS + 1)[:, :LABELS]  # OPEN is a row of zeros
        left, right = one[near[0]], one[near[1]]
        agree = one[near[2]] + one[near[3]]
        sizes = (FEATURES.shape[1] * LABELS, LABELS * LABELS, 1)
        w, m, v = (np.zeros(sum(sizes)) for _ in range(3))
        parts = lambda w: (w[: sizes[0]].reshape(-1, LABELS), w[sizes[0] : -1].reshape(LABELS, LABELS), w[-1])
        penalty = np.repeat(PENALTY, (sizes[0] + sizes[1], 1))
        for i in range(1, STEPS + 1 if len(y) else 1):
            look, chain, skip = parts(w)
            z = x @ look + left @ chain + right @ chain.T + skip * agree
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = (p - np.eye(LABELS)[y]) * share[:, None]
            grad = np.concatenate([(x.T @ off).ravel(), (left.T @ off + off.T @ right).ravel(), [(off * agree).sum()]]) + penalty * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        look, chain, skip = parts(w)
        return cls(look, chain, float(skip))

    def posteriors(self, g: _Graph) -> np.ndarray:
        """(nodes, labels) by loopy sum-product messages, all edges in step."""
        n = len(g.base)
        local = np.full((n, LABELS), -30.0)
        local[np.arange(n), g.base] = 0.0
        local[g.free] = (self.node[g.shape] + g.word[0][:, None] * self.chain[NONE] + g.word[1][:, None] * self.chain[:, NONE])[g.free]
        potts = np.eye(LABELS) * self.skip
        edges = [(g.chain, self.chain), (g.skip, potts)]
        src = np.concatenate([x for e, _ in edges for x in (e[:, 0], e[:, 1])])
        dst = np.concatenate([x for e, _ in edges for x in (e[:, 1], e[:, 0])])
        pot = np.concatenate([np.broadcast_to(p, (len(e), LABELS, LABELS)) for e, f in edges for p in (f, f.T)])
        m = len(src)
        back = np.concatenate([np.arange(len(e)) + k for e, k in ((g.chain, len(g.chain)), (g.chain, 0), (g.skip, 2 * len(g.chain) + len(g.skip)), (g.skip, 2 * len(g.chain)))])
        # Only messages between tokens that can still change matter.
        live = g.free[src] | g.free[dst]
        message = np.zeros((m, LABELS))
        for _ in range(ROUNDS if live.any() else 0):
            belief = local.copy()
            np.add.at(belief, dst[live], message[live])
            out = belief[src] - message[back]
            top = (out[:, :, None] + pot).max(1)
            new = top + np.log(np.exp(out[:, :, None] + pot - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - message)[live].max()
            message = np.where(live[:, None], 0.5 * message + 0.5 * new, 0.0)
            if moved < 1e-4:
                break
        belief = local.copy()
        np.add.at(belief, dst, message)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)

    def added(self, g: _Graph) -> dict[int, list]:
        """Spans beyond the base, by document."""
        out: dict[int, list] = {}
        if not g.free.any():
            return out
        p = self.posteriors(g)
        label = p.argmax(1)
        on = g.free & (label != NONE) & (p.max(1) >= ACCEPT)
        # Side by side, of one label and key: one span.
        joined = np.zeros(len(on), bool)
        a, b = g.chain[:, 0], g.chain[:, 1]
        joined[b] = on[a] & on[b] & (label[a] == label[b]) & np.array([g.group[i] == g.group[j] for i, j in zip(a, b)], bool)
        for i in np.flatnonzero(on & ~joined):
            j = i
            while j + 1 < len(on) and joined[j + 1]:
                j += 1
            d, k = int(g.doc[i]), int(label[i])
            head = _TRIM.search(g.tokens[i])
            size = len(g.tokens[j].rstrip("\"'<>()[]{}.,;:!?*#$%&|"))
            if not head or not size or (i == j and size <= head.start()):
                continue
            a, b = int(g.start[i]) + head.start(), int(g.start[j]) + size
            if all(e <= a or b <= s for s, _, e in g.spans[d]):
                out.setdefault(d, []).append((a, k, b))
        return out


def train(df: DataFrame, text: str = "text") -> Field:
    """Weights from every text of df; the driver gets the table of configurations, at
    most SHAPES * (LABELS + 1)^4 * LABELS rows and a few thousand in truth."""

    def work(batch: pa.RecordBatch) -> dict:
        code, n = _configurations(batch.column(0))
        return {"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())}

    got = common.fetch(common.arrow_map(df.select(F.col(text).alias("text")), "code long, n long", "text", work).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code"))
    return Field.fit(got["code"], got["n"])


def find(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    empty = hashlib.sha256(b"").hexdigest()

    def work(batch: pa.RecordBatch) -> dict:
        g = _Graph(batch.column(1))
        more, n = field.added(g), batch.num_rows
        counts = np.zeros((len(KINDS), n), np.int64)
        sha, spans, added = [empty] * n, [""] * n, np.zeros(n, np.int64)
        for d, base in g.spans.items():
            if base:
                np.add.at(counts[:, d], [k for _, k, _ in base], 1)
                sha[d] = hashlib.sha256(joined(base).encode()).hexdigest()
                added[d] = len(more.get(d, ()))
                spans[d] = joined(sorted([*base, *more.get(d, ())]))
        return {"doc_id": batch.column(0), **{f"n_{k}": pa.array(c) for k, c in zip(KINDS, counts)}, "base_sha256": pa.array(sha), "spans": pa.array(spans), "n_added": pa.array(added)}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return common.arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), schema, "text", work)


def redact(df: DataFrame, field: Field, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """df with every span replaced by its kind in brackets, overlapping ones by that
    of the first, and ``n_chars``, if there, recounted. Rows and columns stay."""
    common.ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, text):
                at = part.schema.get_field_index(text)
                column = part.column(at)
                g = _Graph(column)
                more, values = field.added(g), None
                for d, base in g.spans.items():
                    if not base:
                        continue
                    values = values or column.to_pylist()
                    old, out, done = g.texts[d], [], 0
                    for a, k, b in sorted([*base, *more.get(d, ())]):
                        if a >= done:
                            out += [old[done:a], f"[{KINDS[k].upper()}]"]
                        done = max(done, b)
                    values[d] = "".join([*out, old[done:]])
                if values:
                    new = pa.array(values, column.type)
                    part = part.set_column(at, part.schema.field(at), new)
                    if n_chars in part.schema.names:
                        i = part.schema.get_field_index(n_chars)
                        part = part.set_column(i, part.schema.field(i), pa.compute.utf8_length(new).cast(part.schema.field(i).type))
                yield part

    return df.mapInArrow(run, df.schema)
