"""Each operator against brute force on a small fixture with every odd case."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.llm import ann, common, licenses, media, mixing, neardup, packing, pii, quality, sharding, substrings, words
from tests.llm.conftest import TEXTS

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_words_and_hashes():
    import pyarrow as pa

    data, offsets = words.buffer(pa.array(TEXTS))
    w = words.Words(data, offsets, words.SPACE_WORDS, False)
    want = [m for t in TEXTS for m in re.findall(SPACE, t or "")]
    got = [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert got == want and w.counts.tolist() == [len(re.findall(SPACE, t or "")) for t in TEXTS]
    by = {}
    for word, h in zip(want, w.hashes()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_pii(spark, docs):
    field = pii.train(docs)
    got = {r.doc_id: r for r in pii.find(docs, field).collect()}
    assert (got[7].n_email, got[7].n_ip, got[7].n_card, got[7].n_phone) == (1, 1, 1, 1)
    t = TEXTS[7]
    assert "email:%d:%d" % (t.index("a.b@"), t.index("a.b@") + 8) in got[7].spans
    assert all(got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in (0, 3, 4, 6, 9))
    red = pii.redact(docs, field)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert "[EMAIL]" in red.where("doc_id = 7").first().text and red.where("doc_id = 0").first().text == TEXTS[0]


def test_pii_skip_edges_need_a_base_span(spark):
    x = spark.createDataFrame([(1, "call +1 (743) 555-3824 or 743-555-3824 now"), (2, "nothing 743-555-3824 here")] + [(i, f"at +1 (201) 555-{1000 + i} and again +1 (201) 555-{1000 + i} now") for i in range(3, 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(x, pii.train(x)).collect()}
    assert got[1].n_added == 1 and got[2].spans == ""


def enumerate_field(field, g):
    """Marginals of the free tokens by trying every labelling."""
    from itertools import product

    free, n = np.flatnonzero(g.free), pii.LABELS
    total = np.zeros((len(g.base), n))
    for labels in product(range(n), repeat=len(free)):
        y = g.base.copy()
        y[free] = labels
        e = sum(field.node[g.shape[i], y[i]] + g.word[0][i] * field.chain[pii.NONE, y[i]] + g.word[1][i] * field.chain[y[i], pii.NONE] for i in free)
        e += sum(field.chain[y[a], y[b]] for a, b in g.chain) + sum(field.skip * (y[a] == y[b]) for a, b in g.skip)
        total[np.arange(len(y)), y] += np.exp(e)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("text, close", [
    ("call +1 (743) 555-3824 or 743-555-3824 now", 1e-3), ("+1 (743) 555-3824 then 743.555.3824 then 7435553824 end", 1e-3),
    ("mail a.b@c.de and a.b@c.de, 10 times; card 4111 1111 1111 1111 or 4111.1111.1111.1111 5", 1e-3),
    ("+49 30 1234 5678 or 030 1234 5678 or 030 1234 5678", 0.1),  # on a loop of chain and skip edges messages are near only
])
def test_messages_against_enumeration(text, close):
    import pyarrow as pa

    rng, g = np.random.default_rng(3), pii._Graph(pa.array([text]))
    assert g.free.any()
    for _ in range(5):
        field = pii.Field(rng.normal(size=(pii.FEATURES.shape[1], pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)) * 0.5, float(rng.uniform(0, 2)))
        assert np.abs(field.posteriors(g) - enumerate_field(field, g))[g.free].max() < close


def test_fit_is_at_the_best_weights():
    """No step from the fitted weights raises the penalised pseudo-likelihood."""
    import pyarrow as pa

    texts = ["at +1 (201) 555-%d and again +1 (201) 555-%d now, %d of 12" % (1000 + i, 1000 + i, i) for i in range(40)]
    code, count = pii._configurations(pa.array(texts))
    field, rng = pii.Field.fit(code, count), np.random.default_rng(1)

    def loss(look, chain, skip):
        out = 0.0
        for c, n in zip(code.tolist(), count.tolist()):
            c, y = divmod(c, pii.LABELS)
            near = []
            for _ in range(4):
                c, x = divmod(c, pii.LABELS + 1)
                near.insert(0, x)
            for f in (pii.FEATURES[c], np.zeros(pii.FEATURES.shape[1])):
                z = f @ look
                for x, part in zip(near[:2], (chain, chain.T)):
                    z = z + (part[x] if x != pii.OPEN else 0)
                for x in near[2:]:
                    z = z + (skip * (np.arange(pii.LABELS) == x) if x != pii.OPEN else 0)
                out -= n * (z[y] - np.log(np.exp(z).sum()))
        a, b = pii.PENALTY
        return out / (2 * count.sum()) + (a * (look**2).sum() + a * (chain**2).sum() + b * skip**2) / 2

    best = loss(field.look, field.chain, field.skip)
    for _ in range(20):
        assert best <= loss(field.look + 0.1 * rng.normal(size=field.look.shape), field.chain + 0.1 * rng.normal(size=field.chain.shape), field.skip + rng.normal())
    assert field.skip > 1


def test_pii_other_layouts_of_a_base_span(spark):
    """Spans over several tokens, as base and as what is added."""
    rows = [(i, f"at +1 (201) 555-{1000 + i} and again +1 (201) 555-{1000 + i} in {i}, 12 times 7 of 1999") for i in range(30)]
    rows += [(50, "card 4111 1111 1111 1111 and 4111.1111.1111.1111 too, +49 30 1234 5678 or 030 1234 5678 ok"), (51, "1999 2000 2001 and 4111.1111.1111.1111 alone")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(x, pii.train(x)).collect()}
    assert got[50].spans == "card:5:24,card:29:48,phone:54:70,phone:74:87" and got[51].spans == "" and got[3].n_added == 0


@pytest.mark.parametrize("text", ["a@b.c@d.ef x..y@-.-", "1.2.3.4.5.6.7.8.256.1.1.1", "@@a@b.c", "a@b@c.d", "+12+123456789012 ", "1.2.3.4567.8.9.10", "00255.0001.1.1 1.2.3"])
def test_pii_patterns(text):
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda x: re.sub("[^0-9]", "", x)
    fine = [lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 14 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), lambda x: 10 <= len(digits(x)) <= 15]
    want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(zip(pats, fine)) for m in re.finditer(p, text) if ok(m[0]))
    assert pii.base_spans(text) == want


def test_quality(spark, docs):
    good = ["the plain words of text number %d go on and on" % i for i in range(120)]
    bad = ["BUY!! NOW!! %d!! CHEAP!! OFFER!!" % i for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180) if i % 3] + [(1, None), (2, 7)], "doc_id long, quality int")
    model = quality.fit(x, labels)
    s = {r.doc_id: r.score for r in quality.score(x, model).collect()}
    held = [i for i in range(180) if i % 3 == 0]
    assert np.mean([(s[i] >= 0.7) == (i < 120) for i in held]) > 0.95
    every = quality.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    assert quality.keep(docs, model).columns == docs.columns
    none = quality.fit(x, labels.where("false"))
    assert all(abs(r.score - 0.5) < 1e-6 for r in quality.score(docs, none).collect())


def test_descent_against_another_solver():
    """The same dual problem by projected gradients."""
    rng = np.random.default_rng(4)
    dim, n = 40, 70
    rows = [np.sort(rng.choice(dim, int(rng.integers(3, 12)), replace=False)) for _ in range(n)]
    ratios, y, cost = rng.normal(size=dim), np.where(rng.random(n) < 0.4, 1.0, -1.0), rng.uniform(0.5, 2, n)
    x = np.zeros((n, dim + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / quality._length(ratios[r])
    x[:, dim] = 1
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(40_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    want = x.T @ (alpha * y)
    w, b = quality.descend(rows, ratios, y, dim, cost, 2_000)
    value = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert value(np.append(w, b)) == pytest.approx(value(want), rel=1e-3)


def test_ratios_and_margins_by_hand():
    """Log-count ratios and a margin recomputed from the texts' distinct slots."""
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([3, 4]), np.array([1, 4])] * 5
    y = np.array([1, 1, 0, 0] * 5)
    m = quality.train(rows, y)
    fold = np.arange(20) % 5 == 4
    p, q = (np.ones(quality.DIM) * quality.SMOOTH for _ in range(2))
    for r, k, f in zip(rows, y, fold):
        if not f:
            (p if k else q)[r] += 1
    assert np.allclose(m.ratios, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_held_out_rows(spark):
    from tallygraph.llm.queries import held_out

    rows = [(i,) for i in range(50)] + [(None,)]
    got = {r.doc_id: r.h for r in spark.createDataFrame(rows, "doc_id long").select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)} | {None: False}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the given tables are not here")
def test_held_out_accuracy_on_the_given_tables(spark):
    from tallygraph.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = queries.op2_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out and quality in (0, 1)").collect()
    assert len(rows) > 200 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_media_round_trip(docs):
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature


def test_media_random_coefficients():
    rng = np.random.default_rng(0)
    payloads = [bytes(64), bytes(range(256)), rng.integers(0, 256, 64 * 3_100, dtype=np.uint8).tobytes()]
    payloads += [np.where(rng.random(64 * 100) < q, rng.integers(126, 131, 64 * 100), 128).astype(np.uint8).tobytes() for q in (0.01, 0.1, 0.5)]
    assert [p for _, p in media._decode(media.encode(payloads))] == payloads
    with pytest.raises(ValueError):
        media.decode([b"not a file"])


def test_media_flat_image_is_flat():
    (t,) = media.decode(media.encode([np.full(384, 128, np.uint8).tobytes()]))
    assert t.shape == (16, 16, 3) and (t == 128).all()


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(ALNUM, lower(t))
        at = [j for p in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(at))
        assert (got[i].first_word, got[i].last_word) == ((min(at), max(at)) if at else (None, None))
    assert got[8].labels == "mit" and got[8].score == 1.0 and got[8].base_labels == "mit" and got[0].score == 0


def brute_licenses(text):
    """Labels, score and matches by trying every block of every template."""
    w, labels, score, found = re.findall(ALNUM, lower(text)), set(), 0.0, []
    for p, label in licenses.PHRASES.items():
        if any(w[j : j + len(p.split())] == p.split() for j in range(len(w))):
            labels.add(label)
    for t, (label, line, keys) in enumerate(licenses.TEMPLATES):
        mine = re.findall(ALNUM, lower(line))
        span, least = int(np.ceil(licenses.SPAN * len(mine))), licenses.need(len(set(mine)))
        best = 0
        for j in range(len(w)):
            held = set(w[j : j + span]) & set(mine)
            if w[j] in mine and len(held) >= least and set(keys.split()) <= held and len(held) > best:
                best, at = len(held), j
        if best:
            labels.add(label)
            score = max(score, best / len(set(mine)))
            found.append((t, at, best / len(set(mine))))
    return ",".join(sorted(labels)), score, found


def test_license_blocks_against_brute_force(spark):
    monkeypatch.setattr(ann, "TARGET", 1.0)  # every cell that holds a neighbour is asked
    rng = np.random.default_rng(8)
    lines = [t[1] for t in licenses.TEMPLATES]
    vocabulary = sorted({x for t in lines for x in re.findall(ALNUM, lower(t))})
    texts = list(lines)
    for t in lines * 4:  # words dropped, swapped in and spread over lines
        own = t.split()
        for _ in range(int(rng.integers(1, 4))):
            own[int(rng.integers(len(own)))] = ["", "zebra", "\n"][int(rng.integers(3))]
        texts.append(" ".join([*rng.choice(vocabulary, int(rng.integers(0, 90))), *own, *rng.choice(vocabulary, int(rng.integers(0, 90)))]))
    texts += [" ".join(rng.choice(vocabulary, 4_000)), "mit der license"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].labels, got[i].score, [tuple(m) for m in got[i].matches]) == brute_licenses(t), t


@pytest.mark.parametrize("text, labels", [
    ("Released under the Apache License.", "apache"), ("the book was released in spring under heavy rain and the driver lost a license", ""),
    ("Er kam mit der Lizenz, released under the old law", ""), ("Licensed under the Apache License, Version 2.0.", "apache"), ("RELEASED UNDER\nTHE MIT\tLICENSE", "mit"),
    ("a copy of this software and its documentation files goes to any person, free of charge", ""),
])
def test_license_labels(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
    assert row.labels == labels


def exact_components(texts, n, hundredths=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACE, lower(t))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= hundredths * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_neardup(spark, docs, n):
    rng = np.random.default_rng(n)
    base = [f"w{j}" for j in range(150)]
    texts = dict(enumerate(TEXTS))
    for i in range(60):  # a chain of edits, so hubs do not reach all
        base[int(rng.integers(150))] = f"v{i}"
        texts[100 + i] = " ".join(base)
    x = spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(docs.where("doc_id = 0").select("doc_id", "text").limit(1))
    want = exact_components(texts, n)
    got = neardup.near_duplicates(x, n=n).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    one, two = a, np.concatenate([a[100:], b])  # 800 of 1000 in common
    r = neardup.registers(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
    n = np.array([900.0])
    assert abs(neardup.estimate(r[:1], r[1:], n, n)[0] - 0.8) < 0.2
    union = neardup.registers(np.unique(np.concatenate([one, two])), np.array([0, 1000]))
    assert (neardup.merge(r[:1], r[1:]) == union).all()


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count() and all(r.law == "key" and r.grown_shard in (r.shard, 24) for r in got)
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    by = {r.doc_id: r for r in got}
    assert (by[3].size, by[3].text_crc32, by[8].size) == (8, 0, 8 + len(TEXTS[8].encode()))


def walk(key, n):
    """The jump walk as published, with draws from MD5."""
    at, step = 0, 0
    while step < n:
        at = step
        draw = int(hashlib.md5(f"{key}:{step}".encode()).hexdigest()[:13], 16)
        step = int((step + 1) * float(1 << 52) / (draw + 1))
    return at


def test_jump_against_the_walk(spark):
    x = spark.range(300).select("id", sharding.shard_of(F.col("id"), 1, 7, 24, 25).alias("s")).collect()
    assert all(tuple(r.s) == tuple(walk(r.id, n) for n in (1, 7, 24, 25)) for r in x)


def test_slots_against_a_sort(docs):
    got = sharding.shard(docs).collect()
    for s in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        order = [(hashlib.md5(f"{r.doc_id}:{r.text_crc32}".encode()).hexdigest()[:15], r.doc_id) for r in own]
        assert order == sorted(order) and [r.slot for r in own] == list(range(len(own)))
        assert all(r.shard == walk(r.doc_id, 24) and r.grown_shard == walk(r.doc_id, 25) for r in own)


def test_jump_moves_few_and_evenly(spark):
    x = spark.range(20_000).select(sharding.shard_of(F.col("id"), 10, 11).alias("s")).select(F.col("s.s10").alias("a"), F.col("s.s11").alias("b"))
    assert x.where("a <> b and b <> 10").count() == 0 and 0.07 < x.where("a <> b").count() / 20_000 < 0.11
    assert all(1_700 < r["count"] < 2_300 for r in x.groupBy("a").count().collect())


def test_packing(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == len(ids) * (2 if i == 0 else 1)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    ends = {}
    for r in rows:
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(ends[s] == 2048 for s in range(max(ends)))


def test_packing_knows_the_added_token(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"end {end} start", end, end * 3, f"a{end}b", f" {end}\n{end} ", "<|endoftext", f"<{end}>", "plain text"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert {r.doc_id for r in rows} == set(range(len(texts)))


def test_hilbert_is_a_curve():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = packing.hilbert(g, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_mixing(spark, docs):
    got = mixing.mix(docs)
    assert got.columns == [c for c in docs.columns if c != "mix_tokens"] + ["mix_domain", "mix_tokens", "mix_epoch", "mix_before", "mix_budget"]
    assert all(r.mix_before < r.mix_budget for r in got.collect())


def brute_budgets(tree, budget, weights, level=0):
    """Budgets of leaves {path: supply} by filling one child after another."""
    if level == 3:
        return {k: min(budget, s) for k, s in tree.items()}
    name = mixing.LEVELS[level]
    weight = {k[level]: float(weights.get(name, {}).get(k[level], 1.0)) for k in tree}
    def usable(k):
        return all(float(weights.get(n, {}).get(v, 1.0)) > 0 for n, v in zip(mixing.LEVELS, k))
    supply = {c: sum(s for k, s in tree.items() if k[level] == c and usable(k)) for c in weight}
    given, open_ = {c: 0.0 for c in weight}, {c for c in weight if weight[c] > 0 and supply[c] > 0}
    left = budget
    while open_ and left > 1e-9:
        t = min([left / sum(weight[c] for c in open_), *((supply[c] - given[c]) / weight[c] for c in open_)])
        for c in open_:
            given[c] += t * weight[c]
        left -= t * sum(weight[c] for c in open_)
        open_ = {c for c in open_ if supply[c] - given[c] > 1e-9}
    out = {}
    for c in weight:
        out |= brute_budgets({k: (s if usable(k) else 0) for k, s in tree.items() if k[level] == c}, given[c], weights, level + 1)
    return out


WEIGHTS = [mixing.WEIGHTS, {"domain": {"web": 0, "books": 1.5}, "lang": {"de": 0}, "source": {"src1": 3}}, {"domain": {"web": 0, "books": 0, "code": 0}}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_mixing_against_brute_force(spark, weights):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["en", "de", "fr", None][int(rng.integers(4))], f"src{int(rng.integers(5))}" if i % 9 else None) for i in range(150)]
    rows += [rows[3], (None, "a null id", "en", "src0")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), share=0.7, weights=weights).collect()
    leaves, want = {}, []
    for i, t, la, so in rows:
        domain = mixing.DOMAINS[int((so or "0")[-1]) % 3]
        leaves.setdefault((domain, la or "", so or ""), []).append((i, t, max(1, len(t.split()))))
    own = {k: sum(n for *_, n in v) for k, v in leaves.items()}
    budget = brute_budgets({k: 2 * n for k, n in own.items()}, 0.7 * sum(own.values()), weights)
    for k, v in leaves.items():
        for e in range(2):
            at = e * own[k]
            key = lambda r: (hashlib.md5(f"8:{e}:{'' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()[:15], r[0] or -1)
            for i, _, n in sorted(v, key=key):
                if at < int(budget[k] + 1e-6):
                    want.append((i, k[0], n, e, at, int(budget[k] + 1e-6)))
                at += n
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.mix_domain, r.mix_tokens, r.mix_epoch, r.mix_before, r.mix_budget)) for r in got)


def test_bad_weights_raise(docs):
    for w in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix(docs, weights={"lang": {"en": w}})


def test_budgets_fill_siblings_first(spark):
    rows = [("web", "en", "a", 10), ("web", "en", "b", 1_000), ("web", "de", "c", 1_000), ("books", "en", "d", 20), ("code", "en", "e", 5)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(600.0)).collect()}
    assert sum(got.values()) == pytest.approx(600) and got["d"] == 20 and got["e"] == 5 and got["a"] == 10
    assert got["a"] + got["b"] == pytest.approx(2 * got["c"])  # en weighs twice de; a's shortage stays in en


def brute_repeats(texts, size=20):
    seen, out = {}, {}
    for i, t in sorted(texts.items()):
        w = re.findall(SPACE, t or "")
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if tuple(w[j : j + size]) in seen:
                gone[j : j + size] = [True] * size
            seen.setdefault(tuple(w[j : j + size]), 1)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(spark, docs):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: (t if i != 9 else "x " * 300) for i, t in enumerate(TEXTS)}
    texts |= {20: "a b c " + passage + " d e", 21: passage + " z " + passage, 22: " ".join(f"p{i}" for i in range(19)), 23: " ".join(f"p{i}" for i in range(5, 25))}
    x = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(x).collect()}
    assert got == brute_repeats(texts)


def test_substrings_repeated_row_and_null_id(spark, docs):
    got = substrings.dedup(docs.select("doc_id", "text").where("doc_id < 9").unionByName(spark.createDataFrame([(None, "q " * 50)], "doc_id long, text string"))).collect()
    assert len(got) == 11 and [r.n_removed for r in got if r.doc_id is None] == [0] and len({r[1:] for r in got if r.doc_id == 0}) == 1


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16))
    v[100:300] = v[100]  # a mass of copies
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1_000, None), (1_001, [0.0] * 16), (1_002, [float("nan")] * 16), (1_003, [None] * 16), (1_004, [float("inf")] + [0.0] * 15)]
    got = ann.neighbours(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    hits = total = 0
    for q in range(0, 600, 20):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        hits += len(set(best) & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9


def recall(v, q, k=20):
    g, order = ann.Graph.build(ann.unit(v))
    got, scores = g.search(ann.asked(q), k)
    best = np.argsort(-(q @ v.T), axis=1)[:, :k]
    assert got.shape == scores.shape == (len(q), k) and (np.diff(scores, axis=1) <= 1e-6).all()
    return np.mean([len(set(a) & set(order[b])) / k for a, b in zip(best.tolist(), got.tolist())])


def on_sphere(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_of_a_full_shard():
    """Unclustered vectors, queries of other shards."""
    rng = np.random.default_rng(4)
    assert recall(on_sphere(rng, ann.SHARD_ROWS), on_sphere(rng, 128)) >= 0.92


@pytest.mark.parametrize("clusters, size", [(40, 200), (400, 80)])
def test_recall_on_tight_clusters(clusters, size):
    """Also far more rows than a shard takes; near links alone would never leave a cluster."""
    rng = np.random.default_rng(5)
    v = np.repeat(on_sphere(rng, clusters), size, 0) + 0.02 * rng.normal(size=(clusters * size, 64))
    q = v[rng.choice(len(v), 128)] + 0.005 * rng.normal(size=(128, 64))
    assert recall(v / np.linalg.norm(v, axis=1, keepdims=True), q) >= 0.97


def test_every_node_can_be_reached():
    v = np.repeat(np.eye(40, 64), 30, 0) + 1e-3 * np.random.default_rng(6).normal(size=(1_200, 64))
    g, _ = ann.Graph.build(ann.unit(v))
    for flat in g.layers:
        seen, front = {0}, [0]
        while front:
            front = [int(y) for x in front for y in flat[x] if y >= 0 and int(y) not in seen and not seen.add(int(y))]
        assert len(seen) == len(flat)


def test_neighbours_of_vectors_of_any_length_by_routing(spark):
    """More rows than the cells probed hold, norms that differ, a hot vector and a repeated row."""
    rng = np.random.default_rng(7)
    v = np.repeat(on_sphere(rng, 60, 16), 60, 0) + 0.05 * rng.normal(size=(3_600, 16))
    v *= rng.uniform(0.5, 2, size=(3_600, 1))
    v[1_000:2_200] = v[1_000]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = ann.neighbours(spark.createDataFrame([*rows, rows[40], rows[40]], "vec_id long, embedding array<double>"), F.col("vec_id") % 40 == 0).collect()
    hits = 0
    for q in range(0, 3_600, 40):
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3_600), -np.round(s, 12)))[:20]
        own = [r.vec_id for r in got if r.query_id == q]
        assert len(own) == (60 if q == 40 else 20)  # three rows of that id, each with its own twenty
        own = list(dict.fromkeys(own))
        hits += len(set(best.tolist()) & set(own))
    assert hits / (90 * 20) >= 0.95


def test_neighbours_of_repeated_ids_and_rows(spark, monkeypatch):
    """Every query row has ranks of its own; others of its id, and rows like it, are candidates.
    Vectors of other lengths don't meet."""
    monkeypatch.setattr(ann, "TARGET", 1.0)  # every cell that holds a neighbour is asked
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(20, [float(x) for x in rng.normal(size=8)]), (20, [float(x) for x in rng.normal(size=8)]), rows[40], rows[40], rows[7]]
    short = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(0, 60, 3)]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows + short, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {}
    for part in (rows, short):
        x = np.array([r[1] for r in part])
        for at, (i, _) in enumerate(part):
            if i % 20 == 0:
                s = [(-round(float(x[at] @ x[j]), 9), part[j][0]) for j in range(len(part)) if j != at]
                want.setdefault(i, []).extend((k, j, -t) for k, (t, j) in enumerate(sorted(s)[:5], 1))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_texts_longer_than_a_slice(spark):
    """One text alone exceeds what a kernel holds at once; what stands at its end counts."""
    long = "alpha beta gamma " * (common.SLICE_BYTES // 16) + "call +1 (743) 555-3824 Released under the MIT License. " + " ".join(f"p{i}" for i in range(40))
    assert len(long) > common.SLICE_BYTES
    x = spark.createDataFrame([(0, long), (1, " ".join(f"p{i}" for i in range(40))), (2, long)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(x, pii.train(x)).collect()}
    assert found[0].n_phone == 1 and found[0].spans == f"phone:{long.index('+1')}:{long.index('+1') + 17}"
    assert {r.doc_id: r.labels for r in licenses.scan(x).collect()} == {0: "mit", 1: "", 2: "mit"}
    gone = {r.doc_id: r.n_words - r.n_removed for r in substrings.dedup(x).collect()}
    assert gone == {0: 3 + len(re.findall("call.*", long)[0].split()), 1: 0, 2: 0}  # the first three windows of the period
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(x).collect()}
    assert near == {0: 0, 1: 1, 2: 0}
    packed = packing.pack(x).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in packed)
    d = {r.doc_id: r for r in media.digests(x).collect()}
    assert d[0].n_bytes == len(long) and d[0].payload_sha256 == d[2].payload_sha256 == hashlib.sha256(long.encode() + bytes(-len(long) % 64)).hexdigest()
    assert sharding.shard(x).where("doc_id = 0").first().size == len(long) + 8 and quality.score(x, quality.train([], np.zeros(0, int))).count() == 3


def test_neardup_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(50)) for k in "abc")
    rows = [(None, a), (3, a + " end"), (5, b), (5, c), (7, b + " end"), (None, "lone words here"), (None, None), (9, c), (9, c)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(map(str, [(None, 3, None), (3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (None, None, None), (None, None, None), (9, 5, False), (9, 5, False)]))
    assert len({r.component for r in got if r.doc_id == 5}) == 2


def test_empty_table(spark, docs):
    none = docs.where("false")
    field = pii.train(none)
    for df in (pii.find(none, field), media.digests(none), licenses.scan(none), neardup.near_duplicates(none), sharding.shard(none), packing.pack(none), mixing.mix(none), substrings.dedup(none), quality.score(none, quality.train([], np.zeros(0, int))), ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True))):
        assert df.count() == 0


def test_substrings_of_repeated_ids_with_other_texts(spark):
    """Documents of one id don't touch each other, and each keeps its own result; also over tasks
    that cut a run of equal windows."""
    passage = " ".join(f"w{i}" for i in range(25))
    texts = [(1, passage), (2, passage + " tail a"), (2, " ".join(f"z{i}" for i in range(30))), (2, passage + " tail b"), (2, passage + " tail b"), (3, passage + " x " + passage), (0, " ".join(f"z{i}" for i in range(5, 27)))]
    texts += [(i % 5 + 10, f"v{i} " + " ".join(f"q{j}" for j in range(22)) + f" u{i % 7}") for i in range(60)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(7)).collect())
    words_of = lambda t: re.findall(SPACE, t)
    at = [(i, t, a, tuple(words_of(t)[a : a + 20])) for i, t in texts for a in range(max(0, len(words_of(t)) - 19))]
    by = {}
    for i, t, a, w in at:
        by.setdefault(w, []).append((i, t, a))
    want = []
    for i, t in texts:
        w, gone = words_of(t), set()
        for a in range(max(0, len(w) - 19)):
            if any(j < i or (j, u) == (i, t) and b < a for j, u, b in by[tuple(w[a : a + 20])]):
                gone |= set(range(a, a + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want)


def test_later_rows_over_cut_runs():
    """A run of equal hashes that tasks cut anywhere gives the same repeats."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted((int(h), 0, int(d), int(w), int(a)) for h, d, w, a in rng.integers(0, [3, 3, 2, 3], (40, 4)))  # some repeat
    want = {r for r in rows if any(q[:2] == r[:2] and (q[2] < r[2] or q[2:4] == r[2:4] and q[4] < r[4]) for q in rows)}
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*x)), kinds)], ["hash", "check", "doc_id", "row", "at"])
    for trial in range(200):
        cuts = sorted({0, len(rows), *rng.integers(0, len(rows), 4).tolist()})
        out = []
        for a, b in zip(cuts, cuts[1:]):
            mid = int(rng.integers(a, b + 1))
            out += [r for x in substrings._later(batch(rows[p:q]) for p, q in ((a, mid), (mid, b)) if q > p) for r in x.to_pylist()]
        got = {(r["hash"], r["check"], r["doc_id"], r["row"], r["at"]) for r in out if r["kind"] == 0}
        for r in (r for r in out if r["kind"] == 1):
            key = r["hash"], r["check"]
            first = min(x["doc_id"] for x in out if x["kind"] == 2 and (x["hash"], x["check"]) == key) if any(x["kind"] == 2 and (x["hash"], x["check"]) == key for x in out) else r["doc_id"]
            before = [x["at"] for x in out if x["kind"] == 3 and (x["hash"], x["check"], x["doc_id"], x["row"]) == (*key, r["doc_id"], r["row"])]
            if first < r["doc_id"] or before and min(before) < r["at"]:
                got.add((*key, r["doc_id"], r["row"], r["at"]))
        assert got == want
