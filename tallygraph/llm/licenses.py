"""License scans: exact set-containment join of text blocks with license templates.

A template's set T is its distinct words (runs of ASCII digits, lower-cased letters
and non-ASCII characters).  Its blocks are the runs of ``SPAN`` times its words in a
text, from any word on: blocks as long as the template, so that the words of a long
text do not add up by chance.  T is found in a block B where B holds ceil(threshold
* |T|) of its words, all of them if T has fewer than ``SHORT``, and every key word of
the template (the name that tells the license).

The join looks at chunks first, runs of twice the longest block that overlap by
half, so that each block lies in one.  Tokens have one global order, rarest first
by their count over the whole corpus.  A chunk that holds a block of T holds one of
the first |T| - need + 1 tokens of T (prefix filter) and at least need of the
templates' words (length filter), and, when its first match is T's token i, T has
need tokens from i on (positional filter).  What passes is verified exactly, block
by block.  Templates are a parameter of bounded size: at most ``MOST_TOKENS``
distinct tokens in all, so their index goes to every task.

Phrases (word sequences) are the base: every place in a text is counted, across
lines too.  A template's label joins the phrases' labels.

Defined cases: null and empty texts have no word, no label and score 0; a text of
any length is read whole; a template without words is never found; repeated rows
give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, words

#: Share of a template's words; templates that must be held whole; words of a block to a template's.
THRESHOLD, SHORT, SPAN = 0.8, 8, 1.5
MOST_TOKENS = 100_000

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Typical lines of license notices: label, line, key words.
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "software"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation", "lesser general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "software fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
]


def _hashes(texts: list[str]) -> list[np.ndarray]:
    w = words.Words(*words.buffer(pa.array(texts)), words.ALNUM_WORDS, True)
    h = w.hashes()
    return [h[a:b] for a, b in zip(w.first, w.first[1:])]


def frequencies(df: DataFrame, tokens: np.ndarray, text: str = "text") -> np.ndarray:
    """Corpus counts of the given sorted token hashes, over every text of df."""

    def work(batch: pa.RecordBatch) -> dict:
        h = words.Words(*words.buffer(batch.column(0)), words.ALNUM_WORDS, True).hashes()
        at = np.searchsorted(tokens, h)
        at = at[tokens[np.minimum(at, len(tokens) - 1)] == h]
        slot, n = np.unique(at, return_counts=True)
        return {"slot": pa.array(slot, pa.int64()), "n": pa.array(n, pa.int64())}

    got = common.fetch(common.arrow_map(df.select(F.col(text).alias("text")), "slot long, n long", "text", work).groupBy("slot").agg(F.sum("n").alias("n")))
    out = np.zeros(len(tokens), np.int64)
    out[got["slot"]] = got["n"]
    return out


class Index:
    """Templates as ranks in the global order: vocabulary, each template's ascending
    ranks, key ranks, least overlap and block length, and who has a rank in its prefix."""

    def __init__(self, templates: list[tuple], tokens: np.ndarray, counts: np.ndarray, threshold: float):
        order = np.lexsort((tokens, counts))
        self.tokens, self.rank = tokens, np.empty(len(tokens), np.int64)
        self.rank[order] = np.arange(len(tokens))
        words_of = _hashes([t[1] for t in templates])
        ranks = lambda h: np.unique(self.rank[np.searchsorted(tokens, h)])
        self.sets = [ranks(h) for h in words_of]
        self.keys = [ranks(h) for h in _hashes([t[2] if len(t) > 2 else "" for t in templates])]
        self.need = [need(len(s), threshold) for s in self.sets]
        self.span = [int(np.ceil(SPAN * len(h))) for h in words_of]
        self.chunk = max(self.span, default=1) or 1
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for i in range(len(s) - self.need[t] + 1 if len(s) else 0):
                self.prefix.setdefault(int(s[i]), []).append((t, i))
        self.starts = np.zeros(len(tokens), bool)
        self.starts[sorted(self.prefix)] = True

    def candidates(self, ranks: np.ndarray) -> list[int]:
        """Templates that a chunk of these ascending distinct ranks may hold."""
        tried: dict[int, bool] = {}
        for rank in ranks[self.starts[ranks]].tolist():
            for t, i in self.prefix[rank]:  # rarest first: i is this template's first match
                tried.setdefault(t, len(ranks) >= self.need[t] and len(self.sets[t]) - i >= self.need[t])
        return [t for t, fits in tried.items() if fits]

    def best(self, t: int, places: np.ndarray, ranks: np.ndarray) -> tuple[int, int] | None:
        """Most words of template t in one of its blocks that holds enough of it, and
        the first such block's first word of t; by words' places and ranks in order."""
        mine = np.isin(ranks, self.sets[t], assume_unique=False)
        at, rank = places[mine].tolist(), ranks[mine].tolist()
        if len(at) < self.need[t]:
            return None
        keys, span, out = set(self.keys[t].tolist()), self.span[t], None
        inside: dict[int, int] = {}
        hi = 0
        for lo in range(len(at)):
            while hi < len(at) and at[hi] < at[lo] + span:
                inside[rank[hi]] = inside.get(rank[hi], 0) + 1
                hi += 1
            if len(inside) >= self.need[t] and (out is None or len(inside) > out[0]) and keys <= inside.keys():
                out = len(inside), at[lo]
            inside[rank[lo]] -= 1
            if not inside[rank[lo]]:
                del inside[rank[lo]]
        return out


def need(size: int, threshold: float = THRESHOLD) -> int:
    """Words that a block must hold of a template of so many."""
    return size if size < SHORT else int(np.ceil(threshold * size - 1e-9))


def scan(df: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the
    largest containment found, 0 if none), matches: for each template found its number,
    containment and the first word that its first fullest block shares with it."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = [*_hashes([t[1] for t in templates]), *_hashes([t[2] for t in templates if len(t) > 2])]
    tokens = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"templates have {len(tokens)} tokens; at most {MOST_TOKENS} go to every task")
    index = Index(templates, tokens, frequencies(docs, tokens), threshold)
    wanted = [(h, label) for h, label in zip(_hashes(list(phrases)), phrases.values())]
    names = [t[0] for t in templates]

    def work(batch: pa.RecordBatch) -> dict:
        w = words.Words(*words.buffer(batch.column(1)), words.ALNUM_WORDS, True)
        h, n, first = w.hashes(), batch.num_rows, w.first
        doc = w.doc
        places, labels = [], [set() for _ in range(n)]
        for phrase, label in wanted:
            m = len(h) - len(phrase) + 1
            if m <= 0:
                continue
            at = np.flatnonzero(h[:m] == phrase[0])
            for i in range(1, len(phrase)):
                at = at[h[at + i] == phrase[i]]
            at = at[doc[at] == doc[at + len(phrase) - 1]]
            places.append(at)
            for d in np.unique(doc[at]):
                labels[d].add(label)
        at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
        count = np.bincount(doc[at], minlength=n)
        lo = np.searchsorted(doc[at], np.arange(n))
        has = count > 0
        start = np.where(has, at[np.minimum(lo, len(at) - 1)] - first[:-1], 0) if len(at) else np.zeros(n, np.int64)
        stop = np.where(has, at[np.minimum(lo + count - 1, len(at) - 1)] - first[:-1], 0) if len(at) else start
        base = [",".join(sorted(x)) for x in labels]
        score, found = np.zeros(n), [[] for _ in range(n)]
        slot = np.minimum(np.searchsorted(index.tokens, h), max(0, len(index.tokens) - 1))
        known = np.flatnonzero(index.tokens[slot] == h) if len(index.tokens) else np.zeros(0, np.int64)
        if len(known):
            owner, rank = doc[known], index.rank[slot[known]]
            local = known - first[owner]
            most = w.counts // index.chunk + 1  # chunks of each text
            chunk = local // index.chunk + (np.cumsum(most) - most)[owner]
            back = np.flatnonzero(local >= index.chunk)  # also in the chunk before
            of = np.concatenate([np.arange(len(known)), back])
            chunk = np.concatenate([chunk, chunk[back] - 1])
            order = np.lexsort((known[of], chunk))
            of, chunk = of[order], chunk[order]
            may = np.unique(chunk[index.starts[rank[of]]])
            edges = np.searchsorted(chunk, may), np.searchsorted(chunk, may, "right")
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for lo_, hi in zip(*edges):
                some = of[lo_:hi]
                for t in index.candidates(np.unique(rank[some])):
                    got, d = index.best(t, local[some], rank[some]), int(owner[some[0]])
                    if got and ((d, t) not in best or got[0] > best[d, t][0]):
                        best[d, t] = got
            for (d, t), (size, place) in sorted(best.items()):
                labels[d].add(names[t])
                score[d] = max(score[d], size / len(index.sets[t]))
                found[d].append({"template": t, "word": place, "containment": size / len(index.sets[t])})
        return {
            "doc_id": batch.column(0),
            "n_words": pa.array(w.counts, pa.int64()),
            "n_base": pa.array(count, pa.int64()),
            "first_word": pa.array(start, pa.int64(), mask=~has),
            "last_word": pa.array(stop, pa.int64(), mask=~has),
            "base_labels": pa.array(base),
            "labels": pa.array([",".join(sorted(x)) for x in labels]),
            "score": pa.array(score),
            "matches": pa.array(found, pa.list_(pa.struct([("template", pa.int32()), ("word", pa.int64()), ("containment", pa.float64())]))),
        }

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:int,word:bigint,containment:double>>"
    return common.arrow_map(docs, schema, "text", work)
