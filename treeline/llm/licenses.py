"""License scans: phrases, and an exact set-similarity join against license templates.

Base: places where the words of a phrase stand one after the other.

Method: a template contains its distinct words; a text block matches when it
has at least the share ``threshold`` of them. A block is any run of consecutive
words of one text, ``SLACK`` times as long as the template, whatever line feeds
lie within it: notices are found however they are wrapped, and words scattered
over a longer stretch are no notice. The join finds every such block without
looking at most of them:

* Words are ordered by their frequency over all documents, rarest first (one
  counting scan; only template words are counted, a fixed number).
* Prefix filter: a block with ``need = ceil(threshold * |T|)`` words of template
  T must have one of T's ``|T| - need + 1`` rarest, so only words less than a
  block away from such a word are looked at.
* Candidates are verified by counting the shared words of the block that starts
  at each template word: an occurrence counts for the starts after the previous
  occurrence of its word, so one sorted pass counts all blocks at once.
* Blocks that overlap are one notice, given once: the one with the most shared
  words, of these the one that ends first, of these the shortest.

Shared words alone do not tell the templates of a family apart (GPL and LGPL,
the Creative Commons licenses, "Released under the ... License"). A block gets a
label only if it also has the phrases of ``REQUIRED`` for it, word after word.
The grant of MIT opens the NCSA license too, and the sentence of ``bsd-3`` opens
every BSD license; there the label says no more than the sentence does.

Both scans read the documents where they lie; only the word counts are
shuffled. Templates are a parameter of fixed size and travel with the tasks.

Defined results: null and empty texts have no words and no labels (empty
strings, score 0). Labels are distinct, sorted and joined by commas. The score
is 1 with a base label, else the largest containment of a matching block, else
0. The line of a notice is that of its first template word. Texts without words
match nothing; an empty template is refused. Every row is judged
for itself, repeated rows and null ids included. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import each_batch
from treeline.llm.words import slices, text_bytes, words

# Fixed phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public notices of common licenses and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file "
                 "except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under "
              "the terms of the GNU General Public License, version 3"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, "
              "are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                 "International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                 "International License"),
)
THRESHOLD = 0.8
# Words of a block for each word of its template.
SLACK = 1.5

_THIRD = ("version 3", "license 3", "license v3", "license gpl v3", "license lgpl v3")
# For each label: of every group of phrases, a block must have one.
REQUIRED = {
    "mit": (("mit license", "mit licence", "under the mit", "under mit",
             "associated documentation files"),),
    "apache-2": (("apache license version 2", "apache license 2", "apache license v2",
                  "apache 2"),),
    "gpl-3": (("gnu general public license",), _THIRD),
    "lgpl-3": (("lesser general public license",), _THIRD),
    "mpl-2": (("mozilla public license",),),
    "cc-by-nc": (tuple(f"{name} {v}" for v in (4, 3, 2, 1) for name in
                       ("by nc", "attribution noncommercial", "attribution non commercial")),),
    "cc-by-sa": (tuple(f"{name} {v}" for v in (4, 3, 2, 1) for name in
                       ("by sa", "attribution sharealike", "attribution share alike")),),
}

DIGEST = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")
BLOCKS = ("doc_id long, line long, template int, label string, shared int, "
          "containment double")


def _word_hashes(text: str) -> np.ndarray:
    buf, offsets = text_bytes(pa.array([text], pa.large_string()))
    return words(buf, offsets)[0]


class Join:
    """Templates with their words in the global order, and an index of their prefixes."""

    def __init__(self, templates, threshold: float, counts: dict[int, int] | None = None,
                 required: dict | None = None):
        self.threshold = threshold
        self.labels = [label for label, _ in templates]
        sets = [np.unique(_word_hashes(text)) for _, text in templates]
        if any(len(s) == 0 for s in sets):
            raise ValueError("a template without words")
        self.tokens = np.unique(np.concatenate(sets))
        count = np.array([(counts or {}).get(int(t), 0) for t in self.tokens.view(np.int64)])
        rank = np.empty(len(self.tokens), np.int64)
        rank[np.lexsort((self.tokens, count))] = np.arange(len(self.tokens))
        self.rank = rank
        self.ordered = [np.sort(rank[np.searchsorted(self.tokens, s)]) for s in sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ranks in enumerate(self.ordered):
            for i, r in enumerate(ranks[:len(ranks) - self.need[t] + 1].tolist()):
                self.index[r].append((t, i))
        self.rare = np.sort(self.tokens[np.isin(rank, list(self.index))])
        self.sizes = [math.ceil(SLACK * len(_word_hashes(text))) for _, text in templates]
        self.required = {label: [[_word_hashes(p) for p in group] for group in groups]
                         for label, groups in (required or {}).items()}

    def notices(self, h: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, template, shared words) of the notices in the words ``h`` of texts
        that end before the words ``ends``."""
        near = _around(_found(h, self.rare), max(self.sizes), len(h))
        if not len(near):
            return []
        at = near[_found(h[near], self.tokens)]
        rank = self.rank[np.searchsorted(self.tokens, h[at])]
        phrases: dict[int, list] = {}
        found = []
        for t, ranks in enumerate(self.ordered):
            need, size = self.need[t], self.sizes[t]
            own = np.isin(rank, ranks)
            p, r = at[own], rank[own]
            rare = p[np.isin(r, ranks[:len(ranks) - need + 1])]
            keep = np.isin(p, _around(rare, size, len(h)))
            p, r = p[keep], r[keep]
            if len(p) < need:
                continue
            # The previous occurrence of each word, and the first start a word counts for.
            order = np.lexsort((p, r))
            before = np.full(len(p), -1)
            again = r[order][1:] == r[order][:-1]
            before[order[1:][again]] = p[order[:-1][again]]
            row = np.searchsorted(ends, p, side="right")
            first = np.where(row > 0, ends[row - 1], 0)
            lower = np.sort(np.maximum(np.maximum(before + 1, p - size + 1), first))
            shared = np.searchsorted(lower, p, side="right") - np.arange(len(p))
            good = np.flatnonzero(shared >= need)
            stop = np.minimum(p[good] + size, ends[row[good]])
            for group in self.required.get(self.labels[t], ()):
                has = np.zeros(len(good), bool)
                for phrase in group:
                    places = phrases.get(id(phrase))
                    if places is None:
                        places = phrases[id(phrase)] = _places(h, near, phrase)
                    if len(places):
                        k = np.searchsorted(places, p[good])
                        has |= (k < len(places)) & \
                            (places[np.minimum(k, len(places) - 1)] + len(phrase) <= stop)
                good, stop = good[has], stop[has]
            # The last word a block needs: the last that does not repeat within it.
            last = np.searchsorted(p, stop) - 1
            while True:
                repeats = before[last] >= p[good]
                if not repeats.any():
                    break
                last[repeats] -= 1
            found += [(a, t, n) for a, n in
                      _apart(p[good].tolist(), p[last].tolist(), shared[good].tolist())]
        return sorted(found)

    def matches(self, block: np.ndarray) -> list[tuple[int, int]]:
        """(template, shared words) of the templates whose words a given block contains."""
        distinct = np.unique(block)
        at = np.searchsorted(self.tokens, distinct)
        at[at == len(self.tokens)] = 0
        own = np.sort(self.rank[at[self.tokens[at] == distinct]])
        checked, found = set(), []
        for j, r in enumerate(own.tolist()):
            for t, i in self.index.get(r, ()):
                need, size = self.need[t], len(self.ordered[t])
                if t in checked or len(distinct) < need:
                    continue
                # The first common word of both orders: nothing before it is shared.
                checked.add(t)
                if 1 + min(size - i - 1, len(own) - j - 1) < need:
                    continue
                shared = len(np.intersect1d(own, self.ordered[t], assume_unique=True))
                if shared >= need:
                    found.append((t, shared))
        return found


def _found(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the words of ``h`` that are in sorted ``wanted``."""
    if not len(h) or not len(wanted):
        return np.zeros(0, np.int64)
    door = np.zeros(1 << 16, bool)
    door[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(door[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(wanted, h[maybe])
    at[at == len(wanted)] = 0
    return maybe[wanted[at] == h[maybe]]


def _around(at: np.ndarray, size: int, total: int) -> np.ndarray:
    """Sorted positions less than ``size`` away from one of the sorted positions ``at``."""
    if not len(at):
        return at
    new = np.flatnonzero(np.diff(at) >= 2 * size - 1) + 1
    a = np.maximum(at[np.concatenate([[0], new])] - size + 1, 0)
    z = np.minimum(at[np.concatenate([new - 1, [len(at) - 1]])] + size, total)
    spans = z - a
    return np.arange(spans.sum()) + np.repeat(a - (np.cumsum(spans) - spans), spans)


def _places(h: np.ndarray, near: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions of ``near`` at which the words of the phrase start."""
    at = near[h[near] == phrase[0]]
    at = at[at + len(phrase) <= len(h)]
    for w in range(1, len(phrase)):
        at = at[h[at + w] == phrase[w]]
    return at


def _apart(starts: list[int], lasts: list[int], shared: list[int]) -> list[tuple[int, int]]:
    """(start, shared) of the best of each group of overlapping blocks, sorted by start."""
    out, i = [], 0
    while i < len(starts):
        best, j = i, i
        while j < len(starts) and starts[j] <= lasts[best]:
            if (shared[j], -lasts[j], starts[j]) > (shared[best], -lasts[best], starts[best]):
                best = j
            j += 1
        out.append((starts[best], shared[best]))
        i = j
    return out


def word_counts(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """How often each template word stands in all documents (at most the templates' words)."""
    tokens = Join(templates, 1.0).tokens

    def count(batches):
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                h, _ = words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                at = np.searchsorted(tokens, h[_found(h, tokens)])
                total += np.bincount(at, minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(total)],
                                         names=["token", "n"])

    rows = (each_batch(docs.select(F.col("text").cast("string").alias("text")), count,
                       "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect())
    return {r.token: r.n for r in rows}


def _scan(column, join: Join, phrases):
    """Per slice: (first row, word counts, base hits [(row, word, label)], block hits
    [(row, line, template, shared)])."""
    coded = [(_word_hashes(p), label) for p, label in phrases]
    buf, offsets = text_bytes(column)
    for i, j in slices(offsets):
        part, own = buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        h, c, where = words(part, own, places=True)
        ends = np.cumsum(c)
        base = []
        for phrase, label in coded:
            k = len(phrase)
            at = np.flatnonzero(h[:max(0, len(h) - k + 1)] == phrase[0])
            for w in range(1, k):
                at = at[h[at + w] == phrase[w]]
            row = np.searchsorted(ends, at, side="right")
            same = np.searchsorted(ends, at + k - 1, side="right") == row
            base += [(int(r), int(a - ends[r] + c[r]), label) for r, a in zip(row[same], at[same])]
        blocks = []
        notices = join.notices(h, ends)
        if notices:
            feeds = np.flatnonzero(part == 10)
            for a, t, shared in notices:
                r = int(np.searchsorted(ends, a, side="right"))
                first, last = np.searchsorted(feeds, [own[r], where[a]])
                blocks.append((r, int(last - first), t, shared))
        yield i, c, base, blocks


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def matching_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
                    required=REQUIRED) -> DataFrame:
    """(doc_id, line, template, label, shared, containment) of every notice."""
    join = Join(templates, threshold, word_counts(docs, templates), required)

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, _, _, blocks in _scan(batch.column("text"), join, ()):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([i + r for r, _, _, _ in blocks], pa.int64())),
                     pa.array([line for _, line, _, _ in blocks], pa.int64()),
                     pa.array([t for _, _, t, _ in blocks], pa.int32()),
                     pa.array([join.labels[t] for _, _, t, _ in blocks], pa.string()),
                     pa.array([s for _, _, _, s in blocks], pa.int32()),
                     pa.array([s / len(join.ordered[t]) for _, _, t, s in blocks], pa.float64())],
                    names=["doc_id", "line", "template", "label", "shared", "containment"])

    return each_batch(_source(docs), scan, BLOCKS)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES,
                  threshold: float = THRESHOLD, required=REQUIRED) -> DataFrame:
    """One row per row of ``docs``: word count, base places and labels, all labels, score."""
    join = Join(templates, threshold, word_counts(docs, templates), required)

    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, c, base, blocks in _scan(batch.column("text"), join, phrases):
                n = len(c)
                places: list[list[int]] = [[] for _ in range(n)]
                by_phrase: list[set[str]] = [set() for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                score = np.zeros(n)
                for r, t, shared in ((b[0], b[2], b[3]) for b in blocks):
                    labels[r].add(join.labels[t])
                    score[r] = max(score[r], shared / len(join.ordered[t]))
                for r, word, label in base:
                    places[r].append(word)
                    by_phrase[r].add(label)
                    score[r] = 1.0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), pa.array(c.astype(np.int64)),
                     pa.array([len(p) for p in places], pa.int64()),
                     pa.array([min(p) if p else None for p in places], pa.int64()),
                     pa.array([max(p) if p else None for p in places], pa.int64()),
                     pa.array([",".join(sorted(b)) for b in by_phrase], pa.string()),
                     pa.array([",".join(sorted(a | b)) for a, b in zip(labels, by_phrase)],
                              pa.string()), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word",
                           "base_labels", "labels", "score"])

    return each_batch(_source(docs), scan, DIGEST)
