"""License scans by patience alignment of template and text words."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import Words, steps

COVERAGE = 0.8
# Wording of common public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts, lower=True, letters=True)
    return w.hashes(), w.first


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    tops, at, back = [], [], [-1] * len(values)
    for n, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(n)
        else:
            tops[k], at[k] = v, n
        back[n] = at[k - 1] if k else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(n)
        n = back[n]
    return out[::-1]


def align(template: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Matched (template place, text place) pairs, rising in both.

    Words that occur once in each part are anchors; the longest rising run of them is kept and the gaps between
    are aligned in the same way. A gap without anchors matches its equal head and tail. Gaps wait on a list, so depth is no limit.
    """
    out, todo = [], [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        u, at_u, n_u = np.unique(template[a:b], return_index=True, return_counts=True)
        here = text[c:d]
        mine = np.flatnonzero(np.isin(here, u[n_u == 1]))
        v, at_v, n_v = np.unique(here[mine], return_index=True, return_counts=True)
        once = n_v == 1
        pairs = sorted(zip((at_u[np.searchsorted(u, v[once])] + a).tolist(), (mine[at_v[once]] + c).tolist()))
        if not pairs:
            continue
        pairs = [pairs[n] for n in longest_rising([p[1] for p in pairs])]
        last = (a - 1, c - 1)
        for p in pairs:
            out.append(p)
            todo.append((last[0] + 1, p[0], last[1] + 1, p[1]))
            last = p
        todo.append((last[0] + 1, b, last[1] + 1, d))
    return sorted(out)


def densest(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The run of matches with the most words, parted where the text between two matches is longer than the template."""
    runs, now = [], []
    for p in pairs:
        if now and p[1] - now[-1][1] > size:
            runs.append(now)
            now = []
        now.append(p)
    return max([*runs, now], key=len)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, license, coverage, first_word, n_words, matched) of every template found in a text.

    Words are lower-cased (A-Z) and parted by white space and ASCII punctuation. Found: at least ``coverage`` of the template's
    words in one dense run. So few words may be missing that one of a template's seeds (its longest words, one more than may be missing) must
    stand in the text; each seed is aligned in windows around one copy, from tight to as wide as the template on both sides,
    then all that lies between found copies at once. So a template can be found several times, also in a row. Equal or nested templates are all
    reported. Templates are a parameter, held by every task. A null or empty text holds nothing; a null id stays null;
    repeated rows are scanned one by one; an empty table gives an empty table.
    """
    named = sorted((templates or TEMPLATES).items())

    def run(batches):
        hashes, first = _words(pa.array([t for _, t in named], pa.string()))
        parts = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        seeds = [_seeds(named[k][1], p, coverage) for k, p in enumerate(parts)]
        for batch in steps(batches, "t"):
            words, bounds = _words(batch.column("t"))
            every = np.unique(words)
            rows = []
            for k, seed in enumerate(seeds):
                if len(seed) and np.isin(parts[k][seed], every).any():
                    at = np.flatnonzero(np.isin(words, parts[k][seed]))
                    rows += _found(words, bounds, at, parts[k], k, coverage)
            if rows:
                who, kinds, shares, starts, sizes, matched = zip(*sorted(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").take(pa.array(who)), pa.array([named[k][0] for k in kinds]), pa.array(shares, pa.float64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(matched, pa.int32())],
                    ["i", "license", "coverage", "first_word", "n_words", "matched"])

    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, license string, coverage double, first_word int, n_words int, matched int").withColumnRenamed("i", id)


def _need(size: int, coverage: float) -> int:
    """Fewest matched words that are found."""
    return max(1, int(np.ceil(coverage * size - 1e-9)))


def _seeds(text: str, template: np.ndarray, coverage: float) -> np.ndarray:
    """Places of the longest words of a template, one more than may be missing."""
    w = Words(pa.array([text], pa.string()), lower=True, letters=True)
    return np.argsort(w.start - w.end, kind="stable")[:len(template) - _need(len(template), coverage) + 1] if len(template) else np.zeros(0, np.int64)


def _found(words, bounds, at, template, k, coverage):
    size, out, n = len(template), [], 0
    need = _need(size, coverage)
    owner = np.searchsorted(bounds, at, "right") - 1
    lo, hi = np.maximum(at - 2 * size, bounds[owner]), np.minimum(at + 2 * size, bounds[owner + 1])
    known = np.concatenate([[0], np.cumsum(np.isin(words, template))])
    names, most = np.unique(template, return_counts=True)
    places = {w: np.flatnonzero(template == w) for w in names.tolist()}

    def enough(a: int, b: int) -> bool:
        """Whether the words of a window can hold the template, in any order."""
        if known[b] - known[a] < need:
            return False
        here = words[a:b]
        place = np.searchsorted(names, here)
        place = place[names[np.minimum(place, len(names) - 1)] == here]
        return int(np.minimum(np.bincount(place, minlength=len(names)), most).sum()) >= need

    def best(a: int, b: int) -> list[tuple[int, int]]:
        run = densest(align(template, words[a:b]), size) if b > a and enough(a, b) else []
        return [(p, q + a) for p, q in run] if len(run) >= need else []

    while n < len(at):
        a, b, t, first = int(lo[n]), int(hi[n]), owner[n], n
        while n + 1 < len(at) and owner[n + 1] == t and lo[n + 1] <= b:
            n += 1
            b = int(hi[n])
        n += 1
        if not enough(a, b):
            continue
        runs, done = [], a
        for s in at[first:n].tolist():
            if s < done or not enough(max(done, s - 2 * size), min(b, s + 2 * size)):
                continue
            tries = []
            for slack in (0, size - need + 1, size):
                for p in places[int(words[s])].tolist():
                    tries.append(best(max(done, s - p - slack), min(b, s - p + size + slack)))
                if len(max(tries, key=len)) == size:
                    break
            # many words of the template in a short stretch, so that no run takes words of two copies
            run = max(tries, key=lambda r: (bool(r), 2 * len(r) - (r[-1][1] + 1 - r[0][1] if r else 0), len(r)))
            if run:
                runs.append(run)
                done = run[-1][1] + 1
        # what lies between the copies, for copies with long gaps
        ends = [(a, a), *[(r[0][1], r[-1][1] + 1) for r in runs], (b, b)]
        rest = [(x[1], y[0]) for x, y in zip(ends[:-1], ends[1:])]
        while rest:
            c, d = rest.pop()
            run = best(c, d)
            if run:
                runs.append(run)
                rest += [(c, run[0][1]), (run[-1][1] + 1, d)]
        out += [(int(t), k, len(r) / size, r[0][1] - int(bounds[t]), r[-1][1] + 1 - r[0][1], len(r)) for r in runs]
    return out
