"""Licence scan: a trained paragraph classifier confirmed by templates.

A paragraph is a line of text, and notices are sought in windows of about a
template's length along it, so what else the line holds does not count.  Sparse
word n-grams (words and word pairs of the training vocabulary, plus how much of the
window lies outside it) feed a multinomial logistic regression over licence families
and "none".  A temperature fitted on examples left out of training calibrates its
probabilities; a window that looks like a licence but like no known family is
"unknown".  A family counts only if the window also matches one of its templates.

A window begins with a word of its template and holds enough of the template's
words to match; sums along the text give the most that any family can gain over
"none" in it, and only windows where "none" can lose by that are evaluated in full.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import fold, utf8

NONE, UNKNOWN = "none", "unknown"

# --- fixed values: notices of the licence families -----------------------------
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
}
#: Licence-like paragraphs of no family: what "unknown" is calibrated on.
STRANGE = (
    "Licensed under the terms of the vendor agreement, version 7.",
    "This work is licensed under a custom licence, see the legal notice.",
    "All rights reserved. Use is subject to the licence terms of the publisher.",
    "Released under the house licence of the archive.",
    "Copyright by the author. Redistribution is not permitted without permission.",
)

#: Paragraphs of the corpus that "none" is learned from, at most.
SAMPLE = 1_500
LEAST_PROBABILITY = 0.5
#: Share of a template's words that a confirmed window shares in order.
LEAST_MATCH = 0.6
#: The same for a licence of no known family.
LEAST_LIKENESS = 0.5
_EPOCHS, _RATE, _DECAY = 6, 0.5, 1e-4

#: Letters and digits stay, A-Z lowered; other ASCII signs become blanks, lines stay.
_CLEAN = bytes(
    c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 or c == 10 else c + 32 if 65 <= c < 91 else 32 for c in range(256)
)


def words(paragraph: bytes) -> list[bytes]:
    return paragraph.translate(_CLEAN).split()


def places_of(template: list) -> dict:
    """Per word of a template the bits of its places."""
    places: dict = {}
    for n, word in enumerate(template):
        places[word] = places.get(word, 0) | 1 << n
    return places


def shared(places: dict, length: int, paragraph: list) -> int:
    """Words of the longest common subsequence; each clear bit of a row is one."""
    full = row = (1 << length) - 1
    for word in paragraph:
        here = row & places.get(word, 0)
        if here:
            row = ((row + here) | (row - here)) & full
    return length - row.bit_count()


def in_order(template: list[bytes], paragraph: list[bytes]) -> float:
    """Longest common subsequence as a share of the template's words."""
    return shared(places_of(template), len(template), paragraph) / max(len(template), 1)


class Form:
    """A template by word codes, and the lengths of the windows compared with it."""

    def __init__(self, number: int, codes: list[int], size: int):
        self.number, self.length, self.places = number, len(codes), places_of(codes)
        self.member = np.zeros(size, bool)
        self.member[codes] = True
        #: As it stands, and with other words in between.
        self.windows = (self.length, self.length + self.length // 4 + 2)


class LicenceModel:
    """Weights of words and word pairs per class; class 0 is "none"."""

    def __init__(self) -> None:
        self.classes = [NONE, *TEMPLATES, UNKNOWN]
        self.templates = {family: [words(t.encode()) for t in texts] for family, texts in TEMPLATES.items()}
        self.strange = [words(t.encode()) for t in STRANGE]
        self.codes: dict[bytes, int] = {}
        self.temperature = 1.0

    # Features of one paragraph: words 1..V, pairs V+1.., then outside share and bias.
    def _encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.array([self.codes.get(w, 0) for w in tokens], np.int64)
        size = len(self.codes) + 1
        pairs = codes[:-1] * size + codes[1:]
        pairs = pairs[(codes[:-1] > 0) & (codes[1:] > 0)]
        return codes, pairs

    def learn(self, plain: list[bytes], seed: int = 9) -> LicenceModel:
        rng = random.Random(seed)
        noise = [w for p in plain for w in words(p)] or [b"lorem", b"ipsum"]
        positives: list[tuple[list[bytes], int]] = []
        for number, family in enumerate(self.classes):
            for template in self.templates.get(family, [words(t.encode()) for t in STRANGE] if family == UNKNOWN else []):
                positives.append((template, number))
                for _ in range(24):
                    body = [w for w in template if rng.random() > 0.08]
                    head = [rng.choice(noise) for _ in range(rng.choice((0, 0, 2, 5)))]
                    tail = [rng.choice(noise) for _ in range(rng.choice((0, 0, 2, 5)))]
                    positives.append((head + body + tail, number))
        counted = Counter(w for t, _ in positives for w in set(t))
        template_words = {w for texts in self.templates.values() for t in texts for w in t}
        template_words |= {w for t in STRANGE for w in words(t.encode())}
        self.codes = {w: n for n, w in enumerate(sorted(w for w in counted if w in template_words), 1)}
        examples = positives + [(words(p), 0) for p in plain]
        # Windows of plain lines, as the scan cuts them.
        longest = max(len(t) for t, _ in positives)
        for body in (words(p) for p in plain):
            if len(body) > 4:
                start = rng.randrange(len(body) - 3)
                examples.append((body[start : start + rng.randint(4, longest)], 0))
        # Pieces of templates' common words are not licences.
        common = sorted(template_words)
        examples += [([rng.choice(common) for _ in range(rng.randint(1, 12))], 0) for _ in range(400)]
        examples += [([w] * rng.randint(1, 3), 0) for w in common for _ in range(3)]
        examples += [([rng.choice(common), rng.choice(noise)], 0) for _ in range(400)]
        rng.shuffle(examples)
        held = len(examples) // 5
        size, k = len(self.codes) + 1, len(self.classes)
        self.word_weights = np.zeros((size, k))
        self.pair_weights: dict[int, np.ndarray] = {}
        self.bias = np.zeros(k)
        encoded = [(*self._encode(t), y) for t, y in examples if t]
        order = list(range(held, len(encoded)))
        for epoch in range(_EPOCHS):
            rng.shuffle(order)
            pace = _RATE / (1 + epoch)
            for n in order:
                codes, pairs, y = encoded[n]
                share = 1 / len(codes)
                z = self._logits(codes, pairs)
                p = np.exp(z - z.max())
                error = p / p.sum()
                error[y] -= 1
                if np.abs(error).max() < 1e-3:
                    continue
                np.subtract.at(self.word_weights, codes, pace * share * 8 * error)
                for pair in pairs.tolist():
                    self.pair_weights[pair] = self.pair_weights.get(pair, np.zeros(k)) * (1 - _DECAY) - pace * share * 8 * error
                self.bias -= pace * 0.1 * error
        self._calibrate(encoded[:held])
        texts = [(n, t) for n, f in enumerate(self.classes) for t in (self.strange if f == UNKNOWN else self.templates.get(f, ()))]
        self.forms = [Form(n, [self.codes[w] for w in t], size) for n, t in texts]
        self.most = self.gains()
        return self

    def _logits(self, codes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        # Means over the paragraph's words, scaled: long and short notices are alike.
        z = self.word_weights[codes].sum(axis=0)
        for pair in pairs.tolist():
            found = self.pair_weights.get(pair)
            if found is not None:
                z = z + found
        return self.bias + 8 * z / max(len(codes), 1)

    def _calibrate(self, held: list[tuple]) -> None:
        """The temperature that gives the examples left out the largest likelihood."""

        def loss(t: float) -> float:
            total = 0.0
            for codes, pairs, y in held:
                z = self._logits(codes, pairs) / t
                total -= z[y] - z.max() - np.log(np.exp(z - z.max()).sum())
            return total

        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.5), key=loss) if held else 1.0

    def gains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Most that a word, a pair (sorted keys, values) and the bias give any class over "none"."""
        word = (self.word_weights[:, 1:] - self.word_weights[:, :1]).max(axis=1)
        keys = np.array(sorted(self.pair_weights), np.int64)
        pair = np.array([(self.pair_weights[k][1:] - self.pair_weights[k][0]).max() for k in keys.tolist()])
        return word, keys, pair, float((self.bias[1:] - self.bias[0]).max())

    def _windows(self, codes: np.ndarray, stops: tuple[np.ndarray, ...]) -> Iterator[tuple[Form, int, int]]:
        """Windows (first word, behind the last) that may be a notice of the form."""
        word, keys, pair, bias = self.most
        gain = np.r_[0.0, np.cumsum(word[codes])]
        joined = codes[:-1] * (len(self.codes) + 1) + codes[1:]
        value = np.zeros(len(joined))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, joined), len(keys) - 1)
            known = (keys[at] == joined) & (codes[:-1] > 0) & (codes[1:] > 0)
            value[known] = pair[at[known]]
        both = np.r_[0.0, np.cumsum(value)]
        # Below it no sum of the families' odds reaches 1; sums along the text are rounded.
        least_gain = -self.temperature * np.log(len(self.classes) - 1) - 1e-6
        for form in self.forms:
            member = form.member[codes]
            seen = np.r_[0, np.cumsum(member)]
            starts = np.flatnonzero(member)
            least, tried = LEAST_LIKENESS * form.length, []
            for length in form.windows:
                for stop in stops:
                    ends = np.minimum(starts + length, stop[starts])
                    rich = np.flatnonzero(seen[ends] - seen[starts] >= least)
                    i, e = starts[rich], ends[rich]
                    bound = bias + 8 * (gain[e] - gain[i] + both[e - 1] - both[i]) / (e - i)
                    tried.append(np.stack((i, e))[:, bound > least_gain])
            for i, e in np.unique(np.concatenate(tried, axis=1), axis=1).T.tolist():
                yield form, i, e

    def notices(self, codes: np.ndarray, *stops: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Notices among words: first word, behind the last, family, probability.

        ``stops`` has for each word where a window that begins there must end.
        Known families come before "unknown", then more shared words less the
        template's others, then the larger probability; a notice takes its words from those after it.
        """
        if not len(codes):
            return []
        text, judged, hits = codes.tolist(), {}, []
        for form, i, e in self._windows(codes, stops):
            common = shared(form.places, form.length, text[i:e])
            if common < LEAST_LIKENESS * form.length:
                continue
            if (i, e) not in judged:
                judged[i, e] = self._probabilities(codes[i:e])
            p = judged[i, e]
            if p[0] >= LEAST_PROBABILITY:
                continue
            best = 1 + int(np.argmax(p[1:-1]))
            if best == form.number and p[best] >= LEAST_PROBABILITY and common >= LEAST_MATCH * form.length:
                hits.append((False, form.length - 2 * common, -float(p[best]), i, e, self.classes[best], form))
            else:
                hits.append((True, form.length - 2 * common, -float(1 - p[0]), i, e, UNKNOWN, form))
        hits.sort(key=lambda h: h[:6])
        taken, found = np.zeros(len(codes), bool), []
        for strange, _, p, i, e, family, form in hits:
            if taken[i]:
                continue
            if taken[i:e].any():
                e = i + int(np.argmax(taken[i:e]))
            common = shared(form.places, form.length, text[i:e])
            if common < (LEAST_LIKENESS if strange else LEAST_MATCH) * form.length:
                continue
            # Words at the ends that match nothing are not the notice's.
            while shared(form.places, form.length, text[i : e - 1]) == common:
                e -= 1
            while shared(form.places, form.length, text[i + 1 : e]) == common:
                i += 1
            taken[i:e] = True
            found.append((i, e, family, -p))
        return found

    def _probabilities(self, codes: np.ndarray) -> np.ndarray:
        pairs = codes[:-1] * (len(self.codes) + 1) + codes[1:]
        z = self._logits(codes, pairs[(codes[:-1] > 0) & (codes[1:] > 0)]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def verdict(self, tokens: list[bytes]) -> tuple[str, float]:
        """Family, "unknown" or "none", with the calibrated probability."""
        if not tokens:
            return NONE, 1.0
        codes = self._encode(tokens)[0]
        found = self.notices(codes, np.full(len(codes), len(codes)))
        return found[0][2:] if found else (NONE, float(self._probabilities(codes)[0]))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> LicenceModel:
    """Learn from the templates and at most ``sample`` paragraphs of the corpus.

    One paragraph of each of the first documents by the id's crc32; paragraphs that
    name a licence teach nothing about "none".
    """
    lines = F.split(F.col(text).cast("string"), "\n")
    middle = F.get(lines, F.floor(F.size(lines) / 2).cast("int"))
    rows = docs.select(fold(key).alias("_order"), F.col(key).alias("_id"), F.substring(middle, 1, 2000).alias("_line"))
    plain = rows.where("_id is not null and _line is not null").where(~F.lower("_line").rlike("licen|copyright|spdx"))
    # Ids first, so that only the sample's lines leave the executors.
    chosen = plain.select("_order", "_id").distinct().orderBy("_order", "_id").limit(sample).select("_id")
    found = plain.join(F.broadcast(chosen), "_id").select("_line").collect()
    return LicenceModel().learn(sorted(r[0].encode() for r in found))


RESULT = "doc_id long, paragraphs long, licence_paragraphs long, unknown_paragraphs long, families string, places string"


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


#: Words that are scanned at once, of whole texts.
_AT_ONCE = 100_000


def _scan(model: LicenceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Codes(model.codes).__getitem__
        rows: list[tuple] = []
        codes, lines, owners, blocks = [], [], [], []  # of each word, but for owners of each row

        def flush() -> pa.RecordBatch:
            flat, line = np.array(codes, np.int64), np.array(lines, np.int64)
            found: list[set] = [set() for _ in rows]
            firsts = np.cumsum([0, *(r[2] for r in rows)])
            for i, _, family, _ in model.notices(flat, *_stops(flat, line, np.array(blocks, np.int64))):
                row = int(np.searchsorted(firsts, i, side="right")) - 1
                found[row].add((int(line[i]) - owners[row], family))
            out = []
            for (key, paragraphs, _), places in zip(rows, map(sorted, found)):
                known = sorted({f for _, f in places if f != UNKNOWN})
                strange = sum(f == UNKNOWN for _, f in places)
                out.append((key, paragraphs, len(places), strange, ",".join(known), ",".join(f"{f}:{n}" for n, f in places)))
            columns = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=[part.split()[0] for part in RESULT.split(", ")]
            )

        for batch in batches:
            above = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                split = [line.split() for line in text.translate(_CLEAN).split(b"\n")]
                before = len(codes)
                block = above
                for n, line in enumerate(split):
                    block = block if line else above + n + 1
                    codes.extend(map(look, line))
                    lines.extend([above + n] * len(line))
                    blocks.extend([block] * len(line))
                rows.append((key, sum(map(bool, split)), len(codes) - before))
                owners.append(above)
                above += len(split)
                if len(codes) >= _AT_ONCE:
                    yield flush()
                    for held in (rows, codes, lines, owners, blocks):
                        held.clear()
            yield flush()
            for held in (rows, codes, lines, owners, blocks):
                held.clear()

    return run


def _stops(codes: np.ndarray, *parts: np.ndarray) -> list[np.ndarray]:
    """Per kind of part the end of the part that each word is in."""
    out = []
    for part in parts:
        ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(codes)]
        out.append(ends[np.searchsorted(ends, np.arange(len(codes)), side="right")] if len(codes) else ends[:0])
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", model: LicenceModel | None = None) -> DataFrame:
    """One row per document: its paragraphs, those that are licences, the families.

    ``places`` lists ``family:line`` (the line a notice begins in, from 0) in text
    order, "unknown" included, a family once per line; ``licence_paragraphs`` counts
    them.  Blank lines are no paragraphs; a null or empty text has none.  Equal
    probabilities go to the family listed first.  Repeated rows are each reported,
    a null id stays null, texts are read whole.  An empty table gives an empty
    result; other columns are not read.
    """
    model = model or train(docs, text, key)
    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("body")).mapInArrow(_scan(model), RESULT)
