"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a short notice or the opening of a license; as a set it has m distinct words. A block is
any stretch of WIDEN times as many words as the template has (the whole text if that is shorter). A block
and a template are joined when the block holds at least `least` = ceil(THRESHOLD * m) of the template's
words. All blocks of all texts are decided:

1. The words of all templates are counted over all documents (sums with map-side combining; as many rows
   as the templates have words reach the driver, a bound that no input changes) and ordered from
   rare to frequent. A template is the sequence of its words in that order.
2. Prefix filter: a joined block holds one of the template's m - least + 1 rarest words. An index from
   these words to templates finds the few texts that go on.
3. Length filter: such a text must hold `least` different words of the template.
4. Positional filter: if the rarest word that block and template share has position i in the
   template, the others have greater ones, so around that place there must be `least` places of words
   from position i on. Places that fail propose no block.
5. What is left is counted exactly: a word's place counts for the blocks that start after its previous
   place, so running sums give every block's number of different words.

Joined blocks that touch are one span. Where spans of templates of one family overlap (texts of one license
share most words with the next version's), those that hold most words, of these those of the shortest templates, stay; ties do too.

Everything happens inside the tasks that read the documents, twice; nothing but the counts is shuffled, and a
task holds one batch.

A null text is empty; texts without words give zeros, empty labels and nulls for the places. Very
long texts are scanned whole. Repeated rows are rows of their own; doc_id may be null. Columns other than
id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

THRESHOLD, WIDEN = 0.8, 1.25

# Phrases that decide a label wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Fixed values: (label, family, notice), as their publishers word them.
TEMPLATES = [
    ("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2", "gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", "gpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "gpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-2", "epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("cc-by", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "cc", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

#: Digits, small letters and bytes of other characters stay, capitals become small, all others separate words.
LETTERS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


@dataclass
class Template:
    label: str
    family: str
    words: list[bytes]
    #: The distinct words from rare to frequent, once `ordered` has been called.
    order: list[bytes] = field(default_factory=list)

    @property
    def width(self) -> int:
        return int(len(self.words) * WIDEN)

    def least(self, threshold: float) -> int:
        m = len(set(self.words))
        return max(1, -int(-threshold * m // 1))

    def ordered(self, frequency: dict[bytes, int]) -> Template:
        self.order = sorted(set(self.words), key=lambda w: (frequency.get(w, 0), w))
        return self


def templates(texts: list[tuple[str, str, str]]) -> list[Template]:
    return [Template(label, family, words_of(text)) for label, family, text in texts]


def frequencies(docs: DataFrame, found: list[Template], text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the templates stands."""
    vocabulary = frozenset(w for t in found for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(vocabulary.intersection(words_of(value.as_py())))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Index:
    """Templates by their rarest words, and the exact count of what these propose."""

    def __init__(self, found: list[Template], threshold: float):
        self.found, self.least = found, [t.least(threshold) for t in found]
        self.places = [{w: i for i, w in enumerate(t.order)} for t in found]
        self.prefixes = [len(t.order) - n + 1 for t, n in zip(found, self.least, strict=True)]
        self.by_word: dict[bytes, list[int]] = {}
        for k, t in enumerate(found):
            for w in t.order[: self.prefixes[k]]:
                self.by_word.setdefault(w, []).append(k)
        self.rare = frozenset(self.by_word)

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, start, stop, words held) of all joined blocks, those that touch as one with its best count."""
        met = self.rare.intersection(words)
        out = []
        for k in sorted({k for w in met for k in self.by_word[w]}):
            out += self.spans_of(k, words)
        return out

    def spans_of(self, k: int, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        where, least, n = self.places[k], self.least[k], len(words)
        width = min(self.found[k].width, n)
        both = [(p, where[w]) for p, w in enumerate(words) if w in where]
        at, rank = (np.array(x, "i8") for x in zip(*both, strict=True))
        if len(np.unique(rank)) < least:
            return []
        proposed = np.zeros(len(at), bool)
        low, high = np.searchsorted(at, at - width, "right"), np.searchsorted(at, at + width, "left")
        for i in range(self.prefixes[k]):
            here = np.flatnonzero(rank == i)
            upto = np.concatenate([[0], np.cumsum(rank >= i)])
            proposed[here] = upto[high[here]] - upto[low[here]] >= least
        if not proposed.any():
            return []
        last: dict[int, int] = {}
        change = np.zeros(n + 1, "i8")
        for p, r in zip(at.tolist(), rank.tolist(), strict=True):
            change[max(last.get(r, -1) + 1, p - width + 1)] += 1
            change[p + 1] -= 1
            last[r] = p
        held = np.cumsum(change)[: n - width + 1]
        joined = np.flatnonzero(held >= least)
        if not len(joined):
            return []
        cuts = np.flatnonzero(np.diff(joined) > width) + 1
        return [(k, int(run[0]), int(run[-1]) + width, int(held[run].max())) for run in np.split(joined, cuts)]

    def labelled(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, start, stop, containment): spans without those that lose to one of their family."""
        spans = self.spans(words)
        family = lambda x: self.found[x[0]].family
        rank = lambda x: (x[3], -len(self.found[x[0]].order))
        lost = {x for x in spans for y in spans if family(x) == family(y) and x[1] < y[2] and y[1] < x[2] and rank(y) > rank(x)}
        return sorted({(self.found[k].label, a, b, n / len(self.found[k].order)) for k, a, b, n in spans if (k, a, b, n) not in lost})


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(start, label) of all places where a phrase's words stand consecutively."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(b" " + phrase + b" ", at + 1)
    return sorted(out)


FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<label: string, start: bigint, stop: bigint, containment: double>>"


def licenses(docs: DataFrame, texts: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and FOUND of every document; blocks are the spans that templates label, in words from 0, stop excluded.

    score is the greatest part of a template's words that one block holds, 1 where a phrase stands, 0 without labels.
    """
    found = templates(texts)
    frequency = frequencies(docs, found, text)
    index = Index([t.ordered(frequency) for t in found], threshold)
    wanted = {b" ".join(words_of(p)): label for p, label in phrases.items()}
    names = [f.split()[0] for f in FOUND.split("blocks")[0].split(", ") if f] + ["blocks"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))]

    def row(value: str | None) -> tuple:
        words = words_of(value)
        base, blocks = phrase_places(words, wanted), index.labelled(words)
        own, every = {x[1] for x in base}, {x[1] for x in base} | {x[0] for x in blocks}
        score = 1.0 if base else max((x[3] for x in blocks), default=0.0)
        spans = [dict(zip(("label", "start", "stop", "containment"), x, strict=True)) for x in blocks]
        return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(every)), score, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(row(v.as_py()) for v in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
