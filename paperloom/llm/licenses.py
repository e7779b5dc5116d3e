"""License scans by conditional compression.

A document's candidate blocks are the words around its license words, as far as a notice may reach. In
a block, the windows where a template may stand are those about its rarest word. A window's words,
lower-cased and with one space between, are compressed once alone and once with the template's as a
raw dictionary. Templates are ranked by the bytes that the dictionary saves, and a window goes on only
if it saves at least SAVES of the template's own size: one that holds the notice, with no more other
words than a notice may have, saves far more. What goes on is confirmed by exact wording: the words are
aligned, and what differs decides. Names, numbers and negations must be as in the template. A hole
({}) stands for up to HOLE words, such as the name of a holder. Of places that overlap the longer one
stays, of equal ones that of the higher rank. SPDX tags are read as expressions, every license of them.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FSF = "free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
_NAME = "endorse or promote products derived from this software without specific prior written permission"


def _named(*names: str) -> tuple[str, ...]:
    """The short notices of a license by name."""
    ways = ("Licensed under the {}", "Released under the {}", "distributed under the {}", "available under the {}", "under the terms of the {}")
    return tuple(way.format(name) for name in names for way in ways)


# Notices and telling sentences of well-known licenses, by SPDX identifier; [*] is a hole.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _FSF.format("Affero General Public License", "3"), "GNU AGPL v3", "AGPLv3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        *_named("Apache License 2.0", "Apache 2.0 License"), "Licensed under Apache 2.0", "Apache License Version 2.0, January 2004",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", *_named("BSD 2-Clause License")),
    "BSD-3-Clause": (
        f"Neither the name of [*] nor the names of its contributors may be used to {_NAME}", f"The name of [*] may not be used to {_NAME}",
        f"The names of [*] contributors may not be used to {_NAME}", *_named("BSD 3-Clause License"),
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _FSF.format("General Public License", "2"), "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _FSF.format("General Public License", "3"), "GNU GPL v3", "GPLv3"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", *_named("ISC License")),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", _FSF.format("Lesser General Public License", "2.1"), "GNU LGPL v2.1"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _FSF.format("Lesser General Public License", "3"), "GNU LGPL v3", "LGPLv3"),
    "MIT": (
        *_named("MIT License"), "MIT License Copyright",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", *_named("Mozilla Public License 2.0")),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: Words that a hole may stand for, at most; and the share of a template's bytes that a window must save.
HOLE, SAVES, SHORT = 12, 0.15, 60  # templates of fewer bytes than SHORT are always aligned
#: An SPDX tag is one more template of each license, with or without one of these endings.
TAG, ENDINGS = "SPDX-License-Identifier: {}", ("", "-only", "-or-later")
#: A notice that two licenses share stands for the first only where no sentence of the second follows within so many characters.
SHARED, FOLLOWS = {"BSD-2-Clause": "BSD-3-Clause"}, 2000
EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
TRIGGER = re.compile(r"licen[cs]e|free\s+software|released\s+under|hereby\s+granted|permission\s+is\s+hereby|public\s+domain|redistribution\s+and\s+use|neither\s+the\s+name|names?\s+of|SPDX|\b[AL]?GPL", re.IGNORECASE)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
# Words that may differ from a template without making it another license.
LOOSE = frozenset("a an and are as at be by file for in is it of on or released software source that the these this to under was with work works".split())

NEGATIONS = frozenset("isn't never no non not nor without".split())
SPELLINGS = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


class Finding(NamedTuple):
    license: str
    start: int  # code points into the text
    end: int
    saved: int  # bytes, of the place with up to 200 characters on either side
    differences: int  # words


class Part(NamedTuple):
    """The words of a template between two holes."""

    words: list[str]
    needed: frozenset[str]


class Template(NamedTuple):
    license: str
    words: list[str]
    needed: frozenset[str]
    with_it: zstandard.ZstdCompressor
    size: int  # bytes of its words, joined by spaces
    parts: list[Part]


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(SPELLINGS.get(w := m[0].lower(), w), m.start(), m.end()) for m in WORD.finditer(text)]


def every_text(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(license, text) of all templates, tags included."""
    return [(k, t) for k, texts in templates.items() for t in (*texts, *(TAG.format(k + ending) for ending in ENDINGS))]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, loose: float = 0.1, level: int = 3):
        self.alone = zstandard.ZstdCompressor(level=level)
        self.templates = []
        for key, text in every_text(templates):
            parts = [Part(p, frozenset(p) - LOOSE) for p in ([w for w, _, _ in words_of(t)] for t in text.split("[*]"))]
            words = [w for p in parts for w in p.words]
            plain = " ".join(words).encode()
            raw = zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append(Template(key, words, frozenset(words) - LOOSE, zstandard.ZstdCompressor(level=level, dict_data=raw), len(plain), parts))
        self.reach = 2 * max((len(t.words) for t in self.templates), default=0)  # words of a notice about a trigger, at most
        self.loose = loose
        self.known = set(templates)

    def ranked(self, block: str, templates: list[Template] | None = None) -> list[tuple[int, Template]]:
        """Templates by the bytes their dictionary saves in a block's words, largest first."""
        return self._ranked([w for w, _, _ in words_of(block)], self.templates if templates is None else templates)

    def _ranked(self, words: list[str], templates: list[Template]) -> list[tuple[int, Template]]:
        raw = " ".join(words).encode()
        base = len(self.alone.compress(raw))
        return sorted(((base - len(t.with_it.compress(raw)), t) for t in templates), key=lambda x: (-x[0], x[1].license))

    def candidate(self, words: list[str], template: Template) -> bool:
        """Whether a window saves enough under the template's dictionary to be aligned with it."""
        return template.size < SHORT or self._ranked(words, [template])[0][0] >= SAVES * template.size

    def confirmed(self, words: list[tuple[str, int, int]], index: dict[str, list[int]], template: Template) -> list[tuple[int, int, int]]:
        """(first word, word after the last, differing words) of the places that state the template:
        each part's places, and of these the first ones that follow on one another over holes."""
        chains = [(a, b, d) for a, b, d in self._places(words, index, template, template.parts[0])]
        for part in template.parts[1:]:
            places = self._places(words, index, template, part)
            starts = [a for a, _, _ in places]
            longer = []
            for begin, end, differ in chains:
                i = bisect_left(starts, end)
                if i < len(places) and starts[i] - end <= HOLE:
                    longer.append((begin, places[i][1], differ + places[i][2]))
            chains = longer
        return chains

    def _places(self, words: list[tuple[str, int, int]], index: dict[str, list[int]], template: Template, part: Part) -> list[tuple[int, int, int]]:
        """A part's places, from left to right.

        A place has all words that are not loose, so each is sought about the occurrences of the
        rarest of them: the part's words are aligned at the cheapest place near one, with free ends. A
        difference in a word that is not loose, or in more than a tenth of the words, is another wording.
        """
        out, at = [], 0
        near = len(part.words) + int(self.loose * len(part.words)) + 1
        whole = len(template.words) + int(self.loose * len(template.words)) + 1 + HOLE * (len(template.parts) - 1)
        for hit in min((index[w] for w in part.needed), key=len):
            if hit < at or not self.candidate([w for w, _, _ in words[max(0, hit - whole) : hit + whole + 1]], template):
                continue
            while hit >= at:
                lo, hi = max(at, hit - near), min(len(words), hit + near + 1)
                begin, end, cost = _best_place(part.words, [w for w, _, _ in words[lo:hi]])
                begin, end = lo + begin, lo + end
                if begin == end or cost > self.loose * len(part.words):
                    break
                there = [w for w, _, _ in words[begin:end]]
                differ = 0
                sound = not (begin and words[begin - 1][0] in NEGATIONS and part is template.parts[0])
                for kind, a, b, c, d in difflib.SequenceMatcher(None, part.words, there, autojunk=False).get_opcodes():
                    if kind != "equal":
                        differ += max(b - a, d - c)
                        sound &= LOOSE.issuperset(part.words[a:b]) and LOOSE.issuperset(there[c:d])
                if sound and differ <= self.loose * len(part.words):
                    out.append((begin, end, differ))
                at = end
        return out

    def block(self, text: str, words: list[tuple[str, int, int]]) -> list[Finding]:
        """Findings among the words of one block of the text."""
        index: dict[str, list[int]] = {}
        for i, (word, _, _) in enumerate(words):
            index.setdefault(word, []).append(i)
        found = []
        for template in (t for t in self.templates if all(w in index for w in t.needed)):
            for a, b, differ in self.confirmed(words, index, template):
                start, end = words[a][1], words[b - 1][2]
                found.append(Finding(template.license, start, end, self.ranked(text[max(0, start - 200) : end + 200], [template])[0][0], differ))
        return found

    def expressions(self, text: str) -> list[Finding]:
        """Every known license that an SPDX tag names besides its first; what follows WITH is none."""
        out = []
        for m in EXPRESSION.finditer(text):
            names = list(re.finditer(r"[A-Za-z0-9][A-Za-z0-9.+-]*", m[1]))
            plain = [re.sub(r"(-only|-or-later|\+)$", "", n[0]) for n in names]
            for i, (n, name) in enumerate(zip(names, plain, strict=True)):
                joined = not i or n[0].upper() in ("OR", "AND", "WITH") or names[i - 1][0].upper() in ("OR", "AND", "WITH")
                if not joined:
                    break  # the tag's line goes on with something else
                if i and names[i - 1][0].upper() in ("OR", "AND") and name in self.known:
                    out.append(Finding(name, m.start(1) + n.start(), m.start(1) + n.end(), 0, 0))
        return out

    def document(self, text: str) -> tuple[int, list[Finding]]:
        """Number of candidate blocks, and findings with places into the whole text."""
        if not TRIGGER.search(text):
            return 0, []
        words = words_of(text)
        starts = [a for _, a, _ in words]
        blocks: list[list[int]] = []
        for m in TRIGGER.finditer(text):
            lo = max(0, bisect_right(starts, m.start()) - 1 - self.reach)
            hi = min(len(words), bisect_left(starts, m.end()) + self.reach)
            if blocks and lo <= blocks[-1][1]:
                blocks[-1][1] = hi
            else:
                blocks.append([lo, hi])
        found = [f for lo, hi in blocks for f in self.block(text, words[lo:hi])] + self.expressions(text)
        kept: list[Finding] = []  # by place
        for f in sorted(found, key=lambda f: (f.start - f.end, -f.saved, f.license, f.start)):
            i = bisect_left(kept, f.start, key=lambda g: g.start)
            if (not i or kept[i - 1].end <= f.start) and (i == len(kept) or kept[i].start >= f.end):
                kept.insert(i, f)
        out = []
        for i, f in enumerate(kept):
            other, later = SHARED.get(f.license), i + 1
            while other and later < len(kept) and kept[later].start - f.end <= FOLLOWS and kept[later].license not in (other, f.license):
                later += 1
            if not (other and later < len(kept) and kept[later].license == other and kept[later].start - f.end <= FOLLOWS):
                out.append(f)
        return len(blocks), out


def _best_place(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """Bounds of the words whose edit distance to the template is least, the first such place, and
    that distance.

    One row a template word, all block words at once; free ends come from a zero first row.
    """
    n = len(words)
    ids = {w: i for i, w in enumerate(dict.fromkeys(template))}
    column = np.array([ids.get(w, -1) for w in words])
    at = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), at.copy()
    for word in template:
        up = cost + 1
        diagonal = cost[:-1] + (column != ids[word])
        best, start = up.copy(), origin.copy()
        better = diagonal <= best[1:]
        best[1:][better] = diagonal[better]
        start[1:][better] = origin[:-1][better]
        # insertions: the least cost so far, counting the steps from it
        reach = best - at
        least = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == least, at, 0))
        cost, origin = least + at, start[source]
    end = int(cost.argmin())
    return int(origin[end]), end, int(cost[end])


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, n_blocks, n_findings, licenses (identifiers, sorted, each once, joined by commas),
    findings (array of license, start, end, saved, differences; places in code points) of every row.

    Rows stay where they are read; only the templates travel. Null text is empty and, like any text
    without a license word, has no block. A very long text takes time in proportion to its length,
    however many notices it repeats. A null id stays null; repeated rows are scanned one by
    one; an empty table gives an empty result; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("differences", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [scanner.document(t or "") for t in batch.column(1).to_pylist()]
            lists = [[f._asdict() for f in fs] for _, fs in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array([",".join(sorted({f.license for f in fs})) for _, fs in found]), pa.array(lists, pa.list_(item))],
                ["id", "n_blocks", "n_findings", "licenses", "findings"],
            )

    out = rows.mapInArrow(scanned, f"id {kind}, n_blocks long, n_findings long, licenses string, findings array<struct<license: string, start: long, end: long, saved: long, differences: long>>")
    return out.select(F.col("id").alias(id_col), "n_blocks", "n_findings", "licenses", "findings")
