"""License notices by conditional compression.

Candidate blocks are lines that hold a licensing word, with the lines between two of them less than `REACH` apart. A
block is judged alone and with the lines around it, as many words as the longest template has on either side, and the
longer notice counts. A block of many words is judged in windows that overlap by more than the longest template, so that
every notice lies whole in one of them. Each piece is compressed with every template as a zstandard raw dictionary;
templates are ranked by how much that saves over no dictionary, and the first is taken whose wording agrees: what tells
licenses apart is exact (every required word and phrase is there, no barred phrase is in or around it, and the sentence of a
short notice is not negated), and of the template's other words at most `slack` differ. The differences are reported word by
word. SPDX tags go the same way, each identifier of an expression on a line of its own, against templates of tags.

What is left of a block before and after a notice is judged in turn, and every SPDX tag counts. One row per notice, or
per block without one; `license` is null where no template agrees, which holds for unknown identifiers too. Null and empty
texts have no blocks. Equal savings go to the first template by name. Offsets are code points, ends exclusive. Repeated
rows and null ids pass through. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, start long, end long, license string, saving double, differences string"
REACH = 3

# Notices of public licenses, and what tells one from another: words that a notice must hold, phrases that it
# must hold, and phrases that neither it nor what stands around it may hold (phrases end with a semicolon).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "affero 3 later", "later version", ""),
    "AGPL-3.0-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; version 3 of the License.", "affero 3", "", "later version"),
    "AGPL-3.0-only-long": ("This program is free software; you can redistribute it and/or modify it under the terms of version 3 of the GNU Affero General Public License as published by the Free Software Foundation.", "affero 3", "", "later version"),
    "AGPL-3.0-only-line": ("Licensed under the GNU Affero General Public License version 3 only.", "affero 3 only", "", "later version"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache 2.0"),
    "Apache-2.0-line": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions retain reproduce", "", "advertising materials; endorse or promote"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistributions neither endorse", "", "advertising materials"),
    "BSD-4-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistributions neither endorse advertising acknowledgement", "advertising materials", ""),
    "BSD-line": ("Licensed under the BSD License.", "bsd"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4.0"),
    "CC-BY-4.0-long": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    "CC-BY-NC-4.0-long": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution-noncommercial 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    "CC-BY-SA-4.0-long": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution-sharealike 4.0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "cc by-nd 4.0"),
    "CC-BY-ND-4.0-long": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative commons attribution-noderivatives 4.0"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "cc by-nc-sa 4.0"),
    "CC-BY-NC-SA-4.0-long": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "creative commons attribution-noncommercial-sharealike 4.0"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "cc by-nc-nd 4.0"),
    "CC-BY-NC-ND-4.0-long": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "creative commons attribution-noncommercial-noderivatives 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "cc0 1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "eclipse public 2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "boost software 1.0"),
    "GPL-2.0-or-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public 2 later", "later version", ""),
    "GPL-2.0-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "gnu general public 2", "", "later version"),
    "GPL-2.0-only-long": ("This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.", "gnu general public 2", "", "later version"),
    "GPL-2.0-only-line": ("Licensed under the GNU General Public License version 2 only.", "gnu general public 2 only", "", "later version"),
    "GPL-2.0-line": ("This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    "GPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public 3 later", "later version", ""),
    "GPL-3.0-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 3 of the License.", "gnu general public 3", "", "later version"),
    "GPL-3.0-only-long": ("This program is free software; you can redistribute it and/or modify it under the terms of version 3 of the GNU General Public License as published by the Free Software Foundation.", "gnu general public 3", "", "later version"),
    "GPL-3.0-only-line": ("Licensed under the GNU General Public License version 3 only.", "gnu general public 3 only", "", "later version"),
    "GPL-3.0-line": ("This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee appear"),
    "LGPL-2.1-or-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lesser 2.1 later", "later version", ""),
    "LGPL-2.1-only": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License.", "lesser 2.1", "", "later version"),
    "LGPL-2.1-only-long": ("This library is free software; you can redistribute it and/or modify it under the terms of version 2.1 of the GNU Lesser General Public License as published by the Free Software Foundation.", "lesser 2.1", "", "later version"),
    "LGPL-2.1-only-line": ("Licensed under the GNU Lesser General Public License version 2.1 only.", "lesser 2.1 only", "", "later version"),
    "LGPL-3.0-or-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "lesser 3 later", "later version", ""),
    "LGPL-3.0-only": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 3 of the License.", "lesser 3", "", "later version"),
    "LGPL-3.0-only-long": ("This library is free software; you can redistribute it and/or modify it under the terms of version 3 of the GNU Lesser General Public License as published by the Free Software Foundation.", "lesser 3", "", "later version"),
    "LGPL-3.0-only-line": ("Licensed under the GNU Lesser General Public License version 3 only.", "lesser 3 only", "", "later version"),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "permission charge sublicense", "above copyright notice", "not evil"),
    "MIT-0": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.", "permission charge sublicense", "", "above copyright notice; not evil"),
    "JSON": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software shall be used for Good, not Evil.", "permission charge sublicense good evil", "not evil", ""),
    "MIT-line": ("Released under the MIT License.", "mit"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2.0"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "as-is alter freely"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.", "unencumbered domain"),
}

# Identifiers of the public list that tags may name.
IDENTIFIERS = (
    "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 "
    "CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0+ "
    "GPL-3.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0+ ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1+ LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0+ "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL Python-2.0 Unlicense Vim WTFPL X11 Zlib"
).split()
TAG = "SPDX-License-Identifier: "
TAGS = {name: (TAG + name, f"{TAG[:-2]} {name}".lower()) for name in IDENTIFIERS}

ANCHOR = r"(?i)licen[sc]e|copyright|redistribut|permission is hereby|permission to use|creative commons|\bCC[ -]?BY\b|\bCC0\b|public domain|SPDX|\bGPL\b|free software"
_ANCHOR = re.compile(ANCHOR)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*\+?")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)", re.IGNORECASE)
_EXCEPTION = re.compile(r"\s+WITH\s+\S+|\s+(?:AND|OR)\s+|[()\s]+", re.IGNORECASE)


#: Words around a notice in which phrases are looked for, and the words of a template so short that a "not" turns it round.
NEAR, SHORT = 30, 20
_NEGATION = re.compile(r"\b(?:not|never|neither|nor|cannot|no longer|instead of|rather than)\b|n['\u2019]t\b", re.IGNORECASE)
_STOP = re.compile(r"[.!?;][\"')\]]*\s|\n\s*\n")


def _sentence(text: str, at: int) -> int:
    """Where the sentence begins that the place `at` is in."""
    return max((m.end() for m in _STOP.finditer(text, max(0, at - 400), at)), default=max(0, at - 400))


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of lines with a licensing word; lines between two of them at most REACH apart belong to the block."""
    at, start, end, gap = 0, -1, -1, 0
    for line in text.split("\n"):
        if _ANCHOR.search(line):
            if start >= 0 and gap >= REACH:
                yield start, end
                start = -1
            start = at if start < 0 else start
            end, gap = at + len(line), 0
        else:
            gap += 1
        at += len(line) + 1
    if start >= 0:
        yield start, end


def windows(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Spans of 2 * size words that overlap by size words; the whole text if it has no more."""
    places = [m.span() for m in _WORD.finditer(text)]
    if len(places) <= 2 * size:
        yield 0, len(text)
        return
    for at in range(0, len(places) - size, size):
        last = at + 2 * size
        yield (places[at][0] if at else 0), (places[last - 1][1] if last < len(places) else len(text))


def around(text: str, start: int, end: int, most: int) -> tuple[int, int]:
    """The span with whole lines before and after it, up to `most` words on either side."""
    left = most
    while start > 0 and left > 0:
        line = text.rfind("\n", 0, start - 1) + 1
        left -= len(text[line : start - 1].split())
        if left >= 0:
            start = line
    left = most
    while end < len(text) and left > 0:
        line = text.find("\n", end + 1)
        line = len(text) if line < 0 else line
        left -= len(text[end + 1 : line].split())
        if left >= 0:
            end = line
    return start, end


def _differences(template: list[str], block: list[str]) -> tuple[int, list[str], int, int]:
    """How many of the template's words differ within the block, each difference as -template +block, and the words of the
    block that the notice spans."""
    matcher = SequenceMatcher(None, template, block, autojunk=False)
    codes = matcher.get_opcodes()
    changes, count = [], 0
    for k, (tag, a, b, c, d) in enumerate(codes):
        if tag == "equal" or (tag == "insert" and k in (0, len(codes) - 1)):
            continue
        # What surrounds the notice in its block is no difference of wording.
        other = [] if k in (0, len(codes) - 1) and d - c > b - a else block[c:d]
        count += max(b - a, len(other))
        changes.append("-" + " ".join(template[a:b]) + (" +" + " ".join(other) if other else ""))
    same = [(c, d) for tag, _, _, c, d in codes if tag == "equal"]
    return count, changes, same[0][0] if same else 0, same[-1][1] if same else 0


Notice = tuple[int, int, str, float, str, int]


class Matcher:
    """Compressors of all templates, ready to judge blocks."""

    def __init__(self, templates: dict[str, tuple[str, ...]], slack: float) -> None:
        self.slack = slack
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.own, self.tags = ({name: self._ready(*template) for name, template in sorted(some.items())} for some in (templates, TAGS))
        self.longest = max((len(t) for _, t, *_ in self.own.values()), default=0)
        self.window = max(1, int(self.longest * (1 + 2 * slack)))
        self._named = lru_cache(4096)(lambda name: self._best(TAG + name, self.tags)[0])

    @staticmethod
    def _ready(text: str, needed: str, holds: str = "", bars: str = "") -> tuple[zstandard.ZstdCompressor, list[str], set[str], list[str], list[str]]:
        raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        phrases = [[f" {p.strip()} " for p in x.split(";") if p.strip()] for x in (holds, bars)]
        return zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False), words(text), set(needed.split()), *phrases

    def judge(self, block: str) -> tuple[list[Notice], float]:
        """Every notice as (start, end, license, saving, differences, how many), in order, and the best saving."""
        found, best = [], 0.0
        spans, at = [], 0
        for tag in _SPDX.finditer(block):
            named = [self._named(name) for name in dict.fromkeys(_EXCEPTION.sub(" ", tag[1]).split())]
            found += [(tag.start(), tag.end(), *won[2:]) for won in named if won]
            spans.append((at, tag.start()))
            at = tag.end()
        spans.append((at, len(block)))
        tagged = {x[2] for x in found}
        wordings: list[Notice] = []
        for low, high in spans:
            for first, last in windows(block[low:high], self.window):
                todo = [(low + first, low + last)]
                while todo:
                    a, b = todo.pop()
                    if (a, b) != (0, len(block)) and not _ANCHOR.search(block, a, b):
                        continue
                    won, saving = self._best(block[a:b], self.own)
                    best = max(best, saving)
                    if won:
                        start, end, *rest = won
                        wordings.append((a + start, a + end, *rest))
                        todo += [(a, a + start), (a + end, b)]
        # Windows overlap: of notices that meet, the longer one, then the one with fewer differences, was seen whole.
        for x in sorted(set(wordings), key=lambda x: (x[0] - x[1], x[5], x[0], x[2])):
            if x[2] not in tagged and not any(y[0] < x[1] and y[1] > x[0] for y in found):
                found.append(x)
        return sorted(found), best

    def _best(self, block: str, templates: dict) -> tuple[Notice | None, float]:
        data = block.encode()
        bare = len(self.plain.compress(data))
        ranked = sorted(((bare - len(packer.compress(data))) / bare, name) for name, (packer, *_) in templates.items())
        ranked.sort(key=lambda x: (-x[0], x[1]))
        places = [m.span() for m in _WORD.finditer(block)]
        told = words(block)
        have = set(told)
        for saving, name in ranked:
            if saving <= 0.05:
                break
            _, template, needed, holds, bars = templates[name]
            if not have >= needed:
                continue
            count, changes, first, last = _differences(template, told)
            if last > first and count <= self.slack * len(template):
                near = f" {' '.join(told[max(0, first - NEAR) : last + NEAR])} "
                if any(p not in near for p in holds) or any(p in near for p in bars):
                    continue
                if len(template) <= SHORT and _NEGATION.search(block, _sentence(block, places[first][0]), places[last - 1][1]):
                    continue
                return (places[first][0], places[last - 1][1], name.removesuffix("-line").removesuffix("-long"), saving, "; ".join(changes), count), saving
        return None, max(0.0, ranked[0][0]) if ranked else 0.0


def _notices(body: str, judge: Callable[[str], tuple], longest: int) -> Iterator[tuple[int, int, str | None, float, str]]:
    """(start, end, license, saving, differences) of a text's notices and of its blocks without one."""
    done: set[tuple[int, int, str | None]] = set()
    taken = 0
    for start, end in blocks(body):
        if end <= taken:
            continue
        found, saving = judge(body[start:end])
        rows = [(start + a, start + b, *rest) for a, b, *rest in found]
        low, high = around(body, start, end, longest)
        wide = [(low + a, low + b, *rest) for a, b, *rest in judge(body[low:high])[0]]
        wide = [x for x in wide if x[0] < end and x[1] > start]
        # A notice of the block alone stays unless one of the wider lines meets it and is longer, or as long and as good.
        rows = [x for x in rows if not any(y[0] < x[1] and y[1] > x[0] and (y[1] - y[0], -y[5]) >= (x[1] - x[0], -x[5]) for y in wide)]
        rows += [y for y in wide if not any(y[0] < x[1] and y[1] > x[0] for x in rows)]
        if len(rows) == 1:
            rows = [(min(start, rows[0][0]), max(end, rows[0][1]), *rows[0][2:])]
        for a, b, name, gain, changes, _ in sorted(rows):
            if (a, b, name) not in done:
                done.add((a, b, name))
                yield a, b, name, gain, changes
            taken = max(taken, b)
        if not rows:
            yield start, end, None, saving, ""


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, tuple[str, ...]], slack: float) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(templates, slack)
    judge = lru_cache(4096)(matcher.judge)
    for batch in batches:
        rows = [(key.as_py(), *row) for key, text in zip(batch.column(0), batch.column(1), strict=True) for row in _notices(text.as_py() or "", judge, matcher.longest)]
        names = ["id", "start", "end", "license", "saving", "differences"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, slack: float = 0.25) -> DataFrame:
    """(id_col, start, end, license, saving, differences) of every candidate block. Only texts with a licensing word reach Python."""
    asked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(ANCHOR))
    return asked.mapInArrow(partial(_scan, templates=templates or TEMPLATES, slack=slack), SCHEMA).withColumnRenamed("id", id_col)
