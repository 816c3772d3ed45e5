"""License scans by conditional compression.

A document's blocks are its lines with a word of a licence notice, with as many words on
both sides as the longest notice has, so that a wrapped notice is whole; lines that are
less than that apart are one block.  A block is compressed with zstandard alone and with each
template's wording as raw dictionary (long blocks in overlapping pieces of ``PIECE`` characters,
as a dictionary serves what is near it); the templates are ranked by how many bytes the
dictionary saves.  All that save at least ``MIN_SAVED`` of what their own shortest notice
takes, whatever the block's length, are confirmed by the exact differences in wording (words
missing from and added to the best-matching notice of the template): a notice counts if at most
``MAX_DIFF`` of its words differ and no version number or licence's own name does.  Templates are the wording
of notices and what licences are called, by name and identifier; an SPDX expression counts as a
line for each licence in it.

Null and empty texts have no licences.  Repeated rows are scanned each; a notice that a block
repeats counts once for the block; templates that save alike come by name.  Very long texts
are scanned whole.  Extra columns are kept, unless named (in any case) like a result; empty
tables give empty results.  No shuffle: one narrow pass.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

MIN_SAVED = 0.25
MAX_DIFF = 0.15
PIECE = 4_000
MAX_CACHE = 20_000
#: Words that notices have; each of the longer ones has several, so that a changed word hides none of them.
TRIGGER = r"(?i)licen[sc]e|copyright|spdx|hereby|granted|permission|permitted|redistribut|warrant|implied|liable|as-is|public\W+domain|creative\W+commons|free\W+of\W+charge|binary|copies|foundation|neighbou?ring|unencumbered|software"
RESULTS = ("n_blocks", "licenses")

# Public licences by their identifiers, as they are called.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache-2.0 license", "Apache License Version 2.0, January 2004", "Apache 2.0 license"),
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License",),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "GNU GPL v3", "GPLv3 license"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "GNU GPL v2", "GPLv2 license"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007", "GNU LGPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License Version 2.1, February 1999", "GNU LGPL v2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License Version 3, 19 November 2007", "GNU AGPL v3"),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "MPL-1.1": ("Mozilla Public License Version 1.1",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "New BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License"),
    "0BSD": ("Zero-Clause BSD License",),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("The Unlicense",),
    "WTFPL": ("Do What The F*ck You Want To Public License",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License - v 1.0"),
    "EUPL-1.2": ("European Union Public Licence v. 1.2", "EUPL-1.2 licence"),
    "CDDL-1.0": ("Common Development and Distribution License Version 1.0",),
    "CECILL-2.1": ("CeCILL Free Software License Agreement Version 2.1",),
    "MS-PL": ("Microsoft Public License",),
    "MS-RL": ("Microsoft Reciprocal License",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "AFL-3.0": ("Academic Free License version 3.0",),
    "OSL-3.0": ("Open Software License version 3.0",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python Software Foundation License Version 2",),
    "PHP-3.01": ("PHP License, version 3.01",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "ODbL-1.0": ("Open Database License v1.0",),
    "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0",),
    "UPL-1.0": ("Universal Permissive License v 1.0",),
    "BUSL-1.1": ("Business Source License 1.1",),
    "Elastic-2.0": ("Elastic License 2.0",),
    "SSPL-1.0": ("Server Side Public License, version 1",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal license"),
}
FAMILIES = ("GPL", "LGPL", "AGPL", "GFDL")  # identifiers of these may say only or or-later


def _called(name: str) -> list[str]:
    """The notices that call a licence by its names or its identifier."""
    ids = [name, f"{name}-only", f"{name}-or-later"] if name.split("-")[0] in FAMILIES else [name]
    said = [f"{how} the {n}." for n in NAMES[name] for how in ("Licensed under", "Released under", "This work is licensed under", "Distributed under")]
    return [*NAMES[name], *said, *(f"SPDX-License-Identifier: {i}" for i in ids)]


# Wording of public licence notices.
_WORDING = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

TEMPLATES = {name: [*_WORDING.get(name, []), *_called(name)] for name in NAMES}

_SPDX = re.compile(r"(?i)(SPDX-License-Identifier:)[ \t]*([^\n]*)")
_OPERAND = re.compile(r"(?i)\bWITH\s+[\w.\-]+|\b(?:OR|AND)\b|([A-Za-z0-9][\w.\-]*)")
_WORD = re.compile(r"[\w][\w.\-]*")


def _words(text: str) -> list[str]:
    return [w.strip(".-") for w in _WORD.findall(text.lower())]


def written_out(text: str) -> str:
    """A text whose SPDX expressions have a line for each licence that they join, without exceptions."""

    def lines(m):
        names = [x for x in _OPERAND.findall(m[2]) if x]
        return "\n".join(f"{m[1]} {x}" for x in names) if len(names) > 1 and re.search(r"(?i)\b(?:OR|AND)\b", m[2]) else m[0]

    return _SPDX.sub(lines, text)


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.coders = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict("\n".join(v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in templates.items()}
        self.notices = {k: [_words(x) for x in v] for k, v in templates.items()}
        # a notice's names and numbers don't differ, so a block without one of them needs no alignment
        self.must = {k: [set(_digits(n)) | set(n) & _NAMES for n in v] for k, v in self.notices.items()}
        self.least = {k: MIN_SAVED * min((len(self.plain.compress(x.encode())) for x in v), default=0) for k, v in templates.items()}
        self.trigger = re.compile(TRIGGER)
        self.margin = max((math.ceil(len(n) * (1 + MAX_DIFF)) for v in self.notices.values() for n in v), default=0)
        self.cache: dict[tuple, list] = {}

    def blocks(self, text: str) -> list[tuple[str, str]]:
        """Lines with a trigger that are less than a notice apart, alone and with a notice's length around."""
        text = written_out(text)
        lines = text.split("\n")
        start = list(accumulate((len(x) + 1 for x in lines), initial=0))
        hits = set()
        for m in self.trigger.finditer(text):
            hits.update(range(bisect_right(start, m.start()) - 1, bisect_right(start, m.end() - 1)))
        runs: list[list[int]] = []
        for k in sorted(hits):
            if runs and sum(len(_WORD.findall(x)) for x in lines[runs[-1][-1] + 1 : k]) < self.margin:
                runs[-1].append(k)
            else:
                runs.append([k])
        out = []
        for run in runs:
            before, after = [], []
            for k in range(run[0] - 1, -1, -1):
                if len(before) >= self.margin:
                    break
                before = _WORD.findall(lines[k]) + before
            for k in range(run[-1] + 1, len(lines)):
                if len(after) >= self.margin:
                    break
                after += _WORD.findall(lines[k])
            whole = [" ".join(before[-self.margin :]), *lines[run[0] : run[-1] + 1], " ".join(after[: self.margin])]
            out.append(("\n".join(lines[k] for k in run), "\n".join(whole)))
        return out

    def ranked(self, block: str) -> list[tuple[int, str]]:
        """Bytes that each template's dictionary saves, the most in any piece of the block; most first."""
        saved = dict.fromkeys(self.coders, 0)
        for at in range(0, max(1, len(block)), PIECE):
            data = block[at : at + PIECE + PIECE // 4].encode()
            alone = len(self.plain.compress(data))
            for k, c in self.coders.items():
                saved[k] = max(saved[k], alone - len(c.compress(data)))
        return sorted(((v, k) for k, v in saved.items()), key=lambda x: (-x[0], x[1]))

    def scan(self, block: tuple[str, str]) -> list[dict]:
        got = self.cache.get(block)
        if got is None:
            got = []
            words = _words(block[1])
            have = set(words)
            enough: dict[str, int] = {}
            for part in dict.fromkeys(block):
                for saved, name in self.ranked(part):
                    if saved >= self.least[name]:
                        enough[name] = max(saved, enough.get(name, saved))
            for name, saved in sorted(enough.items(), key=lambda x: (-x[1], x[0])):
                best = min((d for n, must in zip(self.notices[name], self.must[name]) if must <= have and (d := _differences(n, words)) is not None), default=None)
                if best is not None:
                    got.append({"license": name, "saved": saved, "missing": best[1], "added": best[2]})
            if len(self.cache) >= MAX_CACHE:
                self.cache.clear()
            if len(block[1]) < 2000:
                self.cache[block] = got
        return got


def _differences(notice: list[str], words: list[str]):
    """(share, missing, added) of the words at the notice's best place, if few differ."""
    n = len(notice)
    if n == 0 or not words:
        return None
    wanted, names, digits = Counter(notice), set(notice) & _NAMES, _digits(notice)
    have: Counter = Counter()
    best, shared = None, 0
    for end, w in enumerate(words):
        have[w] += 1
        shared += have[w] <= wanted[w]
        if end >= n:
            old = words[end - n]
            shared -= have[old] <= wanted[old]
            have[old] -= 1
        if end < n - 1 and end < len(words) - 1:
            continue
        # words in common in any order bound those in the notice's order
        if n - shared > MAX_DIFF * n:
            continue
        part = words[max(0, end - n + 1) : end + 1]
        same = sum(m.size for m in difflib.SequenceMatcher(None, notice, part, autojunk=False).get_matching_blocks())
        missing, added = n - same, len(part) - same
        # a name's own words must not differ: what tells templates apart is no small change
        if max(missing, added) > MAX_DIFF * n or _digits(part) != digits or set(part) & _NAMES != names:
            continue
        if best is None or missing + added < best[0]:
            best = (missing + added, missing, added)
            if best[0] == 0:
                break
    if best is None:
        return None
    return (max(best[1:]) / n, best[1], best[2])


def _digits(words: list[str]) -> list[str]:
    return sorted(w for w in words if any(c.isdigit() for c in w))


#: Words that tell one licence from another: those of names and identifiers that are not common to many.
_COMMON = {"license", "licence", "public", "general", "version", "v", "the", "software", "open", "free", "source", "international", "unported", "universal", "and", "of", "no", "new", "model", "foundation", "agreement", "development", "distribution", "documentation", "common", "creative", "commons", "do", "what", "you", "want", "to", "f", "ck", "june", "january", "february", "november", "union", "university", "system", "side"}
_NAMES = {w for name, called in NAMES.items() for x in (name, *called) for w in _words(x) if not any(c.isdigit() for c in w)} - _COMMON


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, prefix: str = "") -> DataFrame:
    """The columns of docs, n_blocks (candidate blocks) and licenses (array<struct<license,saved,
    missing,added>>, one per block and confirmed licence; saved in bytes), named with ``prefix``."""
    T.lean(docs.sparkSession)
    templates = templates or TEMPLATES
    results = [prefix + x for x in RESULTS]
    base = docs.select(*T.columns(docs, results))
    text_at = [c.lower() for c in base.columns].index("text")
    kind = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.int32()), ("missing", pa.int32()), ("added", pa.int32())]))

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            for part in T.slices(batch):
                text = part.column(text_at).cast(pa.string()).fill_null("")
                some = pc.match_substring_regex(text, TRIGGER).to_pylist()
                n, found = [], []
                for row, hit in enumerate(some):
                    blocks = scanner.blocks(text[row].as_py()) if hit else []
                    n.append(len(blocks))
                    found.append([x for b in blocks for x in scanner.scan(b)])
                yield [*part.columns, pa.array(n, pa.int64()), pa.array(found, kind)]

    return T.mapped(base, run, f"`{results[0]}` long, `{results[1]}` array<struct<license:string,saved:int,missing:int,added:int>>")
