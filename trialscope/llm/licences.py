"""Licence scans: sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import small_batches, text_of

#: Known licence sentences, by identifier.
SENTENCES = {
    "apache-2.notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.comply": "you may not use this file except in compliance with the License",
    "apache-2.obtain": "You may obtain a copy of the License at",
    "apache-2.asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "gpl-3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl.details": "See the GNU General Public License for more details",
    "mit.notice": "Released under the MIT License",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software',
    "mit.permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "cc-by-nc-4.notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.notice": "Licensed under CC BY-SA 4.0",
    "cc0.notice": "Released under CC0 1.0",
    "bsd-3.notice": "Released under the BSD 3-Clause License",
    "unlicense.domain": "This is free and unencumbered software released into the public domain",
    "unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "apache-2.notice-comply": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-2.obtain-http": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.obtain-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "lgpl.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl.warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl.details": "See the GNU Lesser General Public License for more details",
    "agpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl.details": "See the GNU Affero General Public License for more details",
    "mpl-2.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-2.copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-2.copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl-2.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsd.use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd.liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc.asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "isc.liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost.terms": "Distributed under the Boost Software License, Version 1.0",
}

#: Rules in order; the first that fits at a place holds. A rule is a licence and a sequence of identifiers.
RULES = [
    ("MIT", ("mit.grant", "mit.asis", "mit.liability")),
    ("MIT", ("mit.permission", "mit.condition", "mit.asis", "mit.liability")),
    ("Apache-2.0", ("apache-2.notice", "apache-2.comply", "apache-2.obtain", "apache-2.asis")),
    ("Apache-2.0", ("apache-2.notice-comply", "apache-2.obtain", "apache-2.asis")),
    ("Apache-2.0", ("apache-2.notice-comply", "apache-2.obtain-http", "apache-2.asis")),
    ("Apache-2.0", ("apache-2.notice-comply", "apache-2.obtain-https", "apache-2.asis")),
    ("Apache-2.0", ("apache-2.notice-comply", "apache-2.obtain")),
    ("Apache-2.0", ("apache-2.notice-comply", "apache-2.obtain-http")),
    ("Apache-2.0", ("apache-2.notice-comply", "apache-2.obtain-https")),
    ("BSD-3-Clause", ("bsd.use", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis", "bsd.liability")),
    ("BSD-2-Clause", ("bsd.use", "bsd.source", "bsd.binary", "bsd.asis", "bsd.liability")),
    ("ISC", ("isc.grant", "isc.asis", "isc.liability")),
    ("Zlib", ("zlib.asis", "zlib.grant")),
    ("LGPL-2.1-or-later", ("lgpl.free", "lgpl.warranty", "lgpl.details")),
    ("AGPL-3.0-or-later", ("agpl.free", "gpl.warranty", "agpl.details")),
    ("MPL-2.0", ("mpl-2.terms", "mpl-2.copy-http")),
    ("MPL-2.0", ("mpl-2.terms", "mpl-2.copy-https")),
    ("Unlicense", ("unlicense.domain", "unlicense.anyone")),
    ("EPL-2.0", ("epl-2.terms",)),
    ("BSL-1.0", ("boost.terms",)),
    ("LGPL-2.1-or-later", ("lgpl.free",)),
    ("AGPL-3.0-or-later", ("agpl.free",)),
    ("Apache-2.0", ("apache-2.notice-comply",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.warranty", "gpl.details")),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("Apache-2.0", ("apache-2.notice",)),
    ("GPL-3.0", ("gpl-3.notice",)),
    ("MIT", ("mit.grant",)),
    ("MIT", ("mit.permission", "mit.condition")),
    ("MIT", ("mit.notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.notice",)),
    ("CC-BY-4.0", ("cc-by-4.notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.notice",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("BSD-3-Clause", ("bsd-3.notice",)),
    ("Unlicense", ("unlicense.domain",)),
]
#: Unknown lines or sentences that may stand between two identifiers of a rule.
GAP = 3

_LINE_END = re.compile(r"[.!?]+(?:[ \t\r\n\f\v]+|$)|\n+")
_SENTENCE_END = re.compile(r"[.!?]+(?:[ \t\r\n\f\v]+|$)|\n(?:[^\w\n]|_)*\n")
_LETTERS = re.compile(r"[a-z0-9]+")


def normal(sentence: str) -> str:
    """Lower case, with one space for all that isn't a letter a-z or a digit."""
    return " ".join(_LETTERS.findall(sentence.lower()))


def _sentences(text: str, end: re.Pattern) -> Iterator[tuple[int, int]]:
    start = 0
    for m in end.finditer(text):
        if m.start() > start:
            yield start, m.start()
        start = m.end()
    if start < len(text):
        yield start, len(text)


class Rules:
    """Known sentences by their normal form, and ordered rules by the identifier that they begin with."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]]):
        self.known = {normal(s): k for k, s in sentences.items()}
        self.first = frozenset(s.split()[0] for s in self.known)
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for licence, rule in rules:
            self.by_first.setdefault(rule[0], []).append((licence, rule))

    def identifiers(self, text: str) -> list[tuple[int, int, int, str]]:
        """(gap, start, end, identifier) of the known sentences, in order.

        Sentences end at a stop before white space or at a line's end; a sentence that is wrapped over
        lines is found too, as one that ends at a stop or a line without letters and digits. Where both
        kinds are known at overlapping places, the longer holds. gap is how many lines or sentences
        with letters or digits stand whole between it and the known one before.
        """
        units = list(_sentences(text, _LINE_END))
        found = []
        for those in (units, _sentences(text, _SENTENCE_END)):
            for a, b in those:
                sentence = text[a:b].lower()
                first = _LETTERS.search(sentence)
                if first and first[0] in self.first and (k := self.known.get(normal(sentence))):
                    found.append((a, b, k))
        out: list[tuple[int, int, int, str]] = []
        starts = [a for a, _ in units] if len(found) > 1 else []
        for a, b, k in sorted(set(found), key=lambda x: (x[0], -x[1])):
            if not out:
                out.append((0, a, b, k))
            elif a >= out[-1][2]:
                between = units[bisect_left(starts, out[-1][2]) : bisect_left(starts, a)]
                out.append((sum(e <= a and _LETTERS.search(text[s:e].lower()) is not None for s, e in between), a, b, k))
        return out

    def recognise(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, start, end) of every place where a rule fits; identifiers are used once."""
        ids = self.identifiers(text)
        out, i = [], 0
        while i < len(ids):
            for licence, rule in self.by_first.get(ids[i][3], ()):
                part = ids[i : i + len(rule)]
                if tuple(x[3] for x in part) == rule and all(x[0] <= GAP for x in part[1:]):
                    out.append((licence, part[0][1], part[-1][2]))
                    i += len(rule)
                    break
            else:
                i += 1
        return out


_RULES = Rules(SENTENCES, RULES)
identifiers, recognise = _RULES.identifiers, _RULES.recognise


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """id and found (array of licence, start, end) of every row's whole text.

    sentences (by identifier) and rules (in order) may be given instead of the known ones.

    Defined cases: null text counts as empty and has no licence; ids may be null or repeat, each row is
    scanned; a very long text is scanned whole, as one row; where several rules fit at a place, the
    first in order holds; an empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    known = Rules(sentences or SENTENCES, rules or RULES) if sentences or rules else _RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [[{"licence": x, "start": s, "end": e} for x, s, e in known.recognise(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "found"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, found array<struct<licence:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
