"""Licence recognition by sentence rules.

A text is cut into sentences (at . ! ? : ; before white space, and at blank lines); a sentence is
compared in normal form, lower case with one space for every run of other signs than letters and
digits. Known licence sentences map to identifiers: a text becomes the sequence of its known sentences'
identifiers with their places. Rules are ordered sequences of identifiers; at each place the longest
rule that fits is taken (of equally long ones the first listed), and the search goes on behind it. Up to
GAP unknown sentences may lie between two of a rule's sentences. A sentence may be wrapped over any
number of lines, and may follow a line that has no full stop: lines are joined as long as they are the
beginning of a known sentence.

Each document is read alone, in Python on Arrow batches; nothing is shuffled. The tables below are the
default; callers may pass their own.

Defined results: null and empty texts match nothing; a licence that occurs several times gives a row
each time; repeated rows match alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.shared import texts_of

GAP = 2
MATCHES = "doc_id long, license string, rule string, first_sentence int, last_sentence int, n_sentences int"

# Known licence sentences by identifier, and the rules over them in their order.
SENTENCES = {
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit_title": "MIT License",
    "mit_title_the": "The MIT License",
    "mit_released": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "apache_short": "Licensed under the Apache License, Version 2.0",
    "apache_grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache_use": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl_free": "This program is free software",
    "gpl2_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl_implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_see": "See the GNU General Public License for more details",
    "mpl_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc_by": "Licensed under CC BY 4.0",
    "cc_by_sa": "Licensed under CC BY-SA 4.0",
    "cc_work_by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc_work_by_sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc_work_by_nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc_work_by_nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc_work_by_nc_sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc_work_by_nc_nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "mit0_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "ncsa_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "zero_bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd_advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost_short": "Distributed under the Boost Software License, Version 1.0",
    "boost_grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "postgresql_grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "apache_title": "Apache License",
    "apache_version": "Version 2.0, January 2004",
    "apache_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "lgpl_free": "This library is free software",
    "lgpl21_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl_title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl_title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl_title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl3_date": "Version 3, 29 June 2007",
    "agpl3_date": "Version 3, 19 November 2007",
    "gpl2_date": "Version 2, June 1991",
    "lgpl21_date": "Version 2.1, February 1999",
    "gpl_verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "epl2_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl_subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "ofl_font": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "mspl_governs": "This license governs use of the accompanying software",
    "mspl_accept": "If you use the software, you accept this license",
    "unlicense_free": "This is free and unencumbered software released into the public domain",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
RULES = (
    ("mit_full", "MIT", ("mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("mit_body", "MIT", ("mit_grant", "mit_notice")),
    ("mit_released", "MIT", ("mit_released",)),
    ("mit_licensed", "MIT", ("mit_licensed",)),
    ("mit_title", "MIT", ("mit_title",)),
    ("mit_title_the", "MIT", ("mit_title_the",)),
    ("bsd_3_full", "BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty")),
    ("bsd_3_body", "BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("bsd_2_full", "BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty")),
    ("bsd_2_body", "BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("isc_full", "ISC", ("isc_grant", "isc_warranty")),
    ("isc_grant", "ISC", ("isc_grant",)),
    ("apache_header", "Apache-2.0", ("apache_grant", "apache_use", "apache_copy", "apache_basis", "apache_see")),
    ("apache_grant", "Apache-2.0", ("apache_grant", "apache_use")),
    ("apache_short", "Apache-2.0", ("apache_short",)),
    ("gpl3_header", "GPL-3.0-or-later", ("gpl_free", "gpl3_later", "gpl_hope", "gpl_implied", "gpl_see")),
    ("gpl3_grant", "GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("gpl2_header", "GPL-2.0-or-later", ("gpl_free", "gpl2_later", "gpl_hope", "gpl_implied", "gpl_see")),
    ("gpl2_grant", "GPL-2.0-or-later", ("gpl_free", "gpl2_later")),
    ("gpl3_work", "GPL-3.0-only", ("gpl3_work",)),
    ("mpl_subject", "MPL-2.0", ("mpl_subject",)),
    ("cc_by_nc", "CC-BY-NC-4.0", ("cc_by_nc",)),
    ("cc_by", "CC-BY-4.0", ("cc_by",)),
    ("cc_by_sa", "CC-BY-SA-4.0", ("cc_by_sa",)),
    ("cc_work_by", "CC-BY-4.0", ("cc_work_by",)),
    ("cc0", "CC0-1.0", ("cc0",)),
    ("cc_work_by_sa", "CC-BY-SA-4.0", ("cc_work_by_sa",)),
    ("cc_work_by_nc", "CC-BY-NC-4.0", ("cc_work_by_nc",)),
    ("cc_work_by_nd", "CC-BY-ND-4.0", ("cc_work_by_nd",)),
    ("cc_work_by_nc_sa", "CC-BY-NC-SA-4.0", ("cc_work_by_nc_sa",)),
    ("cc_work_by_nc_nd", "CC-BY-NC-ND-4.0", ("cc_work_by_nc_nd",)),
    ("mit_0", "MIT-0", ("mit0_grant", "mit_warranty")),
    ("ncsa", "NCSA", ("ncsa_grant",)),
    ("zero_bsd", "0BSD", ("zero_bsd_grant",)),
    ("bsd_4_body", "BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising")),
    ("zlib_full", "Zlib", ("zlib_as_is", "zlib_liability", "zlib_grant")),
    ("zlib_grant", "Zlib", ("zlib_grant",)),
    ("boost_short", "BSL-1.0", ("boost_short",)),
    ("boost_grant", "BSL-1.0", ("boost_grant",)),
    ("postgresql", "PostgreSQL", ("postgresql_grant",)),
    ("apache_text", "Apache-2.0", ("apache_title", "apache_version", "apache_terms")),
    ("lgpl21_header", "LGPL-2.1-or-later", ("lgpl_free", "lgpl21_later")),
    ("lgpl3_header", "LGPL-3.0-or-later", ("lgpl_free", "lgpl3_later")),
    ("lgpl3_program", "LGPL-3.0-or-later", ("gpl_free", "lgpl3_later")),
    ("agpl3_header", "AGPL-3.0-or-later", ("gpl_free", "agpl3_later")),
    ("gpl2_only", "GPL-2.0-only", ("gpl_free", "gpl2_only")),
    ("gpl3_text", "GPL-3.0-only", ("gpl_title", "gpl3_date", "gpl_verbatim")),
    ("gpl2_text", "GPL-2.0-only", ("gpl_title", "gpl2_date", "gpl_verbatim")),
    ("lgpl3_text", "LGPL-3.0-only", ("lgpl_title", "gpl3_date", "gpl_verbatim")),
    ("lgpl21_text", "LGPL-2.1-only", ("lgpl_title", "lgpl21_date", "gpl_verbatim")),
    ("agpl3_text", "AGPL-3.0-only", ("agpl_title", "agpl3_date", "gpl_verbatim")),
    ("epl2", "EPL-2.0", ("epl2_terms",)),
    ("cddl_1", "CDDL-1.0", ("cddl_subject", "apache_use")),
    ("ofl_1_1", "OFL-1.1", ("ofl_font",)),
    ("ms_pl", "MS-PL", ("mspl_governs", "mspl_accept")),
    ("unlicense_full", "Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("unlicense_free", "Unlicense", ("unlicense_free",)),
)
SPDX = (
    "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "NCSA", "Zlib", "BSL-1.0", "PostgreSQL", "Apache-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CDDL-1.0", "OFL-1.1", "MS-PL",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "Unlicense",
)

#: A run of stops is tried once, from its first sign.
_BREAK = re.compile(r"(?<![.!?;:])[.!?;:]++(?=\s|$)|\n[^\S\n]*\n")
_SIGNS = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _SIGNS.sub(" ", text.lower()).strip()


#: (rule, licence, identifiers of its sentences in order).
Rules = tuple[tuple[str, str, tuple[str, ...]], ...]


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: Rules = RULES, spdx: tuple[str, ...] = SPDX, gap: int = GAP) -> None:
        self.gap = gap
        known = dict(sentences) | {f"spdx_{x}": f"SPDX License Identifier {x}" for x in spdx}
        rules = [*rules, *((f"spdx_{x}", x, (f"spdx_{x}",)) for x in spdx)]
        #: A known sentence may itself hold breaks ("v. 2.0"): its pieces are identifiers in a row.
        self.ids: dict[str, str] = {}
        parts: dict[str, tuple[str, ...]] = {}
        for name, sentence in known.items():
            row = [p for p in map(normal, _BREAK.split(sentence.lower())) if p]
            parts[name] = tuple(self.ids.setdefault(p, name if len(row) == 1 else f"{name}_{k}") for k, p in enumerate(row))
        # "SPDX-License-Identifier: X" breaks at the colon; its first half is a sentence of its own.
        head = normal("SPDX-License-Identifier")
        self.ids[head] = "spdx"
        for x in spdx:
            self.ids.setdefault(normal(x), f"spdx_{x}")
            parts[f"spdx_{x}"] = ("spdx", self.ids[normal(x)])
        self.beginnings = frozenset(" ".join(w[:k]) for w in (s.split(" ") for s in self.ids) for k in range(1, len(w) + 1))
        self.rules: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {}
        for order, (rule, license_, names) in enumerate(rules):
            row = tuple(p for n in names for p in parts[n])
            self.rules.setdefault(row[0], []).append((-len(row), order, rule, license_, row))
        for same in self.rules.values():
            same.sort()

    def sequence(self, text: str) -> list[tuple[int, str]]:
        """(sentence number, identifier) of the known sentences, in text order."""
        out, number = [], 0
        for sentence in _BREAK.split(text.lower()):
            lines = [x for x in map(normal, sentence.split("\n")) if x] if "\n" in sentence else [x] if (x := normal(sentence)) else []
            k = 0
            while k < len(lines):
                step = 1
                joined, end, found = lines[k], k + 1, None
                while joined in self.beginnings:
                    if joined in self.ids:
                        found, step = self.ids[joined], end - k
                    if end == len(lines):
                        break
                    joined, end = f"{joined} {lines[end]}", end + 1
                if found:
                    out.append((number, found))
                number += 1
                k += step
        return out

    def matches(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """(license, rule, first sentence, last sentence, sentences) in text order."""
        seen, out, k = self.sequence(text), [], 0
        while k < len(seen):
            step = 1
            for _, _, rule, license_, row in self.rules.get(seen[k][1], ()):
                part = seen[k : k + len(row)]
                if tuple(x[1] for x in part) == row and all(b[0] - a[0] <= self.gap + 1 for a, b in zip(part, part[1:])):
                    out.append((license_, rule, part[0][0], part[-1][0], len(row)))
                    step = len(row)
                    break
            k += step
        return out


def find_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: Rules = RULES, spdx: tuple[str, ...] = SPDX, gap: int = GAP) -> DataFrame:
    """One row for each licence match: MATCHES. The tables given take the place of the ones above; they go to
    every task, so they are a rule book's size, not a corpus's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Recogniser(sentences, rules, spdx, gap).matches
        names = ["doc_id", "license", "rule", "first_sentence", "last_sentence", "n_sentences"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in matches(text.as_py())]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return texts_of(docs).mapInArrow(run, MATCHES)
