"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is normalised: letters and digits, lower case, single blanks; what may end a
sentence or stand around one (line ends, colons, brackets, quotes, marks before white
space) becomes a boundary. Known licence sentences are looked up between boundaries,
the longest first; they may run over boundaries, as sentences wrapped over lines do.
What is found, in order, is a sequence of identifiers. Rules name a licence and the
identifiers that must follow each other in the sequence. Identifiers are used up by
the longest rule that fits where they stand, so that a rule within a longer one isn't
reported with it.

Notices, titles and SPDX lines are made by rules from the names of the licences.

Defined results: a null or empty text has no sentences and no licences; a sentence that
repeats is an identifier each time, a rule that fits again is reported once; rules that
tie in length go in their order; very long texts are searched whole; repeated rows and
equal ids are reported each; an empty table gives no rows; columns other than the id
and text aren't read, whatever their names.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names by which licences are called in notices and titles.
NAMES = {
    "MIT": ["MIT License", "MIT Licence"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-clause BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "GPL-1.0": ["GNU General Public License, version 1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0"],
    "CPL-1.0": ["Common Public License Version 1.0", "Common Public License 1.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "WTFPL": ["Do What The F*ck You Want To Public License", "WTFPL"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License Version 2"],
    "Ruby": ["Ruby License"],
    "OpenSSL": ["OpenSSL License"],
    "PHP-3.01": ["PHP License v3.01", "PHP License, version 3.01"],
    "EUPL-1.2": ["European Union Public Licence v1.2", "EUPL-1.2"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "AFL-3.0": ["Academic Free License version 3.0", "Academic Free License v3.0"],
    "OSL-3.0": ["Open Software License version 3.0", "Open Software License v3.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "UPL-1.0": ["Universal Permissive License v 1.0", "Universal Permissive License, Version 1.0"],
    "MulanPSL-2.0": ["Mulan PSL v2", "Mulan Permissive Software License, Version 2"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"],
    "SSPL-1.0": ["Server Side Public License, version 1"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License"],
    "X11": ["X11 License"],
    "Vim": ["Vim License"],
}
# Parts of Creative Commons names.
_CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
# What precedes a name in a notice. A licence of "or later" has it behind.
_NOTICES = ["released under", "licensed under", "this work is licensed under", "this project is licensed under", "this software is licensed under", "this software is released under", "distributed under", "this program is licensed under", "this code is licensed under", "available under"]
_ARTICLES = ["the", "a", "an"]
_LATER = ["{} or later", "{} or (at your option) any later version", "{} or any later version"]

# Sentences of public licence texts.
SENTENCES = {
    "reserved": "All rights reserved",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "x11-names": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "apache-use": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-2": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl1-file": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",
    "epl1-made": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cddl-file": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "wtfpl-grant": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ofl-file": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "public-domain": "This work is in the public domain",
}
# Fixed values: (licence, identifiers in order); one with a mark may be missing.
RULES = [
    ("MIT", "mit-grant mit-keep mit-as-is? mit-liable?"),
    ("MIT", "mit-grant"),
    ("X11", "mit-grant mit-keep mit-as-is mit-liable? x11-names"),
    ("ISC", "isc-grant isc-as-is?"),
    ("0BSD", "0bsd-grant isc-as-is?"),
    ("Apache-2.0", "apache-use apache-copy? apache-as-is? apache-see?"),
    ("BSD-2-Clause", "reserved? bsd-grant bsd-source bsd-binary bsd-as-is?"),
    ("BSD-3-Clause", "reserved? bsd-grant bsd-source bsd-binary bsd-names bsd-as-is?"),
    ("BSD-3-Clause", "reserved? bsd-grant bsd-source bsd-binary bsd-names-2 bsd-as-is?"),
    ("BSD-4-Clause", "reserved? bsd-grant bsd-source bsd-binary bsd-ads bsd-names bsd-as-is?"),
    ("BSD-4-Clause", "reserved? bsd-grant bsd-source bsd-binary bsd-ads bsd-names-2 bsd-as-is?"),
    ("MPL-2.0", "mpl-form mpl-copy?"),
    ("MPL-1.1", "mpl1-file"),
    ("EPL-1.0", "epl1-made"),
    ("EPL-2.0", "epl2-made"),
    ("CDDL-1.0", "cddl-file"),
    ("Unlicense", "unlicense"),
    ("Zlib", "zlib-as-is zlib-liable? zlib-grant"),
    ("BSL-1.0", "boost-grant"),
    ("WTFPL", "wtfpl-grant"),
    ("CC0-1.0", "cc0-waive"),
    ("PostgreSQL", "postgresql-grant"),
    ("OFL-1.1", "ofl-file"),
    ("LicenseRef-Public-Domain", "public-domain"),
    ("LicenseRef-All-Rights-Reserved", "reserved"),
]

#: What may stand around a sentence.
_BOUNDARY = r"""[.!?]+(?=[ \t\r\n]|$)|[:;()\[\]{}"|*#<>\r\n–—“”]|//|--"""


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _gnu() -> list[tuple[str, str, str]]:
    """(identifier, licence, sentence) of the headers of the GNU licences."""
    kinds = {"GPL": ("program", "GNU General Public License", ("1", "2", "3")), "LGPL": ("library", "GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("program", "GNU Affero General Public License", ("3",))}
    out = []
    for kind, (what, name, versions) in kinds.items():
        for v in versions:
            full = f"{kind}-{v if '.' in v else v + '.0'}"
            start = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
            out.append((f"{full}-only", full, f"{start}version {v} of the License"))
            for either in ("either version", "version"):
                out.append((f"{full}-later", f"{full}-or-later", f"{start}{either} {v} of the License, or (at your option) any later version"))
    return out


def names() -> dict[str, list[str]]:
    """All names of licences, with those of Creative Commons and of later versions."""
    out = {k: list(v) for k, v in NAMES.items()}
    for (part, said), (version, where) in product(_CC_PARTS.items(), _CC_VERSIONS.items()):
        out[f"CC-{part}-{version}"] = [f"CC {part} {version}", f"CC-{part}-{version}", f"Creative Commons {said} {version} {where} License", f"Creative Commons {said} {version} License"]
    for k in [k for k in NAMES if "GPL" in k]:
        out[f"{k}-or-later"] = [later.format(n) for n in NAMES[k] for later in _LATER]
    return out


def tables() -> tuple[dict[str, str], dict[str, str], dict[str, tuple[str, str]]]:
    """Identifiers by normalised sentence; licences by normalised name; (rule, licence)
    by sequence of identifiers."""
    known = {normal(s): name for name, s in SENTENCES.items()}
    named: dict[str, str] = {}
    rules: dict[str, tuple[str, str]] = {}
    for name, licence, sentence in _gnu():
        known[normal(sentence)] = name
        for tail in ("", ",gpl-hope", ",lgpl-hope"):
            rules.setdefault(name + tail, (name, licence))
    for licence, own in names().items():
        for n in own:
            named.setdefault(normal(n), licence)
        for tag in {licence, f"{licence}-only" if "GPL" in licence and "later" not in licence else licence}:
            known.setdefault(normal(f"SPDX-License-Identifier: {tag}"), f"spdx/{licence}")
        for kind in ("notice", "title", "spdx"):
            rules[f"{kind}/{licence}"] = (f"{kind}/{licence}", licence)
    for licence, wanted in RULES:
        parts = [((p[:-1], None) if p.endswith("?") else (p,)) for p in wanted.split()]
        first = next(p[0] for p in parts if len(p) == 1)
        for chosen in product(*parts):
            rules.setdefault(",".join(c for c in chosen if c), (f"{licence}:{first}", licence))
    return known, named, rules


KNOWN, NAMED, SEQUENCES = tables()

#: Each known sentence has one of these.
ANCHORS = "licen|permi|copyright|redistrib|warrant|reserved|gpl|domain|cc[ -]by|cc0|creative|wtfpl|mulan|eupl|advertising|liable|obtain"


def _longest(options) -> str:
    return "|".join(sorted(options, key=lambda x: (-len(x), x)))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    if missing := [s for s in [*KNOWN, *NAMED] if not re.search(ANCHORS, s)]:
        raise ValueError(f"no anchor in {missing}")
    marked = F.regexp_replace(F.lower(text), _BOUNDARY, "\n")
    marked = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\n]+", " "), " *\n[ \n]*", "\n")
    before = f"(?:(?:{_longest(_NOTICES)}) )?(?:(?:{_longest(_ARTICLES)}) )?"
    options = f"{_longest(KNOWN)}|{before}(?:{_longest(NAMED)})"
    # a boundary may stand for a blank
    sentence = r"(?:^|\n) ?(" + options.replace(" ", "[ \n]") + r")(?= ?(?:\n|$))"
    found = F.regexp_extract_all(marked, F.lit(sentence), F.lit(1))

    def name(s: Column) -> Column:
        plain = F.replace(s, F.lit("\n"), F.lit(" "))
        bare = F.regexp_replace(plain, f"^{before}", "")
        kind = F.when(plain.rlike(f"^(?:{_longest(_NOTICES)}) "), "notice/").otherwise("title/")
        return F.coalesce(F.try_element_at(_map(KNOWN), plain), F.concat(kind, F.try_element_at(_map(NAMED), bare)))

    return F.when(text.rlike(f"(?i){ANCHORS}"), F.transform(found, name)).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """What the rules make of a sequence, as the sequences of identifiers that they use up:
    at each place the longest that fits."""
    rule = rf"(?<=,)(?:{_longest(SEQUENCES)})(?=,)"
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")), F.lit(rule), F.lit(0)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sequence, rules, licenses."""
    ids = docs.select(F.col(id_col), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    rows = ids.select(id_col, "ids", F.when(F.size("ids") > 0, matched(F.col("ids"))).otherwise(F.array().cast("array<string>")).alias("m"))

    def named(k: int) -> Column:
        table = _map({seq: rule[k] for seq, rule in SEQUENCES.items()})
        return F.array_join(F.array_distinct(F.transform("m", lambda s: F.element_at(table, s))), ",")

    has = F.size("m") > 0
    return rows.select(id_col, F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sequence"), F.when(has, named(0)).otherwise("").alias("rules"), F.when(has, named(1)).otherwise("").alias("licenses"))


#: By hand, and by another way: sentences cut out by line and mark, and looked up in a
#: short list of notices; each is a rule by itself.
ORACLE = r"""
WITH notice(s, id, licence) AS (VALUES
  ('released under the mit license', 'notice/MIT', 'MIT'),
  ('licensed under the mit license', 'notice/MIT', 'MIT'),
  ('the mit license', 'title/MIT', 'MIT'),
  ('licensed under the apache license version 2 0', 'notice/Apache-2.0', 'Apache-2.0'),
  ('this work is licensed under the gnu general public license version 2', 'notice/GPL-2.0', 'GPL-2.0'),
  ('this work is licensed under the gnu general public license version 3', 'notice/GPL-3.0', 'GPL-3.0'),
  ('licensed under cc by 4 0', 'notice/CC-BY-4.0', 'CC-BY-4.0'),
  ('licensed under cc by sa 4 0', 'notice/CC-BY-SA-4.0', 'CC-BY-SA-4.0'),
  ('licensed under cc by nc 4 0', 'notice/CC-BY-NC-4.0', 'CC-BY-NC-4.0'),
  ('all rights reserved', 'reserved', 'LicenseRef-All-Rights-Reserved')),
parts AS (
  SELECT doc_id, row_number() OVER () AS r, string_split_regex(lower(coalesce(text, '')), '[.!?]+(?:[ \t\r\n]|$)|[:;()\[\]{}"|*#<>\r\n–—“”]|//|--') AS p FROM documents),
each AS (SELECT r, trim(regexp_replace(unnest(p), '[^a-z0-9]+', ' ', 'g'), ' ') AS s, unnest(range(1, len(p) + 1)) AS i FROM parts),
found AS (SELECT r, i, id, licence FROM each JOIN notice ON each.s = notice.s),
firsts AS (SELECT r, id, licence, min(i) AS i FROM found GROUP BY r, id, licence),
names AS (SELECT r, licence, min(i) AS i FROM found GROUP BY r, licence),
ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY i) AS seq FROM found GROUP BY r),
rules AS (
  SELECT r, string_agg(CASE id WHEN 'reserved' THEN 'LicenseRef-All-Rights-Reserved:reserved' ELSE id END, ',' ORDER BY i) AS rules
  FROM firsts GROUP BY r),
licences AS (SELECT r, string_agg(licence, ',' ORDER BY i) AS licenses FROM names GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(seq, '') AS sequence, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM parts LEFT JOIN ids ON parts.r = ids.r LEFT JOIN rules ON parts.r = rules.r LEFT JOIN licences ON parts.r = licences.r
"""
