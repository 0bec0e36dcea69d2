from sylva.llm import licenses

from .conftest import CLASHING  # noqa: F401

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL."""


BSD = """Copyright (c) 1998, The Owner. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{names}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
NAMES = """ * Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
APACHE = """#!/bin/sh
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
x=1
"""
GPL = """ /* This program is free software; you can redistribute it and/or modify
  * it under the terms of the GNU {kind}General Public License as published by
  * the Free Software Foundation; either version {v} of the License, or
  * (at your option) any later version. */"""

CASES = [
    (MIT, "MIT"),
    (BSD.format(names=NAMES), "BSD-3-Clause"),
    (BSD.format(names=""), "BSD-2-Clause"),
    (BSD.format(names=NAMES) + "\n----\n" + BSD.format(names=""), "BSD-3-Clause,BSD-2-Clause"),
    (APACHE, "Apache-2.0"),
    (GPL.format(kind="", v=2), "GPL-2.0-or-later"),
    (GPL.format(kind="Affero ", v=3), "AGPL-3.0-or-later"),
    (GPL.format(kind="Lesser ", v="2.1").replace("program", "library"), "LGPL-2.1-or-later"),
    ("// SPDX-License-Identifier: MPL-2.0\ncode", "MPL-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"),
    ("# SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0-or-later"),
    ("no mark\nReleased under the MIT License.\nmore", "MIT"),
    ("See x: Released under the MIT License.", "MIT"),
    ("Some words. Released under the\nMIT License", "MIT"),
    ("x. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ("Licensed under CC BY 4.0 now", ""),
    ("This isn't licensed under the MIT License", ""),
    ("All rights reserved. Licensed under the Apache License, Version 2.0.", "LicenseRef-All-Rights-Reserved,Apache-2.0"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ""),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Distributed under the GNU General Public License, version 2 or (at your option) any later version.", "GPL-2.0-or-later"),
    ("Boost Software License - Version 1.0\nDistributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("GPLv3", "GPL-3.0"),
    ("(\"The MIT License\")", "MIT"),
    ("MIT License. " * 3000, "MIT"),
]


def test_licences(spark):
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")).collect()}
    for k, (text, want) in enumerate(CASES):
        assert got[k].licenses == want, (text[:200], got[k])
    assert got[0].rules == "MIT:mit-grant" and got[0].sequence == "mit-grant,mit-keep,mit-as-is"
    assert got[1].sequence == "reserved,bsd-grant,bsd-source,bsd-binary,bsd-names,bsd-as-is" and got[1].rules == "BSD-3-Clause:bsd-grant"


def test_every_name_and_rule_is_recognised(spark):
    """Each name in a notice, each SPDX line, and each whole sequence of sentences."""
    rows = [(f"Some heading\nLicensed under the {n}.", licence) for licence, own in licenses.names().items() for n in own]
    rows += [(f"SPDX-License-Identifier: {licence}", licence) for licence in licenses.names()]
    said = dict(licenses.SENTENCES) | {name: s for name, _, s in licenses._gnu()}
    rows += [(".\n\n".join(said[p] for p in seq.split(",")) + ".", licence) for seq, (_, licence) in licenses.SEQUENCES.items() if not seq.startswith(("notice/", "title/", "spdx/"))]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert len({licence for _, licence in rows}) >= 70
    assert not [(rows[k][0], got[k], want) for k, (_, want) in enumerate(rows) if got[k] != want]


def test_odd_rows(spark, odd, empty):
    assert licenses.scan(odd).count() == odd.count()
    assert [r.licenses for r in licenses.scan(odd).filter("doc_id = 8").collect()] == ["MIT"]
    assert licenses.scan(empty).count() == 0


def test_plan_has_no_python(spark, odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
