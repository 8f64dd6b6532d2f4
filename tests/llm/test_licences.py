import duckdb
from pyspark.sql import functions as F

from millrace.llm import licences
from tests.llm import cases

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
TEXTS = {
    20: (ISC, "ISC", 0), 21: (BSD, "BSD-3-Clause", 0), 22: (ZLIB, "Zlib", 0), 23: ("Released under the MIT.", "MIT", 0), 24: ("published under WTFPL", "WTFPL", 0),
    25: ("                 Apache License\n           Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0", 0),
    1: (MIT, "MIT", 0), 2: (APACHE, "Apache-2.0", 0), 3: ("Some words.\nReleased under the MIT License.", "MIT", 0),
    4: ("no stop before\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 0),
    5: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0), 6: ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", 0),
    7: ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0. LICENSED UNDER THE MIT LICENSE!", "MIT,Apache-2.0", 0),
    8: ("All rights reserved.", "", 1), 9: ("The MIT licence is often mentioned.", None, 0),
    10: ("See the License for the specific language governing permissions and limitations under the License.", "", 1),
    12: (GPL, "GPL-2.0-or-later", 0),
    11: (GPL.replace("Foundation; either", "Foundation, either"), "GPL-2.0-or-later", 0),
}


def test_licences_are_recognised(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in TEXTS.items()], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.unmatched) for r in licences.licences(df).collect()}
    assert got == {i: (name, n) for i, (_, name, n) in TEXTS.items() if name is not None}


VERSION_3 = """    This {it} is free software: you can redistribute it and/or modify
    it under the terms of the GNU {name} Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This {it} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {name} Public License for more details.
"""
NOTICES = [
    (VERSION_3.format(it="program", name="General"), "GPL-3.0-or-later"), (VERSION_3.format(it="library", name="Lesser General"), "LGPL-3.0-or-later"),
    (VERSION_3.format(it="program", name="Affero General"), "AGPL-3.0-or-later"), (VERSION_3.format(it="program", name="General").replace("    ", " * "), "GPL-3.0-or-later"),
    (" ".join(VERSION_3.format(it="program", name="General").split()), "GPL-3.0-or-later"), (VERSION_3.format(it="program", name="General").replace("is free software", "is free\n    software"), "GPL-3.0-or-later"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("Released under an MIT license.", "MIT"),
]


def test_notices_of_version_3_and_with_an_article(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)]
    got = {r.doc_id: (r.licences, r.unmatched) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (name, 0) for i, (_, name) in enumerate(NOTICES)}


def test_plan_has_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    plan = licences.licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    extra = spark.createDataFrame([(None, "Licensed under the MIT License."), (5, "Licensed under the MIT License.")] * 2, "doc_id long, text string")
    docs = cases.odd(spark).unionByName(extra, allowMissingColumns=True)
    got = [(r.doc_id, r.licences) for r in licences.licences(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, "MIT"), (5, "MIT")] * 2, key=str)
    assert licences.licences(cases.empty(spark)).count() == 0


def test_sql_agrees_on_whole_licences(spark):
    rows = [(i, t) for i, (t, *_) in TEXTS.items()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = set(con.sql(licences.oracle()).fetchall())
    got = {tuple(r) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sentences", "licences", F.col("unmatched")).collect()}
    assert got == want


def test_no_known_sentence_passes_the_gate_unseen(spark):
    """Every known sentence by itself is found, in capitals and broken over lines too."""
    rows = [(i, s.upper().replace(" ", "\n ") if i % 2 else s) for i, s in enumerate(licences.SENTENCES)]
    got = {r.doc_id for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(len(rows)))
