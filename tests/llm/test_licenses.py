from __future__ import annotations

import duckdb
import pytest

from quarry.llm import licenses
from quarry.llm.queries import ORACLE_SQL, op4_license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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


def found(spark, text):
    return licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, "MIT"), ("Foo bar.\nReleased under the MIT License.\nMore.", "MIT"), ("LICENSED *** under the Apache License,   Version 2.0.", "Apache-2.0"), ("Not licensed under the MIT license at all.", ""),
        ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "CC-BY-NC-4.0,CC-BY-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ],
)
def test_rules(spark, text, want):
    assert found(spark, text) == want


def test_longer_rules_take_their_sentences(spark):
    names = {v: k for k, v in licenses.SENTENCES.items()}
    bsd3 = ". ".join(names[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))
    assert found(spark, bsd3) == "BSD-3-Clause"
    assert found(spark, ". ".join(names[i] for i in ("bsd-source", "bsd-grant", "bsd-binary"))) == ""


def test_odd_rows(spark, odd, none):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and all(r["licenses"] == "" and r["n_sentences"] == 0 for r in rows)
    assert licenses.scan_licenses(none).count() == 0


def test_no_shuffle_and_no_python(spark, data):
    plan = op4_license_scan(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(map(tuple, op4_license_scan(spark, data).collect())) == sorted(c.execute(ORACLE_SQL["op4_license_scan"]).fetchall())


APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

BSD3 = BSD + """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""

LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""

WHOLE = {
    "Apache-2.0": (APACHE, "apache-grant,apache-copy,apache-asis,apache-see"), "MPL-2.0": (MPL, "mpl2-line,mpl2-copy"), "BSD-2-Clause": (BSD, "bsd-grant,bsd-source,bsd-binary"),
    "BSD-3-Clause": (BSD3, "bsd-grant,bsd-source,bsd-binary,bsd-endorse"), "GPL-3.0-or-later": (GPL, "gpl3-grant,gpl-warranty,gpl-see"), "LGPL-2.1-or-later": (LGPL, "lgpl21-grant"), "ISC": (ISC, "isc-grant"),
    "MIT": ("MIT License\n\nCopyright (c) 2021 J. Doe\n\n" + MIT, "mit-title,mit-grant,mit-notice,mit-asis,mit-liable"), "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "gpl-title,gpl3-version"),
}


def test_canonical_notices_are_read_whole(spark):
    """Plain, between prose, and as comments of several languages."""
    shapes = [lambda t: t, lambda t: "Some prose before. And\nmore\n\n" + t + "\nProse after.", *[lambda t, m=m: "\n".join(f"{m} {x}".rstrip() for x in t.split("\n")) for m in ("#", "//", " *", ";;", "--")]]
    rows = [(n, k, name, shape(text), ids) for n, shape in enumerate(shapes) for k, (name, (text, ids)) in enumerate(WHOLE.items())]
    docs = spark.createDataFrame([(10 * n + k, t) for n, k, _, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["sentences"]) for r in licenses.scan_licenses(docs).collect()}
    assert got == {10 * n + k: (name, ids) for n, k, name, _, ids in rows}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), (BSD + "\nReleased under the MIT License\nand prose goes on here", "BSD-2-Clause,MIT"),
        ("Released under the MIT License\nwith prose on the next line. " + ISC, "ISC,MIT"), ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this", "Apache-2.0"),
        ("\n" * 5000 + "MIT License" + " \n" * 5000, "MIT"), ("see section 2. licensed under\nthe mit license", "MIT"),
    ],
)
def test_both_readings_count(spark, text, want):
    assert found(spark, text) == want


BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""

ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""

#: Texts by hand with what they should be read as.
SAID = [
    (BSD + "3. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n", "BSD-3-Clause"),
    (BSD + "3. Neither the name of the University nor the\n   names of its contributors may be used to endorse or promote products\n   derived from this software without specific prior written permission.\n", "BSD-3-Clause"),
    (BSD + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n", "BSD-3-Clause"),
    (BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement.\n4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n", "BSD-4-Clause"),
    (BSD, "BSD-2-Clause"), (BOOST, "BSL-1.0"), (ZLIB, "Zlib"), (BSD3.replace("copyright holder", "Regents"), "BSD-3-Clause"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0"), ("// SPDX-License-Identifier: BSD-3-Clause AND MIT\nint x;", "MIT,BSD-3-Clause"), ("# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT", "MIT,GPL-2.0-only"), ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: Zlib", "Zlib"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("SPDX-License-Identifier: NoSuch-1.0", ""),
    ("Released under the MIT License, see LICENSE.", "MIT"), ("distributed under the terms of the MIT license", "MIT"), ("This project is licensed under the terms of the MIT License.", "MIT"), ("The code is available under the MIT licence; see the file LICENCE for details.", "MIT"), ("Published under an MIT License", "MIT"),
    ("This software is not licensed under the MIT License.", ""), ("It was never released under the GPLv3.", ""), ("Unless it is licensed under the MIT license.", ""),
    ("This library is distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("Released under the 2-clause BSD license.", "BSD-2-Clause"), ("licensed under the new BSD license", "BSD-3-Clause"),
    ("Licensed under Apache 2.0", "Apache-2.0"), ("This package is distributed under the Apache License 2.0", "Apache-2.0"), ("Provided under the terms and conditions of the Apache License, Version 2.0", "Apache-2.0"),
    ("Distributed under the GNU GPL v3", "GPL-3.0"), ("The program is released under GPLv2.", "GPL-2.0"), ("Licensed under the LGPL v2.1", "LGPL-2.1"), ("available under the GNU Affero General Public License version 3", "AGPL-3.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"), ("Published under the ISC license", "ISC"), ("Licensed under the zlib license", "Zlib"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("CC0 1.0 Universal", "CC0-1.0"), ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WTFPL"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("Frob is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"),
    (GPL.replace("This program is free", "Foo Bar is free").replace("This program is dist", "Foo Bar is dist"), "GPL-3.0-or-later"), (GPL.replace("General", "Lesser General"), "LGPL-3.0-or-later"), (GPL.replace("General", "Affero General"), "AGPL-3.0-or-later"), (LGPL.replace("library", "program"), "LGPL-2.1-or-later"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n", "AGPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n", "GPL-2.0"), ("Mozilla Public License Version 2.0\n", "MPL-2.0"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"), ("The Artistic License 2.0", "Artistic-2.0"), ("SIL OPEN FONT LICENSE Version 1.1", "OFL-1.1"), ("The licence of a driver is a card.", ""), ("Neither the name nor the place was known", ""), ("He published under the name of Fox.", ""), ("Our terms: available under the counter.", ""),
]


def test_texts_by_hand(spark):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(SAID)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs).collect()}
    assert [(t[:120], got[n], want) for n, (t, want) in enumerate(SAID) if sorted(got[n].split(",")) != sorted(want.split(","))] == []
    assert len({name for name, _ in licenses.ALL_RULES}) >= 30 and len(SAID) >= 55


def test_forms_in_python_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    said = ["".join(c if c.isalnum() else " " for c in t.lower().replace("licence", "license")) for t, _ in SAID]
    said = [" ".join(t.split()) for t in said]
    rows = spark.createDataFrame(list(enumerate(said)), "n int, s string").select("n", licenses._formed(F.col("s")).alias("f")).collect()
    assert {r["n"]: r["f"] for r in rows} == {n: licenses.form(s) for n, s in enumerate(said)}


def test_sql_on_notices(spark, tmp_path):
    rows = [(k, t) for k, (t, _) in enumerate(WHOLE.values())] + [(90, BSD3 + APACHE + MPL), (91, None), (92, ""), (93, "#\n# MIT License\n#\n\n\n1) Released under the MIT license\n")] * 2 + [(200 + n, t) for n, (t, _) in enumerate(SAID)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(map(tuple, licenses.scan_licenses(spark.read.parquet(str(tmp_path / "d"))).collect())) == sorted(c.execute(ORACLE_SQL["op4_license_scan"]).fetchall())
