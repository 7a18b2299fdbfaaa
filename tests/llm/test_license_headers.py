"""The genuine header of each rule of several sentences: a paragraph a line, wrapped, and as a comment."""

import textwrap

import duckdb
import pytest

from grantlens.llm import licenses
from tests.llm.helpers import frame
from tests.llm.test_licenses import MIT

APACHE = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
GPL_WARRANTY = """
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
"""
GPL_3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
"""
GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
MIT_END = """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
ISC_END = """ IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LGPL_21 = GPL_2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
LGPL_WARRANTY = GPL_WARRANTY.replace("GNU General", "GNU Lesser General")
LGPL_3, AGPL_3 = (GPL_3.replace("GNU General", f"GNU {kind} General") for kind in ("Lesser", "Affero"))
HEADERS = [
    ("apache-2.0-full-notice", "Apache-2.0", APACHE),
    ("apache-2.0-notice", "Apache-2.0", APACHE.split("Unless")[0]),
    ("mit-text", "MIT", MIT),
    ("mit-full-text", "MIT", MIT + MIT_END),
    ("gpl-3.0-notice", "GPL-3.0", GPL_3 + GPL_WARRANTY),
    ("gpl-3.0-grant", "GPL-3.0", GPL_3),
    ("gpl-2.0-notice", "GPL-2.0", GPL_2 + GPL_WARRANTY),
    ("gpl-2.0-grant", "GPL-2.0", GPL_2),
    ("gpl-3.0-uncut-notice", "GPL-3.0", (GPL_3 + GPL_WARRANTY).replace(": ", ", ").replace(";", ",")),
    ("gpl-2.0-uncut-notice", "GPL-2.0", (GPL_2 + GPL_WARRANTY).replace(";", ",")),
    ("lgpl-2.1-notice", "LGPL-2.1", LGPL_21 + LGPL_WARRANTY.replace("program", "library")),
    ("lgpl-2.1-grant", "LGPL-2.1", LGPL_21),
    ("lgpl-3.0-notice", "LGPL-3.0", LGPL_3 + LGPL_WARRANTY),
    ("lgpl-3.0-grant", "LGPL-3.0", LGPL_3),
    ("agpl-3.0-notice", "AGPL-3.0", AGPL_3 + GPL_WARRANTY.replace("GNU General", "GNU Affero General")),
    ("agpl-3.0-grant", "AGPL-3.0", AGPL_3),
    ("mpl-2.0-https-notice", "MPL-2.0", MPL),
    ("mpl-2.0-notice", "MPL-2.0", MPL.replace("https", "http")),
    ("isc-text", "ISC", ISC),
    ("isc-full-text", "ISC", ISC + ISC_END),
    ("bsd-2-text", "BSD-2-Clause", BSD_2),
    ("bsd-3-text", "BSD-3-Clause", BSD_2 + BSD_3),
    ("bsd-2-full-text", "BSD-2-Clause", BSD_2 + BSD_END),
    ("bsd-3-full-text", "BSD-3-Clause", BSD_2 + BSD_3 + BSD_END),
    ("spdx-LGPL-2.1-or-later", "LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later\nCopyright 2020 Somebody"),
    ("", "", "SPDX-License-Identifier: MIT OR Apache-2.0"),
]


def wrapped(text, mark="", width=80):
    lines = [textwrap.wrap(line, width - len(mark), break_on_hyphens=False, break_long_words=False) or [""] for line in text.split("\n")]
    return "\n".join((mark + line).rstrip() for part in lines for line in part)


@pytest.fixture(scope="module", params=["long lines", "80 columns", "narrow", "comment", "after a title", "carriage returns"])
def docs(spark, request):
    form = {
        "long lines": lambda text: text,
        "80 columns": wrapped,
        "narrow": lambda text: wrapped(text, width=20),
        "comment": lambda text: "/*\n" + wrapped(text, " * ") + "\n */\nint main;",
        "after a title": lambda text: "A Title Without A Mark\n" + wrapped(text, "# "),
        "carriage returns": lambda text: wrapped(text).replace("\n", "\r\n"),
    }[request.param]
    # A tag's expression ends with its line, so tags are not wrapped.
    texts = [text if "SPDX" in text else form(text) for _, _, text in HEADERS]
    return frame(spark, list(enumerate(texts)))


def test_genuine_headers_match(docs):
    found = {r.doc_id: (r.rules, r.licenses) for r in licenses.scan(docs).collect()}
    assert found == {k: (rules, spdx) for k, (rules, spdx, _) in enumerate(HEADERS)}
    several = {name for name, _, sequence in licenses.RULES if len(sequence) > 1}
    assert several <= {name for rules, _, _ in HEADERS for name in rules.split(",")}


def test_long_rules_take_their_identifiers(spark):
    texts = [
        "Released under the MIT License.\n" * 3,  # one rule, three times
        BSD_2 + BSD_3 + "Between.\n" + BSD_2,  # both licences, each by its own sentences
        "\n".join(["All rights reserved"] * 500),
        "Some words, all rights reserved",  # neither begins nor ends with the line
        "all rights reserved to somebody",
    ]
    found = {r.doc_id: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert [found[k].rules for k in range(5)] == ["mit-named", "bsd-3-text,bsd-2-text", "reserved", "", ""]
    assert [found[k].n_sentences for k in range(5)] == [3, 7, 500, 0, 0]


def test_genuine_headers_equal_sql(docs):
    df = licenses.scan(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({licenses.scan_sql()})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)
