"""Licence texts count only if their whole mandatory wording is there."""

from __future__ import annotations

import duckdb
import pytest

from segline.llm import license_scan, oracles

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n4. Neither the name"
CASES = [
    (MIT, "mit"), (BSD, "bsd-3-clause"), (f"{MIT}\n\n{BSD}", "bsd-3-clause,mit"), (BSD.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "c) ").replace("the copyright holder nor", "Acme Widgets, Inc. nor"), "bsd-3-clause"),
    (MIT[:200], ""), (MIT[:-40], ""), (MIT.replace("sublicense, and/or sell", "and sublicense"), ""), (MIT.replace("without restriction", "without commercial use"), ""),
    (BSD.replace("3. Neither the name", ADVERT), ""), (BSD[: BSD.index("THIS SOFTWARE IS")], ""), (BSD.replace("must retain", "need not retain"), ""), (BSD.replace("1. Redis", "not redis"), ""),
]


def test_license_texts_need_their_whole_wording():
    scanner = license_scan.Scanner()
    for text, labels in CASES:
        words = license_scan.words_of(text)
        assert ",".join(sorted({x for *_, x in scanner.matches(words)})) == labels, text
    (match,) = scanner.matches(license_scan.words_of(BSD))
    assert match[:2] == (0, len(license_scan.words_of(BSD)))


def test_license_sql_agrees_on_whole_texts():
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [[k, text] for k, (text, _) in enumerate(CASES)])
    cur = db.execute(oracles.LICENSE)
    names = [c[0] for c in cur.description]
    got = {r[names.index("doc_id")]: r[names.index("labels")] for r in cur.fetchall()}
    assert [got[k] for k in range(len(CASES))] == [labels for _, labels in CASES]
