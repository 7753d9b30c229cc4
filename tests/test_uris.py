"""URI references against the examples of RFC 3986, 5.4, and against the standard library."""

from __future__ import annotations

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from segline.functions.scalars import attributes, resolve_uri

BASE = "http://a/b/c/d;p?q"
#: The references of RFC 3986, 5.4.1 and 5.4.2, and what they are from BASE.
EXAMPLES = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("g;x?y#s", "http://a/b/c/g;x?y#s"), ("", "http://a/b/c/d;p?q"),
    (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"), ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"),
    ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"),
    ("g?y/./x", "http://a/b/c/g?y/./x"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/./x", "http://a/b/c/g#s/./x"), ("g#s/../x", "http://a/b/c/g#s/../x"),
]


def test_examples_of_the_standard(spark):
    df = spark.createDataFrame(EXAMPLES, "ref string, want string").withColumn("got", resolve_uri(F.lit(BASE), "ref"))
    assert {r["ref"]: r["got"] for r in df.collect()} == dict(EXAMPLES)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_references_as_the_library_has_them(spark):
    rng = random.Random(1)
    part = lambda: rng.choice(["a", "b.ts", "..", ".", "x;y", "k%20", "c..d", "é"])
    tail = lambda: rng.choice(["", "", "?t=1/../2", "?a#b", "#f/./g"])
    rows = []
    for _ in range(3000):
        base = rng.choice(["https://h.example:80", "http://u@h", "HTTP://H"]) + "".join("/" + rng.choice("abc") for _ in range(rng.randrange(4))) + rng.choice(["", "/"]) + tail()
        ref = rng.choice(["", "/", "//z.example/", "ftp://y/"]) + "/".join(part() for _ in range(rng.randrange(1, 6))) + rng.choice(["", "/"]) + tail()
        rows.append((base, ref))
    rows += [(None, "../a"), ("", "a/b"), ("a/b/p", "../k"), ("https://h/p", "data:text/plain,../x"), ("x/", "https://h/a")]
    got = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", resolve_uri("base", "ref").alias("got")).collect()
    for r in got:
        if not (r["ref"].startswith(("ftp:", "//", "../a"))):  # the library leaves dots of references with a host
            assert r["got"] == urljoin(r["base"] or "", r["ref"]), r
    assert spark.range(1).select(resolve_uri(F.lit(BASE), F.lit(None).cast("string"))).first()[0] is None


def test_attributes(spark):
    lines = ['#EXT-X-KEY:METHOD=AES-128,URI="a,METHOD=x",IV=0x1,IV=0x2', "#EXT-X-MAP:", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(attributes("line")).collect()]
    assert got == [{"METHOD": "AES-128", "URI": "a,METHOD=x", "IV": "0x2"}, {}, None]
