"""Words of a line in line dedup: white space of any kind and number parts them."""

from __future__ import annotations

import pytest

from segline.llm import line_dedup


@pytest.mark.parametrize(("blank", "words", "removed"), [(" ", 27, 2), (" ", 24, 0), ("\t", 27, 2), ("\t", 24, 0), ("  ", 27, 2), ("  ", 24, 0), (" \t ", 24, 0), ("\u00a0", 27, 2), ("\u3000", 27, 2), ("\u3000", 24, 0)])
def test_line_dedup_counts_words_by_any_blank(spark, blank, words, removed):
    text = "\n".join(blank.join(f"{k}{i}" for i in range(words)) for k in "ab")
    docs = spark.createDataFrame([(1, f"first\n{text}"), (2, f"second\n{text}\n \u00a0 ")], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.drop_repeated_runs(docs).orderBy("doc_id").collect()] == [0, removed]
