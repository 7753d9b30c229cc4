"""The pipeline's stages against plain versions, on odd rows, and op9's scores by hand."""

from __future__ import annotations

import math
import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from segline.llm import quality_rules
from tests.llm.test_operators import SF, empty_docs, jaccard_components, odd_docs, rule_lines


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, stage):
    for df in (odd_docs(spark), empty_docs(spark)):
        out = stage(spark, df, SF)
        rows = out.collect()
        if stage is not pipeline.packing:
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            every = {r["doc_id"] for r in df.collect()}
            assert {r["doc_id"] for r in rows} <= every
        assert bool(rows) == bool(df.take(1))


def test_near_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = {k: " ".join(base[:40] + [f"n{k}"] + base[41:]) for k in range(10, 20)} | {k: " ".join(f"o{k}x{i}" for i in range(30)) for k in range(5)} | {30: None, 31: ""}
    rows = [(d, t, "s", 1) for d, t in texts.items()]
    rows += [rows[0], rows[11], rows[11], (3, "another text of three", "s", 1), (None, "x", "s", 1), (None, "x", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, component_id long")
    got = Counter(r["doc_id"] for r in pipeline.near(spark, df, SF).collect())
    want = {d for d, (_, root) in jaccard_components({**texts, 3: texts[3]}, 5).items() if d == root}
    assert got == Counter(dict.fromkeys(want, 1) | {None: 2})


def test_line_stage_equals_the_rule(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.lines(spark, df, SF).collect()}
    after = dict(zip([d for d, _ in docs], rule_lines(docs), strict=True))
    want = {d: (after[d], len(after[d])) for d, t in docs if after[d] == t or after[d].strip(" ") != ""}
    assert got == want


def test_quality_stage_drops_what_scores_low(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    verdict = {r["doc_id"]: r["predicted"] for r in quality_rules.score_documents(docs, labels).collect()}
    assert {r["doc_id"] for r in pipeline.quality(spark, docs, SF).collect()} == {d for d, p in verdict.items() if p == 1}


def test_scores_are_the_rules_by_hand(spark):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    stats = quality_rules.with_statistics(docs, ["doc_id"]).withColumn("label", (F.col("doc_id") % 2).cast("int"))
    a, b = quality_rules.STATISTICS[0], quality_rules.STATISTICS[-1]
    middle = sorted(r[a] for r in stats.collect())[len(stats.columns) // 2]
    model = quality_rules.RuleModel(-0.3, ((quality_rules.Rule(((a, True, middle),)), 1.5), (quality_rules.Rule(((a, False, middle), (b, True, 0.0))), -2.0)))
    for r in stats.withColumn("score", model.score()).collect():
        total = -0.3 + (1.5 if r[a] <= middle else 0) + (-2.0 if r[a] > middle and r[b] <= 0.0 else 0)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-12)
    fitted = quality_rules.fit(stats, "label", trees=4)
    for r in stats.withColumn("score", fitted.score()).collect():
        total = fitted.intercept + sum(w for rule, w in fitted.weights if all(r[c] <= x if low else r[c] > x for c, low, x in rule.tests))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_repeated_rows_train_on_one_of_them(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = [(i, ("good words here " if i % 2 else "$$ %% !! ") * (i % 7 + 3)) for i in range(60)] + [(i, "other") for i in range(0, 60, 3)]
    runs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(docs)
        out = quality_rules.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(seed + 2), labels)
        runs.append(sorted((r["doc_id"], round(r["score"], 6)) for r in out.collect()))
    assert [d for d, _ in runs[0]] == [d for d, _ in runs[1]]
