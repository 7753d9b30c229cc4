"""Quality classifier: conjunctive rules from tree paths, lasso logistic weights, compiled to Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batches_of, rows
from .storage import Workspace

STATISTICS = ["log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "letters", "upper", "digits", "punctuation", "signs", "pipes", "shouts", "beyond_ascii", "breaks", "distinct_lines", "line_words", "entropy", "signed_words", "short_words", "capital_words", "repeated_pairs"]
#: What training may take at most, whatever the corpus.
TRAIN_ROWS = 20_000

_KIND = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [_b < 128 and _c.isalpha(), 65 <= _b <= 90, 48 <= _b <= 57, _c in ".,;:!?'\"()-", _b < 128 and _c.isprintable() and not _c.isalnum() and _c not in " .,;:!?'\"()-", _c == "|", _c in "!?", _b >= 128]
_SIGNED = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; an empty or null one gives zeros. Linear in its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper, digits, punct, signs, pipes, shouts, beyond = (counts @ _KIND / n).tolist()
    p = counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(hash, words), np.int64, len(words))
    pairs = len(np.unique(ids[:-1] * 1000003 ^ ids[1:])) if len(ids) > 1 else 0
    return [
        log2(1 + n), log2(1 + len(words)), float(sizes.mean()), log2(1 + int(sizes.max())), len(seen) / len(words), max(seen.values()) / len(words),
        letters, upper, digits, punct, signs, pipes, shouts, beyond, int(counts[10]) / len(words), len(set(lines)) / len(lines), len(words) / len(lines),
        float(-(p * np.log2(p)).sum()), sum(w[-1] in _SIGNED or w[0] in _SIGNED for w in words) / len(words), float((sizes <= 2).mean()),
        sum(65 <= w[0] <= 90 for w in words) / len(words), 1 - pairs / max(1, len(words) - 1),
    ]


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and one double column for each of STATISTICS."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = kept.drop("__text").schema.jsonValue()
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("__text").schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, i]) for i in range(found.shape[1]))], names=[f["name"] for f in schema["fields"]] + STATISTICS)

    return kept.mapInArrow(run, f"{types}, " + ", ".join(f"{c} double" for c in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """All of its tests hold: (statistic, True for <= and False for >, bound)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(c) <= F.lit(x)) if low else (F.col(c) > F.lit(x)) for c, low, x in self.tests])


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Chance of label 1, as a column expression over STATISTICS: no Python, no model object."""
        total = F.lit(self.intercept)
        for rule, w in self.weights:
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(text: str) -> set[Rule]:
    """Every path from a root to an inner or outer node, as a rule; text is a Spark tree ensemble's description."""
    out, path = set(), []
    for line in text.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        elif m := _SPLIT.match(line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (STATISTICS[int(m[3])], m[4] == "<=", float(m[5])))]
            tightest: dict[tuple[str, bool], float] = {}
            for _, (c, low, x) in path:
                tightest[c, low] = min(x, tightest.get((c, low), x)) if low else max(x, tightest.get((c, low), x))
            out.add(Rule(tuple(sorted((c, low, x) for (c, low), x in tightest.items()))))
    return out


def fit(table: DataFrame, label: str, *, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """A rule model from rows with STATISTICS and a 0/1 label; table must be bounded, see TRAIN_ROWS.

    Trees are grown and weights fitted by Spark's own learners. Rules that hold for the same training rows
    count once; lasso leaves few. Without rows of both labels, the score is the share of label 1 (0.5 if
    there are no rows).
    """
    counts = table.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).first()
    n, ones = counts["n"], counts["ones"] or 0
    if not 0 < ones < n:
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(share / (1 - share))), ())
    data = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(table).select("x", F.col(label).cast("double").alias("y"), *STATISTICS)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(data)
    rules = sorted(tree_rules(forest.toDebugString), key=lambda r: (len(r.tests), r.tests))
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))), ())
    hits = np.ones((n, len(rules)), bool)
    seen = table.select(*STATISTICS, F.col(label)).toPandas()  # at most TRAIN_ROWS rows
    for k, rule in enumerate(rules):
        for c, low, x in rule.tests:
            hits[:, k] &= (seen[c] <= x) if low else (seen[c] > x)
    distinct: dict[bytes, int] = {}
    for k in range(len(rules)):
        if 0 < hits[:, k].sum() < n:
            distinct.setdefault(min(hits[:, k].tobytes(), (~hits[:, k]).tobytes()), k)
    chosen = [rules[k] for k in sorted(distinct.values())]
    as_rules = data.select("y", *(F.when(r.column(), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(chosen)))
    vectors = VectorAssembler(inputCols=[f"r{k}" for k in range(len(chosen))], outputCol="x").transform(as_rules).select("x", "y").cache()
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(vectors)
    vectors.unpersist()
    weights = tuple((r, float(w)) for r, w in zip(chosen, lasso.coefficients.toArray(), strict=True) if w)
    return RuleModel(float(lasso.intercept), weights)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality.

    Statistics of all whole texts are made once and written. The model learns from at most train_rows
    labelled documents outside the held-out fifth, the first by a hash of doc_id; a document with
    several labels counts once, with the larger, and of several rows with one doc_id the model sees the one with
    the least statistics; null labels and null doc_ids are left out. Scores see
    statistics only. Null and empty texts are scored like others; a null doc_id is not held out.
    """
    ws = Workspace(docs.sparkSession, "quality")
    stats = ws.save(with_statistics(docs, ["doc_id"]), "statistics")
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    one = stats.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    train = one.select("s.*", "label").coalesce(4)
    model = fit(ws.save(train, "train"), "label")
    score = model.score()
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
