"""Nearest neighbours by inverted lists and adaptive dimension scan: candidates are abandoned on partial distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

#: Rows the centroids and the rotation are fitted on at most; rows of a bin and queries of a lot, which one task scans.
FIT_ROWS, CHUNK, QUERY_CHUNK = 16_384, 4_096, 2_048
BLOCK = 16  # dimensions that a hypothesis test goes by
#: Pairs of one step of a scan, and the share of them below which survivors are read one by one.
TILE, SPARSE = 1 << 18, 0.05
NO_BAR = (float("-inf"), (1 << 63) - 1)


class Index:
    """Bounded, driver-made parts of the index: centroids, rotation, and the norm that turns products to distances.

    The largest inner product is the least distance once each vector x gets a coordinate sqrt(M^2 - |x|^2)
    and each query 0, with M the largest norm of all. A random rotation spreads a distance evenly over
    dimensions, so a distance over the first d of D, times D/d, estimates the whole.
    """

    def __init__(self, sample: np.ndarray, norm: float, lists: int, seed: int = 11, rounds: int = 12):
        rng = np.random.default_rng(seed)
        self.norm, self.width = norm, sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((self.width, self.width)))[0]
        x = self.lift(sample)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            near = self._nearest(x, centres)
            for k in range(len(centres)):
                own = x[near == k]
                centres[k] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
        # lists that lie along one direction follow each other, so small ones that share a bin are near
        self.centres = centres[np.argsort((centres - centres.mean(axis=0)) @ np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0], kind="stable")]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1) @ self.rotation

    def turn(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.rotation

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = np.einsum("ij,ij->i", centres, centres) / 2
        return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and its distance from that list's centre."""
        lifted = self.lift(x)
        own = self._nearest(lifted, self.centres)
        return own, np.sqrt(np.square(lifted - self.centres[own]).sum(axis=1))

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distances from each query to each centre."""
        t = self.turn(q)
        c = self.centres
        return np.sqrt(np.maximum(0, np.einsum("ij,ij->i", t, t)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * t @ c.T))

    def beyond(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that stands for a score."""
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q) + self.norm**2 - 2 * score))


def _scan(index: Index, lists, ids, vectors, q_ids, queries, asked, bar_score, bar_id, k: int, slack: float) -> pd.DataFrame:
    """The best k of a bin for each query, as (query_id, vec_id, score), better than the query's bar.

    asked[i]: the lists of the bin that query i probes. Rotated columns are read in blocks. After each, a
    candidate goes if its partial distance, scaled to all dimensions, exceeds the bar's by the factor
    (1 + slack / sqrt(d))^2: the test that its true distance is below the bar is rejected. Blocks are matrix
    products for all pairs while many are alive, and read the surviving pairs alone after that. What remains
    is scored on the original vectors in double precision, dimension after dimension.
    """
    rotated, turned, width = index.lift(vectors), index.turn(queries), index.width
    far = index.beyond(queries, bar_score) ** 2
    room = 1e-9 * (index.norm**2 + np.einsum("ij,ij->i", queries, queries))
    edges = [*range(0, width, BLOCK), width]
    limit = lambda d: (1 + slack / d**0.5) ** 2 * d / width if d < width else 1 + 1e-9
    places = {v: i for i, v in enumerate(np.unique(lists).tolist())}
    place = np.array([places[v] for v in lists.tolist()], np.int64)
    probed = np.zeros((len(q_ids), len(places)), bool)
    for i, wanted in enumerate(asked):
        probed[i, [places[v] for v in wanted if v in places]] = True
    found = []
    step = max(1, TILE // max(1, len(ids)))
    for at in range(0, len(q_ids), step):
        now = slice(at, at + step)
        alive, part, i, c = probed[now][:, place], None, None, None
        for a, b in zip(edges, edges[1:], strict=False):
            x, q = rotated[:, a:b], turned[now, a:b]
            bound = far[now] * limit(b) + room[now]
            if i is None and np.count_nonzero(alive) < SPARSE * alive.size:
                i, c = np.nonzero(alive)
                part = None if part is None else part[i, c]
            if i is None:
                near = np.maximum(0, np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", x, x) - 2 * q @ x.T)
                part = near if part is None else part + near
                alive &= part <= bound[:, None]
            else:
                gap = x[c] - q[i]
                near = np.einsum("ij,ij->i", gap, gap)
                part = near if part is None else part + near
                keep = part <= bound[i]
                i, c, part = i[keep], c[keep], part[keep]
        if i is None:
            i, c = np.nonzero(alive)
        i = i + at
        score = np.concatenate([np.add.accumulate(vectors[c[p : p + 65536]] * queries[i[p : p + 65536]], axis=1)[:, -1] for p in range(0, len(i), 65536)] or [np.empty(0)])
        better = (ids[c] != q_ids[i]) & ((score > bar_score[i]) | ((score == bar_score[i]) & (ids[c] <= bar_id[i])))
        i, c, score = i[better], c[better], score[better]
        order = np.lexsort((ids[c], -score, i))
        i, c, score = i[order], c[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((q_ids[i[first]], ids[c[first]], score[first]))
    q, v, s = (np.concatenate(x) if found else np.empty(0) for x in (zip(*found, strict=True) if found else ((), (), ())))
    return pd.DataFrame({"query_id": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(np.float64)})


def _stack(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _bins(counts: np.ndarray) -> list[tuple[int, int]]:
    """(first bin, number of bins) of each list: lists that follow each other share a bin up to CHUNK rows, a
    larger one is dealt over bins of its own."""
    out, now, held = [], 0, 0
    for n in counts.tolist():
        if n > CHUNK:
            now += held > 0
            out.append((now, -(-n // CHUNK)))
            now, held = now + out[-1][1], 0
            continue
        if held + n > CHUNK:
            now, held = now + 1, 0
        out.append((now, 1))
        held += n
    return out


def nearest(vectors: DataFrame, *, k: int = 20, query_every: int = 20, slack: float = 2.1) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by query_every, its k rows of
    largest inner product among all others, ties to the smaller vec_id. vectors: vec_id, embedding.

    Null, empty, zero or non-finite vectors and null vec_ids take no part; nor do vectors of another width
    than the most frequent one. Repeated rows with one vec_id count once if equal; of unequal ones the
    least is taken. Fewer than k candidates: all of them. Further columns, of any name, are ignored.

    Lists number about the square root of the rows, at most FIT_ROWS / 16 (fewer sample rows a list give no
    centre). Centroids come from at most FIT_ROWS rows; all rows are indexed. Lists are stored in bins of about
    CHUNK rows, small neighbouring ones together and a large one over many, and queries meet a bin in lots, so
    a list with a third of all rows makes more tasks, not a larger one, and a query's vector goes to a bin once.

    1. Each query scans its nearest lists until they hold k others; its k-th best is its bar.
    2. It then probes every list that may hold better: those whose centre's distance less the list's radius is
       within the bar's. Where data has clusters this leaves few lists, where it has none, most of them; no list
       that could hold a neighbour is left out. There the adaptive scan abandons candidates by its tests.
    slack: how far a partial distance may lie above the bar's before a candidate goes; infinity makes it exact.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return empty
    rows = ws.save(rows.where(F.size("v") == width["d"]).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    share = min(1.0, FIT_ROWS / facts["n"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).select("v").toPandas()
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(FIT_ROWS).select("v").toPandas()
    index = Index(_stack(sample["v"]), facts["m"] ** 0.5, int(np.clip(round(facts["n"] ** 0.5), 1, FIT_ROWS // 16)))

    def assigned(batches):
        for b in batches:
            if b.num_rows:
                own, gap = index.assign(np.array(b.column(1).to_pylist(), np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(gap, pa.float64()), b.column(0), b.column(1)], names=["list", "gap", "vec_id", "v"])

    stored = ws.save(rows.mapInArrow(assigned, "list int, gap double, vec_id long, v array<double>"), "lists")
    counts, radius = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
    for r in stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect():  # a row a list
        counts[r["list"]], radius[r["list"]] = r["n"], r["gap"]
    place = _bins(counts)
    firsts, spread = (F.array(*(F.lit(p[x]) for p in place)) for x in (0, 1))
    bin_of = (F.get(firsts, F.col("list")) + F.pmod(F.xxhash64("vec_id"), F.get(spread, F.col("list")))).cast("int")
    members = ws.save(stored.select("list", "vec_id", "v", bin_of.alias("bin")), "members")
    queries = rows.where(F.col("vec_id") % query_every == 0).withColumnRenamed("vec_id", "query_id")

    def first_lists(q: np.ndarray) -> np.ndarray:
        """Whether a list is among the nearest that are needed to find k others."""
        order = np.argsort(index.reach(q), axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before <= k, axis=1)
        return out & (counts > 0)

    def asks(df: DataFrame, first: bool) -> DataFrame:
        """df: query_id, v, bar_score, bar_id -> a row for each bin a query meets, with the lists it probes there."""

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                q = np.array(b.column(1).to_pylist(), np.float64)
                wanted = first_lists(q)
                if not first:
                    bar = index.beyond(q, b.column(2).to_numpy())
                    wanted = ~wanted & (counts > 0) & (index.reach(q) - radius <= (bar + 1e-6 * index.norm)[:, None])
                at, bins, lists = [], [], []
                for i in range(len(q)):
                    here: dict[int, list[int]] = {}
                    for one in np.flatnonzero(wanted[i]).tolist():
                        for x in range(place[one][0], sum(place[one])):
                            here.setdefault(x, []).append(one)
                    at += [i] * len(here)
                    bins += here
                    lists += here.values()
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(bins, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "bar_score", "bar_id", "bin", "asked"])

        return df.select("query_id", "v", "bar_score", "bar_id").mapInArrow(run, "query_id long, v array<double>, bar_score double, bar_id long, bin int, asked array<int>")

    def scan(asked: DataFrame) -> DataFrame:
        """A task gets one bin and one lot of the queries that meet it."""
        lots = ws.save(asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("lots")), "lots")
        left = members.join(lots, "bin").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
        right = asked.join(lots, "bin").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int")).drop("lots")

        def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
            return _scan(index, a["list"].to_numpy(), a["vec_id"].to_numpy(), _stack(a["v"]), b["query_id"].to_numpy(), _stack(b["v"]), b["asked"].tolist(), b["bar_score"].to_numpy(), b["bar_id"].to_numpy(), k, slack)

        return left.groupBy("bin", "lot").cogroup(right.groupBy("bin", "lot")).applyInPandas(one, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # noqa: E731  (cut to k before the shuffle too)

    none = queries.withColumns({"bar_score": F.lit(NO_BAR[0]), "bar_id": F.lit(NO_BAR[1])})
    near = ws.save(top(scan(ws.save(asks(none, True), "first_probes"))).drop("rank"), "near")
    bars = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("last")).where(F.col("n") == k)
    barred = queries.join(bars, "query_id").select("query_id", "v", (-F.col("last.s")).alias("bar_score"), F.col("last.vec_id").alias("bar_id"))
    more = scan(ws.save(asks(barred, False), "probes"))
    found = ws.save(near.unionByName(more), "found")
    return top(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
