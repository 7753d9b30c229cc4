"""Ordered folds over keys of any size: rows in blocks of a global order, summaries of blocks composed, blocks run at once.

A key with a third of all rows is many blocks. What a block does to the state it is entered with is a small summary; from
two of them a block (of its first and its last key) the driver finds the state at which each block is entered.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segline.session import on_workers, shared_folder

PART = "_part"


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df's rows and _part, written: parts are ranges of keys and order, as even as a sample makes them, so that one key may
    have many of them. parts: how many, else as many as shuffles have."""
    spark = df.sparkSession
    on_workers(spark)
    by = [*keys, *(F.col(c).asc_nulls_last() for c in order)]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    path = shared_folder(spark, "blocks")
    dealt.withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(dealt.withColumn(PART, F.lit(0)).schema).parquet(path)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[int, tuple, tuple]]:
    """(part, key, row) of sorted batches: part, keys, then the other columns."""
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield part, tuple(row[:n_keys]), tuple(row)


def _sorted(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    by = [F.col(c).asc_nulls_last() for c in order]
    return blocks.repartition(PART).sortWithinPartitions(PART, *keys, *by).select(PART, *keys, *(c for c in blocks.columns if c not in (PART, *keys)))


def entered(blocks: DataFrame, keys: list[str], order: list[str], summary: Callable[[object], object], initial: object, hints: dict[int, object] | None = None) -> dict[int, object]:
    """The state at which each block's first key is entered, for blocks that go on with the key of the block before.

    summary(hint) makes an object with feed(row), called for each row of a key in a block, and apply(state), the state
    after them; it is pickled in between. hint: what hints has for the block if the key goes on in it, else initial.
    The driver holds two summaries a block.
    """
    schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("key", pa.binary()), ("summary", pa.binary())])
    n, hints = len(keys), hints or {}

    def run(batches):
        def emit(part, at, key, held):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, at, pickle.dumps(key), pickle.dumps(held)), schema.types, strict=True)], schema=schema)

        part = key = held = None
        at = 0
        for p, k, row in _runs(batches, n):
            if (p, k) != (part, key):
                if held is not None and (at == 0 or p != part):
                    yield emit(part, at, key, held)
                at = 0 if p != part else at + 1
                part, key = p, k
                held = summary(hints.get(p, initial) if at == 0 else initial)
            held.feed(row)
        if held is not None:
            yield emit(part, at, key, held)

    found = _sorted(blocks, keys, order).mapInArrow(run, "part int, at int, key binary, summary binary").collect()
    out: dict[int, object] = {}
    key, state = None, initial
    for r in sorted(found, key=lambda r: (r["part"], r["at"])):
        now, held = pickle.loads(r["key"]), pickle.loads(r["summary"])  # noqa: S301  our own tasks wrote it
        if r["at"] == 0 and key == (now,):
            out[r["part"]] = state
        elif r["at"] != 0 or key != (now,):
            state = initial
        key, state = (now,), held.apply(state)
    return out


def run_blocks(blocks: DataFrame, keys: list[str], order: list[str], fold: Callable[[object], Callable[[tuple], tuple]], entries: dict[int, object], initial: object, schema: str, arrow: pa.Schema, most: int = 5000) -> DataFrame:
    """fold(state) makes a function from a row (keys, then the other columns as blocks has them) to an output row; it starts
    at the entered state, or at initial where a key begins. Blocks run side by side."""
    n = len(keys)

    def run(batches):
        part = key = step = None
        out: list[tuple] = []
        for p, k, row in _runs(batches, n):
            if (p, k) != (part, key):
                goes_on = p != part and p in entries
                part, key = p, k
                step = fold(entries[p] if goes_on else initial)
            out.append(step(row))
            if len(out) == most:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return _sorted(blocks, keys, order).mapInArrow(run, schema)


def _batch(rows: Iterable[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


class SharedPeriods:
    """T7's state is (latest period, renditions that are on it; None: all), its summary what a stretch of rewinds does to it.

    The first rewind that opens a period is the first of a rendition that is on the latest, or the first of one that has
    rewound in the stretch before. From there on the entry no longer matters: so there is one outcome for each rendition
    of the stretch, and one for the repeat.
    """

    def __init__(self, hint: object = None):
        self.outcomes: list[list] = []  # trigger, periods opened, who is on the latest
        self.seen: list[str] = []
        self.repeat: list | None = None

    def feed(self, row: tuple) -> None:
        rep = row[1]
        for o in [*self.outcomes, *([self.repeat] if self.repeat else [])]:
            if rep in o[2]:
                o[1], o[2] = o[1] + 1, {rep}
            else:
                o[2].add(rep)
        if self.repeat is None:
            if rep in self.seen:
                self.repeat = [None, 1, {rep}]
            else:
                self.outcomes.append([rep, 1, {rep}])
                self.seen.append(rep)

    def apply(self, state: tuple) -> tuple:
        latest, on = state
        for trigger, opened, there in self.outcomes:
            if on is None or trigger in on:
                return latest + opened, there
        if self.repeat:
            return latest + self.repeat[1], self.repeat[2]
        return latest, on | set(self.seen) if on is not None else None


def shared_period_fold(state: tuple) -> Callable[[tuple], tuple]:
    latest, on = state[0], None if state[1] is None else set(state[1])

    def step(row: tuple) -> tuple:
        nonlocal latest, on
        if on is None or row[1] in on:
            latest, on = latest + 1, {row[1]}
        else:
            on.add(row[1])
        return (*row, latest)

    return step


def restarts(held: dict, last: object, dynamic: bool | None, ast: object, tops: dict) -> bool:
    """T8's rule on one manifest, of a period of which `held` is stored and that had availability start `last` before."""
    return bool(dynamic and held) and ((last is not None and ast != last) or any(k in held and v < held[k] for k, v in tops.items()))


def highest_listed(tops: list[dict]) -> dict:
    """The largest number by rendition, of a manifest's entries k, v."""
    out: dict = {}
    for x in tops:
        out[x["k"]] = max(x["v"], out.get(x["k"], x["v"]))
    return out


class Generation:
    """T8's state: restarts so far, the highest number held by rendition, the last availability start."""

    def __init__(self, n: int, held: dict, last: object):
        self.n, self.held, self.last = n, dict(held), last

    def feed(self, dynamic: bool | None, ast: object, tops: dict) -> int:
        if restarts(self.held, self.last, dynamic, ast, tops):
            self.n, self.held = self.n + 1, {}
        self.last = ast
        for k, v in tops.items():
            self.held[k] = max(v, self.held.get(k, v))
        return self.n


class ManifestRestarts:
    """What a stretch of manifests of one period does to T8's state, (restarts, highest held by rendition, last start).

    Until its first restart the stretch only adds to what is held. That restart is the first that holds whatever was
    before (`sure`), or an earlier one that what was before decides: a rendition's first dynamic number is below what it
    held, the first manifest has another start than the one before it, or the start changes while only the entry holds
    anything. A later number of a rendition decides nothing, being no lower than its first one. So there is one outcome for
    each manifest with such a condition, at most two more than the stretch has renditions.
    """

    def __init__(self, hint: object = None):
        self.outcomes: list[tuple[list[tuple], Generation]] = []
        self.sure: Generation | None = None
        self.own: dict = {}
        self.listed: set = set()
        self.last: object = None
        self.asked = False
        self.n = 0

    def feed(self, row: tuple) -> None:
        dynamic, ast, tops = row[3], row[4], highest_listed(row[5])
        for _, state in self.outcomes:
            state.feed(dynamic, ast, tops)
        if self.sure is not None:
            self.sure.feed(dynamic, ast, tops)
            return
        if restarts(self.own, self.last, dynamic, ast, tops):
            self.sure = Generation(1, tops, ast)
            return
        if dynamic:
            asks: list[tuple] = [("top", k, v) for k, v in tops.items() if k not in self.listed]
            if self.n == 0:
                asks.append(("start", None, ast))
            elif not (self.asked or self.own) and self.last is not None and ast != self.last:
                asks.append(("held", None, None))
                self.asked = True
            if asks:
                self.outcomes.append((asks, Generation(1, tops, ast)))
            self.listed.update(tops)
        for k, v in tops.items():
            self.own[k] = max(v, self.own.get(k, v))
        self.last, self.n = ast, self.n + 1

    def apply(self, state: tuple) -> tuple:
        n, held, last = state

        def true(kind: str, rep: object, value: object) -> bool:
            if kind == "top":
                return rep in held and value < held[rep]
            return bool(held) and (kind == "held" or (last is not None and value != last))

        for asks, after in self.outcomes:
            if any(true(*ask) for ask in asks):
                return n + after.n, after.held, after.last
        if self.sure is not None:
            return n + self.sure.n, self.sure.held, self.sure.last
        return n, held | {k: max(v, held.get(k, v)) for k, v in self.own.items()}, self.last if self.n else last


def manifest_restart_fold(state: tuple) -> Callable[[tuple], tuple]:
    now = Generation(*state)
    return lambda row: (*row[:3], now.feed(row[3], row[4], highest_listed(row[5])))


class LastBegin:
    """What X9's baseline is after a stretch: that of its last begin."""

    def __init__(self, hint: object = None):
        self.last = None

    def feed(self, row: tuple) -> None:
        if row[2] in ("begin", "begin_suppressed"):
            self.last = int(row[3] or 0)

    def apply(self, state: dict) -> dict:
        return state if self.last is None else state | {"baseline": self.last}


class Transitions:
    """What a stretch of lifecycle events does to each mode and suppression, at the baseline that it is entered with."""

    def __init__(self, step, modes: list[str], hint: dict):
        self.step = step
        self.after = {(m, s): {"mode": m, "suppressed": s, "baseline": hint["baseline"]} for m in modes for s in (False, True)}

    def feed(self, row: tuple) -> None:
        done: dict[tuple, dict] = {}
        for k, state in self.after.items():
            now = tuple(state.values())
            if now not in done:
                self.step(state := dict(state), [{"at": row[1], "transition": row[2], "stored": row[3]}])
                done[now] = state
            self.after[k] = done[now]

    def apply(self, state: dict) -> dict:
        return self.after[state["mode"], bool(state["suppressed"])]
