"""Chat formatting as a prefix tree: turns that conversations share from their start are written once, depth first."""

from __future__ import annotations

import re
import struct
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import batches_of, rows
from .storage import Workspace

OPEN, CLOSE = "<|turn|>", "\n<|end|>\n"
#: Strings that steer a model; inside texts each gets one backslash more than it has.
CONTROLS = ["<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]"]
ASSISTANT = "assistant"
#: Rows that one key may bring to a task of a join, as a share of all its rows: 1 in SALTS.
SALTS = 64
NO_ID = -(1 << 63)
_ANY = "|".join(map(re.escape, CONTROLS))
_IN_TEXT, _ESCAPED, _BARE = re.compile(rf"(\\*)({_ANY})"), re.compile(rf"\\(\\*)({_ANY})"), re.compile(rf"(?<!\\)(?:{_ANY})")
_IN_ROLE, _ROLE_ESCAPED = re.compile(r"[\\\n<\[]"), re.compile(r"\\(.)")


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: m[1] + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as it is written, and where its text lies in it."""
    head = OPEN + _IN_ROLE.sub(lambda m: "\\" + ("n" if m[0] == "\n" else m[0]), role) + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turn(written: str) -> tuple[str, str]:
    """(role, text) of a written turn; bare control strings but the template's two are an error."""
    marks = [m.span() for m in _BARE.finditer(written)]
    if not written.endswith(CLOSE) or marks != [(0, len(OPEN)), (len(written) - len(CLOSE) + 1, len(written) - 1)]:
        raise ValueError("not one turn of this template")
    head = written.index("\n")
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], written[len(OPEN) : head]), unescape(written[head + 1 : -len(CLOSE)])


def _salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left joined to right, whose keys are unique: a key's rows are dealt by `by` over SALTS tasks, and a row of right
    goes to those that have any."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    used = dealt.select(*keys, "salt").distinct().join(right, keys)
    return dealt.join(used, [*keys, "salt"]).drop("salt")


def turn_nodes(convs: DataFrame) -> DataFrame:
    """conv, place (from 0), node, at, n_chars, role, text: each turn with its node in the tree, a hash of 128 bits of
    all roles and texts down to it, and where it starts in its written conversation.

    Turns lie by turn (nulls first), those of one turn by role and text. Null roles and texts are empty. conv is
    conv_id as a long, the least long if null. A conversation's rows pass through its task one at a time.
    """
    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("node", pa.binary()), ("at", pa.int64()), ("n_chars", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        def found():
            now, place, at, node = None, 0, 0, b""
            for conv, role, text in rows(batches):
                if conv != now:
                    now, place, at, node = conv, 0, 0, b""
                a, b = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                node = blake2b(node + struct.pack("<q", len(a)) + a + b, digest_size=16).digest()
                n = len(format_turn(role, text)[0])
                yield conv, place, node, at, n, role, text
                place, at = place + 1, at + n

        return batches_of(found(), schema)

    d = convs.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    ordered = d.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").select("conv", "role", "text")
    return ordered.mapInArrow(run, "conv long, place long, node binary, at long, n_chars long, role string, text string")


def _owners(turns: DataFrame) -> DataFrame:
    """conv, place, at, n_chars, owner: the least conversation through each turn's node. Counted in SALTS parts first."""
    light = turns.select("conv", "place", "at", "n_chars", "node", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = light.groupBy("node", "salt").agg(F.min("conv").alias("least"))
    owner = parts.groupBy("node").agg(F.min("least").alias("owner"))
    return light.join(parts.select("node", "salt").join(owner, "node"), ["node", "salt"]).select("conv", "place", "at", "n_chars", "owner")


def _segments(owned: DataFrame) -> DataFrame:
    """conv, seg, owner, from_place, to_place, from_at, to_at, key: the runs of turns with one owner along each
    conversation's path, first to last; key orders the runs that conversations own, else null.

    Owners only grow along a path, so what a conversation owns is the end of its path: a block that is written in one
    piece. A block hangs under the block before it at from_place. Depth first, a block is followed by those that
    hang under it, deepest first, ties by conversation: key is the list of (from_place downwards, owner) of the
    path's runs, as bytes in that order. All keys together are as long as the paths have runs.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("conv", "seg", "owner", "from_place", "to_place", "from_at", "to_at")] + [("key", pa.binary())])

    def run(batches):
        def found():
            now, seg, key = None, None, bytearray()

            def done():
                return (*seg, bytes(key) if seg[2] == seg[0] else None)

            for conv, place, at, n, owner in rows(batches):
                if seg and conv == now and owner == seg[2]:
                    seg[4], seg[6] = place + 1, at + n
                    continue
                if seg:
                    yield done()
                if conv != now:
                    now, seg, key = conv, None, bytearray()
                key += struct.pack(">QQ", (1 << 63) - place, owner + (1 << 63))
                seg = [conv, seg[1] + 1 if seg else 0, owner, place, place + 1, at, at + n]
            if seg:
                yield done()

        return batches_of(found(), schema)

    ordered = owned.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "place", "at", "n_chars", "owner")
    return ordered.mapInArrow(run, "conv long, seg long, owner long, from_place long, to_place long, from_at long, to_at long, key binary")


def _starts(segments: DataFrame, ws: Workspace) -> DataFrame:
    """owner, start: where each block starts in the whole output: running sums in ranges of keys, then over ranges."""
    schema = pa.schema([("part", pa.int32()), ("owner", pa.int64()), ("within", pa.int64()), ("n", pa.int64())])

    def run(batches):
        def found():
            part, at = TaskContext.get().partitionId(), 0
            for owner, n in rows(batches):
                yield part, owner, at, n
                at += n

        return batches_of(found(), schema)

    own = segments.where("key is not null").select("key", "owner", (F.col("to_at") - F.col("from_at")).alias("n"))
    dealt = own.repartitionByRange("key").sortWithinPartitions("key").select("owner", "n").mapInArrow(run, "part int, owner long, within long, n long")
    dealt = ws.save(dealt, "blocks")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return dealt.join(parts.select("part", before.alias("before")), "part").select("owner", (F.col("before") + F.col("within")).alias("start"))


def format_tree(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written, paths), both written tables. convs: conv_id, turn, role, text; other columns are ignored.

    written: one row for each node of the tree, that is each turn that conversations share from their start: owner and
    place (the least conversation through it and its place there), start (its place in the output, which lies depth
    first without gaps), position (of its first character in its conversation: position ids count on from it),
    n_chars, written, loss_from and loss_to (the assistant's text in it, else null), ancestors (array of from, to: what
    it may attend to before its own block, in output places; of its own block all from block_start to itself).
    paths: conv, runs (array of seg, owner, from_place, to_place, from, to): the output places that make up each
    conversation, in order. Units are code points. A conversation that is equal to, or the start of, another owns
    nothing and has a path only; repeated rows are turns of their own; an empty table gives empty tables.
    """
    ws = Workspace(convs.sparkSession, "chat")
    turns = ws.save(turn_nodes(convs), "turns")
    owned = ws.save(_owners(turns), "owners")
    segments = ws.save(_segments(owned), "segments")
    starts = ws.save(_starts(segments, ws), "starts")

    run = F.struct("seg", "owner", "from_place", "to_place", F.col("start").alias("from"), (F.col("start") + F.col("to_at") - F.col("from_at")).alias("to"))
    runs = _salted_join(segments, starts, ["owner"], "conv").groupBy("conv").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    paths = ws.save(runs, "paths")

    above = F.transform(F.filter("runs", lambda r: r["owner"] != F.col("conv")), lambda r: F.struct(r["from"], r["to"]))
    own = F.filter("runs", lambda r: r["owner"] == F.col("conv"))
    blocks = paths.where(F.size(own) > 0).select(F.col("conv").alias("owner"), above.alias("ancestors"), own[0]["from"].alias("block_start"))
    first = segments.where("key is not null").select("owner", F.col("from_at").alias("block_at"), F.col("from_place").alias("first"))
    heads = blocks.join(first, "owner")
    said = turns.select(F.col("conv").alias("owner"), "place", "at", "n_chars", "role", "text")
    kept = _salted_join(said, heads, ["owner"], "place").where("place >= first")
    return ws.save(_write(kept), "written"), paths


def _write(kept: DataFrame) -> DataFrame:
    """The template's text of each owned turn, beside its place in the output."""
    interval = "ancestors array<struct<from: long, to: long>>"
    names = [("owner", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("block_start", pa.int64()), ("ancestors", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("n_chars", pa.int64()), ("written", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())]

    def run(batches):
        def found():
            for owner, place, at, n, role, text, ancestors, block_start, block_at in rows(batches):
                written, a, b = format_turn(role, text)
                yield (owner, place, block_start + at - block_at, at, block_start, ancestors, n, written, *((a, b) if role == ASSISTANT else (None, None)))

        return batches_of(found(), pa.schema(names))

    return kept.select("owner", "place", "at", "n_chars", "role", "text", "ancestors", "block_start", "block_at").mapInArrow(run, f"owner long, place long, start long, position long, block_start long, {interval}, n_chars long, written string, loss_from long, loss_to long")


def read_tree(written: DataFrame, paths: DataFrame) -> DataFrame:
    """conv, place, written, loss_from, loss_to: every conversation's turns, read back from the shared output along its path."""
    one = paths.select("conv", F.explode("runs").alias("r")).select("conv", F.col("r.owner").alias("owner"), F.explode(F.sequence("r.from_place", F.col("r.to_place") - 1)).alias("place"))
    return _salted_join(one, written.select("owner", "place", "written", "loss_from", "loss_to"), ["owner", "place"], "conv").select("conv", "place", "written", "loss_from", "loss_to")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation as it was read back."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def found():
            now, n, turns, chars, loss, size = None, 0, sha256(), 0, sha256(), 0
            for conv, written, a, b in rows(batches):
                if conv != now:
                    if n:
                        yield (None if now == NO_ID else now), n, turns.hexdigest(), chars, loss.hexdigest(), size
                    now, n, turns, chars, loss, size = conv, 0, sha256(), 0, sha256(), 0
                role, text = parse_turn(written)
                n, size = n + 1, size + len(written)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    masked = unescape(written[a:b])
                    chars += len(masked)
                    loss.update(masked.encode("utf-8", "surrogatepass"))
            if n:
                yield (None if now == NO_ID else now), n, turns.hexdigest(), chars, loss.hexdigest(), size

        return batches_of(found(), schema)

    ordered = read.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "written", "loss_from", "loss_to")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
