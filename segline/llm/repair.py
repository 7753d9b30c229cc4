"""Conversation structure repair: the cheapest edits that give legal roles, by a dynamic program over shared edit prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import batches_of, rows
from .storage import Workspace

#: What an edit costs, and what a truncated row adds unless it is deleted.
COST, TRUNCATED_COST = {"K": 0, "R": 3, "D": 4, "I": 3}, 3
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal roles are (system? (user assistant)+)?: from which states a role's initial leads where.
MOVES = {"s": ({START}, SYSTEM), "u": ({START, SYSTEM, ASSISTANT}, USER), "a": ({USER}, ASSISTANT)}
ROLES = {"u": "user", "a": "assistant"}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Prefixes:
    """Edit strings as linked nodes: a node is its parent's string and one edit more, so strings share their prefixes.

    up[n][k] is the 2^k-th ancestor; hash[n] is a polynomial of the whole string. An edit is its letter, and for
    R and I the role's initial behind it; only letters are compared and hashed.
    """

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self._equal: set[tuple[int, int]] = set()

    def add(self, parent: int, edit: str) -> int:
        up, a = [parent], parent
        for k in range(self.depth[parent].bit_length()):
            if len(self.up[a]) <= k:
                break
            a = self.up[a][k]
            up.append(a)
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(edit[0])) % _PRIME)
        self.up.append(up)
        return len(self.up) - 1

    def above(self, n: int, depth: int) -> int:
        """The ancestor at a depth of at most n's."""
        d = self.depth[n] - depth
        while d:
            n = self.up[n][d.bit_length() - 1]
            d -= 1 << d.bit_length() - 1
        return n

    def less(self, a: int, b: int) -> bool:
        """Whether a's string is before b's: the end of their longest common prefix is searched by hashes of ancestors,
        then that prefix is verified edit by edit, back to a node that both share or to a pair known as equal."""
        level = min(self.depth[a], self.depth[b])
        x, y = self.above(a, level), self.above(b, level)
        p, q = x, y
        differ = self.hash[x] != self.hash[y]
        if differ:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            p, q = self.up[x][0], self.up[y][0]
        known = (p, q)
        while p != q and (p, q) not in self._equal:
            if self.edit[p][0] != self.edit[q][0]:  # equal hashes of unlike strings: the first difference is higher up
                x, y, differ, known = p, q, True, (self.up[p][0], self.up[q][0])
            p, q = self.up[p][0], self.up[q][0]
        self._equal.add(known)
        return self.edit[x][0] < self.edit[y][0] if differ else self.depth[a] < self.depth[b]

    def shared(self, nodes: Iterable[int]) -> int:
        """The deepest ancestor of all nodes."""
        nodes = list(nodes)
        level = min(self.depth[n] for n in nodes)
        nodes = [self.above(n, level) for n in nodes]
        while len(set(nodes)) > 1:
            x = nodes[0]
            step = next((k for k in range(len(self.up[x]) - 1, -1, -1) if len({self.up[n][k] for n in nodes}) > 1), 0)
            nodes = [self.up[n][step] for n in nodes]
        return nodes[0]

    def path(self, n: int, top: int) -> list[str]:
        """Edits below the ancestor top, down to n."""
        out = []
        while n != top:
            out.append(self.edit[n])
            n = self.up[n][0]
        return out[::-1]


class Audit:
    """The program over one conversation's rows, fed one at a time; edits leave as soon as all alternatives agree on them.

    What is held are the prefixes that still differ: four states' best strings below their last common edit.
    """

    def __init__(self):
        self.nodes, self.limit = Prefixes(), 1 << 13
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self._insert(self.best)

    def _offer(self, best: dict, state: int, cost: int, parent: int, edit: str) -> bool:
        """Take an alternative that is cheaper, or as cheap and before in ASCII."""
        held = best.get(state)
        if held and held[0] < cost:
            return False
        n = self.nodes.add(parent, edit)
        if held and held[0] == cost and not self.nodes.less(n, held[1]):
            return False
        best[state] = cost, n
        return True

    def _insert(self, best: dict) -> None:
        changed = True
        while changed:
            changed = False
            for role in "ua":
                sources, to = MOVES[role]
                for state in [s for s in sources if s in best]:
                    changed |= self._offer(best, to, best[state][0] + COST["I"], best[state][1], "I" + role)

    def feed(self, initial: str, fault: int) -> list[str]:
        """One row; fault: 0 none, 1 blank or duplicate, 2 truncated. Gives edits that are settled."""
        after: dict[int, tuple[int, int]] = {}
        more = TRUNCATED_COST if fault == 2 else 0
        for state, (cost, n) in self.best.items():
            self._offer(after, state, cost + COST["D"], n, "D")
            if fault != 1:
                if initial in MOVES and state in MOVES[initial][0]:
                    self._offer(after, MOVES[initial][1], cost + more, n, "K")
                for role in "ua":
                    if state in MOVES[role][0]:
                        self._offer(after, MOVES[role][1], cost + COST["R"] + more, n, "R" + role)
        self._insert(after)
        self.best = after
        return self._settle() if len(self.nodes.edit) > self.limit else []

    def _settle(self) -> list[str]:
        """Give out what all live strings share and keep only the nodes below it."""
        top = self.nodes.shared(n for _, n in self.best.values())
        out = self.nodes.path(top, 0)
        fresh, moved = Prefixes(), {top: 0}
        live = set()
        for _, n in self.best.values():
            while n != top and n not in live:
                live.add(n)
                n = self.nodes.up[n][0]
        for n in sorted(live):
            moved[n] = fresh.add(moved[self.nodes.up[n][0]], self.nodes.edit[n])
        self.best = {s: (c, moved[n]) for s, (c, n) in self.best.items()}
        self.nodes, self.limit = fresh, 2 * len(fresh.edit) + (1 << 13)
        return out

    def end(self) -> list[str]:
        """The rest of the cheapest legal audit."""
        cost, n = min(self.best[s] for s in (START, ASSISTANT) if s in self.best)
        for s in (START, ASSISTANT):
            if s in self.best and self.best[s][0] == cost and self.best[s][1] != n and self.nodes.less(self.best[s][1], n):
                n = self.best[s][1]
        return self.nodes.path(n, 0)


def numbered(steps: Iterable[str], step: int, place: int) -> Iterator[tuple[int, int | None, str, str | None]]:
    """(step, place of the row or None, letter, role or None) of edits that follow so many steps and rows."""
    for s in steps:
        place += s[0] != "I"
        yield step, place if s[0] != "I" else None, s[0], ROLES.get(s[1:])
        step += 1


def _as(column: str, type_: str) -> Column:
    return F.coalesce(F.col(column).cast(type_), F.lit(" "))


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows damaged by crc32(`conv_id:turn`) % 20, as a repair is tested.

    0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it (copy 1), 4 makes its role user. Null ids,
    turns, roles and texts count as one space; columns of other names are left out.
    """
    what = F.crc32(F.concat(_as("conv_id", "string"), F.lit(":"), _as("turn", "string"))) % 20
    d = convs.select("conv_id", "turn", _as("role", "string").alias("role"), _as("text", "string").alias("text"), what.alias("_w")).where("_w <> 0")
    text = F.when(F.col("_w") == 1, "").when(F.col("_w") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_w") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(F.col("_w") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def placed(convs: DataFrame) -> DataFrame:
    """conv_key, turn, role, text, place (from 1), and before: the initial of the row above, opens: a turn's first row.

    Rows lie by turn (nulls first), those of one turn by role and text. A window that sorts and spills; it holds no
    conversation in memory.
    """
    d = convs.select(_as("conv_id", "string").alias("conv_key"), "turn", _as("role", "string").alias("role"), _as("text", "string").alias("text"))
    w = Window.partitionBy("conv_key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    opens = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(w) == F.col("turn"), F.lit(False))
    return d.select("*", F.row_number().over(w).cast("bigint").alias("place"), initial.alias("initial"), F.lag(initial).over(w).alias("before"), opens.alias("opens"))


def faults(rows_: DataFrame) -> DataFrame:
    """Rows as placed() has them, without texts, with fault: the first of blank, duplicate (role and text stand further
    up in the conversation), truncated (the last character but white space is none of .!?), else null.

    The first place of each role and text is an aggregate; it is joined by conversation and place, which no two rows share.
    """
    left = F.rtrim(F.col("text"), F.lit(SPACE))
    one = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    light = rows_.select("conv_key", "turn", "place", "initial", "before", "opens", (left == "").alias("blank"), F.substring(left, -1, 1).isin(".", "!", "?").alias("ends"), one.alias("one"))
    first = light.groupBy("conv_key", "one").agg(F.min("place").alias("place")).select("conv_key", "place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ends"), "truncated")
    return light.join(first, ["conv_key", "place"], "left").select("conv_key", "turn", "place", "initial", "before", "opens", fault.alias("fault"))


def edits(facts: DataFrame) -> DataFrame:
    """conv_key, step (from 0), place (null for an insertion), edit (K, R, D or I), to_role of each conversation's cheapest
    audit, ties to the ASCII-least. facts: see faults(). A conversation's rows pass through its task in order, one at a
    time and without texts; what is held are the edits on which the alternatives still differ."""
    schema = pa.schema([("conv_key", pa.string()), ("step", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("to_role", pa.string())])
    kinds = {None: 0, "blank": 1, "duplicate": 1, "truncated": 2}

    def run(batches):
        def found():
            now, audit, step, place = None, None, 0, 0
            for key, initial, fault in rows(batches):
                if key != now or audit is None:
                    if audit:
                        yield from ((now, *x) for x in numbered(audit.end(), step, place))
                    now, audit, step, place = key, Audit(), 0, 0
                for x in numbered(audit.feed(initial, kinds[fault]), step, place):
                    step, place = x[0] + 1, x[1] or place
                    yield now, *x
            if audit:
                yield from ((now, *x) for x in numbered(audit.end(), step, place))

        return batches_of(found(), schema)

    ordered = facts.repartition("conv_key").sortWithinPartitions("conv_key", "place").select("conv_key", "initial", "fault")
    return ordered.mapInArrow(run, "conv_key string, step long, place long, edit string, to_role string")


def repairs(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, facts): the repaired conversations with their audit, and each row's faults.

    messages: conv_key, step, edit (K keep, R rerole, D delete, I insert), role, text, cost, one row for each edit in
    order; a deleted row keeps its text there, an inserted one has an empty text. convs: conv_id, turn, role, text.
    Kept and reroled rows in order make roles (system? (user assistant)+)? at the least cost. A role's initial counts;
    an empty role has none, so its row is reroled or deleted. conv_key is conv_id as text, one space if null. Repeated
    rows are duplicates, an empty table gives empty ones, other columns are ignored.
    """
    ws = Workspace(convs.sparkSession, "repair")
    lying = ws.save(placed(convs), "rows")
    facts = ws.save(faults(lying), "faults")
    steps = ws.save(edits(facts), "edits")
    said = lying.select("conv_key", "place", "role", "text").join(facts.select("conv_key", "place", "fault"), ["conv_key", "place"])
    base = F.create_map(*(F.lit(x) for item in COST.items() for x in item))[F.col("edit")]
    late = F.when((F.col("fault") == "truncated") & (F.col("edit") != "D"), TRUNCATED_COST).otherwise(0)
    out = steps.join(said, ["conv_key", "place"], "left").select("conv_key", "step", "edit", F.coalesce("to_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), (base + late).cast("bigint").alias("cost"))
    return out, facts


def digests(messages: DataFrame) -> DataFrame:
    """conv_key, cost, audit, repaired_sha256 (of `role:text` of what stays, newline-joined) of each conversation.
    A conversation's messages pass in order, one at a time: a hash of one text cannot be made in parts."""
    schema = pa.schema([("conv_key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        def found():
            now, cost, letters, whole, any_ = None, 0, bytearray(), sha256(), False
            for key, edit, role, text, price in rows(batches):
                if key != now:
                    if now is not None:
                        yield now, cost, letters.decode(), whole.hexdigest()
                    now, cost, letters, whole, any_ = key, 0, bytearray(), sha256(), False
                cost += price
                letters += edit.encode()
                if edit != "D":
                    whole.update(("\n" * any_ + role + ":" + text).encode("utf-8", "surrogatepass"))
                    any_ = True
            if now is not None:
                yield now, cost, letters.decode(), whole.hexdigest()

        return batches_of(found(), schema)

    ordered = messages.repartition("conv_key").sortWithinPartitions("conv_key", "step").select("conv_key", "edit", "role", "text", "cost")
    return ordered.mapInArrow(run, "conv_key string, cost long, audit string, repaired_sha256 string")


def audit_conversations(convs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, see repairs().

    gaps: turns that are missing between the least and the largest; illegal: neighbours whose roles' initials are none
    of su, ua, au. ids: a table whose conv_id are all reported, zeros and empty results where convs has no rows.
    """
    messages, facts = repairs(convs)
    count = lambda c: F.count_if(c).alias
    turns = F.when(F.count("turn") > 0, F.max("turn") - F.min("turn") + 1 - F.count_if(F.col("opens"))).otherwise(0).cast("bigint")
    pair = F.concat("before", "initial")
    counted = facts.groupBy("conv_key").agg(turns.alias("gaps"), *(count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")), count(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"))("illegal"))
    ids = convs if ids is None else ids
    every = ids.select(F.col("conv_id"), _as("conv_id", "string").alias("conv_key")).distinct()
    out = every.join(counted, "conv_key", "left").join(digests(messages), "conv_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
