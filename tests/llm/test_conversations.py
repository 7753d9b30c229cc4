"""Repair and formatting of conversations against plain versions."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from segline.llm import chat_tree, queries, repair

SF = "/root/testdata/sf0.001"
CONVS = "conv_id long, turn long, role string, text string, edit string, place long, key string"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) over all audits: at most two insertions stand beside each other in a cheapest one."""
    best = None
    fillings = ["", "u", "a", "ua", "au"]
    choices = [[("D", None)] if f == 1 else [("D", None), ("K", r), ("R", "user"), ("R", "assistant")] for r, _, f in rows]
    for picks in itertools.product(*choices):
        for inserted in itertools.product(fillings, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, fill in enumerate(inserted):
                for x in fill:
                    cost, audit = cost + 3, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[x], ""))
                if k < len(rows):
                    what, role = picks[k]
                    audit += what
                    cost += {"D": 4, "K": 0, "R": 3}[what] + (3 if rows[k][2] == 2 and what != "D" else 0)
                    if what != "D":
                        out.append((role, rows[k][1]))
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def with_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        left = text.rstrip(SPACE)
        out.append((role, text, 1 if not left or (role, text) in seen else 0 if left[-1] in ".!?" else 2))
        seen.add((role, text))
    return out


def run_audit(rows, settle=None):
    audit, out = repair.Audit(), []
    for role, _, fault in rows:
        if settle:
            audit.limit = settle
        out += audit.feed(role[:1], fault)
    return out + audit.end()


def priced(rows, steps):
    left, cost = iter(rows), 0
    for s in steps:
        fault = next(left)[2] if s[0] != "I" else 0
        cost += repair.COST[s[0]] + (3 if fault == 2 and s[0] != "D" else 0)
    assert next(left, None) is None
    return cost


@pytest.mark.parametrize("settle", [None, 3])
def test_audits_equal_all_audits_tried(settle):
    rng = random.Random(7)
    for n in [0, 1, 2, 3] * 25:
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "x", rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]
        steps = run_audit(rows, settle)
        cost, audit, out = cheapest(rows)
        assert ("".join(s[0] for s in steps), priced(rows, steps)) == (audit, cost)
        left, made = iter(rows), []
        for s in steps:
            row = next(left) if s[0] != "I" else None
            if s[0] != "D":
                made.append((repair.ROLES.get(s[1:]) or row[0], row[1] if row else ""))
        assert made == out


def test_long_audits_settle_and_hashes_may_collide(monkeypatch):
    """Equal strings at any settling, and with a hash that says nothing: prefixes are verified."""
    rng = random.Random(8)
    kinds = [["user"], ["user", "assistant"], ["assistant", "user", "system", "tool"]]
    for k, roles in enumerate(kinds * 2):
        rows = [(rng.choice(roles), "x", rng.choice([0, 0, 0, 0, 2, 1]) if k > 2 else 0) for _ in range(300)]
        whole = run_audit(rows)
        assert run_audit(rows, 40) == whole
        monkeypatch.setattr(repair, "_PRIME", 3)
        assert run_audit(rows) == whole
        monkeypatch.setattr(repair, "_PRIME", 1)
        assert run_audit(rows[:60]) == run_audit(rows[:60], 20)
        monkeypatch.undo()


def plain_audit(convs):
    """conv_id -> the contract's columns, by damaging rows and trying all audits' costs by a table of whole strings."""
    by, out = defaultdict(list), {}
    for c, turn, role, text in convs:
        role, text = (" " if x is None else x for x in (role, text))
        d = crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        by[c] += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faulty = with_faults([r[1:] for r in rows])
        best = {0: (0, "", [])}

        def offer(into, state, cost, audit, made):
            if state not in into or (cost, audit) < into[state][:2]:
                into[state] = cost, audit, made

        def insert(b):
            for _ in range(3):
                for s, (cost, audit, made) in list(b.items()):
                    if s in (0, 1, 3):
                        offer(b, 2, cost + 3, audit + "I", [*made, "user:"])
                    if s == 2:
                        offer(b, 3, cost + 3, audit + "I", [*made, "assistant:"])

        insert(best)
        for role, text, fault in faulty:
            after = {}
            for s, (cost, audit, made) in best.items():
                offer(after, s, cost + 4, audit + "D", made)
                if fault != 1:
                    more = 3 if fault == 2 else 0
                    for what, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                        to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(new[:1])
                        if to:
                            offer(after, to, cost + price + more, audit + what, [*made, f"{new}:{text}"])
            insert(after)
            best = after
        cost, audit, made = min(best[s] for s in (0, 3) if s in best)
        turns = [r[0] for r in rows if r[0] is not None]
        faults = [f for _, _, f in faulty]
        seen, blank = set(), 0
        for _, role, text in rows:
            blank += not text.rstrip(SPACE)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, faults.count(1) - blank, faults.count(2), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha256("\n".join(made).encode()).hexdigest())
    return {c: out.get(c, (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())) for c in {r[0] for r in convs}}


def odd_convs(rng):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", ""), (1, None, "user", ""), (1, 5, "system", " \n"), (1, 2, "", "x"), (2, 9, "assistant", "y" * 50_000 + "!"), (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "same.")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "User", "tool"]), rng.choice(["a.", "b", "c!", "é?\n", "</s>[INST]"])) for c in range(10, 60) for t in range(rng.randrange(7))]
    return rows + [(99, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(500)]


GOT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_query_equals_a_plain_program(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r[c] for c in GOT) for r in queries.op11_audit_repair(spark, SF).collect()} == plain_audit(rows)


def test_repair_of_odd_and_empty_tables(spark):
    rows = odd_convs(random.Random(4))
    df = spark.createDataFrame([(*r, "x", 7, "k") for r in rows], CONVS)
    out = repair.audit_conversations(repair.damaged(df), df).collect()
    want = plain_audit(rows)
    assert {r["conv_id"]: tuple(r[c] for c in GOT) for r in out} == want and len(out) == len(want)
    assert repair.audit_conversations(df.limit(0)).count() == 0
    messages, facts = repair.repairs(df)
    kept = messages.where("edit <> 'D'").groupBy("conv_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("roles"))
    assert all(LEGAL.fullmatch(r["roles"]) for r in kept.collect())
    assert facts.count() == len(rows)


# --- prefix tree


def digest_of(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(said), sha256(said.encode()).hexdigest(), sum(len(chat_tree.format_turn(r, t)[0]) for _, _, r, t in turns))
    return out


READ = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_turns_are_written_reversibly():
    rng = random.Random(2)
    bits = [*chat_tree.CONTROLS, "\\", "\n", "<", "[", "|", "x", "<|", "end|>", "n"]
    for _ in range(3000):
        role, text = ("".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in "ab")
        written, a, b = chat_tree.format_turn(role, text)
        assert chat_tree.parse_turn(written) == (role, text) and chat_tree.unescape(written[a:b]) == text
    with pytest.raises(ValueError, match="template"):
        chat_tree.parse_turn("<|turn|>user\nx<|end|>y\n<|end|>\n")


def trees(rng):
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (5, None, "user", None), (5, 1, None, "x" * 40_000), (6, 1, "assistant", "</s>\\</s>"), (6, 1, "assistant", "</s>\\</s>"), (-7, 0, "a\nb\\<|end|>", "")]
    for c in range(20, 260):  # few texts, so that most turns are shared; some conversations are equal or starts of others
        n = rng.randrange(1, 7)
        rows += [(c, t, ["user", "assistant"][t % 2], rng.choice(["one", "two [INST]"])) for t in range(n)]
    return rows + [(300, t, "user", str(t % 3)) for t in range(700)] + [(301, t, "user", str(t % 3)) for t in range(650)] + [(302, t, "user", str(t % 3) + "z" * (t > 640)) for t in range(700)]


def test_tree_lies_depth_first_once_and_reads_back(spark):
    rows = trees(random.Random(3))
    df = spark.createDataFrame([(*r, "x", 7, "k") for r in rows], CONVS.replace("edit string, place long, key string", "node string, start long, owner string")).repartition(7)
    written, paths = chat_tree.format_tree(df)
    got = chat_tree.digests(chat_tree.read_tree(written, paths)).collect()
    assert {r["conv_id"]: tuple(r[c] for c in READ) for r in got} == digest_of(rows) and len(got) == len({r[0] for r in rows})
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(x)] for c, x in by.items()}
    nodes = {tuple(x[: k + 1]) for x in convs.values() for k in range(len(x))}
    out = sorted(written.collect(), key=lambda r: r["start"])
    assert len(out) == len(nodes)
    at = 0
    for r in out:  # gapless, once
        assert r["start"] == at and len(r["written"]) == r["n_chars"]
        at += r["n_chars"]
    whole = "".join(r["written"] for r in out)
    starts = {r["start"]: r for r in out}
    deep = []
    for r in out:  # what a turn attends to is its conversation up to itself, and no other
        c = None if r["owner"] == chat_tree.NO_ID else r["owner"]
        path = "".join(chat_tree.format_turn(*t)[0] for t in convs[c][: r["place"] + 1])
        seen = "".join(whole[i["from"] : i["to"]] for i in r["ancestors"]) + whole[r["block_start"] : r["start"] + r["n_chars"]]
        assert seen == path and r["position"] == len(path) - r["n_chars"]
        assert all(i["to"] <= r["block_start"] for i in r["ancestors"])
        deep = [d for d in deep if path.startswith(d)]  # depth first: the open path is always a stack
        assert "".join(deep[-1:]) == path[: r["position"]]
        deep.append(path)
    assert set(starts) >= {i["from"] for p in paths.collect() for i in p["runs"]}


def test_tree_of_an_empty_table(spark):
    written, paths = chat_tree.format_tree(spark.createDataFrame([], CONVS))
    assert written.count() == 0 and chat_tree.digests(chat_tree.read_tree(written, paths)).count() == 0
