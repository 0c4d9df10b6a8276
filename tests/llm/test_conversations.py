"""Conversation repair: against every sequence of edits, blocks against one search, and the query against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from graphnom.llm import conversations as V

PATTERN = re.compile("(s?(ua)+)?")
BLANK = " \t\n\v\f\r"


def every_repair(rows):
    """rows: (role, text, must go, breaks off). Every sequence of edits with at most two inserts in a row, its cost and
    what it gives."""

    def go(i, left):
        if left:
            for name in ("user", "assistant"):
                for cost, audit, out in go(i, left - 1):
                    yield cost + 2, "I" + audit, [(name, ""), *out]
        if i == len(rows):
            yield 0, "", []
            return
        role, text, must, breaks = rows[i]
        rest = list(go(i + 1, 2))
        for cost, audit, out in rest:
            yield cost + 3, "D" + audit, out
            if not must:
                yield cost + breaks, "K" + audit, [(role, text), *out]
                for name in ("user", "assistant"):
                    yield cost + 2 + breaks, "R" + audit, [(name, text), *out]

    return go(0, 2)


def plain_cheapest(rows):
    fine = [(c, a, o) for c, a, o in every_repair(rows) if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in o))]
    return min(fine, key=lambda x: x[:2])


def letters(rows):
    return bytes(V.letter(role[:1], 2 if must else int(breaks)) for role, _, must, breaks in rows)


def test_cheapest_edits_against_every_sequence():
    rnd = random.Random(4)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", "", "usr"]), str(k), rnd.random() < 0.2, rnd.random() < 0.25) for k in range(rnd.choice([0, 1, 2, 3, 3]))]
        cost, audit, out = plain_cheapest(rows)
        assert V.cheapest(letters(rows)) == (cost, audit), rows
        assert list(V.edited(audit, ((r, t) for r, t, _, _ in rows))) == out


def plain_table(codes):
    """Least (cost, audit) of a whole conversation by a table over all places, from the end."""
    states, after = range(4), {}
    for i in range(len(codes), -1, -1):
        own = {}
        for state in states:
            options = [(0, "")] if i == len(codes) and state in (V.START, V.ASSISTANT) else [(10**9, "")]
            if i < len(codes):
                initial, fault = "sua-"[codes[i] >> 2], codes[i] & 3
                options.append((after[state][0] + 3, "D" + after[state][1]))
                if fault < 2:
                    ways = [("R", V.WANTED[state], 2)] + [("K", to, 0) for to in [V.ON.get((state, initial))] if to is not None]
                    options += [(after[to][0] + fault + cost, edit + after[to][1]) for edit, to, cost in ways]
            own[state] = min(options)
        after = own
        for _ in range(2):  # at most two inserts in a row
            after = {s: min(own[s], (after[V.WANTED[s]][0] + 2, "I" + after[V.WANTED[s]][1])) for s in states}
    return after[V.START]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    V._found.clear()
    rnd = random.Random(block)
    for _ in range(200):
        codes = bytes(rnd.randrange(16) if rnd.random() < 0.4 else V.letter("ua"[k % 2], 0) for k in range(rnd.randint(0, 40)))
        assert V.cheapest(codes) == plain_table(codes), codes
    V._found.clear()


def plain_report(rows):
    """The whole contract for rows (conv_id, turn, role, text), by plain rules."""
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, codes = set(), [], []
        for _, role, text in kept:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
            codes.append(V.letter(role[:1], {"": 0, "truncated": 1}.get(faults[-1], 2)))
        cost, audit = plain_table(bytes(codes))
        known = [t for t, _, _ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        turns = list(V.edited(audit, ((r, t) for _, r, t in kept)))
        assert PATTERN.fullmatch("".join(r[:1] for r, _ in turns))
        out[conv] = {
            "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
        }
    return out


def test_awkward_rows(spark):
    rnd = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.choice([1, 2, 4, 9])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "Assistant"])
            text = rnd.choice(["Hi.", "Hi.", "So it is", "What? ", "", " \t\n", None, "\x1f", "done!\r\n", "ä" * 5 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn * 3, None, 2]), role, text))
    rows += [(1000, k, "ua"[k % 2], f"{k}." if k % 17 else "") for k in range(1500)]  # goes over blocks and batches
    rows += [(1001, k, "user", "the same.") for k in range(700)]
    rows += [(1002, 0, "user", "long " * 300_000 + "."), (1002, 1, "assistant", "x" * 1_500_000)]
    rows += rows[:40]  # repeated rows
    alone = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "This row is dropped."))
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, gone string, again int")
    out = {r.conv_id: r.asDict() for r in V.report(V.damaged(table)).collect()}
    want = plain_report(rows)
    assert set(out) == set(want)
    for conv, fields in want.items():
        assert {k: out[conv][k] for k in fields} == fields, conv
    assert out[alone]["audit"] == "" and out[alone]["cost"] == 0
    assert V.report(V.damaged(table.where("false"))).count() == 0


def test_turns_stand_in_order(spark):
    rows = spark.createDataFrame([(7, 1, "assistant", "Yes."), (7, 0, "user", "Is it?"), (8, 0, "assistant", "Well"), (9, 0, "system", "Be.")], "conv_id long, turn long, role string, text string")
    found = V.audits(rows)
    assert {r.conv_id: (r.audit, r.cost) for r in found.collect()} == {7: ("KK", 0), 8: ("D", 3), 9: ("D", 3)}
    assert [tuple(r) for r in V.turns(rows, found).orderBy("conv_id", "place").collect()] == [(7, 0, "user", "Is it?"), (7, 1, "assistant", "Yes.")]


def test_one_shuffle_a_pass(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.")], "conv_id long, turn long, role string, text string")
    plan = V.audits(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_query_over_the_whole_table(spark):
    from graphnom.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_report(rows)
    out = {r.conv_id: r.asDict() for r in queries.op12_conversation_repair(spark, folder).collect()}
    assert set(out) == set(want)
    for conv, fields in want.items():
        assert {k: out[conv][k] for k in fields} == fields, conv
