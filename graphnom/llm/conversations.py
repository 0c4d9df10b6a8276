"""Repair of conversation structure: the cheapest edits that make roles alternate, found by A* on the edit lattice.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Its rows may be kept (0), given the role
user or assistant (2) or deleted (3), and empty user or assistant turns may be inserted anywhere (2). Rows that are
blank or repeat an earlier one must go, and a row that breaks off costs 1 as long as it stays. A place of the lattice
is the number of rows taken and the state of the pattern; A* adds to the cost so far what the rest must cost at least
(3 for each row that must go, 1 for each that breaks off), and takes places by that sum, then by their audit, the
initials of the edits. So the first audit to reach the end is the cheapest, and of equally cheap ones the ASCII-least.

Long conversations are searched in blocks of rows, from each state that can be reached to each that can be left in;
what the blocks found is then put together, ordered by cost and audit in the same way. Turns are inserted in front of
a row of their block, or at the end, so that an edit sequence has one reading and the result does not depend on the
blocks.

Two passes go over the rows in their order, each after one shuffle by conversation. The first finds the audits and
holds one byte a row; the second follows them and writes the repaired turns, a row at a time. Texts of a conversation
are never held together, however long it is.

Defined cases: a null role or text is one space; rows of one turn are ordered by role and text, null turns come first;
a null conv_id is a conversation of its own; an empty role has no initial and is never kept; roles are told by their
first character alone; a conversation without rows has zeros, an empty audit and no turns; repeated rows are
duplicates; very long texts count like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

KEEP, REROLE, DELETE, INSERT, BROKEN_OFF = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which initial leads on from each state, and which turn the pattern wants next there.
ON = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row as one letter: its initial (of s, u, a and others) and its fault.
INITIALS, FAULTS = "sua-", ("none", "truncated", "blank", "duplicate")
#: Rows that are searched together, and block searches that a worker remembers.
BLOCK, REMEMBERED = 256, 50_000
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def letter(initial: str, fault: int) -> int:
    return (INITIALS.index(initial) if initial and initial in INITIALS else 3) * 4 + fault


def search(rows: bytes, entry: int, closing: bool) -> dict[int, tuple[int, str]]:
    """From a state in front of a block to each state behind it: least cost, and the least audit of that cost. closing:
    only to where the pattern may end, with turns inserted at the end too."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i] & 3
        ahead[i] = ahead[i + 1] + (DELETE if fault > 1 else fault * BROKEN_OFF)
    heap, done, out = [(ahead[0], "", 0, entry)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and not closing:
            out[state] = (bound, audit)
            continue
        if i == n and state in (START, ASSISTANT):
            return {state: (bound, audit)}
        heapq.heappush(heap, (bound + INSERT, audit + "I", i, WANTED[state]))
        if i == n:
            continue
        fault, rest = rows[i] & 3, bound - ahead[i] + ahead[i + 1]
        heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, state))
        if fault <= 1:
            rest += fault * BROKEN_OFF
            if (to := ON.get((state, INITIALS[rows[i] >> 2]))) is not None:
                heapq.heappush(heap, (rest + KEEP, audit + "K", i + 1, to))
            heapq.heappush(heap, (rest + REROLE, audit + "R", i + 1, WANTED[state]))
    return out


_found: dict[tuple[bytes, int, bool], dict[int, tuple[int, str]]] = {}


def remembered(rows: bytes, entry: int, closing: bool) -> dict[int, tuple[int, str]]:
    key = (rows, entry, closing)
    if key not in _found:
        if len(_found) >= REMEMBERED:
            _found.clear()
        _found[key] = search(rows, entry, closing)
    return _found[key]


def cheapest(rows: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's rows, as letters."""
    # by state: cost, place among the audits of all states, and the audit as a chain of the blocks' ones. Audits of
    # different states have as many row letters and end in one, so none begins another and places tell them apart
    live: dict[int, tuple[int, int, tuple]] = {START: (0, 0, ())}
    lows = range(0, len(rows), BLOCK) or [0]
    for lo in lows:
        best: dict[int, tuple[int, int, str, tuple]] = {}
        for state, (cost, place, chain) in live.items():
            for to, (more, audit) in remembered(rows[lo : lo + BLOCK], state, lo == lows[-1]).items():
                way = (cost + more, place, audit, chain)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        order = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        live = {to: (way[0], order[to], (way[3], way[2])) for to, way in best.items()}
    cost, _, chain = min(live.values(), key=lambda x: x[:2])
    audits = []
    while chain:
        chain, audit = chain
        audits.append(audit)
    return cost, "".join(reversed(audits))


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The roles and texts that an audit makes of a conversation's (role, text)."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES[WANTED[state]]
        state = ON[state, role[0]]
        yield role, text


def told(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def written(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def in_order(dealt: DataFrame) -> DataFrame:
    """Rows that are dealt by conversation, sorted where they are; those that are gone come first."""
    return dealt.sortWithinPartitions("conv_id", F.col("gone").desc(), F.col("turn").asc_nulls_first(), "role", "text")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows without nulls in role and text, and gone: whether the row only says that its conversation exists."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    spaced = [F.when(gone, F.lit("")).otherwise(F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced, gone.alias("gone"))


def audits(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text (gone, for rows that say only that a conversation exists). One row for each
    conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = rows.schema["conv_id"].dataType
    dealt = prepared(rows).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    ordered = in_order(dealt.withColumn("again", F.row_number().over(same) > 1))

    def one(conv, group: Iterator[tuple]) -> tuple:
        letters, counts, illegal, turns, before = bytearray(), [0, 0, 0, 0], 0, 0, None
        least = most = None
        for _, gone, turn, role, text, again in group:
            if gone:
                continue
            if turn is not None:
                turns += turn != most
                least, most = turn if least is None else least, turn
            bare = text.rstrip(BLANK)
            fault = 2 if not bare else 3 if again else int(bare[-1] not in ".!?")
            counts[fault] += 1
            initial = role[:1]
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            letters.append(letter(initial, fault))
        cost, audit = cheapest(bytes(letters))
        gaps = 0 if least is None else most - least + 1 - turns
        return conv, gaps, counts[2], counts[3], counts[1], illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = told(batches, ["conv_id", "gone", "turn", "role", "text", "again"])
        numbers = [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        schema = pa.schema([pa.field("conv_id", pa.int64() if kind.typeName() == "long" else pa.string()), *numbers, pa.field("audit", pa.string())])
        return written((one(conv, group) for conv, group in itertools.groupby(rows, key=lambda r: r[0])), schema)

    return C.arrow_map(ordered, run, f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, place (from 0), role, text. found: of `audits`. The
    turns of a conversation stand together and in order within one partition."""
    kind = rows.schema["conv_id"].dataType
    # an audit stands in front of the rows that it is for
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("gone"))
    both = in_order(heads.unionByName(prepared(rows).where("not gone")).repartition("conv_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64() if kind.typeName() == "long" else pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

        def every() -> Iterator[tuple]:
            for conv, group in itertools.groupby(told(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
                _, _, audit = next(group)
                for place, (role, text) in enumerate(edited(audit, (r[1:] for r in group))):
                    yield conv, place, role, text

        return written(every(), schema, 500)

    return C.arrow_map(both, run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """Of turns as `turns` gives them: conv_id, repaired_sha256 of `role:text`, joined by line breaks."""
    kind = repaired.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64() if kind.typeName() == "long" else pa.string()), ("repaired_sha256", pa.string())])

        def every() -> Iterator[tuple]:
            for conv, group in itertools.groupby(told(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
                digest = hashlib.sha256()
                for k, (_, role, text) in enumerate(group):
                    digest.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
                yield conv, digest.hexdigest()

        return written(every(), schema)

    return C.arrow_map(repaired, run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """The columns of `audits` and repaired_sha256, one row for each conversation."""
    found = C.materialise(audits(rows))
    shown = digests(turns(rows, found)).withColumnRenamed("conv_id", "_conv")
    joined = found.join(shown, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by a hash of `conv_id:turn` (null: one space), modulo 20: 0 the row is dropped, 1 its text emptied, 2
    its stops taken out, 3 the row repeated, 4 its role set to user. A dropped row stays as one that is gone."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(name.cast("binary")) % 20
    spaced = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    hurt = rows.select("conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(spaced["role"]).alias("role"), text.alias("text"), (fate == 0).alias("gone"), fate.alias("fate"))
    return hurt.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "fate")
