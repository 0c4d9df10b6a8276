"""Spelling variants: words one edit apart, grouped under the most frequent form.

Words are near if they differ by one inserted, deleted or replaced code point. Of two near words either the first half
or the second half of the one is in the other as it stands. So each word asks twice: in a forward automaton it follows
its first half exactly and completes the rest with one error; in a backward automaton, of the words reversed, it
follows its second half and completes the first. The automata are acyclic and minimal, and number their words: each
edge carries how many words come before those behind it, so that a walk gives the place of a word in the sorted list,
where its count stands. A pair that both searches find counts once: the backward one leaves out what has the same
first half.

Words meet in cells: a cell is named by a length and by the half that has to agree. A word stands in the cells of its
own length and of the lengths beside it, and asks in those of its own. Cells are dealt out by their name, so a search
meets all it can find, and an automaton is built for some cells at a time. A cell of more than CELL words is split as a
word is: the error lies in one half of what is still open, and the other half joins what has to agree (a beginning and
an end of the word then). That goes on until cells are small or one place is open, when at most 1 + 91 + 91^2 words
can agree in the rest. So no group grows without bound, and no pair is lost or found twice: a cell takes those pairs
that first differ within its open part.

Defined cases: null and empty texts have no words; a null doc_id is the empty text in the hash; documents that repeat an
id are read like others; text of any length is read whole, also a single run; of near words with equal counts the least
in code-point order is the form; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: What a run of letters is, the least length and count of a word, how much more frequent a form is, and
#: one run of how many loses a code point.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = 6, 5, 5, 199
#: Words of a cell above which it is split, rows of cells that an automaton is built for, distinct words that a task
#: counts before it hands them on.
CELL, GROUP, COUNTED = 20_000, 20_000, 200_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text) to (word, n), summed over some documents."""
    runs_of = re.compile(RUN).findall
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(runs_of(text.encode().translate(LOWER).decode())).items():
                if len(run) < LEAST_LENGTH:
                    continue
                h = zlib.crc32(run.encode(), seed)
                if not h % DAMAGED:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                counts[run] += n
            if len(counts) > COUNTED:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of the texts that are long and frequent enough."""
    found = C.arrow_map(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), counted_runs, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a walk sums up to the number of its word."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []  # by sign: the next state, and the words before those behind it
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}
        # states that may still change: whether one is final, and its edges so far; of the last word, one for each sign
        open_states: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            self.close(open_states, before, same)
            open_states += [([False], {}) for _ in word[same:]]
            open_states[-1][0][0] = True
            before = word
        self.close(open_states, before, 0)
        self.root = self.state(*open_states[0])

    def close(self, open_states: list, word: str, down_to: int) -> None:
        while len(open_states) > down_to + 1:
            state = self.state(*open_states.pop())
            open_states[-1][1][word[len(open_states) - 1]] = state

    def state(self, final: list[bool], edges: dict[str, int]) -> int:
        """The state that goes on alike, a new one if there is none."""
        key = (final[0], *edges.items())
        if (found := self.known.get(key)) is None:
            found = self.known[key] = len(self.size)
            at, numbered = int(final[0]), {}
            for sign, to in edges.items():
                numbered[sign] = (to, at)
                at += self.size[to]
            self.final.append(final[0])
            self.edges.append(numbered)
            self.size.append(at)
        return found

    def near(self, word: str, exact: int) -> list[int]:
        """The numbers of the words one edit from this one whose first `exact` signs are the same, each once: a sign of a
        run is taken out or put in at the run's end."""
        edges, final, n = self.edges, self.final, len(word)
        at, number, out = self.root, 0, []
        for sign in word[:exact]:
            if (step := edges[at].get(sign)) is None:
                return out
            at, number = step[0], number + step[1]

        def complete(at: int, number: int, k: int) -> None:
            while k < n:
                if (step := edges[at].get(word[k])) is None:
                    return
                at, number, k = step[0], number + step[1], k + 1
            if final[at]:
                out.append(number)

        for i in range(exact, n + 1):
            here = word[i] if i < n else ""
            if here and (i + 1 == n or word[i + 1] != here):
                complete(at, number, i + 1)
            for sign, (to, more) in edges[at].items():
                if sign != here:
                    complete(to, number + more, i)
                    if here:
                        complete(to, number + more, i + 1)
            if not here or (step := edges[at].get(here)) is None:
                break
            at, number = step[0], number + step[1]
        return out


def first_difference(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        k += 1
    return k


def asked(rows: list[tuple[int, int, int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """rows: length, beginning and end that have to agree, word, n; of whole cells. For each word that asks and finds
    something: word, how many near words, the largest count among them and the least word of that count."""
    for backward in (False, True):
        own = [r for r in rows if (r[1] < r[2]) == backward]
        turn = -1 if backward else 1
        counts = {word[::turn]: n for _, _, _, word, n in own}
        numbered = sorted(counts)
        automaton = Automaton(numbered)
        for length, begins, ends, word, _ in own:
            if len(word) != length:
                continue
            near, most, form = 0, 0, ""
            for number in automaton.near(word[::turn], ends if backward else begins):
                other = numbered[number][::turn]
                if ends:  # the pair belongs to the cell in whose open part it first differs
                    same = first_difference(word, other)
                    if not begins <= same < length - ends:
                        continue
                near += 1
                n = counts[numbered[number]]
                if n > most or (n == most and other < form):
                    most, form = n, other
            if near:
                yield word, near, most, form


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, length, begins, ends, word, n), sorted by cell, some cells at a time."""
    held: list[tuple[int, int, int, str, int]] = []
    last = None

    def found() -> pa.RecordBatch:
        columns = list(zip(*asked(held), strict=True)) or [(), (), (), ()]
        held.clear()
        kinds = [("word", pa.string()), ("near", pa.int64()), ("most", pa.int64()), ("form", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

    for batch in batches:
        for cell, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if cell != last and len(held) >= GROUP:
                yield found()
            last = cell
            held.append(tuple(row))
    yield found()


def placed(rows: DataFrame, parts: list[tuple[Column, Column]]) -> DataFrame:
    """rows (word, n, length, ...) in the cells of the given beginnings and ends."""
    part = F.explode(F.array(*[F.struct(b.cast("int").alias("begins"), e.cast("int").alias("ends")) for b, e in parts]))
    out = rows.withColumn("part", part).select("word", "n", "length", F.col("part.begins").alias("begins"), F.col("part.ends").alias("ends"))
    agree = [F.left("word", F.col("begins")), F.right("word", F.col("ends"))]
    return out.withColumn("cell", F.xxhash64("length", "begins", "ends", *agree))


def cells(words: DataFrame) -> DataFrame:
    """Each word in the cells where it asks or may be found; no cell that can be split holds more than CELL words."""
    own = F.length("word")
    lengths = words.withColumn("length", F.explode(F.array(own - 1, own, own + 1))).where(F.col("length") >= LEAST_LENGTH)
    half = F.floor(F.col("length") / 2)
    now, done = placed(lengths, [(half, F.lit(0)), (F.lit(0), F.col("length") - half)]), []
    while True:
        sizes = now.groupBy("cell").agg(F.count("*").alias("words"), F.first(F.col("length") - F.col("begins") - F.col("ends")).alias("open"))
        large = C.materialise(sizes.where((F.col("words") > CELL) & (F.col("open") > 1)).select("cell"))
        if large.isEmpty():
            break
        done.append(now.join(large, "cell", "left_anti"))
        middle = F.floor((F.col("begins") + F.col("length") - F.col("ends")) / 2)
        now = placed(now.join(large, "cell", "left_semi"), [(middle, F.col("ends")), (F.col("begins"), F.col("length") - middle)])
    for rows in done:
        now = now.unionByName(rows)
    return now


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each (word, form): the last of its forms. Each round looks twice as far, and counts grow by TIMES
    from form to form, so that rounds grow with the logarithm of the logarithm of the counts."""
    now = C.materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        far = C.materialise(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        now = far.select("word", "root")
        if far.where("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """words: word, n. Each word with form, root, n_near and form_n."""
    words = C.materialise(words)
    dealt = cells(words).select("cell", "length", "begins", "ends", "word", "n").repartition("cell").sortWithinPartitions("cell")
    halves = C.arrow_map(dealt, search, "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("m"), F.col("form")))
    near = halves.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    far = F.col("best.m") * -1 >= F.col("n") * TIMES
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n")
    )
    joined = C.materialise(joined)
    last = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs))
