"""SentencePiece encoding by streaming Viterbi, and decoding.

The lattice of a text has an edge for each vocabulary piece that fits at a place. The search goes once over the
text and keeps one best way to each place that a piece can still reach, a window as long as the longest piece. Ways
are a tree of back pointers. A place that leaves the window with no way going on from it is taken out of the tree,
and so are those before it that it leaves without one; as soon as all ways left go through one boundary, the ids
before it are committed. What is kept does not grow with the text.

The way to a place is scored as the model's kind asks. A unigram model sums piece scores. For a byte-pair model a
way is allowed when each two neighbouring pieces are what merging their joint text gives: merges never cross a
border that they do not cross in the pair alone, so exactly one way is allowed at each place, and it is the one
that merging the whole text gives. (Summing the scores of such a model, which are merge ranks, would give ids that
the model's own encoder does not.) A character without a piece is spelled in byte pieces.

Borders that no piece spans are known beforehand: there every way meets. Texts are cut at them, every cut goes
through the window, and the ids of short cuts are remembered in front of it, a bounded number of them. The many cuts
of a batch that fit the window go through it side by side: the same place of all of them at a time.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 decodes to a space, as the
model writes spaces with it; of equal scores the longer last piece wins; a very long text is searched in one pass,
with a window of the same length; rows are independent, repeated ones get equal ids; an empty table gives an empty
result; other columns are ignored unless named in `keep`. The vocabulary file's bytes are read once and sent.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

SPACE = "▁"
#: Cuts whose ids a worker remembers (twice as many at most), and pairs of pieces that it has judged.
MEMORY, PAIRS = 120_000, 150_000
#: Longest cut whose ids are remembered, in characters.
REMEMBERED = 64
#: Fewest cuts that go through the window side by side, most that do at a time, and places for the pairs judged for
#: them (a power of two).
FEWEST, SIDE_BY_SIDE, JUDGED = 1500, 8192, 1 << 19


class Vocabulary:
    """Pieces, scores and kinds, read from a serialized SentencePiece model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        self.pairs = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.prefix = m.normalizer_spec.add_dummy_prefix
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be decoded exactly")
        kinds = proto.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = np.zeros(256, np.int32)
        self.spelled: list[bytes] = []
        for k, p in enumerate(m.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = k
                self.spelled.append(bytes([value]))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece] = k
                self.scores[p.piece] = p.score
                self.spelled.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.spelled.append(b"")
        self.index()
        self.cut = self.cuts()
        size = np.array([len(x) for x in self.spelled], np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.lower = min(self.scores.values()) - 10.0

    def index(self) -> None:
        """The automaton that finds the pieces ending at each place, longest first."""
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, str]]:
        """(place of the last character, piece) in order; a character without a piece stands for itself."""
        found = self.automaton.iter(text)
        if alone := [(k, c) for k, c in enumerate(text) if c not in self.ids]:
            return heapq.merge(found, alone, key=lambda x: x[0])
        return found

    def cuts(self) -> re.Pattern | None:
        """Cuts at borders that no piece spans: before a run of spaces, around a line break without a piece,
        and before ASCII signs that never follow a letter within a piece."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return None
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        joined = {p[k + 1] for p in self.ids for k in range(len(p) - 1) if p[k].isalpha()}
        signs = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in joined)
        # a run of letters ends before such a sign; a run of anything else goes on to the next space
        words = f"{SPACE}*[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        return re.compile(f"{words}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}+" if alone else ""))


def way_to(end: int, last: dict[int, str], start: int = 0) -> list[str]:
    """The pieces of the way to a place, from one on it."""
    out = []
    while end > start:
        out.append(last[end])
        end -= len(out[-1])
    return out[::-1]


class Tables:
    """A byte-pair vocabulary as arrays, by which many cuts go through the window side by side."""

    def __init__(self, encoder: Encoder):
        self.encoder, v = encoder, encoder.v
        self.longest, self.n = v.longest, 1 + max(v.ids.values())
        self.piece, self.score, self.length = [""] * self.n, np.zeros(self.n), np.zeros(self.n, np.int64)
        nodes: dict[str, int] = {}  # prefixes of pieces
        whole = []  # the piece that a prefix is, or -1
        edges = []  # from prefix and character, in order of the prefixes that they lead to
        joins = {}  # from two pieces whose texts make a third
        for p, k in v.ids.items():
            self.piece[k], self.score[k], self.length[k] = p, v.scores[p], len(p)
            for end in range(1, len(p) + 1):
                if (head := p[:end]) not in nodes:
                    nodes[head] = len(whole)
                    edges.append(((nodes[head[:-1]] + 1 if end > 1 else 0) << 21) | ord(head[-1]))
                    whole.append(v.ids.get(head, -1))
                if end < len(p) and (a := v.ids.get(head)) is not None and (b := v.ids.get(p[end:])) is not None:
                    joins[a * self.n + b] = v.scores[p]
        self.whole = np.array(whole, np.int32)
        keys = np.array(edges, np.int64)
        self.edge_to = np.argsort(keys)
        self.edge_keys = keys[self.edge_to]
        self.join_keys = np.array(sorted(joins) or [-1], np.int64)
        self.join_scores = np.array([joins[k] for k in self.join_keys.tolist()] if joins else [0.0])
        # what each piece's last merge joins: -1 nothing, -2 not asked yet, -3 not told
        self.left, self.right = np.full(self.n, -2), np.full(self.n, -2)
        # judged pairs, twice the key and one if allowed; each key has one place, where the latest pair stays
        self.judged = np.full(JUDGED, -1, np.int64)

    def ask(self, pieces: np.ndarray) -> None:
        """Brings in the halves of pieces that were not asked for before."""
        for k in np.unique(pieces[self.left[pieces] == -2]).tolist():
            halves = self.encoder.halves_of(self.piece[k])
            ids = (-3, -3) if halves is None else [self.encoder.v.ids.get(h, -3) for h in halves] or (-1, -1)
            self.left[k], self.right[k] = (-3, -3) if -3 in ids else ids

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The scores of the pieces that the texts of two make, minus infinity if they make none."""
        keys = a * self.n + b
        at = np.minimum(np.searchsorted(self.join_keys, keys), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == keys, self.join_scores[at], -np.inf)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`Encoder.pair` of many pairs at once: the steps of `Encoder.apart`, one of all pairs at a time."""
        good, at, pairs = np.ones(len(a), bool), np.arange(len(a)), (a, b)
        bound, tie = np.full(len(a), -np.inf), np.zeros(len(a), bool)
        while len(at):
            across = self.joined(a, b)
            crossed = (across > bound) | (tie & (across == bound))
            good[at[crossed]] = False
            on = ~crossed
            self.ask(a[on])
            self.ask(b[on])
            untold = on & ((self.left[a] == -3) | (self.left[b] == -3))
            for k in at[untold].tolist():
                good[k] = self.encoder.pair(*(self.piece[x[k]] for x in pairs))
            on &= ~untold & ((self.left[a] >= 0) | (self.left[b] >= 0))
            at, a, b = at[on], a[on], b[on]
            undo_left = (self.left[a] >= 0) & ~((self.left[b] >= 0) & (self.score[b] <= self.score[a]))
            bound, tie = np.where(undo_left, self.score[a], self.score[b]), ~undo_left
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same by what is judged already."""
        keys = a * self.n + b
        place = (keys * 0x9E3779B1 >> 12) & (JUDGED - 1)
        found = self.judged[place]
        if (new := found >> 1 != keys).any():
            asked, which = np.unique(keys[new], return_inverse=True)
            told = asked * 2 + self.apart(asked // self.n, asked % self.n)
            found[new] = told[which]
            self.judged[place[new]] = found[new]
        return (found & 1).astype(bool)

    def matches(self, text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, lengths and pieces of all that fit in a text, by length. room: how many characters of its cut
        there are from each place on."""
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        first, size, piece = [], [], []
        for depth in range(1, self.longest + 1):
            keys = node << 21 | text[at + (depth - 1)]
            edge = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            there = np.flatnonzero(self.edge_keys[edge] == keys)
            at, node = at[there], self.edge_to[edge[there]]
            found = self.whole[node]
            good = np.flatnonzero(found >= 0)
            first.append(at[good])
            size.append(np.full(len(good), depth))
            piece.append(found[good])
            on = np.flatnonzero(room[at] > depth)
            at, node = at[on], node[on] + 1
        return np.concatenate(first), np.concatenate(size), np.concatenate(piece)

    def search(self, cuts: list[str]) -> list[bytes | None]:
        """The ids of cuts that the window holds whole, as 32-bit numbers; None if a character is without a piece."""
        text = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32).astype(np.int64)
        n, sizes = len(cuts), np.fromiter(map(len, cuts), np.int64, len(cuts))
        ends = np.cumsum(sizes)
        own = np.repeat(np.arange(n), sizes)
        first, size, piece = self.matches(text, ends[own] - np.arange(len(text)))
        spelled = np.bincount(own[first[: np.searchsorted(size, 2)]], minlength=n) == sizes
        # pieces by the place they end at, at each place the longest last
        own = own[first]
        end = first - (ends - sizes)[own] + size
        order = np.argsort(end.astype(np.int16), kind="stable")
        own, size, piece, end = own[order], size[order], piece[order], end[order]
        # by place and cut: the last piece of the allowed way to it
        last = np.full((self.longest + 1, n), -1, np.int64)
        at = np.searchsorted(end, np.arange(self.longest + 2))
        for k in range(1, self.longest + 1):
            some = slice(at[k], at[k + 1])
            cut, to, before = own[some], piece[some], k - size[some]
            was = last[before, cut]
            good = before == 0
            asked = np.flatnonzero(was >= 0)
            good[asked] = self.allowed(was[asked], to[asked])
            last[k, cut[good]] = to[good]
        spelled &= last[sizes, np.arange(n)] >= 0
        # the ways, followed back together
        on = np.flatnonzero(spelled)
        place = sizes[on]
        ways, cut_of = [], []
        while len(on):
            to = last[place, on]
            ways.append(to)
            cut_of.append(on)
            place = place - self.length[to]
            left = np.flatnonzero(place)
            on, place = on[left], place[left]
        if not ways:
            return [None] * n
        ids, cut = np.concatenate(ways[::-1]).astype(np.int32), np.concatenate(cut_of[::-1])
        flat = ids[np.argsort(cut, kind="stable")].tobytes()
        bounds = (np.cumsum(np.bincount(cut, minlength=n)) * 4).tolist()
        out: list[bytes | None] = [flat[lo:hi] for lo, hi in itertools.pairwise([0, *bounds])]
        for k in np.flatnonzero(~spelled).tolist():
            out[k] = None
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tables: Tables | None = None
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before the memory was last full
        self.allowed: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, ...] | None] = {}  # of a piece: what its last merge joins
        self.searched = self.kept = 0  # characters that went through the window, and the most places kept

    def merging(self, text: str) -> tuple[list[str], tuple[str, ...], bool]:
        """Byte-pair merging of a short text: always the best-scored neighbours, the leftmost on a tie. The pieces, the
        two that the last merge joined, and whether no merge has a better score than one before it."""
        scores = self.v.scores
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-scores[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores]
        heapq.heapify(heap)
        joined: tuple[str, ...] = ()
        ordered, latest = True, -float("inf")
        while heap:
            rank, i, p = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != p:
                continue
            ordered, latest = ordered and rank >= latest, rank
            joined = parts[i], parts[j]
            parts[i], parts[j] = p, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (q := p + parts[after[i]]) in scores:
                    heapq.heappush(heap, (-scores[q], i, q))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in scores:
                heapq.heappush(heap, (-scores[q], h, q))
        return [p for p in parts if p is not None], joined, ordered

    def merged(self, text: str) -> list[str]:
        return self.merging(text)[0]

    def halves_of(self, piece: str) -> tuple[str, ...] | None:
        """The two pieces whose merge makes this one, none for a character; None if merging its text gives others or
        does not go by falling scores."""
        parts, joined, ordered = self.merging(piece)
        found = self.halves[piece] = joined if parts == [piece] and ordered else None
        return found

    def apart(self, a: str, b: str) -> bool | None:
        """Whether two pieces keep apart while their joint text is merged; None if their halves do not tell. Merges on
        either side are undone, the latest first: the two at the border must never come before the merge undone."""
        scores, halves = self.v.scores, self.halves
        bound, tie = -float("inf"), False  # the score of the merge undone; whether the border comes first on a tie
        while True:
            across = scores.get(a + b)
            if across is not None and (across > bound or (tie and across == bound)):
                return False
            left = halves[a] if a in halves else self.halves_of(a)
            right = halves[b] if b in halves else self.halves_of(b)
            if left is None or right is None:
                return None
            if left and not (right and scores[b] <= scores[a]):
                bound, tie, a = scores[a], False, left[1]
            elif right:
                bound, tie, b = scores[b], True, right[0]
            else:
                return True

    def pair(self, a: str, b: str) -> bool:
        """Whether merging the text of two pieces gives these two."""
        if len(self.allowed) >= PAIRS:
            self.allowed.clear()
        found = self.apart(a, b)
        if found is None:
            found = self.merged(a + b) == [a, b]
        self.allowed[a, b] = found
        return found

    def merge_steps(self, text: str, last: dict[int, str], total: dict[int, float]) -> Iterator[int]:
        """Byte-pair model: puts the last piece of the allowed way to each place that has one in `last`."""
        allowed, longest, solved = self.allowed.get, self.v.longest, 0
        for at, piece in self.v.matches(text):
            end = at + 1
            if end != solved:
                was = last.get(end - len(piece))
                if was is not None and (not was or ((found := allowed((was, piece))) or (found is None and self.pair(was, piece)))):
                    solved = end
                    last[end] = piece
                    if end > longest:
                        yield end

    def score_steps(self, text: str, last: dict[int, str], total: dict[int, float]) -> Iterator[int]:
        """Unigram model: puts the last piece of the best-scored way to each place in `last`, its score in `total`."""
        scores, lower = self.v.scores, self.v.lower
        for end, found in itertools.groupby(self.v.matches(text), lambda x: x[0] + 1):
            best = None
            for _, piece in found:
                if (k := end - len(piece)) in last:
                    score = total[k] + scores.get(piece, lower)
                    if best is None or score > total[end]:
                        best, total[end] = piece, score
            if best is not None:
                last[end] = best
                if end > self.v.longest:
                    yield end

    def steps(self, text: str, last: dict[int, str], total: dict[int, float]) -> Iterator[int]:
        return (self.merge_steps if self.v.pairs else self.score_steps)(text, last, total)

    def whole(self, text: str) -> list[str]:
        """The pieces of a text that the window holds whole, so that nothing is committed before its end."""
        self.searched += len(text)
        last = {0: ""}
        for _ in self.steps(text, last, {0: 0.0}):
            pass
        return way_to(len(text), last)

    def stream(self, text: str) -> Iterator[str]:
        """The pieces of a text (a character without a piece stands for itself), committed as ways meet."""
        longest = self.v.longest
        self.searched += len(text)
        # the tree of ways, by place: the way's last piece, and its score
        last, total = {0: ""}, {0: 0.0}
        # how many ways go on from a place by one piece, and the exclusive or of the places that they go on to (of a
        # single one: that place); told from `last` once a place leaves the window
        onward: dict[int, int] = {}
        places: dict[int, int] = {}
        root = passed = counted = 0  # pieces are committed up to root; no later piece begins before passed
        for end in self.steps(text, last, total):
            for k in range(counted + 1, end + 1):
                if k in last:
                    before = k - len(last[k])
                    onward[before] = onward.get(before, 0) + 1
                    places[before] = places.get(before, 0) ^ k
            counted = end
            for k in range(passed, end - longest + 1):
                while k != root and k in last and not onward.get(k):  # no way goes on from here
                    before = k - len(last.pop(k))
                    onward[before] -= 1
                    places[before] ^= k
                    total.pop(k, None)
                    k = before
            passed = end - longest + 1
            while root < passed and onward.get(root) == 1:
                for kept in (last, onward, total):
                    kept.pop(root, None)
                root = places.pop(root)
                yield last[root]
            self.kept = max(self.kept, len(last))
        yield from way_to(len(text), last, root)

    def ids_of(self, cut: str) -> bytes:
        """The ids of a cut, as 32-bit numbers."""
        ids, spell = self.v.ids, self.v.byte_ids
        out: list[int] = []
        for piece in self.whole(cut) if len(cut) <= self.v.longest else self.stream(cut):
            k = ids.get(piece)
            if k is not None:
                out.append(k)
            else:
                out += spell[np.frombuffer(piece.encode(), np.uint8)].tolist()
        return array("i", out).tobytes()

    def searched_cuts(self, cuts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct cuts and their ids: the short ones side by side if there are many, all others one by one."""
        short = [c for c in cuts if len(c) <= self.v.longest] if self.v.pairs else []
        if len(short) < FEWEST:
            yield from ((c, self.ids_of(c)) for c in cuts)
            return
        self.tables = self.tables or Tables(self)
        step = -(-len(short) // -(-len(short) // SIDE_BY_SIDE))
        for lo in range(0, len(short), step):
            some = short[lo : lo + step]
            found = self.tables.search(some)
            self.searched += sum(len(c) for c, ids in zip(some, found, strict=True) if ids is not None)
            yield from ((c, self.ids_of(c) if ids is None else ids) for c, ids in zip(some, found, strict=True))
        yield from ((c, self.ids_of(c)) for c in cuts if len(c) > self.v.longest)

    def parts(self, text: str) -> list[str]:
        """The text as written, split at borders that no piece spans: into words with the space before them, into cuts
        where runs of spaces go across words."""
        if not text:
            return []
        if self.v.cut is None or "  " in text or text[0] == " " or SPACE in text:
            written = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
            return [written] if self.v.cut is None else self.v.cut.findall(written)
        parts = (SPACE + text).replace(" ", " " + SPACE).split(" ")
        if not self.v.prefix:
            parts[0] = parts[0][1:]
        return parts

    def solved(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that the memory lacks: those there were before it, or else of their cuts."""
        older, findall = self.older.get, self.v.cut.findall if self.v.cut else lambda p: [p]
        out: dict[str, bytes] = {}
        single, made = [], []  # parts that are one cut, and those of several with these (a cut stays one)
        for p in parts:
            if ids := older(p):
                out[p] = ids
            elif len(own := findall(p)) == 1:
                single.append(p)
            else:
                made.append((p, own))
        cuts = dict.fromkeys(itertools.chain.from_iterable(own for _, own in made))
        for c in cuts:
            cuts[c] = self.memory.get(c) or older(c)
        out.update(self.searched_cuts(list(dict.fromkeys(itertools.chain(single, (c for c, ids in cuts.items() if ids is None))))))
        for c, ids in cuts.items():
            out[c] = ids or out[c]
        for p, own in made:
            out[p] = b"".join([out[c] for c in own])
        return out

    def remember(self, found: dict[str, bytes]) -> None:
        """Keeps short ones; of more than the memory holds, the first."""
        if len(found) > MEMORY or max(map(len, found)) > REMEMBERED:
            found = dict(itertools.islice(((c, ids) for c, ids in found.items() if len(c) <= REMEMBERED), MEMORY))
        if len(self.memory) + len(found) > MEMORY:
            self.older, self.memory = self.memory, {}
        self.memory.update(found)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. What the memory lacks is solved once for all texts."""
        rows = [self.parts(t) for t in texts]
        distinct = dict.fromkeys(itertools.chain.from_iterable(rows))
        known = dict(zip(distinct, map(self.memory.get, distinct), strict=True))
        if missing := [p for p, ids in known.items() if ids is None]:
            solved = self.solved(missing)
            self.remember(solved)
            known.update(solved)
        return [np.frombuffer(b"".join(map(known.__getitem__, row)), np.int32) for row in rows]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]


#: The encoder of a worker, under its model's digest: the tasks of a worker share what it remembers.
_encoders: dict[bytes, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(model))
    return _encoders[key]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: pieces and bytes joined, without the space that encoding puts in front."""
    ids = np.asarray(ids, np.int64)
    size = v.size[ids]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.start[ids] - (ends - size), size)
    text = v.flat[at].tobytes().decode("utf-8", "replace")
    return text[1:] if v.prefix and text[:1] == " " else text


def tokenize(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), digests: bool = True) -> DataFrame:
    """The columns in `keep` and ids; with digests also n_ids, ids_sha256 (of little-endian 32-bit ids),
    decoded_sha256 and round_trip, whether decoding gave the text again."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        v = encoder.v
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = [x or "" for x in batch.column(0).to_pylist()]
                ids = encoder.encode_batch(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))]
                names = ["ids"]
                if digests:
                    decoded = [decode(v, x) for x in ids]
                    columns += [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                        pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
                    ]
                    names += ["n_ids", "ids_sha256", "decoded_sha256", "round_trip"]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *names])

    kept = C.text_first(docs, "text", keep)
    more = "ids array<int>" + (", n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean" if digests else "")
    return C.arrow_map_kept(kept, run, more)


def model_bytes(path: str | None = None, spark: SparkSession | None = None) -> bytes:
    """The vocabulary file's bytes. path: by default that of the public 32k model; one with a scheme is read by Spark,
    any other by the driver."""
    path = path or "/opt/tokenizers/piece_bpe_32k.model"
    if "://" in path:
        return bytes((spark or SparkSession.active()).read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()
