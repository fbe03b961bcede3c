"""N-best segmentation of texts into SentencePiece pieces, and decoding.

A text, with a mark for every blank and one in front, is a lattice of the vocabulary's pieces;
the score of a segmentation is the sum of its pieces' scores. A forward Viterbi pass finds the
best score of every prefix. These scores are exact heuristics for an A-star search that runs
backward over the lattice, so segmentations come out best first.

Where two neighbouring characters stand side by side in no piece, no piece spans their border, so
the lattice falls apart there. Each part is solved on its own, words are remembered within a task,
and the best combinations of the parts' lists are those of the text. All words of a batch are put
together at once, in arrays. A character without
a piece of its own is one arc of UTF-8 byte pieces, ten below the lowest score. Segmentations of
equal scores come in a fixed order.

Defined cases: a null text counts as empty, and an empty text has no pieces and score 0; a text
with fewer segmentations than asked for has them all; U+2581 in a text is read as a blank, as the
vocabulary's format defines it; rows that repeat an id are encoded one by one; an empty table
gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
import sys
import types
from collections.abc import Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from carewise.llm.common import sliced

MARK = "▁"
BEST = 3
UNKNOWN_PENALTY = 10.0
# Words and parts a task remembers before it starts anew; some 450 bytes each.
REMEMBERED_WORDS = 900_000
# Parts of at most so many characters are searched side by side, so many at once.
SHORT_PART = 24
SIDE_BY_SIDE = 2048
WORD = re.compile(" *[^ \n]+| +|\n")

INFINITE = float("inf")

# a segmentation: its score and its ids as little-endian 32-bit bytes
Scored = tuple[float, bytes]
# the n best of a word: score, loss of the second, ids, and (loss, ids) of the second best on
Choices = tuple[float, float, bytes, tuple[tuple[float, bytes], ...]]


def _choices(found: list[Scored]) -> Choices:
    score, ids = found[0]
    if len(found) == 1:
        return score, INFINITE, ids, ()
    rest = tuple([(score - other, more) for other, more in found[1:]])
    return score, rest[0][0], ids, rest


def _bytes(pieces) -> bytes:
    """The ids of a linked list of pieces."""
    ids: list[int] = []
    while pieces is not None:
        own, pieces = pieces
        if isinstance(own, int):
            ids.append(own)
        else:
            ids += own
    return struct.pack(f"<{len(ids)}I", *ids)


@contextmanager
def no_collection():
    """No search for cycles meanwhile: what is remembered has none, and walking through all of it
    again and again takes a quarter of the time."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


class Numbered(dict):
    """Numbers in order of arrival; ``new`` has the keys that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Lists:
    """Segmentations by number: the best one's score, the losses of the others, infinite where there are fewer, and the ids of all."""

    def __init__(self, best: int):
        self.scores, self.losses = np.zeros(0), np.zeros((0, best - 1))
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros((0, best), dtype=np.int32)
        self.ids = np.zeros(0, dtype="<u4")

    def add(self, scores: np.ndarray, losses: np.ndarray, sizes: np.ndarray, ids: np.ndarray, order: np.ndarray | None = None) -> None:
        """More of them; ``order`` has the place of each among the given ones. The ids lie by segmentation, best first."""
        whole = sizes.sum(axis=1, dtype=np.int64)
        starts, sizes = np.cumsum(whole) - whole + len(self.ids), sizes.astype(np.int32)
        more = (scores, losses, starts, sizes) if order is None else (v[order] for v in (scores, losses, starts, sizes))
        self.scores, self.losses, self.starts, self.sizes = map(np.concatenate, zip((self.scores, self.losses, self.starts, self.sizes), more))
        self.ids = np.concatenate((self.ids, ids))

    def spelt(self, which: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids, and the ids, of the given choice of each of ``which``."""
        starts, sizes = self.starts[which], self.sizes[which, choice].astype(np.int64)
        other = np.flatnonzero(choice)
        before = np.arange(self.sizes.shape[1]) < choice[other, None]
        starts[other] += (self.sizes[which[other]] * before).sum(axis=1, dtype=np.int64)
        return sizes, self.ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def _open(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The places in ``which`` of each group that may take another choice, in order, -1 where there are fewer."""
        begins, groups, more = np.cumsum(counts) - counts, len(counts), self.losses.shape[1]
        # both of two, as in ``Pieces.combined``
        rounds = max(more, 2) if more else 0
        out = np.full((groups, rounds), len(which), dtype=np.int64)
        left, group = self.losses[which, 0] if more else None, np.repeat(np.arange(groups), counts)
        for i in range(rounds):
            least = np.minimum.reduceat(left, begins)
            there = np.flatnonzero((left == least[group]) & (left < INFINITE))
            there = there[np.diff(group[there], prepend=-1) > 0]
            if i >= more:
                there = there[counts[group[there]] == 2]
            if not len(there):
                break
            out[group[there], i] = there
            left[there] = INFINITE
        out.sort(axis=1)
        out[out == len(which)] = -1
        return out

    def combined(self, which: np.ndarray, counts: np.ndarray, spelt: int) -> tuple[np.ndarray, ...]:
        """Scores and losses of the best ways to take one segmentation of each of ``which``, ``counts`` by ``counts``,
        and the sizes and ids of the first ``spelt`` of them.

        As in ``Pieces.combined``, the n - 1 with the smallest loss of a second choice matter, and of
        equal losses the one with the earlier choices comes first.
        """
        begins, groups, best = np.cumsum(counts) - counts, len(counts), self.losses.shape[1] + 1
        losses = np.full((groups, best), INFINITE)
        losses[:, 0] = 0
        open_ = self._open(which, counts)
        taken, code = np.zeros((groups, best, open_.shape[1]), dtype=np.int64), np.zeros((groups, best), dtype=np.int64)
        # a pair of choices is no better than all pairs of choices at or before both
        before, choice = (v.ravel() for v in np.divmod(np.arange(best * best), best))
        worse = (before + 1) * (choice + 1) > best
        before, choice = before[~worse], choice[~worse]
        for i in range(open_.shape[1]):
            own = np.flatnonzero(open_[:, i] >= 0)
            if not len(own):
                continue
            more = np.concatenate((np.zeros((len(own), 1)), self.losses[which[open_[own, i]]]), axis=1)
            sums, codes = losses[own][:, before] + more[:, choice], code[own].argsort(axis=1).argsort(axis=1)[:, before] * best + choice
            first = np.lexsort((codes, sums), axis=1)[:, :best]
            rows = np.arange(len(own))[:, None]
            losses[own], code[own], taken[own] = sums[rows, first], codes[rows, first], taken[own[:, None], before[first]]
            taken[own, :, i] = choice[first]
        # the words of every spelt combination; few of them take another choice than their first
        group, k = np.nonzero(losses[:, :spelt] < INFINITE)
        words = counts[group]
        at = np.cumsum(words) - words
        place, chosen = np.repeat(begins[group] - at, words) + np.arange(int(words.sum())), np.zeros(int(words.sum()), dtype=np.int64)
        for i in range(open_.shape[1]):
            own = np.flatnonzero(open_[group, i] >= 0)
            chosen[at[own] + open_[group[own], i] - begins[group[own]]] = taken[group[own], k[own], i]
        per_word, ids = self.spelt(which[place], chosen)
        sizes = np.zeros((groups, spelt), dtype=np.int64)
        sizes[group, k] = np.add.reduceat(per_word, at)
        return np.add.reduceat(self.scores[which], begins), losses[:, 1:], sizes, ids


class Pieces:
    """The vocabulary, with n-best lists of words that were met before."""

    def __init__(self, path: str, best: int = BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.best = best
        self.normal: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.normal[piece] = (model.get_score(i), i)
                self.bytes_of.append(piece.encode())
        self.plain_bytes = pa.array([b.replace(MARK.encode(), b" ") for b in self.bytes_of], pa.large_binary())
        # every start of a piece; empty where it is no piece itself
        self.starts = {piece[:i]: () for piece in self.normal for i in range(1, len(piece))} | self.normal
        self.unknown = min((s for s, _ in self.normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.neighbours = {piece[i:i + 2] for piece in self.normal for i in range(len(piece) - 1)}
        # words may be cut at marks only if no piece has one behind another character
        self.by_word = not any(a != MARK and b == MARK or "\n" in a + b for a, b in self.neighbours)
        self._grow_tree()
        self.forget()

    def _grow_tree(self) -> None:
        """The starts of pieces as a tree: a hash table of (node, character) and the nodes they lead to."""
        self.pair_keys = np.array([*sorted(ord(a) << 21 | ord(b) for a, b in self.neighbours), -1], dtype=np.int64)
        self.letters = {c: i for i, c in enumerate(sorted({c for piece in self.normal for c in piece}))}
        number = {"": 0} | {start: i for i, start in enumerate(self.starts, 1)}
        edges = sorted((number[start[:-1]] * len(self.letters) + self.letters[start[-1]], number[start]) for start in self.starts)
        keys, nodes = (np.array(v, dtype=np.int64) for v in zip(*edges)) if edges else (np.zeros(0, dtype=np.int64),) * 2
        # open addressing at most a quarter full; the last place is kept free
        self.edge_bits = max(2, int(4 * len(keys)).bit_length())
        self.edge_keys = np.full((1 << self.edge_bits) + len(keys) + 1, -1, dtype=np.int64)
        self.edge_nodes = np.zeros(len(self.edge_keys), dtype=np.int64)
        slot, left = self._edge_slots(keys), np.arange(len(keys))
        while len(left):
            free = self.edge_keys[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.edge_keys[slot[put]], self.edge_nodes[slot[put]] = keys[put], nodes[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] += 1
        self.first_nodes = np.array([number.get(c, 0) for c in self.letters], dtype=np.int64)
        self.node_inner = np.zeros(len(number), dtype=bool)  # whether a piece goes on from here
        self.node_inner[keys // max(len(self.letters), 1)] = True
        self.node_gain = np.zeros(len(number))
        self.node_id = np.full(len(number), -1, dtype=np.int64)
        for piece, (gain, i) in self.normal.items():
            self.node_gain[number[piece]], self.node_id[number[piece]] = gain, i

    def _edge_slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.edge_bits)).astype(np.int64)

    def forget(self) -> None:
        self.words: dict[str, Choices] = {}
        self.parts: dict[str, Choices] = {}
        self.word_numbers, self.part_numbers = Numbered(), Numbered()
        self.word_lists, self.part_lists = Lists(self.best), Lists(self.best)

    def arcs(self, part: str) -> list[list[tuple[int, float, int | tuple[int, ...]]]]:
        """Pieces that end at each position, as (start, score, id or byte ids)."""
        size, find = len(part), self.starts.get
        out: list[list] = [[] for _ in range(size + 1)]
        for start in range(size):
            for end in range(start + 1, size + 1):
                found = find(part[start:end])
                if found:
                    out[end].append((start, found[0], found[1]))
                elif found is None:
                    break  # no piece starts like this
            if not out[start + 1] or out[start + 1][-1][0] != start:
                ids = tuple(self.byte_ids[b] for b in part[start].encode("utf-8", "surrogatepass"))
                out[start + 1].append((start, self.unknown, ids))
        return out

    def search(self, part: str) -> Choices:
        """The n best segmentations of one part."""
        arcs = self.arcs(part)
        ahead = [0.0]
        for own in arcs[1:]:
            ahead.append(max([ahead[start] + score for start, score, _ in own]))
        # (minus the best total over this suffix, order of arrival, position, score and pieces of the suffix)
        heap = [(-ahead[-1], 0, len(part), 0.0, None)]
        visits = [0] * (len(part) + 1)
        arrived, found = 0, []
        while heap and len(found) < self.best:
            _, _, at, score, pieces = heapq.heappop(heap)
            if visits[at] == self.best:
                continue  # the n best ones through here are known
            visits[at] += 1
            if not at:
                found.append((score, _bytes(pieces)))
                continue
            for start, gain, own in arcs[at]:
                arrived += 1
                heapq.heappush(heap, (-(ahead[start] + score + gain), arrived, start, score + gain, (own, pieces)))
        return _choices(found)

    def search_all(self, parts: list[str]) -> list[Choices]:
        """``search`` of many parts; short ones step side by side, each through its own lattice."""
        found: dict[str, Choices] = {}
        for some in self._short_of(parts):
            found.update(zip(some, self._side_by_side(some)))
        return [found[p] if p in found else self.search(p) for p in parts]

    def _short_of(self, parts: list[str]) -> list[list[str]]:
        """The parts that are searched side by side, by length and so many at once."""
        short = [p for p in parts if 1 < len(p) <= SHORT_PART and all(map(self.normal.__contains__, p))]
        short.sort(key=len)
        return [short[first:first + SIDE_BY_SIDE] for first in range(0, len(short), SIDE_BY_SIDE)]

    def _list_parts(self, parts: list[str]) -> None:
        """Numbered parts are searched like in ``search_all`` and put on the lists."""
        if not parts:
            return
        order, made = {}, []
        for some in self._short_of(parts):
            order.update(zip(some, range(len(order), len(order) + len(some))))
            scores, n_found, n_pieces, ids = self._searched(some, self.best)
            there = np.arange(self.best) < n_found[:, None]
            losses, sizes = scores[:, :1] - scores, np.zeros((len(some), self.best), dtype=np.int64)
            losses[~there], sizes[there] = INFINITE, n_pieces
            made.append((scores[:, 0], losses[:, 1:], sizes, ids))
        rest = [p for p in parts if p not in order]
        if rest:
            order.update(zip(rest, range(len(order), len(parts))))
            found = list(map(self.search, rest))
            losses = [[*[loss for loss, _ in more], *[INFINITE] * (self.best - 1 - len(more))] for _, _, _, more in found]
            every = [[ids, *[other for _, other in more]] for _, _, ids, more in found]
            sizes = np.array([[*[len(ids) // 4 for ids in own], *[0] * (self.best - len(own))] for own in every], dtype=np.int64)
            ids = np.frombuffer(b"".join(chain.from_iterable(every)), dtype="<u4")
            made.append((np.array([score for score, *_ in found]), np.array(losses).reshape(len(rest), -1), sizes, ids))
        self.part_lists.add(*map(np.concatenate, zip(*made)), np.fromiter(map(order.__getitem__, parts), dtype=np.int64, count=len(parts)))

    def _list_words(self, words: list[str]) -> None:
        """Numbered words are put on the lists, from those of their parts."""
        if not words:
            return
        parts, counts = self._cut([w.replace(" ", MARK) for w in words])
        which = np.fromiter(map(self.part_numbers.__getitem__, parts), dtype=np.int64, count=len(parts))
        self._list_parts(self.part_numbers.taken())
        self.word_lists.add(*self.part_lists.combined(which, counts, self.best))

    def _arcs_of(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """All arcs in order of end, part and start: the arcs' starts, scores and ids, and the place
        of the first arc and the number of arcs of each (end, part)."""
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        most = int(sizes.max())
        shown = np.full((len(parts), most), -1, dtype=np.int64)
        shown[np.arange(most) < sizes[:, None]] = np.fromiter(map(self.letters.__getitem__, "".join(parts)), dtype=np.int64, count=int(sizes.sum()))
        lane, start = np.nonzero(shown >= 0)
        # every character is a piece
        end, node, kept = start + 1, self.first_nodes[shown[lane, start]], []
        while True:
            whole = self.node_id[node] >= 0
            kept.append((lane[whole], start[whole], end[whole], node[whole]))
            inside = (end < sizes[lane]) & self.node_inner[node]
            lane, start, end, node = lane[inside], start[inside], end[inside], node[inside]
            if not len(lane):
                break
            key = node * len(self.letters) + shown[lane, end]
            edge = self._edge_slots(key)
            there = self.edge_keys.take(edge)
            further = np.flatnonzero((there != key) & (there >= 0))
            while len(further):
                edge[further] += 1
                there[further] = self.edge_keys.take(edge[further])
                further = further[(there[further] != key[further]) & (there[further] >= 0)]
            fits = there == key
            lane, start, end, node = lane[fits], start[fits], end[fits] + 1, self.edge_nodes[edge[fits]]
        lane, start, end, node = map(np.concatenate, zip(*kept))
        place = end * len(parts) + lane
        order = np.argsort(place * most + start)
        counts = np.bincount(place, minlength=(most + 1) * len(parts))
        return start[order], self.node_gain[node[order]], self.node_id[node[order]], np.cumsum(counts) - counts, counts

    def _side_by_side(self, parts: list[str]) -> list[Choices]:
        """The same search as ``search``, one step of all parts at a time."""
        scores, n_found, n_pieces, ids = self._searched(parts, self.best)
        packed, stops = ids.tobytes(), (4 * np.cumsum(n_pieces)).tolist()
        flat = scores[np.arange(self.best) < n_found[:, None]].tolist()
        every = [(s, packed[a:b]) for s, a, b in zip(flat, [0, *stops], stops)]
        stops = np.cumsum(n_found).tolist()
        return [_choices(every[a:b]) for a, b in zip([0, *stops], stops)]

    def _searched(self, parts: list[str], spelt: int) -> tuple[np.ndarray, ...]:
        """The scores of each part's n best and their number, and the numbers of pieces and the ids of the first ``spelt`` of them.

        Entries of a part's heap stand in order of arrival, so the first of the best ones is next.
        """
        lanes = len(parts)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=lanes)
        most = int(sizes.max())
        starts, gains, ids, first_arc, arc_counts = self._arcs_of(parts)
        ahead = np.zeros((lanes, most + 1))
        for end in range(1, most + 1):
            own = np.flatnonzero(sizes >= end)
            begin = first_arc[end * lanes + own]
            stop = int(begin[-1] + arc_counts[end * lanes + own[-1]])
            of_arc = np.repeat(own, arc_counts[end * lanes + own])
            sums = ahead[of_arc, starts[begin[0]:stop]] + gains[begin[0]:stop]
            ahead[own, end] = np.maximum.reduceat(sums, begin - begin[0])
        # entries lie at lane * width + order of arrival
        rows, width = np.arange(lanes), 32
        total, score = np.full(lanes * width, -INFINITE), np.zeros(lanes * width)
        at, parent, arc = (np.zeros(lanes * width, dtype=np.int64) for _ in range(3))
        total[::width], at[::width], parent[::width] = ahead[rows, sizes], sizes, -1
        used, visits = np.ones(lanes, dtype=np.int64), np.zeros(lanes * (most + 1), dtype=np.int64)
        ends, n_ends = np.zeros((lanes, self.best), dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        ahead, live = ahead.ravel(), rows
        while len(live):
            open_ = total.reshape(lanes, width)[live, : int(used[live].max())]
            slot = open_.argmax(axis=1)
            entry = live * width + slot
            some = total.take(entry) > -INFINITE
            if not some.all():
                live, slot, entry = live[some], slot[some], entry[some]
            total[entry] = -INFINITE
            where = at.take(entry)
            visit = live * (most + 1) + where
            fresh = visits.take(visit) < self.best  # else the n best ones through here are known
            visits[visit] += fresh
            done = np.flatnonzero(fresh & (where == 0))
            ends[live[done], n_ends[live[done]]] = slot[done]
            n_ends[live[done]] += 1
            further = np.flatnonzero(fresh & (where > 0))
            if len(further):
                lane, entry = live[further], entry[further]
                place = where[further] * lanes + lane
                counts = arc_counts.take(place)
                begins = np.cumsum(counts) - counts
                offset = np.arange(int(begins[-1] + counts[-1]))
                taken = offset + np.repeat(first_arc.take(place) - begins, counts)
                while int((used[lane] + counts).max()) > width:
                    wider = ((total, -INFINITE), (score, 0), (at, 0), (parent, 0), (arc, 0))
                    total, score, at, parent, arc = (
                        np.concatenate([a.reshape(lanes, width), np.full((lanes, width), fill, a.dtype)], axis=1).ravel() for a, fill in wider
                    )
                    entry = entry + lane * width
                    width *= 2
                into = offset + np.repeat(lane * width + used[lane] - begins, counts)
                used[lane] += counts
                before, gain, start = np.repeat(score.take(entry), counts), gains.take(taken), starts.take(taken)
                total[into] = ahead.take(np.repeat(lane * (most + 1), counts) + start) + before + gain
                score[into], at[into], arc[into] = before + gain, start, taken
                parent[into] = np.repeat(entry - lane * width, counts)
            open_lanes = n_ends[live] < self.best
            if not open_lanes.all():
                live = live[open_lanes]
        entries = rows[:, None] * width + ends
        # the pieces from the start of the text on, which was reached last
        lane, k = np.nonzero(np.arange(spelt) < n_ends[:, None])
        entry = entries[lane, k]
        pieces, n_pieces = np.zeros((len(lane), most), dtype="<u4"), np.zeros(len(lane), dtype=np.int64)
        left = np.arange(len(lane))
        while len(left):
            pieces[left, n_pieces[left]] = ids[arc[entry[left]]]
            n_pieces[left] += 1
            entry[left] = lane[left] * width + parent[entry[left]]
            left = left[parent[entry[left]] >= 0]
        return score[entries], n_ends, n_pieces, pieces[np.arange(most) < n_pieces[:, None]]

    def parts_of(self, words: list[str]) -> list[list[str]]:
        """The parts of each word between characters that stand side by side in no piece."""
        parts, counts = self._cut(words)
        stops = np.cumsum(counts).tolist()
        return [parts[a:b] for a, b in zip([0, *stops], stops)]

    def _cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """All parts of some words, and their numbers by word."""
        whole = "".join(words)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        inside = self.pair_keys[np.searchsorted(self.pair_keys[:-1], pairs)] == pairs
        stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        inside[stops[:-1] - 1] = False
        cuts = np.concatenate(([0], np.flatnonzero(~inside) + 1, [len(whole)]))
        parts = [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return parts, np.diff(np.searchsorted(cuts, stops), prepend=0)

    def of_words(self, words: list[str]) -> list[Choices]:
        """The n best segmentations of words, from those of their parts."""
        if not words:
            return []
        cut = self.parts_of(words)
        known = self.parts
        new = list({p for parts in cut for p in parts}.difference(known))
        known.update(zip(new, self.search_all(new)))
        return [known[parts[0]] if len(parts) == 1 else _choices(self.combined([known[p] for p in parts])) for parts in cut]

    def combined(self, lists: list[Choices]) -> list[Scored]:
        """The n best ways to take one segmentation from each list.

        Lists beyond the n - 1 with the smallest loss of a second choice keep their first choice:
        a change there is no better than the n - 1 single changes of the others.
        """
        if len(lists) == 2:
            (one, _, first, rest), (two, _, second, more) = lists
            total = one + two
            if not more:
                return [(total, first + second), *[(total - loss, other + second) for loss, other in rest]]
            firsts, seconds = ((0.0, first), *rest), ((0.0, second), *more)
            # a pair of choices is no better than all pairs of choices at or before both
            pairs = [(x + y, k, m) for k, (x, _) in enumerate(firsts) for m, (y, _) in enumerate(seconds[: self.best // (k + 1)])]
            pairs.sort()
            return [(total - loss, firsts[k][1] + seconds[m][1]) for loss, k, m in pairs[: self.best]]
        scores, losses, ids, rest = zip(*lists)
        total, losses, open_ = sum(scores), list(losses), []
        for _ in range(min(self.best - 1, len(losses))):
            least = min(losses)
            if least == INFINITE:
                break
            open_.append(losses.index(least))
            losses[open_[-1]] = INFINITE
        open_.sort()
        choices = [(0.0, ())]
        for i in open_:
            pairs = [
                (loss + more, (*taken, k))
                for before, (loss, taken) in enumerate(choices)
                for k, more in enumerate([0.0, *[m for m, _ in rest[i]]][: self.best // (before + 1)])
            ]
            pairs.sort()
            choices = pairs[: self.best]
        whole, out = b"".join(ids), []
        begins = [sum(map(len, ids[:i])) for i in open_]
        for loss, taken in choices:
            pieces, end = [], 0
            for i, begin, k in zip(open_, begins, taken):
                if k:
                    pieces += whole[end:begin], rest[i][k - 1][1]
                    end = begin + len(ids[i])
            out.append((total - loss, b"".join([*pieces, whole[end:]]) if pieces else whole))
        return out

    def encode(self, text: str) -> list[Scored]:
        """The n best segmentations of a text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[Scored]]:
        """The n best segmentations of each text; all new words are looked at together."""
        if len(self.words) + len(self.parts) > REMEMBERED_WORDS:
            self.forget()
        # blanks become marks in new words only
        cut, known = self.words_of(texts), self.words
        new = list(set().union(*cut).difference(known))
        known.update(zip(new, self.of_words([w.replace(" ", MARK) for w in new])))
        return [self.combined(list(map(known.__getitem__, words))) if words else [(0.0, b"")] for words in cut]

    def words_of(self, texts: list[str]) -> list[list[str]]:
        plain = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        return [WORD.findall(p) if self.by_word or not p else [p] for p in plain]

    def encode_lists(self, texts: list[str], spelt: int) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        """What ``encode_all`` finds, in arrays: the numbers of ids of the first ``spelt`` segmentations of
        each text, these ids and the scores of the n best. A text with fewer has no ids for the others."""
        if len(self.word_numbers) + len(self.part_numbers) > REMEMBERED_WORDS:
            self.forget()
        cut = self.words_of(texts)
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        which = np.fromiter(map(self.word_numbers.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
        self._list_words(self.word_numbers.taken())
        sizes, scores = np.zeros((len(texts), spelt), dtype=np.int64), np.full((len(texts), self.best), -INFINITE)
        scores[:, 0] = 0
        ids, some = np.zeros(0, dtype="<u4"), counts > 0
        if some.any():
            total, losses, sizes[some], ids = self.word_lists.combined(which, counts[some], spelt)
            scores[some] = np.concatenate((total[:, None], total[:, None] - losses), axis=1)
        return sizes, ids, [[s for s in own if s > -INFINITE] for own in scores.tolist()]

    def encode_best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        """``encode_lists`` with the ids of the best segmentation only."""
        sizes, ids, scores = self.encode_lists(texts, 1)
        return sizes[:, 0], ids, scores

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:]

    def decode_all(self, found: list[bytes]) -> list[str]:
        """``decode`` of packed ids, all of them looked up at once."""
        return self.decode_flat(np.array([len(f) // 4 for f in found], dtype=np.int64), np.frombuffer(b"".join(found), dtype="<u4"))

    def decode_flat(self, sizes: np.ndarray, ids: np.ndarray) -> list[str]:
        """``decode`` of so many ids for each text."""
        if not len(ids):
            return [""] * len(sizes)
        looked_up = self.plain_bytes.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(looked_up.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        data = looked_up.buffers()[2].to_pybytes() if at[-1] else b""
        cuts = at[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:])]
        # a mark can also come from byte pieces
        return [(t.replace(MARK, " ") if MARK in t else t)[1:] for t in texts]


def worker_pieces(path: str, best: int) -> Pieces:
    """The vocabulary of this Python worker, which lives as long as the worker; remembered words
    are forgotten after each task, so that idle workers hold no memory."""
    kept = sys.modules.setdefault("_carewise_pieces", types.ModuleType("_carewise_pieces")).__dict__
    key = f"{best}:{path}"
    if key not in kept:
        kept[key] = Pieces(path, best)
    return kept[key]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _added(docs: DataFrame, *fields: T.StructField) -> tuple[DataFrame, T.StructType]:
    kept = docs.drop(*[f.name for f in fields])
    return kept, T.StructType(kept.schema.fields + list(fields))


INTS = T.ArrayType(T.IntegerType())
ENCODED = {
    "ids": (INTS, pa.list_(pa.int32())),
    "scores": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
    "other_ids": (T.ArrayType(INTS), pa.list_(pa.list_(pa.int32()))),
    "decoded": (T.StringType(), pa.string()),
}


def encode(
    docs: DataFrame, model: str | None = None, best: int = BEST, text: str = "text", columns: Sequence[str] = ("ids", "scores", "other_ids")
) -> DataFrame:
    """The documents with some of these columns: ``ids`` of the best segmentation, ``scores`` of
    the n best, ``other_ids`` of the second best on, best first, and ``decoded``, the text that the
    ids of the best one give back."""
    path = model or default_model()
    docs, schema = _added(docs, *[T.StructField(c, ENCODED[c][0]) for c in columns])

    def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)

    def columns_of(texts: list[str], pieces: Pieces) -> dict[str, list | pa.Array]:
        out: dict[str, list | pa.Array] = {}
        sizes, ids, out["scores"] = pieces.encode_lists(texts, best if "other_ids" in columns else 1)
        if "other_ids" in columns:
            first = np.repeat(np.tile(np.arange(best) == 0, len(texts)), sizes.ravel())
            n_others = np.array([len(own) - 1 for own in out["scores"]], dtype=np.int64)
            others = sizes[:, 1:][np.arange(best - 1) < n_others[:, None]]
            out["other_ids"] = lists(n_others, lists(others, pa.array(ids[~first].astype(np.int32))))
            ids = ids[first]
        sizes = sizes[:, 0]
        out["ids"] = lists(sizes, pa.array(ids.astype(np.int32)))
        if "decoded" in columns:
            out["decoded"] = pieces.decode_flat(sizes, ids)
        return out

    def work(batches):
        pieces = worker_pieces(path, best)
        with no_collection():
            for part in sliced(batches, text, most=1 << 20):
                found = columns_of([t or "" for t in part.column(text).to_pylist()], pieces)
                made = [v if isinstance(v := found[c], pa.Array) else pa.array(v, ENCODED[c][1]) for c in columns]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema.names)
            pieces.forget()

    return docs.mapInArrow(work, schema)


def decode(docs: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """The documents with ``decoded``, the text of their ids."""
    path = model or default_model()
    docs, schema = _added(docs, T.StructField("decoded", T.StringType()))

    def work(batches):
        for batch in batches:
            pieces = worker_pieces(path, 1)
            texts = [pieces.decode(i or []) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return docs.mapInArrow(work, schema)
