"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a public BPE model whose path is a parameter. Encoding is the merge
agenda of BPE: the adjacent pair whose joint piece has the best score is merged first, the
leftmost of equals. With dropout each candidate that comes up is skipped with the given rate; a
skipped candidate comes back only as part of another pair. The skips are drawn by a hash keyed
with the seed, the text and the place of the word in it, so every occurrence is cut by itself,
while equal texts and seeds give equal pieces on any executor.

What is drawn is the number of candidates up to the next skip. The pieces of a word are thus
given by the ordinals of its skipped candidates, and a worker remembers words as trees: a node
has the pieces for the skips on the way to it, and a child for each further skip. The agendas of
words and skips that are new to a worker advance together, some thousands at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lintlake.llm.shared import as_rows, from_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Nodes that a Python worker remembers; then it starts afresh. Results don't depend on it.
REMEMBERED = 1_000_000
#: No piece reaches over the start of a blank after other text, so these are encoded alone;
#: line breaks and the mark itself are spelt in bytes.
CHUNK = regex.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n|\r")
MASK = (1 << 64) - 1
#: Parts beyond this many characters are not remembered; agendas that advance at once.
LONG, ROWS = 48, 4096
#: Characters of texts that are encoded at once, unless one text is longer.
CHARS = 2_000_000
#: A candidate in one number, the least is the next: rank, place of its left symbol, joint.
RANK, PLACE = 42, 20
JOINT, NONE = (1 << PLACE) - 1, 1 << 62


class Vocabulary:
    """Merge scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.scores = {pieces[i]: model.get_score(i) for i in plain}
        spelt = [b""] * size
        for i in plain:
            spelt[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_length = np.array([len(x) for x in spelt], np.int64)
        self.spelt_begin = np.cumsum(self.spelt_length) - self.spelt_length
        # characters are symbols too: their piece, a number beyond all pieces if something joins
        # them all the same, or one that stands for all others
        self.size = size
        apart = sorted({c for p in self.ids if len(p) > 1 for c in (p[0], p[-1])}.difference(self.ids))
        self.number = self.ids | {c: size + i for i, c in enumerate(apart)}
        self.gone = size + len(apart) + 1  # no symbol
        self.symbol = np.full(0x110000, self.gone - 1, np.int64)
        for p, i in self.number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.byte = np.array([self.bytes[b] for b in range(256)], np.int32)
        self._join_table()

    def _join_table(self) -> None:
        """What two symbols join to, in a table that is read at ``offset[left] + right``: the
        lists of the left symbols are laid over each other, where none needs the same place."""
        number = self.number.get
        joins = [(a, b, i, self.scores[p]) for p, i in self.ids.items() for k in range(1, len(p)) if (a := number(p[:k])) is not None and (b := number(p[k:])) is not None]
        best_first = {x: r for r, x in enumerate(sorted({j[3] for j in joins}, reverse=True))}
        rights: dict[int, list[tuple[int, int]]] = {}
        for a, b, i, score in joins:
            rights.setdefault(a, []).append((b, (best_first[score] << RANK) + i))
        span = self.gone + 1
        self.offset = np.zeros(span, np.int64)
        self.owner = np.full(span + 4 * len(joins) + span, -1, np.int64)
        self.joint = np.full(len(self.owner), NONE, np.int64)
        rnd = np.random.default_rng(0)
        for a, list_ in sorted(rights.items(), key=lambda x: -len(x[1])):
            b, value = np.array(list_, np.int64).T
            for _ in range(100):
                offsets = rnd.integers(0, len(self.owner) - span, 16)
                free = (self.owner[offsets[:, None] + b] < 0).all(1)
                if free.any():
                    self.offset[a] = offsets[free.argmax()]
                    break
            else:  # too full for a list as long
                self.offset[a] = len(self.owner)
                self.owner = np.concatenate([self.owner, np.full(2 * span, -1, np.int64)])
                self.joint = np.concatenate([self.joint, np.full(2 * span, NONE, np.int64)])
            self.owner[self.offset[a] + b] = a
            self.joint[self.offset[a] + b] = value

    def pieces_of(self, word: str, skips: Iterator[int] | None = None) -> tuple[list[int], int]:
        """Ids of one chunk of any length, merged with a heap and links, and how many candidates
        came up; ``skips`` gives the ordinals of those left out, in order."""
        scores = self.scores.get
        skip = next(skips, -1) if skips else -1
        came = 0
        live: list[str | None] = list(word)
        n = len(live)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, i + 1, word[i : i + 2]) for i in range(n - 1) if (s := scores(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, right, joint = heappop(heap)
            if live[left] is None or after[left] != right or live[right] is None or live[left] + live[right] != joint:
                continue
            came += 1
            if came - 1 == skip:
                skip = next(skips, -1)
                continue
            live[left], live[right] = joint, None
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (s := scores(joint + live[nxt])) is not None:
                    heappush(heap, (-s, left, nxt, joint + live[nxt]))
            if (prv := before[left]) >= 0 and (s := scores(live[prv] + joint)) is not None:
                heappush(heap, (-s, prv, left, live[prv] + joint))
        out: list[int] = []
        for p in live:
            if p is not None:
                out.extend([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])
        return out, came

    def many(self, words: list[str], skips: list[tuple[int, ...]] | None = None) -> list[tuple[bytes, int]]:
        """``pieces_of`` of each chunk, ids as little-endian bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        found: list = [None] * len(words)
        for i in np.flatnonzero(lengths > LONG).tolist():
            ids, came = self.pieces_of(words[i], iter(skips[i]) if skips else None)
            found[i] = np.array(ids, "<i4").tobytes(), came
        short = np.flatnonzero(lengths <= LONG)
        left_out = None
        if skips:
            some = [skips[i] for i in short.tolist()]
            left_out = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.array([*chain.from_iterable(some)], np.int64)
        order, ids, sizes, came = self.agendas(points, (np.cumsum(lengths) - lengths)[short], lengths[short], left_out)
        ends = np.cumsum(sizes)
        for i, a, b, n in zip(short[order].tolist(), (ends - sizes).tolist(), ends.tolist(), came.tolist(), strict=True):
            found[i] = ids[a:b].astype("<i4").tobytes(), n
        return found

    def agendas(self, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, left_out: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merges chunks of up to ``LONG`` code points, given by their places in ``points``;
        ``left_out`` has numbers of chunks and ordinals of their candidates to skip. Returns the
        chunks' numbers in the order of the rest: all ids, how many are a chunk's, and how many
        candidates came up."""
        order = np.argsort(lengths, kind="stable")
        if left_out:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows, ordinals = place[left_out[0]], left_out[1]
            by_row = np.argsort(rows, kind="stable")
            rows, ordinals = rows[by_row], ordinals[by_row]
        made = []
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            skips = None
            if left_out:
                a, b = np.searchsorted(rows, [at, at + len(some)])
                skips = rows[a:b] - at, ordinals[a:b]
            made.append(self._advance(points, begins[some], lengths[some], skips))
        if not made:
            return order, np.empty(0, np.int32), order, order
        return order, *(np.concatenate(x) for x in zip(*made, strict=True))

    def _advance(self, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, skips: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agendas of chunks in order of length advance together. A chunk is a column with no
        symbol before and after; a merge leaves the left symbol and links past the right one."""
        n, most = len(lengths), int(lengths[-1])
        shift = max(n - 1, 1).bit_length()
        step = 1 << shift
        symbols = np.full((most + 2, step), self.gone, np.int64)
        for i, first in enumerate(np.searchsorted(lengths, np.arange(most), side="right").tolist()):
            symbols[i + 1, first:n] = self.symbol[points[begins[first:] + i]]
        places = np.arange(symbols.size)
        after, before = places + step, places - step
        keys = np.full(symbols.shape, NONE, np.int64)
        keys[1:-1] = self._joined(symbols[1:-1], symbols[2:]) + (np.arange(1, most + 1) << (shift + PLACE))[:, None]
        flat, key = symbols.reshape(-1), keys.reshape(-1)
        column = ~(step - 1)
        if skips is not None:
            skipped = np.zeros((int(skips[1].max(initial=-1)) + 1, step), bool)
            skipped[skips[1], skips[0]] = True
        came, no = np.zeros(step, np.int64), 0
        while True:
            best = keys.min(axis=0)
            open_ = best < NONE
            every = np.flatnonzero(open_)
            if not len(every):
                break
            came += open_
            best = best.take(every)
            left = ((best >> PLACE) & ((1 << RANK - PLACE) - 1)) + every
            if skips is not None and no < len(skipped):
                skip = skipped[no].take(every)
                key[left[skip]] = NONE
                left, best = left[~skip], best[~skip]
            no += 1
            joint = best & JOINT
            right = after.take(left)
            behind, ahead = before.take(left), after.take(right)
            after[left] = ahead
            before[ahead] = left
            flat[left] = joint
            flat[right] = self.gone
            key[right] = NONE
            both = np.concatenate([left, behind])
            joined = self._joined(np.concatenate([joint, flat.take(behind)]), np.concatenate([flat.take(ahead), joint]))
            key[both] = joined + ((both & column) << PLACE)
        rest = np.ascontiguousarray(symbols[1:-1, :n].T)
        real = rest != self.gone
        ids, sizes = rest[real], real.sum(1)
        spelt = ids >= self.size
        if spelt.any():
            chunk, at = np.nonzero(real)
            chars = points[begins[chunk[spelt]] + at[spelt]]
            times = np.ones(len(ids), np.int64)
            times[spelt] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
            sizes = np.bincount(np.repeat(chunk, times), minlength=n)
            ids, spelt = np.repeat(ids, times), np.repeat(spelt, times)
            ids[spelt] = self.byte[np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids.astype(np.int32), sizes, came[:n]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and joint of symbol pairs; ``NONE`` where no piece joins them."""
        at = self.offset.take(left)
        at += right
        return np.where(self.owner.take(at) == left, self.joint.take(at), NONE)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Gaps:
    """Numbers of candidates up to the next skip, drawn by hash: geometric with the rate."""

    def __init__(self, rate: float):
        # a hash below the kth bound goes on for k candidates or more; whole numbers, so that
        # all machines draw alike
        bounds, kept = [], 1.0
        while rate > 0 and (kept := kept * (1 - min(rate, 1.0))) * 2**64 >= 1:
            bounds.append(int(kept * 2**64))
        self.rate, self.bounds = rate, np.array(bounds[::-1], np.uint64)
        #: a gap is below k from this hash on
        self.reach = np.array([MASK, *bounds, 0], np.uint64)

    def draw(self, keys: np.ndarray, no: int) -> np.ndarray:
        """The ``no``th gap of each key."""
        return self._gaps(self._hashes(keys, no))

    def draw_below(self, keys: np.ndarray, no: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys whose gap is below ``most``, and those gaps."""
        hashes = self._hashes(keys, no)
        some = np.flatnonzero((most > 0) & (hashes >= self.reach[np.clip(most, 0, len(self.bounds) + 1)]))
        gaps = self._gaps(hashes[some])
        below = gaps < most[some]
        return some[below], gaps[below]

    def _gaps(self, hashes: np.ndarray) -> np.ndarray:
        return len(self.bounds) - np.searchsorted(self.bounds, hashes, side="right")

    def _hashes(self, keys: np.ndarray, no: int) -> np.ndarray:
        one, two, three = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
        with np.errstate(over="ignore"):
            x = keys + one * np.uint64(no + 1)
            x = (x ^ (x >> np.uint64(30))) * two
            x = (x ^ (x >> np.uint64(27))) * three
            return x ^ (x >> np.uint64(31))

    def skips(self, key: int) -> Iterator[int]:
        """Ordinals of the candidates that are left out under one key."""
        at, no, keys = -1, 0, np.array([key], np.uint64)
        while self.rate > 0:
            at += 1 + int(self.draw(keys, no)[0])
            yield at
            no += 1


class Numbers(dict):
    """Numbers keys as they come up for the first time, from ``first`` on."""

    first = 0

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = self.first + len(self.new)
        self.new.append(key)
        return n

    def of(self, keys: Iterable, count: int, first: int) -> tuple[np.ndarray, list]:
        """The numbers of keys, and those that were new."""
        self.first, self.new = first, []
        return np.fromiter(map(self.__getitem__, keys), np.int64, count), self.new


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if (size := self.size + len(values)) > len(self.held):
            more = max(size, 2 * len(self.held)) - self.size
            self.held = np.concatenate([self.held[: self.size], np.empty(more, self.held.dtype)])
        self.held[self.size : size] = values
        self.size = size


class Memory:
    """The nodes that a worker knows, as columns."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.mark = [vocab.bytes[b] for b in SPACE.encode()]
        self.forget()

    def forget(self) -> None:
        self.unit, self.child = Numbers(), Numbers()
        self.long: dict[int, tuple | str] = {}  # nodes of units beyond LONG of the texts at hand
        #: ids of all nodes; code points of all units
        self.ids, self.points = Column(np.int32), Column(np.uint32)
        #: of a node: where its ids begin, how many there are, and how many candidates came up
        self.begin, self.n_ids, self.came = Column(np.int64), Column(np.int64), Column(np.int64)
        #: of a node: the one that it grew from (-1: none) by which skip, and the unit's own one
        self.parent, self.skip, self.root = Column(np.int32), Column(np.int16), Column(np.int32)
        #: of a unit's own node: where its code points are
        self.point, self.length = Column(np.int64), Column(np.int32)

    def full(self) -> bool:
        return self.came.size > REMEMBERED or self.ids.size > 8 * REMEMBERED

    def _add(self, order: np.ndarray, ids: np.ndarray, sizes: np.ndarray, came: np.ndarray) -> None:
        """Ids and counts of as many new nodes, given in ``order``."""
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.begin.add((self.ids.size + np.cumsum(sizes) - sizes)[back])
        self.n_ids.add(sizes[back])
        self.came.add(came[back])
        self.ids.add(ids)

    def _alone(self, node: int, ids: list[int], came: int) -> None:
        self.begin.held[node], self.n_ids.held[node], self.came.held[node] = self.ids.size, len(ids), came
        self.ids.add(np.array(ids, np.int32))

    def learn(self, units: Iterable, count: int) -> np.ndarray:
        """The nodes without skips of units."""
        first = self.came.size
        nodes, new = self.unit.of(units, count, first)
        parts = [_chunk(u) for u in new]
        apart = {i: p for i, p in enumerate(parts) if not 0 < len(p) <= LONG}
        for i in apart:
            parts[i] = ""
        lengths = np.array([len(p) for p in parts], np.int64)
        begins = self.points.size + np.cumsum(lengths) - lengths
        self.points.add(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32))
        self.point.add(begins)
        self.length.add(lengths)
        self.root.add(np.arange(first, first + len(new)))
        self.parent.add(np.full(len(new), -1))
        self.skip.add(np.full(len(new), -1))
        self._add(*self.vocab.agendas(self.points.held, begins, lengths))
        for i, p in apart.items():
            if p:
                self.long[first + i] = new[i]
            self._alone(first + i, *(self.vocab.pieces_of(p) if p else (self.mark, 0)))
        return nodes

    def grow(self, nodes: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """The nodes for a further skip each. Chunks of up to ``LONG`` have fewer than 256
        candidates: one between two characters, and two more that each merge may bring up."""
        found, new = self.child.of(((nodes << 8) | skips).tolist(), len(nodes), self.came.size)
        wanted = np.array(new, np.int64)
        parents, skip = wanted >> 8, wanted & 255
        roots = self.root.held[parents].astype(np.int64)
        rows, ordinals = [np.arange(len(new))], [skip]
        row, node = rows[0], parents
        while len(row := row[inner := self.parent.held[node] >= 0]):
            node = node[inner]
            rows.append(row)
            ordinals.append(self.skip.held[node].astype(np.int64))
            node = self.parent.held[node]
        none = np.zeros(len(new))
        for column, values in ((self.root, roots), (self.parent, parents), (self.skip, skip), (self.point, none), (self.length, none)):
            column.add(values)
        self._add(*self.vocab.agendas(self.points.held, self.point.held[roots], self.length.held[roots].astype(np.int64), (np.concatenate(rows), np.concatenate(ordinals))))
        return found

    def apart(self, nodes: list[int], skips: Iterable[Iterator[int]]) -> np.ndarray:
        """Nodes of the texts at hand for long units with all their skips."""
        first = self.came.size
        for column in (self.begin, self.n_ids, self.came, self.root, self.parent, self.skip, self.point, self.length):
            column.add(np.zeros(len(nodes)))
        for i, (node, some) in enumerate(zip(nodes, skips, strict=True)):
            self._alone(first + i, *self.vocab.pieces_of(_chunk(self.long[node]), some))
        return np.arange(first, first + len(nodes))

    def drop_long(self) -> None:
        """Long units are seldom seen again."""
        for u in self.long.values():
            del self.unit[u]
        self.long = {}


_MEMORIES: dict[str, Memory] = {}


NEWLINE = ("\n",)


def units(text: str) -> list:
    """A text in chunks that no piece crosses.

    Single blanks between other characters are the common case: a chunk is then a blank and what
    stands behind it, given without the blank. Else it is a 1-tuple of the chunk with its marks,
    empty for a mark that the text has itself.
    """
    if SPACE in text or "  " in text or text[:1] == " ":
        out: list = []
        for no, part in enumerate(text.split(SPACE)):
            if no:
                out.append(("",))
            out.extend((c,) for c in CHUNK.findall(("" if no else SPACE) + part.replace(" ", SPACE)))
        return out
    lines = text.split("\n")
    out = lines[0].split(" ")
    for line in lines[1:]:
        out.append(NEWLINE)
        first, *rest = line.split(" ")
        if first:
            out.append((first,))
        out += rest
    return out


def _chunk(unit: str | tuple) -> str:
    return SPACE + unit if isinstance(unit, str) else unit[0]


def encode_texts(texts: list[str], path: str = MODEL, rate: float = 0.0, seed: int = 0) -> list[bytes]:
    """Little-endian 32-bit ids of each whole text; an empty text has none."""
    ids, ends = encoded(texts, path, rate, seed)
    return [ids[a:b].astype("<i4").tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def encoded(texts: list[str], path: str = MODEL, rate: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin and end."""
    if path not in _MEMORIES:
        _MEMORIES[path] = Memory(vocabulary(path))
    memory = _MEMORIES[path]
    parts = [units(t) if t else [] for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    nodes = memory.learn(chain.from_iterable(parts), int(ends[-1]))
    if rate > 0 and len(nodes):
        gaps = Gaps(rate)
        starts = np.array([xxhash.xxh64_intdigest(t.encode(), seed & MASK) for t in texts], np.uint64)
        places = (np.arange(len(nodes)) - np.repeat(ends[:-1], counts)).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = np.repeat(starts, counts) + places * np.uint64(0xD6E8FEB86659FD93)
        no, (open_, skips) = 0, gaps.draw_below(keys, 0, memory.came.held[nodes])
        if memory.long:
            apart = np.isin(nodes[open_], [*memory.long])
            some = open_[apart]  # by themselves, all skips at once
            nodes[some] = memory.apart(nodes[some].tolist(), map(gaps.skips, keys[some].tolist()))
            open_, skips = open_[~apart], skips[~apart]
        while len(open_):
            nodes[open_] = memory.grow(nodes[open_], skips)
            no += 1
            some, more = gaps.draw_below(keys[open_], no, memory.came.held[nodes[open_]] - skips - 1)
            open_, skips = open_[some], skips[some] + 1 + more
    sizes = memory.n_ids.held[nodes]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    ids = memory.ids.held[np.repeat(memory.begin.held[nodes] - begins[:-1], sizes) + np.arange(begins[-1])]
    memory.drop_long()
    if memory.full():
        memory.forget()
    return ids, begins[ends]


def decode_ids(ids, path: str = MODEL) -> str:
    """The text of ids: bytes are joined, marks become blanks, the first blank is dropped."""
    vocab = vocabulary(path)
    ids = np.asarray(ids, np.int64)
    lengths = vocab.spelt_length[ids]
    ends = np.cumsum(lengths)
    places = np.repeat(vocab.spelt_begin[ids] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return vocab.spelt[places].tobytes().removeprefix(b" ").decode()


def encode(docs: DataFrame, path: str = MODEL, rate: float = 0.1, seed: int = 17, text_col: str = "text", check_col: str | None = None) -> DataFrame:
    """``docs`` with the array ``ids``; all columns stay (a column ``ids`` is replaced).

    Skips come of the text and a word's place in it: copies share their pieces, different texts
    and the words of one text vary. A null text has null ids, an empty one no ids. ``rate`` 0 is
    the plain encoding, 1 that of single characters. With ``check_col`` the ids are decoded again where they are made, and that
    column tells whether they spell the text (true for null).
    """
    shaped, names = as_rows(docs, ("ids", check_col))
    place = names.index(text_col)
    more = [StructField("spelt", BooleanType())] if check_col else []
    schema = StructType([*shaped.schema.fields, StructField("ids", ArrayType(IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field(place).cast(pa.string())
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and len(part) < 500 and size < CHARS:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                ids, ends = encoded([t or "" for t in part], path, rate, seed)
                offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.array([*(t is None for t in part), False]))
                columns = [batch.column("row").slice(at, len(part)), pa.ListArray.from_arrays(offsets, pa.array(ids))]
                if check_col:
                    spans = zip(part, ends.tolist(), ends[1:].tolist(), strict=False)
                    columns.append(pa.array([t is None or decode_ids(ids[a:b], path) == t for t, a, b in spans], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "spelt"][: len(columns)])
                at += len(part)

    made = shaped.mapInArrow(run, schema)
    return made.select(*from_rows(made, names), "ids", *([F.col("spelt").alias(check_col)] if check_col else []))


def decode(coded: DataFrame, path: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of ``ids_col`` as ``out_col``; null for null."""

    shaped, names = as_rows(coded, (out_col,))
    place = names.index(ids_col)
    schema = StructType([*shaped.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                column = batch.column("row").field(place).slice(at, 500)
                texts = [decode_ids(x.values.to_numpy(zero_copy_only=False), path) if x.is_valid else None for x in column]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, 500), pa.array(texts, pa.string())], names=["row", "decoded"])

    made = shaped.mapInArrow(run, schema)
    return made.select(*from_rows(made, names), F.col("decoded").alias(out_col))
