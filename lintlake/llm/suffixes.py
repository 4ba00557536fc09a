"""Repeated 200-byte strings by a distributed merge sort of suffixes that knows common prefixes.

1. Anchors. Each window of ``length`` bytes picks the leftmost smallest hash of the ``gram``-byte
   strings in it, so equal windows pick the same place. Only suffixes that start at an anchor
   are sorted; an anchor stands for the run of window starts that picked it.
2. Duplicate detection. An anchor can only matter if its gram turns up twice; hashes of grams
   are exchanged first, and all other suffixes never travel.
3. Sorted runs. Documents are dealt into groups; a group's suffixes (with the bytes before the
   anchor that its windows reach) are sorted, equal ones become one, and each is written as the
   length of the prefix it shares with the one before and the rest.
4. Merge. The runs of a range meet in a loser tree whose players carry the prefix they share with
   the last winner; prefixes known to be equal are never compared again. Stretches that share a
   gram come out together, with their common prefixes, and windows in them that are equal are
   marked.
5. Marks go back to their runs, become byte ranges of documents, and are cut out.

Grams that very many suffixes share are dealt out by longer strings around the anchor, a band
of window starts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lintlake.llm.shared import fresh_path

LENGTH, GRAM = 200, 80
#: Bytes that are hashed at once; longer texts go in overlapping stretches.
STRETCH = 1 << 20
#: Input bytes per group of documents and per range of suffixes.
GROUP_BYTES, LEAST_GROUPS = 16 << 20, 256
#: A gram of more suffixes than this is dealt out by bands of this many window starts.
HOT, BAND = 50_000, 24
#: A run is closed when its suffixes reach this many bytes.
RUN_BYTES = 48 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_PART = "slot long, kind int, doc_id long, text_hash long, doc_key long, body binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
    return up, down


_TABLE = np.random.default_rng(200).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
_UP, _DOWN = _powers(STRETCH + LENGTH)


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, of which any window's hash is a difference."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _UP[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` bytes at ``starts``, the same wherever they stand."""
    with np.errstate(over="ignore"):
        if isinstance(starts, slice):
            n = len(sums) - size
            h = (sums[size:] - sums[:n]) * _DOWN[:n]
        else:
            h = (sums[starts + size] - sums[starts]) * _DOWN[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``gram hash, text number, place, back, least``: the anchors of texts that lie one after
    the other in ``data`` (at most :data:`STRETCH` bytes), text i in ``bounds[i : i + 2]``.

    The windows that picked an anchor start ``least`` to ``back`` bytes before it.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (np.zeros(0, np.uint64), none, none, none, none)
    hashes = _hash(_sums(data), slice(None), gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    picked = _sliding_min((hashes & ~np.uint64((1 << 21) - 1)) | places, length - gram + 1) & np.uint64((1 << 21) - 1)
    picked = picked.astype(np.int64)
    starts = np.arange(len(picked))
    text = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[text + 1]
    starts, picked, text = starts[inside], picked[inside], text[inside]
    if not len(starts):
        return (np.zeros(0, np.uint64), none, none, none, none)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(picked) != 0) | (np.diff(starts) != 1)]))
    last = np.append(first[1:], len(starts)) - 1
    at, text = picked[first], text[first]
    return hashes[at], text, at - bounds[text], at - starts[first], at - starts[last]


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``data, bounds, text number, offset in the text`` of pieces that fit a stretch; a long
    text's pieces overlap so that each window lies in one."""
    held: list[tuple[bytes, int, int]] = []
    size = 0
    for no, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), STRETCH - length + 1):
            piece = text[at : at + STRETCH] if len(text) > STRETCH else text
            if size + len(piece) > STRETCH and held:
                yield _joined(held)
                held, size = [], 0
            if len(piece) >= length:
                held.append((piece, no, at))
                size += len(piece)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *(len(p) for p, _, _ in held)])
    return np.frombuffer(b"".join(p for p, _, _ in held), np.uint8), bounds, np.array([n for _, n, _ in held]), np.array([a for _, _, a in held])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one body."""
    n = len(arrays[0])
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(body: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        kind = np.dtype(t)
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


GRAMS = ("<u8", "<i8", "<u4", "u1", "u1")
FOUND = ("<i8", "<u4", "u1", "u1", "u1")


def _grams(batches: Iterator[pa.RecordBatch], ranges: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Hashes of grams with where they stand, a row per range and batch."""
    for batch in batches:
        keys = batch.column("doc_key").to_numpy(zero_copy_only=False)
        parts: list[tuple] = []
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for data, bounds, numbers, offsets in _stretches(texts, length):
            h, text, at, back, least = anchors(data, bounds, length, gram)
            parts.append((h, keys[numbers[text]], (at + offsets[text]).astype("<u4"), back.astype("u1"), least.astype("u1")))
        if not parts:
            continue
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        slots = (columns[0] % np.uint64(ranges)).astype(np.int64)
        yield from _by_slot(slots, columns, 0)


def _by_slot(slots: np.ndarray, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(slots, kind="stable")
    cuts = np.flatnonzero(np.diff(slots[order], prepend=-1))
    rows = [(int(slots[order[a]]), kind, None, None, None, _pack(*(c[order[a:b]] for c in columns))) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]
    if rows:
        yield _parts(rows)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _PART.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of a sorted partition, slot by slot; a slot has to be read before the next."""
    from itertools import groupby

    def rows():
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                yield {n: c[i].as_py() for n, c in zip(batch.schema.names, columns, strict=True)}

    return groupby(rows(), key=lambda r: r["slot"])


def _twice(batches: Iterator[pa.RecordBatch], groups: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Of each range, the places whose gram's hash turns up twice, dealt by document."""
    for _, rows in _groups(batches):
        columns = [np.concatenate(c) for c in zip(*(_unpack(r["body"], *GRAMS) for r in rows), strict=True)]
        order = np.argsort(columns[0], kind="stable")
        h = columns[0][order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.append(edge, len(h)))
        each = np.repeat(counts, counts)
        keep = order[each > 1]
        if len(keep):
            keys = columns[1][keep]
            found = [keys, columns[2][keep], columns[3][keep], columns[4][keep], (each[each > 1] > hot).astype("u1")]
            yield from _by_slot((keys.view("<u8") % np.uint64(groups)).astype(np.int64), found, 0)


def _runs(batches: Iterator[pa.RecordBatch], ranges: int, length: int, gram: int, band: int) -> Iterator[pa.RecordBatch]:
    """Sorted front-coded runs (kind 0, by range) and where their suffixes stand (kind 1).

    A slot has its found places (kind 0) first, then its documents (kind 1).
    """
    for slot, rows in _groups(batches):
        found: list[list[np.ndarray]] = []
        places: list[np.ndarray] | None = None
        run = _Run(slot, 0, ranges, length, gram, band)
        for row in rows:
            if row["kind"] == 0:
                found.append(_unpack(row["body"], *FOUND))
                continue
            if not found:
                continue
            if places is None:
                places = [np.concatenate(c) for c in zip(*found, strict=True)]
                order = np.lexsort((places[1], places[0]))
                places = [p[order] for p in places]
            a, b = np.searchsorted(places[0], [row["doc_key"], row["doc_key"] + 1] if row["doc_key"] < (1 << 63) - 1 else [row["doc_key"]] * 2, "left")
            if row["doc_key"] == (1 << 63) - 1:
                b = len(places[0])
            if a < b:
                run.add(row, zstandard.decompress(row["body"]), [p[a:b] for p in places[1:]])
                if run.size > RUN_BYTES:
                    yield from run.close()
                    run = _Run(slot, run.number + 1, ranges, length, gram, band)
        yield from run.close()


class _Run:
    """Suffixes of some documents on their way to a sorted run."""

    def __init__(self, slot: int, number: int, ranges: int, length: int, gram: int, band: int):
        self.slot, self.number, self.ranges = slot, number, ranges
        self.length, self.gram, self.band = length, gram, band
        self.docs: list[tuple] = []
        self.where: dict[tuple[int, bytes, bytes], list[tuple[int, int]]] = {}
        self.size = 0

    def add(self, row: dict, text: bytes, places: list[np.ndarray]) -> None:
        no = len(self.docs)
        self.docs.append((row["doc_id"], row["text_hash"]))
        where, length = self.where, self.length
        for at, back, least, hot in zip(*(p.tolist() for p in places), strict=True):
            if at + length - least > len(text) or at < back:
                continue  # a place of another document whose key is the same
            if not hot:
                spans = [(at, back, least, self.gram)]
            else:
                spans = []
                for low in range(least - least % self.band, back + 1, self.band):
                    high = low + self.band - 1
                    spans.append((at - low, min(back, high) - low, max(least, low) - low, length - high + low))
            for place, b, a, known in spans:
                key = (known, text[place : place + length - a], text[place - b : place])
                held = where.get(key)
                if held is None:
                    where[key] = [(no, place)]
                    self.size += length + b + 80
                else:
                    held.append((no, place))
                    self.size += 16

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.where:
            return
        order = sorted(self.where)
        by: dict[int, list[int]] = {}
        for entry, (known, right, _) in enumerate(order):
            digest = int.from_bytes(hashlib.blake2b(right[:known], digest_size=7).digest(), "little")
            by.setdefault(2 * (digest % self.ranges) + (known != self.gram), []).append(entry)
        run = (self.slot << 16) | self.number
        rows = [(slot, 0, run, None, None, _front_coded([order[e] for e in entries], entries, [len(self.where[order[e]]) > 1 for e in entries])) for slot, entries in by.items()]
        for at in range(0, len(rows), 500):
            yield _parts(rows[at : at + 500])
        spots = [(e, no, place) for e, key in enumerate(order) for no, place in self.where[key]]
        e, no, place = (np.array(c, "<u4") for c in zip(*spots, strict=True))
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        known = np.array([d is not None for d, _ in self.docs], "u1")
        hashes = np.array([h for _, h in self.docs], "<i8")
        first, second = _pack(e, no, place), _pack(ids, known, hashes)
        yield _parts([(run, 1, self.slot, None, None, len(first).to_bytes(8, "little") + first + second)])


def _front_coded(suffixes: list[tuple[int, bytes, bytes]], entries: list[int], many: list[bool]) -> bytes:
    """A sorted run of a range: for each suffix the length of the prefix it shares with the one
    before, the rest, and the bytes before it."""
    shared, rest, lefts, last = [], [], [], b""
    for _, right, left in suffixes:
        n = mismatch(last, right, 0)
        shared.append(n)
        rest.append(right[n:])
        lefts.append(left)
        last = right
    heads = _columns(np.array(entries, "<u4"), np.array(many, "u1"), np.array(shared, "<u2"), np.array([len(r) for r in rest], "<u2"), np.array([len(x) for x in lefts], "u1"))
    return zstandard.compress(len(entries).to_bytes(8, "little") + heads + b"".join(rest) + b"".join(lefts), 3)


def _columns(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _decoded(body: bytes) -> Iterator[tuple[int, bytes, bytes, int, bool]]:
    """``shared, suffix, bytes before, entry, stands twice`` of a front-coded run."""
    raw = zstandard.decompress(body)
    n, at, heads = int.from_bytes(raw[:8], "little"), 8, []
    for t in ("<u4", "u1", "<u2", "<u2", "u1"):
        kind = np.dtype(t)
        heads.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * kind.itemsize
    left_at, last = at + sum(heads[3]), b""
    for entry, many, shared, size, before in zip(*heads, strict=True):
        last = last[:shared] + raw[at : at + size]
        at += size
        yield shared, last, raw[left_at : left_at + before], entry, bool(many)
        left_at += before


def mismatch(a: bytes, b: bytes, start: int) -> int:
    """The first place from ``start`` on where ``a`` and ``b`` differ or one ends."""
    end = min(len(a), len(b))
    while start < end and a[start : start + 24] == b[start : start + 24] and start + 24 <= end:
        start += 24
    while start < end and a[start] == b[start]:
        start += 1
    return start


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple, int]]:
    """``shared with the one before, suffix row, run number`` of sorted runs, in order.

    A loser tree: each inner node keeps the loser of its match and the prefix that it shares
    with the winner. Who shares more with the last winner comes first; only equals are compared,
    and only from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    losers = [-1] * size

    def match(x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared prefix is then with the winner."""
        hx, hy = heads[x], heads[y]
        if hx is None or hy is None:
            return (y, x) if hx is None else (x, y)
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = hx[1], hy[1]
        n = mismatch(a, b, shared[x])
        first = x < y if n == len(a) == len(b) else n == len(a) or (n < len(b) and a[n] < b[n])
        win, lose = (x, y) if first else (y, x)
        shared[lose] = n
        return win, lose

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        ahead = []
        for i in range(0, len(level), 2):
            win, lose = match(level[i], level[i + 1])
            losers[node + i // 2] = lose
            ahead.append(win)
        level = ahead
    winner = level[0]
    while heads[winner] is not None:
        yield shared[winner], heads[winner], winner
        head = heads[winner] = next(runs[winner], None)
        shared[winner] = head[0] if head else 0
        at = (size + winner) // 2
        while at:
            winner, losers[at] = match(winner, losers[at])
            at //= 2


def _merge(batches: Iterator[pa.RecordBatch], length: int, gram: int, band: int) -> Iterator[pa.RecordBatch]:
    """Marks of the windows that stand twice, a row per range and run."""
    for slot, rows in _groups(batches):
        bodies = [(r["doc_id"], r["body"]) for r in rows]
        known = length - band + 1 if slot % 2 else gram
        marks: dict[int, list[tuple[int, bytes]]] = {}
        held: list[tuple[int, list]] = []  # stretches that share a gram
        bytes_held = 0
        stretch: list[list] = []
        for shared, (_, right, left, entry, many), run in merged([_decoded(b) for _, b in bodies]):
            if shared < known and stretch:
                if len(stretch) > 1 or stretch[0][4]:
                    held.append(stretch)
                    bytes_held += sum(len(s[0]) + len(s[1]) for s in stretch)
                    if bytes_held > STRETCH // 2:
                        _mark(held, marks, length)
                        held, bytes_held = [], 0
                stretch = []
            if stretch:
                stretch[-1][5] = max(stretch[-1][5], shared)
            stretch.append([right, left, run, entry, many, shared if stretch else 0])
        if len(stretch) > 1 or (stretch and stretch[0][4]):
            held.append(stretch)
        _mark(held, marks, length)
        out = []
        for run, found in marks.items():
            entries = np.array([e for e, _ in found], "<u4")
            out.append((bodies[run][0], 0, None, None, None, _pack(entries, np.frombuffer(b"".join(m for _, m in found), "V32"))))
        if out:
            yield _parts(out)


def _mark(held: list[list], marks: dict[int, list[tuple[int, bytes]]], length: int) -> None:
    """Adds, for each suffix of the stretches, which of its windows stand twice: bit i is the
    window that starts i bytes before the anchor."""
    rows = [(g, *s) for g, stretch in enumerate(held) for s in stretch]
    if not rows:
        return
    # windows can only be equal as far as the suffix shares its prefix with a neighbour
    least = np.array([length - len(r[1]) for r in rows])
    back = np.array([len(r[2]) for r in rows])
    many = np.array([r[5] for r in rows])
    first = np.where(many, least, np.maximum(least, length - np.array([r[6] for r in rows])))
    counts = np.maximum(0, back - first + 1)
    row = np.repeat(np.arange(len(rows)), counts)
    i = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    hashes = np.zeros(len(row), np.uint64)
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(rows):  # as many suffixes at a time as fit a stretch of bytes
        size, end = 0, begin
        while end < len(rows) and (end == begin or size + len(rows[end][1]) + len(rows[end][2]) <= STRETCH):
            size += len(rows[end][1]) + len(rows[end][2])
            end += 1
        data = np.frombuffer(b"".join(r[2] + r[1] for r in rows[begin:end]), np.uint8)
        offset = np.cumsum([0, *(len(r[1]) + len(r[2]) for r in rows[begin:end])])
        some = slice(ends[begin] - counts[begin], ends[end - 1])
        starts = offset[row[some] - begin] + back[row[some]] - i[some]
        hashes[some] = _hash(_sums(data), starts, length)
        begin = end
    group = np.array([r[0] for r in rows])
    order = np.lexsort((hashes, i, group[row]))
    h, at, g = hashes[order], i[order], group[row][order]
    same = (h[1:] == h[:-1]) & (at[1:] == at[:-1]) & (g[1:] == g[:-1])
    twice = many[row[order]].copy()
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    bits = np.zeros((len(rows), 256), np.uint8)
    bits[row[hit], i[hit]] = 1
    masks = np.packbits(bits, axis=1)
    for r in np.unique(row[hit]).tolist():
        marks.setdefault(rows[r][3], []).append((rows[r][4], masks[r].tobytes()))


def _ranges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges per document from a run's marks (kind 0) and places (kind 1)."""
    for _, rows in _groups(batches):
        marks: list[list[np.ndarray]] = []
        for row in rows:
            if row["kind"] == 0:
                marks.append(_unpack(row["body"], "<u4", "V32"))
                continue
            if not marks:
                continue
            entries = np.concatenate([m[0] for m in marks])
            masks = np.concatenate([m[1] for m in marks]).view(np.uint8).reshape(-1, 32)
            order = np.argsort(entries)
            entries, masks = entries[order], masks[order]
            cut = 8 + int.from_bytes(row["body"][:8], "little")
            e, no, place = _unpack(row["body"][8:cut], "<u4", "<u4", "<u4")
            ids, known, hashes = _unpack(row["body"][cut:], "<i8", "u1", "<i8")
            spot = np.minimum(np.searchsorted(entries, e), len(entries) - 1)
            hit = entries[spot] == e
            e, no, place, spot = e[hit], no[hit], place[hit].astype(np.int64), spot[hit]
            order = np.argsort(no, kind="stable")
            edges = np.flatnonzero(np.diff(no[order].astype(np.int64), prepend=-1))
            out = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                d = int(no[mine[0]])
                which, i = np.nonzero(np.unpackbits(masks[spot[mine]], axis=1))
                first, last = _spans(np.unique(place[mine][which] - i), length)
                out.append((row["doc_id"], 0, int(ids[d]) if known[d] else None, int(hashes[d]), None, _pack(first.astype("<u4"), last.astype("<u4"))))
            if out:
                yield _parts(out)


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows of ``length`` at the sorted ``starts`` cover."""
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1] + length


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents (kind 1) of a slot without the ranges (kind 0) that were found for them."""
    for _, rows in _groups(batches):
        spans: dict[tuple, bytes] = {}
        out = []
        for row in rows:
            key = (row["doc_id"], row["text_hash"])
            if row["kind"] == 0:
                spans[key] = row["body"]
                continue
            text = zstandard.decompress(row["body"])
            first, last = _unpack(spans[key], "<u4", "<u4") if key in spans else (np.zeros(0, int), np.zeros(0, int))
            first, last = first.tolist(), last.tolist()
            kept = b"".join(text[a:b] for a, b in zip([0, *last], [*first, len(text)], strict=True))
            out.append((row["doc_id"], len(text), len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in zip(first, last, strict=True)], *([kept] if with_text else [])))
            if len(out) == 1000:
                yield _out(out)
                out = []
        if out:
            yield _out(out)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names=names[: len(rows[0])])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, band: int = BAND, with_text: bool = True) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` and, if wanted,
    ``kept``: the text's UTF-8 bytes without each byte that a ``length``-byte string covers
    which also starts elsewhere in any document, the same one included.

    Null texts are empty. Repeated rows are documents that copy each other. Texts shorter than
    ``length`` keep all. Windows are compared by prefixes byte for byte on the right of their
    anchor and by 64-bit hashes as a whole. At most 255 window starts share an anchor, so
    ``length - gram`` is below 255.
    """
    if not 0 < band <= length - gram < 255:
        raise ValueError("band and length - gram have to be in 1 .. 254")
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    groups = max(LEAST_GROUPS, min(size // GROUP_BYTES, 1 << 40))  # how finely work is dealt; results don't hang on it
    own = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(CAST(text AS STRING), '') AS text")
    keyed = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    as_group = F.expr(f"CASE WHEN doc_key >= 0 THEN doc_key % {groups} ELSE (doc_key % {groups} + {(1 << 64) % groups} + {groups}) % {groups} END")
    schema = StructType.fromDDL(_PART)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, 1, d, h, k, zstandard.compress(t.encode(), 3)) for s, d, h, k, t in zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_id", "text_hash", "doc_key", "text")), strict=True)]
            if rows:
                yield _parts(rows)

    bodies = keyed.withColumn("slot", as_group).mapInArrow(packed, schema)
    met = lambda df: df.repartition("slot").sortWithinPartitions("slot", "kind")
    grams = keyed.select("doc_key", "text").mapInArrow(lambda b: _grams(b, groups, length, gram), schema)
    found = met(grams).mapInArrow(lambda b: _twice(b, groups, hot), schema)
    path = fresh_path(spark, "runs")
    met(found.unionByName(bodies)).mapInArrow(lambda b: _runs(b, groups, length, gram, band), schema).write.parquet(path)
    runs = spark.read.schema(schema).parquet(path)
    marks = met(runs.where("kind = 0")).mapInArrow(lambda b: _merge(b, length, gram, band), schema)
    spans = met(marks.unionByName(runs.where("kind = 1"))).mapInArrow(lambda b: _ranges(b, length), schema)
    out = StructType.fromDDL(OUT + (", kept binary" if with_text else ""))
    return met(spans.unionByName(bodies)).mapInArrow(lambda b: _cut(b, with_text), out)
