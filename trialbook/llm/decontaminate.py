"""Benchmark decontamination by the q-gram lemma.

Texts and items are folded (A-Z lower-cased, white space collapsed to one blank).  If a passage is within k edits of an
item of m bytes, the two share at least t = m - Q + 1 - k*Q of the item's Q-grams, on diagonals (place in the text minus
place in the item) at most k apart.

1. A text place is marked if its Q-gram occurs in any item.  An item's passage holds t marked places within m + k bytes,
   so running counts over the marks leave only dense stretches (a test for each class of item lengths).
2. Within dense stretches the item places met on one diagonal are counted as intervals: a common stretch is entered where it
   begins (the bytes before it differ), and its length is found by halving on prefix hashes.  So a text and an
   item that repeat themselves cost a stretch for each diagonal, not a hit for each pair of places.  The intervals are united
   in overlapping bands of diagonals; a band of ``rate`` of the item's length and k more holds all of a passage.  Bands
   with fewer than t item places are dropped.
3. What remains is verified: exact copies by a search, the rest by banded alignments of the whole item against the text,
   with free ends in the text, many bands at a time.  Passages of one item don't overlap: exact ones are taken first, from the left.

The items are written to the shared folder in blocks of about ``BLOCK`` bytes.  Documents are read once whatever
the number of blocks: a task holds a group of texts and takes the blocks one by one.

Defined cases: null or empty text has no leak; items that fold to fewer than ``Q`` bytes are found where they
stand exactly, as whole words (and no two share a byte); null and blank items are skipped; items with equal text are each reported; repeated rows are each
reported; an empty benchmark finds nothing; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, materialize, scratch_dir, slices
from .store import Folder, own_name

Q = 10
TABLE_BITS = 21
BLOCK = 8 << 20
#: Bytes of text that are held while several blocks pass.
GROUP = 64 << 20
PIECE = 1 << 20
#: Common stretches, and cells of alignments, that are worked on at once.
MOST = 1 << 20
_BASE = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
#: Bytes of words: letters, digits and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def fold(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes back to back, and offsets."""
    raw, offsets = joined_bytes(column)
    raw = _LOWER[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return raw[keep], np.append(0, np.cumsum(keep))[offsets]


def grams(raw: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the Q bytes at each place."""
    n = max(len(raw) - Q + 1, 0)
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(8):
        low = (low << np.uint64(8)) | raw[k : k + n]
    for k in range(8, Q):
        high = (high << np.uint64(8)) | raw[k : k + n]
    x = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sums(raw: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes times powers: equal stretches have equal differences, but for a power."""
    return np.append(np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    up = np.full(n + 1, _BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up)


def _united(rows: np.ndarray) -> np.ndarray:
    """Intervals (item, band, low, high) with the overlapping ones of each item and band made one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    group = np.cumsum(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    wide = np.int64(1) << 33  # a running maximum that starts anew in each group
    high = np.maximum.accumulate(rows[:, 3] + group * wide) - group * wide
    head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (rows[1:, 2] > high[:-1])))
    out = rows[head].copy()
    out[:, 3] = high[np.append(head[1:], len(rows)) - 1]
    return out


class Items:
    """The index of one block of items."""

    def __init__(self, ids: list, texts: list[str], rate: float):
        raw, offsets = fold(pa.array(texts, pa.string()))
        sizes = np.diff(offsets)
        self._short(ids, [raw[i:j] for i, j in zip(offsets, offsets[1:])])
        fit = [k for k in range(len(ids)) if sizes[k] >= Q]
        self.ids = [ids[k] for k in fit]
        self.raw = [raw[offsets[k] : offsets[k + 1]] for k in fit]
        self.sizes = sizes[fit]
        # The edit budget leaves one shared Q-gram at least.
        self.budget = np.minimum((rate * self.sizes).astype(np.int64), (self.sizes - Q) // Q)
        self.least = self.sizes - Q + 1 - self.budget * Q
        own = [grams(r) for r in self.raw]
        code = np.concatenate([*own, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([*[np.arange(len(g)) for g in own], np.zeros(0, np.int64)])
        # Places of equal grams are in order of the byte before them (the first place of an item has none).
        before = np.concatenate([*[np.append(257, r[: len(r) - Q]) for r in self.raw], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.lexsort((before, code))
        self.item, self.place = item[order], place[order]
        self.codes, self.heads, which = np.unique(code[order], return_index=True, return_inverse=True)
        self.heads = np.append(self.heads, len(code))
        self.entered = which * 258 + before[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.codes >> np.uint64(64 - TABLE_BITS)] = True
        up = _powers(int(self.sizes.max()) if len(fit) else 0)
        self.sums = np.concatenate([*[_sums(r, up) for r in self.raw], np.zeros(0, np.uint64)])
        self.base = np.append(0, np.cumsum(self.sizes + 1))
        # Classes of similar length: (window, least marks in it).
        self.classes = []
        for c in np.unique(np.log2(self.sizes).astype(int)) if len(own) else ():
            of = np.log2(self.sizes).astype(int) == c
            self.classes.append((int((self.sizes + self.budget)[of].max()), int(self.least[of].min())))

    def _short(self, ids: list, raws: list[np.ndarray]) -> None:
        """Items under Q bytes, by length and content."""
        self.short: dict[int, dict[bytes, list]] = {}
        for i, r in zip(ids, raws, strict=True):
            one = r.tobytes().strip()
            if one and len(r) < Q:
                self.short.setdefault(len(one), {}).setdefault(one, []).append(i)

    def short_leaks(self, raw: np.ndarray) -> list[tuple]:
        """(item id, number of places) of the short items that stand in a text as whole words."""
        found, data = [], raw.tobytes()
        for size, items in self.short.items():
            for one, ids in items.items():
                n, at = 0, data.find(one)
                while at >= 0:
                    inside = (at > 0 and _WORD[raw[at - 1]] and _WORD[raw[at]]) or (at + size < len(raw) and _WORD[raw[at + size]] and _WORD[raw[at + size - 1]])
                    n += not inside
                    at = data.find(one, at + (1 if inside else size))
                found += [(i, n) for i in ids if n]
        return found

    def marks(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose Q-gram occurs in an item, and the grams; the bytes are taken in pieces."""
        places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low in range(0, len(raw) - Q + 1, PIECE):
            code = grams(raw[low : low + PIECE + Q - 1])
            where = np.flatnonzero(self.table[code >> np.uint64(64 - TABLE_BITS)])
            code = code[where]
            near = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
            real = self.codes[near] == code if len(self.codes) else np.zeros(0, bool)
            places.append(where[real] + low)
            codes.append(code[real])
        return np.concatenate(places), np.concatenate(codes)

    def dense(self, where: np.ndarray) -> np.ndarray:
        """Which marked places lie in a stretch that may hold a passage."""
        out = np.zeros(len(where), bool)
        for window, least in self.classes:
            # Runs of ``least`` marks within one window, spread back to their marks.
            if len(where) < least:
                continue
            tight = np.flatnonzero(where[least - 1 :] - where[: len(where) - least + 1] < window)
            edge = np.zeros(len(where) + 1, np.int32)
            edge[tight] += 1
            edge[tight + least] -= 1
            out |= np.cumsum(edge[:-1]) > 0
        return out

    def bands(self, text: np.ndarray, sums: np.ndarray, up: np.ndarray, places: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(item, band) with enough item places on its diagonals, from a text's dense marks and their grams."""
        k = np.searchsorted(self.codes, code)
        # Where the place before is no mark, every item place may begin a stretch; elsewhere those after another byte.
        before = np.where(np.append(False, places[1:] == places[:-1] + 1), text[places - 1].astype(np.int64), 256)
        same = k * 258 + before
        skip, resume = np.searchsorted(self.entered, same), np.searchsorted(self.entered, same, side="right")
        lows, many = np.concatenate([self.heads[k], resume]), np.concatenate([skip - self.heads[k], self.heads[k + 1] - resume])
        outer = np.concatenate([places, places])
        some = np.flatnonzero(many)
        lows, many, outer = lows[some], many[some], outer[some]
        ends = np.cumsum(many)
        held = np.zeros((0, 4), np.int64)
        at = 0
        while at < len(many):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + MOST, side="right")))
            n = many[at:stop]
            take = np.arange(n.sum()) + np.repeat(lows[at:stop] - (np.cumsum(n) - n), n)
            held = _united(np.concatenate([held, self._intervals(text, sums, up, self.item[take], self.place[take], np.repeat(outer[at:stop], n))]))
            at = stop
        if not len(held):
            return held[:, :2]
        head = np.flatnonzero(np.append(True, (held[1:, :2] != held[:-1, :2]).any(axis=1)))
        count = np.add.reduceat(held[:, 3] - held[:, 2], head)
        return held[head[count >= self.least[held[head, 0]]], :2]

    def _intervals(self, text: np.ndarray, sums: np.ndarray, up: np.ndarray, item: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """The item places of the common stretches that begin at these pairs of places, for both bands of their diagonals."""
        most = np.minimum(self.sizes[item] - inner, len(text) - outer)
        own, length = self.base[item] + inner, np.minimum(Q, most)
        step = 1 << int(most.max()).bit_length()
        while step:
            longer = length + step
            live = np.flatnonzero(longer <= most)
            far = longer[live]
            i, o = own[live], outer[live]
            equal = (sums[o + far] - sums[o]) * up[inner[live]] == (self.sums[i + far] - self.sums[i]) * up[o]
            length[live[equal]] += step
            step >>= 1
        band = (outer - inner) // (self.budget[item] + 1)
        stop = inner + length - Q + 1
        return np.concatenate([np.stack([item, b, inner, stop], 1) for b in (band, band - 1)])

    def search(self, text: np.ndarray, places: np.ndarray, code: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Leaks in one text: (item, start, end, edits), from its dense marks and their grams."""
        found, data = [], None
        up = _powers(max(len(text), int(self.sizes.max())))
        sums = _sums(text, up)
        rows = self.bands(text, sums, up, places, code)
        for it in np.unique(rows[:, 0]).tolist():
            data = text.tobytes() if data is None else data
            found += [(it, *one) for one in self._verified(it, rows[rows[:, 0] == it, 1], Pair(self.raw[it], text, sums, up), data)]
        return found

    def _verified(self, it: int, bands: np.ndarray, pair: Pair, data: bytes) -> list[tuple[int, int, int]]:
        """Passages of one item in the given bands (ascending): (start, end, edits), none overlapping."""
        item, m, k = self.raw[it].tobytes(), int(self.sizes[it]), int(self.budget[it])
        w = k + 1
        out, rest, done = [], [], 0
        for b in bands.tolist():
            if out and (b + 2) * w <= done:
                continue
            at = data.find(item, max(b * w, done), (b + 2) * w + m)
            if at >= 0:
                out.append((at, at + m, 0))
                done = at + m
            else:
                rest.append(b)
        low = np.array(rest, np.int64) * w
        while len(low):
            # Bands all of whose passages would overlap one that is taken.
            if out:
                starts = np.array(sorted(x[0] for x in out))
                near = starts[np.maximum(np.searchsorted(starts, low + 2 * w) - 1, 0)]
                low = low[~((near - m < low - k) & (low + 2 * w + k <= near + m))]
            picked, last = np.zeros(len(low), bool), None
            for i, x in enumerate(low.tolist()):
                if last is None or x >= last + m + 2 * w:
                    picked[i], last = True, x
            for got in aligned_many(pair, low[picked], 2 * w, k):
                if got is not None and all(got[1] <= s or e <= got[0] for s, e, _ in out):
                    out.append(got)
            low = low[~picked]
        return sorted(out)


class Pair:
    """An item and a text, with the lengths of their common stretches by halving on prefix sums."""

    def __init__(self, item: np.ndarray, text: np.ndarray, sums: np.ndarray | None = None, up: np.ndarray | None = None):
        self.item, self.text = item, text
        self.up = _powers(max(len(item), len(text))) if up is None else up
        self.sums, self.own = _sums(text, self.up) if sums is None else sums, _sums(item, self.up)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that agree from place i of the item and j of the text on."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero((i < len(self.item)) & (j < len(self.text)))
        live = live[self.item[i[live]] == self.text[j[live]]]
        if not len(live):
            return out
        i, j = i[live], j[live]
        most, length = np.minimum(len(self.item) - i, len(self.text) - j), np.ones(len(live), np.int64)
        up_i, up_j, base, own = self.up[i], self.up[j], self.sums[j], self.own[i]
        step = 1 << int(most.max()).bit_length()
        while step:
            far = length + step
            fits = far <= most
            far = np.minimum(far, most)
            length[fits & ((self.sums[j + far] - base) * up_i == (self.own[i + far] - own) * up_j)] += step
            step >>= 1
        out[live] = length
        return out


def aligned_many(pair: Pair, lows: np.ndarray, width: int, budget: int) -> list[tuple[int, int, int] | None]:
    """For each low: a banded alignment of the whole item with text on the diagonals low .. low+width-1; (start, end, edits) within budget."""
    width += 2 * budget
    out: list = []
    for at in range(0, len(lows), max(MOST // width, 1)):
        out += _aligned(pair, lows[at : at + max(MOST // width, 1)] - budget, width, budget)
    return out


def _aligned(pair: Pair, lows: np.ndarray, width: int, budget: int) -> list:
    """With one edit more in each step: the furthest place of the item that each diagonal of a band reaches."""
    m, n, none = len(pair.item), len(pair.text), np.int64(-1 << 40)
    row = np.arange(len(lows))
    column = lows[:, None] + np.arange(width)
    start = np.where((column >= 0) & (column <= n), column, -1)
    reach = np.where(start >= 0, 0, none)
    out: list = [None] * len(lows)
    edge = lambda x, fill, k: np.concatenate([np.full((len(x), 1), fill), x[:, :-1]], 1) if k < 0 else np.concatenate([x[:, 1:], np.full((len(x), 1), fill)], 1)
    for edits in range(budget + 1):
        if edits:
            both = np.where((reach < m) & (reach + column < n), reach + 1, none)  # one byte for another
            text = edge(reach, none, -1)  # a byte of the text only: from the diagonal below
            text = np.where(text + column <= n, text, none)
            item = edge(reach, none, 1) + 1  # a byte of the item only: from the diagonal above
            item = np.where(item <= m, item, none)
            new = np.maximum(np.maximum(both, text), item)
            start = np.where(new == both, start, np.where(new == text, edge(start, -1, -1), edge(start, -1, 1)))
            reach = np.maximum(new, none)
        live = np.flatnonzero(reach.ravel() >= 0)
        i = reach.ravel()[live]
        reach.ravel()[live] = i + pair.common(i, i + column.ravel()[live])
        done = (reach >= m).any(axis=1)
        if done.any():
            for k in np.flatnonzero(done):
                d = int((reach[k] >= m).argmax())
                out[row[k]] = (int(start[k, d]), int(column[k, d] + m), edits)
            row, column, reach, start = row[~done], column[~done], reach[~done], start[~done]
            if not len(row):
                break
    return out


def aligned(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    return aligned_many(Pair(item, text), np.array([low]), width, budget)[0]


def stored(benchmark: DataFrame) -> tuple[str, list[str]]:
    """The items in files of about ``BLOCK`` bytes in the shared folder: its URI and their names."""
    uri = scratch_dir(benchmark.sparkSession, "benchmark")
    known = benchmark.filter("text is not null").select("item_id", "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, part = Folder(uri), 0
        for b in slices(batches, most=BLOCK):
            name = f"{own_name()}-{part:04d}.items"
            with folder.create(name) as out, pa.ipc.new_stream(out, b.schema) as writer:
                writer.write_batch(b)
            yield pa.record_batch({"name": [name]})
            part += 1

    # Equal items lie side by side, whatever the number of partitions, and a row for each file comes to the driver.
    names = materialize(known.repartition(int(size // BLOCK) + 1, "item_id", "text").sortWithinPartitions("item_id", "text").mapInArrow(run, "name string"))
    return uri, sorted(r["name"] for r in names.collect())


def load(uri: str, names: list[str], rate: float) -> Items:
    folder, ids, texts = Folder(uri), [], []
    for name in names:
        with folder.open(name) as file, pa.ipc.open_stream(file) as reader:
            for b in reader:
                ids += b.column("item_id").to_pylist()
                texts += b.column("text").to_pylist()
    return Items(ids, texts, rate)


def scan(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, list[tuple]]]:
    """Row number and leaks (item id, passages, least edits) of each text that has any."""
    raw, offsets = fold(batch.column("text"))
    places, code = items.marks(raw)
    owner = np.searchsorted(offsets, places, side="right") - 1
    # A Q-gram must end in its own text.
    inside = places + Q <= offsets[owner + 1]
    places, code, owner = places[inside], code[inside], owner[inside]
    dense = items.dense(places)
    places, code, owner = places[dense], code[dense], owner[dense]
    for k in range(batch.num_rows) if items.short else np.unique(owner).tolist():
        low, high = np.searchsorted(owner, [k, k + 1])
        text = raw[offsets[k] : offsets[k + 1]]
        found: dict[int, list[int]] = {}
        for it, _, _, edits in items.search(text, places[low:high] - offsets[k], code[low:high]) if high > low else ():
            found.setdefault(it, []).append(edits)
        rows = [(items.ids[it], len(e), min(e)) for it, e in sorted(found.items())]
        rows += [(i, n, 0) for i, n in items.short_leaks(text)]
        if rows:
            yield k, rows


def _scans(batches: Iterator[pa.RecordBatch], uri: str, names: list[str], rate: float) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[tuple]]]]]:
    """Slices of the batches with the leaks of their rows; every slice meets every block of items."""
    pieces = slices(batches, most=2 << 20)
    if len(names) < 2:
        items = load(uri, names, rate)
        for b in pieces:
            yield b, list(scan(b, items))
        return
    while True:
        group, size = [], 0
        for b in pieces:
            group.append((b, []))
            size += b.column("text").nbytes
            if size >= GROUP:
                break
        if not group:
            return
        for name in names:
            items = load(uri, [name], rate)
            for b, found in group:
                found += scan(b, items)
        yield from group


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, n_passages, edits (the least)."""
    uri, names = stored(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _scans(batches, uri, names, rate):
            ids = b.column("doc_id")
            rows = [(ids[k].as_py(), *one) for k, own in found for one in own]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_passages", "edits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_passages long, edits long")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns as they are; no shuffle."""
    uri, names = stored(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _scans(batches, uri, names, rate):
            keep = np.ones(b.num_rows, bool)
            keep[[k for k, _ in found]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
