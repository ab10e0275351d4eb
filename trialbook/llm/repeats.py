"""Exact substring deduplication with an enhanced suffix array, distributed over content-defined segments.

Every window of ``span`` bytes has a minimizer: among its ``KMER``-byte substrings the one with the least hash, the
rightmost at ties.  It depends on the window's content only, so equal windows have equal minimizers.  A segment is a
maximal run of window starts with one minimizer occurrence (about 35 starts); a text is cut into segments in one pass.

1. Segments are dealt by their minimizer.  Of segments with equal content the first (doc_id, then copy, then start)
   stays and the others are removed as they are; each batch drops its own repeats before the shuffle, so
   a hot passage sends a row for each batch, not for each copy.
2. Only minimizers with several different contents need their bytes compared.  Those segments' bytes meet, dealt
   by minimizer again, in a suffix array of their window starts: suffixes are ordered by their leading window
   and then by the bytes after it, with the lengths of common prefixes beside.  Classes whose occurrences all continue
   to the left by one same byte are passed over (the repeat that starts there covers them); over the others a stack scan
   closes common-prefix intervals from the deepest to the shallowest and yields the maximal repeats with all
   occurrences: at each closing, the later of the two first occurrences repeats the earlier one over that prefix.
   A hot minimizer, with more than ``HOT`` contents, would make one task grow with the corpus.  Its segments send a row
   for each window instead, dealt by the window's own hash, and all but the first of equal windows go.
3. The spans come back to the documents, whose single exchange by doc_id serves all three passes.

Defined cases: null or empty text has no byte; texts shorter than ``span`` lose nothing; rows that share a doc_id
are documents of their own, ordered by text; a null doc_id comes before
all others (and -2**63 is taken for one); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_bytes, slices

KMER = 32
PIECE = 1 << 19
#: Stands for a null doc_id while documents are matched.
NO_ID = -(1 << 63)
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION = np.uint64((1 << 20) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of all substrings of a buffer of up to PIECE + span bytes."""

    def __init__(self, most: int):
        self.up, self.down = _powers(_BASE, most), _powers(_INVERSE, most + 1)

    def load(self, raw: np.ndarray) -> None:
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.up[: len(raw)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _stir((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _stir((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def cut(raw: np.ndarray, offsets: np.ndarray, span: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Segments of back-to-back texts: minimizer hash, content hash, first window start, number of starts."""
    found = []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, max(len(raw) - span + 1, 0), PIECE):
        part = raw[at : at + PIECE + span - 1]
        hasher.load(part)
        grams = hasher.windows(KMER)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~_POSITION) | (_POSITION - place), span - KMER + 1)
        own = np.arange(at, at + len(least))
        inside = own + span <= ends[at : at + len(least)]
        least = (_POSITION - (least & _POSITION)).astype(np.int64)
        first = np.ones(len(least), bool)
        # A window of the next text never shares a minimizer occurrence with a valid one of this text: it would have
        # to start in this text, and such windows are not inside.
        first[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(first)
        count = np.diff(np.append(start, len(least)))
        valid = inside[start]
        start, count = start[valid], count[valid]
        found.append((grams[least[start]], hasher.between(start, start + count - 1 + span), start + at, count))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SEGMENT = "key long, content long, doc_id long, copy int, start int, n int, kind int"
#: kind: a segment, a removed span (n bytes), a segment whose bytes are needed, a segment of a hot minimizer.
PLAIN, REMOVED, NEEDED, CROWDED = 0, 1, 2, 3
#: A minimizer with more different contents than this is hot: its windows are dealt one by one instead.
HOT = 1 << 16


def _rows(kind: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    n = len(columns["start"])
    zero = np.zeros(n, np.int64)
    whole = {"key": zero, "content": zero} | columns
    as_type = {"key": pa.int64(), "content": pa.int64(), "doc_id": pa.int64(), "copy": pa.int32(), "start": pa.int32(), "n": pa.int32()}
    out = {c: (v if isinstance(v, pa.Array) else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v)).cast(t) for c, v in whole.items() for t in [as_type[c]]}
    return pa.record_batch({c: out[c] for c in as_type} | {"kind": pa.array(np.full(n, kind, np.int32))})


def _segments(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + span)
        for b in slices(batches, most=6 << 20):
            raw, offsets = joined_bytes(b.column("text"))
            key, content, start, count = cut(raw, offsets, span, hasher)
            row = np.searchsorted(offsets, start, side="right") - 1
            start = start - offsets[row]
            ids, copy = b.column("doc_id"), b.column("copy").to_numpy()
            rank = np.empty(len(ids), np.int64)  # the rows' order by (doc_id, copy), nulls first
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            rank[np.lexsort((copy, ids.fill_null(0).to_numpy(), known))] = np.arange(len(ids))
            order = np.lexsort((start, rank[row], content, key))
            key, content, start, count, row = (x[order] for x in (key, content, start, count, row))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            for kind, these in ((PLAIN, ~again), (REMOVED, again)):
                if not these.any():
                    continue
                at = np.flatnonzero(these)
                n = count[at]
                if kind == REMOVED:  # neighbouring spans of a document become one
                    at = at[np.lexsort((start[at], row[at]))]
                    stop = start[at] + count[at] - 1 + span
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (row[at][1:] != row[at][:-1]) | (start[at][1:] > stop[:-1])
                    heads = np.flatnonzero(fresh)
                    n = np.maximum.reduceat(stop, heads) - start[at][heads]
                    at = at[heads]
                # Removed spans need no meeting place: any key will do.
                yield _rows(kind, key=key[at], content=content[at], doc_id=ids.take(pa.array(row[at])), copy=copy[row[at]], start=start[at], n=n)

    return run


def _resolve(span: int, hot: int):
    """Rows sorted by key, content, doc_id, copy, start -> removed spans, needed and crowded segments, in a stream.

    Of the key at hand at most ``hot`` segments are held back.
    """
    columns = ("key", "content", "doc_id", "copy", "start", "n")

    def as_kind(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return _rows(kind, **{c: b.column(c) for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        held: list[pa.RecordBatch] = []  # the last key's first segments of each content
        crowded = False

        def settled() -> Iterator[pa.RecordBatch]:
            if sum(h.num_rows for h in held) > 1:
                yield from (as_kind(NEEDED, h) for h in held)
            held.clear()

        for b in batches:
            kind = b.column("kind").to_numpy()
            if (kind == REMOVED).any():
                yield b.filter(pa.array(kind == REMOVED))
                b = b.filter(pa.array(kind == PLAIN))
            if not b.num_rows:
                continue
            key, content = b.column("key").to_numpy(), b.column("content").to_numpy()
            new_key = np.append(key[0] != last[0], key[1:] != key[:-1])
            rep = new_key | np.append(content[0] != last[1], content[1:] != content[:-1])
            last = (key[-1], content[-1])
            if (~rep).any():
                gone = b.filter(pa.array(~rep))
                yield _rows(REMOVED, doc_id=gone.column("doc_id"), copy=gone.column("copy"), start=gone.column("start"), n=gone.column("n").to_numpy() - 1 + span)
            group = np.cumsum(new_key)  # 0: still the key at hand
            first, final = group == 0, group == group[-1]
            if (rep & first).any():
                held.append(b.filter(pa.array(rep & first)))
            if not crowded and sum(h.num_rows for h in held) > hot:
                crowded = True
            if crowded:
                yield from (as_kind(CROWDED, h) for h in held)
                held.clear()
            if group[-1] == 0:
                continue
            yield from settled()
            counts = np.bincount(group[rep])
            among = rep & ~first & ~final & (counts[group] > 1)
            for kind_, these in ((NEEDED, counts[group] <= hot), (CROWDED, counts[group] > hot)):
                if (among & these).any():
                    yield as_kind(kind_, b.filter(pa.array(among & these)))
            held.append(b.filter(pa.array(rep & final)))
            crowded = held[0].num_rows > hot
            if crowded:
                yield from (as_kind(CROWDED, h) for h in held)
                held.clear()
        yield from settled()

    return run


BODY = "key long, doc_id long, copy int, start int, body binary"


def _extract(span: int):
    """Joined documents with their lists of rows -> bytes of the needed segments; of crowded ones a row for each
    window, under the window's own hash and without a body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + span)
        for b in slices(batches, most=4 << 20):
            raw, offsets = joined_bytes(b.column("text"))
            lists = b.column("rows")
            rows = lists.flatten()
            doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            kind, start, n = (rows.field(c).to_numpy() for c in ("kind", "start", "n"))
            start, n = start.astype(np.int64), n.astype(np.int64)
            at = np.flatnonzero(kind == NEEDED)
            if len(at):
                size = n[at] - 1 + span
                ends = np.cumsum(size)
                take = np.arange(ends[-1]) + np.repeat(offsets[doc[at]] + start[at] - (ends - size), size)
                body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(raw[take])])
                yield _placed(b, doc[at], rows.field("key").to_numpy()[at], start[at], body)
            at = np.flatnonzero(kind == CROWDED)
            if len(at):
                # All window hashes of the batch, piece by piece; then those of the crowded segments.
                code = [np.zeros(0, np.uint64)]
                for low in range(0, len(raw) - span + 1, PIECE):
                    hasher.load(raw[low : low + PIECE + span - 1])
                    code.append(hasher.windows(span))
                inner = np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
                doc, start = np.repeat(doc[at], n[at]), np.repeat(start[at], n[at]) + inner
                code = np.concatenate(code)[offsets[doc] + start].view(np.int64)
                order = np.lexsort((start, b.column("copy").to_numpy()[doc], b.column("doc_id").to_numpy()[doc], code))
                yield _placed(b, doc[order], code[order], start[order], pa.nulls(len(order), pa.binary()))

    return run


def _placed(b: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, start: np.ndarray, body: pa.Array) -> pa.RecordBatch:
    pick = pa.array(doc)
    return pa.record_batch({"key": key, "doc_id": b.column("doc_id").take(pick), "copy": b.column("copy").take(pick), "start": pa.array(start.astype(np.int32)), "body": body})


def maximal_repeats(raw: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments back to back, the first occurrences first -> (segment, offset in it, length) of each repeat of an
    earlier occurrence, for maximal repeats of at least ``span`` bytes."""
    size = np.diff(offsets)
    starts = np.maximum(size - span + 1, 0)
    segment = np.repeat(np.arange(len(size)), starts)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = offsets[segment] + inner
    hasher = Hasher(len(raw) + 1)
    hasher.load(raw)
    lead = hasher.windows(span)[at]
    order = np.argsort(lead, kind="stable")
    lead, at, segment, inner = lead[order], at[order], segment[order], inner[order]
    fresh = np.ones(len(lead), bool)
    fresh[1:] = lead[1:] != lead[:-1]
    head = np.flatnonzero(fresh)
    many = np.diff(np.append(head, len(lead)))
    # Left-extension diversity: a class with a segment's first start, or with two different bytes before it.
    before = np.where(inner == 0, -1, raw[np.maximum(at - 1, 0)].astype(np.int64))
    low, high = np.minimum.reduceat(before, head), np.maximum.reduceat(before, head)
    chosen = np.flatnonzero((many > 1) & ((low != high) | (low < 0)))
    out: list[tuple[int, int]] = []
    ends = offsets[segment + 1]
    data = raw.tobytes()
    for k in chosen:
        tails = [data[at[m] + span : ends[m]] for m in range(head[k], head[k] + many[k])]
        ranked = sorted(range(len(tails)), key=tails.__getitem__)
        stack: list[tuple[int, int]] = []  # (common prefix with what follows, first occurrence in the interval)
        first = ranked[0]
        for a, b in zip(ranked, [*ranked[1:], None], strict=True):
            depth = -1 if b is None else _common(tails[a], tails[b])
            while stack and stack[-1][0] >= depth:
                deep, other = stack.pop()
                first, later = min(first, other), max(first, other)
                out.append((head[k] + later, deep))
            stack.append((depth, first))
            first = b
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    got = np.array(out, np.int64)
    return segment[got[:, 0]], inner[got[:, 0]], got[:, 1] + span


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def _compare(span: int, most: int = 3 << 20):
    """Segments sorted by key, doc_id, copy, start -> removed spans; whole keys are taken together, about ``most`` bytes at a time."""

    def spans(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        raw, offsets = joined_bytes(b.column("body"))
        segment, inner, length = maximal_repeats(raw, offsets, span)
        if len(segment):
            pick = pa.array(segment)
            yield pa.record_batch({"doc_id": b.column("doc_id").take(pick), "copy": b.column("copy").take(pick), "start": pa.array((b.column("start").to_numpy()[segment] + inner).astype(np.int32)), "n": pa.array(length.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, window = 0, None
        for b in batches:
            alone = b.column("body").is_null()
            if alone.true_count:
                # Windows of hot minimizers: all but the first of each go.
                w, b = b.filter(alone), b.filter(b.column("body").is_valid())
                code = w.column("key").to_numpy()
                again = ~np.append(code[0] != window, code[1:] != code[:-1])
                window = code[-1]
                w = w.filter(pa.array(again))
                yield pa.record_batch({"doc_id": w.column("doc_id"), "copy": w.column("copy"), "start": w.column("start"), "n": pa.array(np.full(w.num_rows, span, np.int32))})
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            body = np.diff(joined_bytes(b.column("body"))[1])
            breaks = np.flatnonzero(np.append(not held or held[-1].column("key")[-1].as_py() != key[0], key[1:] != key[:-1]))
            at = 0
            for stop in [*breaks, len(key)]:  # a key never straddles two comparisons
                if stop > at:
                    held.append(b.slice(at, stop - at))
                    size += int(body[at:stop].sum())
                    at = stop
                if size > most and stop < len(key):
                    yield from spans(held)
                    held, size = [], 0
        if held:
            yield from spans(held)

    return run


def removed_spans(docs: DataFrame, span: int = 100, hot: int = HOT) -> DataFrame:
    """doc_id, copy, text and the removed spans: those in ``rows`` of kind REMOVED and those in ``repeats``."""
    # One key throughout, so that the explicit exchange serves all three passes and both joins.
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id")
    base = base.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    cuts = base.mapInArrow(_segments(span), SEGMENT)
    sorted_ = cuts.repartition("key").sortWithinPartitions("key", "content", "doc_id", "copy", "start")
    rows = sorted_.mapInArrow(_resolve(span, hot), SEGMENT)
    listed = rows.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "kind", "key", "start", "n")).alias("rows"))
    own = lambda c: F.filter(c, lambda r: r["copy"] == F.col("copy"))
    bodies = base.join(listed, "doc_id").select("doc_id", "copy", "text", own("rows").alias("rows"))
    bodies = bodies.mapInArrow(_extract(span), BODY)
    met = bodies.repartition("key").sortWithinPartitions("key", "doc_id", "copy", "start")
    repeats = met.mapInArrow(_compare(span), "doc_id long, copy int, start int, n int")
    repeats = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "start", "n")).alias("repeats"))
    return base.join(listed, "doc_id", "left").join(repeats, "doc_id", "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "copy", "text", own("rows").alias("rows"), own("repeats").alias("repeats"))


def dedup(docs: DataFrame, span: int = 100, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 << 20):
            raw, offsets = joined_bytes(b.column("text"))
            parts = []
            for column in ("removed", "repeats"):
                lists = b.column(column)
                doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                rows = lists.flatten()
                parts.append((doc, rows.field("start").to_numpy().astype(np.int64), rows.field("n").to_numpy()))
            doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, doc))
            doc, start, n = doc[order], offsets[doc[order]] + start[order], n[order]
            stop = np.maximum.accumulate(start + n)
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
            heads = np.flatnonzero(fresh)
            spans = np.bincount(doc[heads], minlength=b.num_rows)
            edge = np.zeros(len(raw) + 1, np.int32)
            last = np.append(heads[1:], len(doc))[: len(heads)] - 1
            np.add.at(edge, start[heads], 1)
            np.add.at(edge, stop[last], -1)
            keep = np.cumsum(edge[:-1]) == 0
            left = np.append(0, np.cumsum(keep))[offsets]
            data = raw[keep].tobytes()
            digest = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(left, left[1:])]
            size = np.diff(offsets)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": size, "n_removed": size - np.diff(left), "n_spans": spans.astype(np.int64), "kept_sha256": pa.array(digest, pa.string())})

    out = removed_spans(docs, span, hot)
    removed = F.transform(F.filter("rows", lambda r: r["kind"] == REMOVED), lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n")))
    return out.select("doc_id", "text", removed.alias("removed"), "repeats").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def maximal_groups(raw: np.ndarray, offsets: np.ndarray, span: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Different segments back to back -> (length, occurrences as (segment, offset in it)) of each maximal repeat of at least
    ``span`` bytes: common-prefix intervals whose members do not all continue to the left by one byte."""
    size = np.diff(offsets)
    starts = np.maximum(size - span + 1, 0)
    segment = np.repeat(np.arange(len(size)), starts)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(starts) - starts, starts)
    at, data, out = offsets[segment] + inner, raw.tobytes(), []
    tails = [data[i : offsets[k + 1]] for i, k in zip(at, segment)]
    order = sorted(range(len(tails)), key=tails.__getitem__)
    before = [data[at[m] - 1] if inner[m] else -1 - int(segment[m]) for m in range(len(tails))]  # no byte before is unlike any other
    stack: list[tuple[int, int]] = []  # (common prefix with what follows, first rank of the interval)
    for rank, m in enumerate(order):
        last = rank + 1 == len(order)
        depth = 0 if last else _common(tails[m], tails[order[rank + 1]])
        low = rank
        while stack and stack[-1][0] > depth:
            deep, low = stack.pop()
            members = order[low : rank + 1]
            if deep >= span and len({before[x] for x in members}) > 1:
                out.append((deep, [(int(segment[x]), int(inner[x])) for x in members]))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, low))
    return out


GROUP = "group long, length int, content long, inner int"


def _groups(span: int):
    """(key, content, body) sorted by key -> the repeats among a key's different segments, and each segment that occurs again as it is."""

    def solve(contents: list[int], bodies: list[bytes], many: list[int]) -> Iterator[tuple]:
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        found = [(len(b), [(k, 0)]) for k, (b, n) in enumerate(zip(bodies, many, strict=True)) if n > 1]
        if len(bodies) > 1:
            found += maximal_groups(raw, np.append(0, np.cumsum([len(b) for b in bodies])), span)
        for length, members in found:
            k, i = members[0]
            group = int.from_bytes(hashlib.blake2b(bodies[k][i : i + length], digest_size=8).digest(), "little", signed=True)
            yield from ((group, length, contents[k], i) for k, i in members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])
        for b in batches:
            rows = []
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("key", "content", "body", "n")), strict=True):
                if k != key:
                    rows += solve(*held)
                    key, held = k, ([], [], [])
                for to, x in zip(held, row, strict=True):
                    to.append(x)
            yield _as_groups(rows)
        yield _as_groups(list(solve(*held)))

    return run


def _as_groups(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["group", "length", "content", "inner"])


def repeat_groups(docs: DataFrame, span: int = 100) -> DataFrame:
    """The maximal repeats of the corpus's segments with all their occurrences: group, length, doc_id, copy, start.

    A repeat ends where its segment does (a longer passage is a row of groups); a segment that occurs several times as it is counts
    as one member of the suffix array, and its occurrences come back by a join on its content.  A key's
    different segments are compared in one task, so this output is for keys that fit there; ``dedup`` has no such bound.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id")
    base = base.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + span)
        for b in slices(batches, most=2 << 20):
            raw, offsets = joined_bytes(b.column("text"))
            key, content, start, count = cut(raw, offsets, span, hasher)
            row = np.searchsorted(offsets, start, side="right") - 1
            data, pick = raw.tobytes(), pa.array(row)
            yield pa.record_batch({
                "key": key.view(np.int64), "content": content.view(np.int64), "doc_id": b.column("doc_id").take(pick), "copy": b.column("copy").take(pick).cast(pa.int32()),
                "start": pa.array((start - offsets[row]).astype(np.int32)), "body": pa.array([data[i : i + n - 1 + span] for i, n in zip(start, count)], pa.binary()),
            })

    cuts = base.mapInArrow(run, "key long, content long, doc_id long, copy int, start int, body binary")
    distinct = cuts.groupBy("key", "content").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n"))
    groups = distinct.repartition("key").sortWithinPartitions("key", "content").mapInArrow(_groups(span), GROUP)
    return groups.join(cuts.drop("body", "key"), "content").select("group", "length", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "copy", (F.col("start") + F.col("inner")).alias("start")).distinct()
