"""Exact n-gram Jaccard join: documents whose shingle sets have a similarity of at least ``percent`` / 100.

The nodes are distinct shingle sets (by a 64-bit digest), so exact copies cost one node.

1. Candidates.  Sizes fall into bands by doubling.  For a band the hash space is split into a fixed number of parts,
   about 2 to 3 elements of a set each.  Two similar sets differ in at most D = (|x|+|y|)(1-t)/(1+t) elements, so at
   most D parts differ; hence, in any global order of (part, its content), the first common one is among the first D+1
   of either set.  Those D+1 digests are the set's keys; larger parts come first, for they are rarely
   shared by accident.  A set also emits keys for the next band when a similar set may be there.  A set with too few
   filled parts for the argument, and any small set, emits single shingles (prefix filtering).  No link can be missed.
2. Every key ties its sets to the least of them, the centre: as many pairs as keys.  Sizes, then the differing bits of hashed
   bitmap signatures (parities of twice as many slots as elements) bound a pair's overlap from above; the sets of surviving pairs are fetched, and
   tiles of a centre's sets meet the centre, with wider bitmaps first and exact intersection of the sorted
   arrays last.  So a group of near copies, however large, is settled in linear work.
3. What the centres leave open: the sets of a key that still lie in several components meet by their signatures, key by key (a
   large key's in tiles).  Those that may be similar to one of another component are held together as groups, by a spanning
   forest.  A group is dealt into tiles by size band and hash, components of a tile's size or more into tiles of their
   own; tiles of neighbouring bands meet pairwise, unless both are of one component, with a union-find that passes over
   pairs that are connected already.  Out comes a spanning forest, never the pairs.
4. Components of the forest, and the smallest doc_id of each.

Defined cases: null or blank text has the empty set and stays alone; fewer than ``size`` words are one shingle; rows
of equal doc_id are each reported; a null doc_id never names a component unless all are null; empty tables give empty results;
extra columns are ignored by ``join`` and pass through ``representatives``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, materialize, slices
from .components import components
from .hashing import shingles, stir, words

SMALL = 24
PER_PART = 3.5
NO_ID = -(1 << 63)
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20
#: The same for tiles of signatures, which are a thirtieth of the sets.
SIG_ROWS, SIG_SHINGLES = 1 << 14, 1 << 25
#: Sets that meet their centre at once.
TOGETHER = 256
#: Bits of a signature, at least and at most.
BITS = 1 << 9, 1 << 18
#: So few wanted rows are sent to every task instead of exchanging the texts.
SMALL = 1 << 16


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, bounds = words(column)
    return [np.unique(shingles(hashes[i:j], size)) for i, j in zip(bounds, bounds[1:])]


def digest(one: np.ndarray) -> np.uint64:
    total = stir(one + np.uint64(0x51ED27)).sum(dtype=np.uint64)
    return stir(np.array([total + np.uint64(len(one))], np.uint64))[0]


def most_differing(n: int, percent: int) -> int:
    """Bound on the symmetric difference of a set of n elements and any similar one."""
    return n * (100 - percent) // percent  # (n + n/t)(1-t)/(1+t) = n(1-t)/t


def band(n: int) -> int:
    return 0 if n < SMALL else (n // SMALL).bit_length()


def keys(one: np.ndarray, percent: int) -> np.ndarray:
    n = len(one)
    need = most_differing(n, percent) + 1
    found, single = [], False
    for b in sorted({band(n), band(n * 100 // percent)}):
        if b == 0:
            single = True
            continue
        parts = int((SMALL << b) / PER_PART)
        place = (stir(one ^ np.uint64(0x7A3B1F)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        content = np.add.reduceat(stir(one[order] + np.uint64(b)), head)
        key = stir(content + place[head].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))
        filled = np.diff(np.append(head, n))
        if len(key) < need:
            single = True
        found.append(key[np.lexsort((key, -filled))[:need]])
    if single:
        found.append(np.sort(stir(one + np.uint64(0x1234567)))[:need])
    return np.concatenate(found)


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n_shingles, set (digest; null for the empty set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 << 20):
            sets = shingle_sets(b.column("text"), size)
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "row": b.column("row"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set": pa.array([int(digest(s).view(np.int64)) if len(s) else None for s in sets], pa.int64()),
                "sig": pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            })

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, n_shingles long, set long, sig binary")


def _keyed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 << 20):
            seen = {}
            for s in shingle_sets(b.column("text"), size):
                if len(s):
                    seen.setdefault(int(digest(s).view(np.int64)), s)
            found = [keys(s, percent) for s in seen.values()]
            if found:
                yield pa.record_batch({"key": np.concatenate(found).view(np.int64), "set": np.repeat(np.array(list(seen), np.int64), [len(k) for k in found])})

    return docs.select("text").mapInArrow(run, "key long, set long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and set -> (key, its least set, another); ``many``: the key may have further sets."""
    last = (None, None, None)  # key, its first set, its latest set
    for b in batches:
        if not b.num_rows:
            continue
        key, node = b.column("key").to_numpy(), b.column("set").to_numpy()
        new = np.append(key[0] != last[0], key[1:] != key[:-1])
        first = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if not new[0]:
            first[: int(np.argmax(new)) if new.any() else len(key)] = last[1]
        fresh = ~new & np.append(node[0] != last[2], node[1:] != node[:-1])
        last = (key[-1], first[-1], node[-1])
        if fresh.any():
            group = np.cumsum(new)
            count = np.bincount(group[fresh], minlength=group[-1] + 1)
            open_ = (count > 1) | np.isin(np.arange(len(count)), (0, group[-1]))  # the first and the last may go on in another batch
            yield pa.record_batch({"key": key[fresh], "a": first[fresh], "b": node[fresh], "many": pa.array(open_[group[fresh]])})


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]
        return self.up


def parities(one: np.ndarray, bits: int) -> np.ndarray:
    """Parities of ``bits`` slots as 64-bit words: differing bits of two are at most the elements in which the sets differ."""
    odd = np.bincount((stir(one) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signature(one: np.ndarray) -> bytes:
    return parities(one, min(max(1 << (2 * len(one)).bit_length(), BITS[0]), BITS[1])).tobytes()


def folded(sigs: list, words: int) -> np.ndarray:
    """Signatures as rows of so many words: halves of a wider one fold into one."""
    out = np.empty((len(sigs), words), np.uint64)
    for k, x in enumerate(sigs):
        x = np.frombuffer(x, np.uint64)
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: differing bits of two are at most the elements in which the sets differ."""
    bits = 1 << min(max(2 * max(map(len, sets)), 512).bit_length(), 15)
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k, s in enumerate(sets):
        out[k] = parities(s, bits)
    return out


def close(one: np.ndarray, others: list[np.ndarray], percent: int) -> list[bool]:
    """Which of the others are similar to one set: by size, by bitmap, by intersection."""
    maps = bitmaps([one, *others])
    differ = np.bitwise_count(maps[1:] ^ maps[0]).sum(axis=1, dtype=np.int64)
    return [_similar(one, x, int(d), percent) for x, d in zip(others, differ, strict=True)]


def _similar(x: np.ndarray, y: np.ndarray, differ: int, percent: int) -> bool:
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or differ * (100 + percent) > both * (100 - percent):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (both - same)


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Component roots of the similar pairs; where both sides 0 and 1 occur, only pairs across count.

    ``known`` components are connected from the start.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    maps, sides, forest = bitmaps([sets[k] for k in order]), side[order], Forest(len(order))
    if known is not None:
        _, first, which = np.unique(known[order], return_index=True, return_inverse=True)
        forest.up = np.minimum(np.arange(len(order)), first[which])
    across = sides.min() != sides.max()
    for i in range(len(order)):
        stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        others = np.arange(i + 1, stop)
        if across:
            others = others[sides[others] != sides[i]]
        roots = forest.roots()
        others = others[roots[others] != roots[i]]
        if not len(others):
            continue
        differ = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j, d in zip(others, differ):
            if forest.root(i) != forest.root(j) and _similar(sets[order[i]], sets[order[j]], int(d), percent):
                forest.join(i, int(j))
    out = np.empty(len(order), np.int64)
    out[order] = np.array(order)[forest.roots()]
    return out


def _by_meeting(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows; binary values are views of the batch."""
    for b in batches:
        found = []
        for c in columns:
            if pa.types.is_binary(b.schema.field(c).type):
                raw, at = joined_bytes(b.column(c))
                found.append([raw[i:j] for i, j in zip(at, at[1:])])
            else:
                found.append(b.column(c).to_pylist())
        yield from zip(*found, strict=True)


def _edges(found: list[tuple]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.record_batch({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})


def _centred(percent: int):
    """Rows sorted by meeting and side (0: the centre) -> the links (centre, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, held = None, (None, None), []

        def settled() -> pa.RecordBatch:
            good = close(centre[1], [x for _, x in held], percent) if held else []
            return _edges([(centre[0], n) for (n, _), ok in zip(held, good, strict=True) if ok])

        for meeting, node, side, body in _by_meeting(batches, ("meeting", "set", "side", "body")):
            if meeting != at or len(held) >= TOGETHER:
                yield settled()
                held = []
            if side == 0:
                at, centre = meeting, (node, np.frombuffer(body, np.uint64))
            elif meeting == at and node != centre[0]:
                held.append((node, np.frombuffer(body, np.uint64)))
        yield settled()

    return run


def _tiles(solve, payload: str):
    """Rows sorted by meeting -> what ``solve`` makes of each meeting's rows (set, side, payload, comp, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for meeting, *row in _by_meeting(batches, ("meeting", "set", "side", payload, "comp", "n")):
            if held and meeting != at:
                yield solve(held)
                held = []
            at = meeting
            held.append(row)
        if held:
            yield solve(held)

    return run


def _hopeful(percent: int):
    """Signatures of a meeting -> a spanning forest of the pairs of different components that may be similar."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[4])
        node, side, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3, 4))
        across, forest = side.min() != side.max(), Forest(len(rows))
        if (comp == comp[0]).all():
            return _edges([])
        stop = np.searchsorted(n, n * 100 // percent, side="right")
        words = np.array([len(r[2]) // 8 for r in rows])  # wider with size
        for w in np.unique(words):
            low, high = np.searchsorted(words, [w, w + 1])
            maps = folded([r[2] for r in rows[low : stop[high - 1]]], int(w))
            for i in range(low, high):
                others = np.arange(i + 1, stop[i])
                others = others[(comp[others] != comp[i]) & ((side[others] != side[i]) | (not across))]
                differ = np.bitwise_count(maps[others - low] ^ maps[i - low]).sum(axis=1, dtype=np.int64)
                for j in others[differ * (100 + percent) <= (n[others] + n[i]) * (100 - percent)]:
                    if forest.root(i) != forest.root(j):
                        forest.join(i, int(j))
        return _edges([(node[i], node[k]) for k, i in enumerate(forest.roots()) if i != k])

    return solve


def _forest(percent: int):
    """Sets of a meeting -> forest edges between components."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1]): r for r in rows}.values())
        known = np.array([r[3] for r in rows], np.int64)
        roots = linked([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows]), percent, known)
        return _edges([(known[i], known[j]) for i, j in enumerate(roots) if known[i] != known[j]])

    return solve


def _bodies(size: int):
    """Texts with the digest of their set -> the set itself, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=2 << 20):
            wanted, seen, rows = b.column("set").to_pylist(), set(), []
            for k, s in enumerate(shingle_sets(b.column("text"), size)):
                if wanted[k] not in seen:
                    seen.add(wanted[k])
                    rows.append((wanted[k], s.tobytes()))
            yield pa.record_batch({"set": pa.array([r[0] for r in rows], pa.int64()), "body": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _fetched(docs: DataFrame, reps: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(set, body) of the wanted ``sets`` (column set), from the row that stands for each; rows that are equal may give a set twice."""
    rows = materialize(reps.join(sets, "set", "left_semi").select("set", "row"))
    if rows.count() <= SMALL:
        rows = F.broadcast(rows)
    texts = docs.filter("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), "text")
    return texts.join(rows, "row").select("text", "set").mapInArrow(_bodies(size), "set long, body binary")


def _met(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """Rows (by set) at their meetings, side by side."""
    return rows.join(seats, "set").repartition("meeting").sortWithinPartitions("meeting", "side")


def _by_centre(bodies: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """The pairs (a: centre, b) of ``stars`` that are similar."""
    tiles = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("long").alias("_tiles"))
    meeting = lambda tile: F.xxhash64("a", tile).alias("meeting")
    centres = tiles.select(F.col("a").alias("set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_t"), "a").select("set", meeting(F.col("_t")), F.lit(0).alias("side"))
    others = stars.join(tiles, "a").select(F.col("b").alias("set"), meeting(F.pmod(F.xxhash64("b"), "_tiles")), F.lit(1).alias("side"))
    seats = centres.unionByName(others)
    return _met(bodies, seats).mapInArrow(_centred(percent), "a long, b long").distinct()


def _may_link(stars: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``stars`` that size and signature leave."""
    side = lambda c, x: reps.select(F.col("set").alias(c), F.col(x).alias(f"{x}_{c}"))
    at = stars.join(side("a", "n"), "a").join(side("b", "n"), "b")
    at = at.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).join(side("a", "sig"), "a").join(side("b", "sig"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()) * (100 - percent)
            pairs = [folded([x, y], min(len(x), len(y)) // 8) for x, y in _by_meeting([b], ("sig_a", "sig_b"))]
            differ = np.array([int(np.bitwise_count(p[0] ^ p[1]).sum(dtype=np.int64)) for p in pairs], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= both))

    return at.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _seats(at: DataFrame, percent: int, rows: int, shingles_: int) -> DataFrame:
    """(set, n, comp, group) -> (set, n, comp, meeting, side).

    A group of a tile's size is a meeting.  Of larger ones tiles of neighbouring size bands meet, but not those of one component.
    """
    size = at.groupBy("group").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_s"))
    sized = at.join(size, "group").withColumn("_large", (F.col("_m") > rows) | (F.col("_s") > shingles_))
    small = sized.filter("not _large").select("set", "n", "comp", F.col("group").alias("meeting"), F.lit(0).alias("side"))
    return small.unionByName(_tile_seats(sized.filter("_large").select("set", "n", "comp", "group"), percent, rows, shingles_))


def _tile_seats(at: DataFrame, percent: int, rows: int, shingles_: int) -> DataFrame:
    many = at.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("_m"))
    # Similar sizes lie in the same band or neighbouring ones; the ratio is wider by a little for the rounding of logarithms.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent)).cast("int")
    at = at.join(many, ["group", "comp"]).select("set", "n", "comp", "group", band.alias("band"), F.when(F.col("_m") >= rows, F.col("comp")).alias("own"))
    size_of = F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("n") / shingles_)).cast("long")
    classes = materialize(at.groupBy("group", "band", "own").agg(size_of.alias("tiles")))
    key = lambda c: F.struct("band", F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNull().alias("mixed"), "tiles").alias(c)
    left = classes.select("group", key("x"))
    right = classes.select("group", key("y"))
    pairs = left.join(right, "group").filter((F.col("x") <= F.col("y")) & (F.col("y.band") - F.col("x.band") <= 1))
    pairs = pairs.filter(F.col("x.mixed") | F.col("y.mixed") | (F.col("x.own") != F.col("y.own")))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{c}.tiles") - 1))
    pairs = pairs.select("group", "x", "y", span("x").alias("t")).select("group", "x", "y", "t", span("y").alias("u")).filter((F.col("x") != F.col("y")) | (F.col("t") <= F.col("u")))
    alone = (F.col("x") == F.col("y")) & (F.col("t") == F.col("u"))
    pairs = pairs.select("*", F.xxhash64("group", "x", "y", "t", "u").alias("meeting"), alone.alias("alone"))
    place = lambda c, t, side: pairs.select("group", f"{c}.band", f"{c}.own", f"{c}.mixed", F.col(t).alias("tile"), "meeting", F.lit(side).alias("side"), "alone")
    sides = place("x", "t", 0).unionByName(place("y", "u", 1).filter("not alone")).drop("alone")
    seated = at.join(classes.withColumnRenamed("own", "_own"), (at["group"] == classes["group"]) & (at["band"] == classes["band"]) & at["own"].eqNullSafe(F.col("_own")))
    seated = seated.select("set", "n", "comp", at["group"], at["band"], F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNull().alias("mixed"), F.pmod(F.xxhash64("set"), "tiles").alias("tile"))
    return seated.join(sides, ["group", "band", "own", "mixed", "tile"]).select("set", "n", "comp", "meeting", "side")


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    about = materialize(described(docs, size))
    keyed = _keyed(docs, size, percent).repartition("key").sortWithinPartitions("key", "set")
    links = materialize(keyed.mapInArrow(_stars, "key long, a long, b long, many boolean").groupBy("a", "b", F.when(F.col("many"), F.col("key")).alias("key")).agg(F.lit(1).alias("_one")).drop("_one"))
    stars = links.select("a", "b").distinct()
    reps = about.filter("set is not null").groupBy("set").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc"))
    reps = materialize(reps)
    near = materialize(_may_link(stars, reps, percent))
    fine = materialize(components(_by_centre(_fetched(docs, reps, near.select(F.explode(F.array("a", "b")).alias("set")).distinct(), size), near, percent)))
    comp = lambda df, c, new: df.join(fine.toDF(c, "_root"), c, "left").withColumn(new, F.coalesce("_root", c)).drop("_root")
    # Of keys with three sets or more (a pair has met already) those with the same sets count once; if these lie in several
    # components the key is open.
    links = links.filter("key is not null")
    alike = links.groupBy("key").agg(F.min("a").alias("a"), F.sum(F.xxhash64("b").cast("decimal(20,0)")).alias("_sum"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    links = materialize(links.join(alike.groupBy("a", "_sum", "_n").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))
    open_ = comp(comp(links, "a", "x"), "b", "y").filter("x <> y").select("key").distinct()
    members = links.select("key", F.col("a").alias("set")).distinct().unionByName(links.select("key", F.col("b").alias("set"))).join(open_, "key", "left_semi")
    members = materialize(comp(members.join(reps.select("set", "n"), "set"), "set", "comp").withColumnRenamed("key", "group"))
    hopeful = _met(reps.select("set", "sig"), _seats(members, percent, SIG_ROWS, SIG_SHINGLES)).mapInArrow(_tiles(_hopeful(percent), "sig"), "a long, b long")
    groups = materialize(components(hopeful))
    at = materialize(comp(groups.toDF("set", "group"), "set", "comp").join(reps.select("set", "n"), "set"))
    edges = _met(_fetched(docs, reps, at.select("set"), size), _seats(at, percent, TILE_ROWS, TILE_SHINGLES)).mapInArrow(_tiles(_forest(percent), "body"), "a long, b long")
    coarse = components(edges)
    sets = comp(reps.select("set", "doc"), "set", "comp").join(coarse.toDF("comp", "_top"), "comp", "left").select("set", "doc", F.coalesce("_top", "comp").alias("label"))
    roots = materialize(_least(materialize(sets)))
    # Plain exchanges on both sides, so that Spark can split a set that many rows have.
    named = about.filter("set is not null").join(roots, "set").select("doc_id", "n_shingles", "component_id")
    return named.unionByName(about.filter("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _least(sets: DataFrame) -> DataFrame:
    """(set, doc, label) -> (set, component_id), the least doc of each label.

    A label with over a thousandth of the sets is told by a broadcast (of under a thousand rows, therefore), the others by a join.
    """
    least = sets.groupBy("label").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    heavy = least.filter(F.col("_n") * 1000 > sets.count())
    told = sets.join(F.broadcast(heavy), "label").select("set", "component_id")
    rest = sets.join(F.broadcast(heavy.select("label")), "label", "left_anti").join(least, "label").select("set", "component_id")
    return told.unionByName(rest)


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group.  Rows of equal doc_id count as one
    document (the one with the least hash of its text stays); of rows without doc_id those with equal text do."""
    found = join(docs, size, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")).distinct()
    digest = F.struct(F.col("text").isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), digest.alias("_text"))
    seen = rows.groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_n")).join(named, "_id", "left_semi")
    chosen = seen.groupBy("_id", F.when(F.col("_id") == NO_ID, F.col("_text")).alias("_own")).agg(F.min(F.struct("_text", "_n")).alias("_at")).select("_id", "_at.*")
    kept = rows.join(chosen, ["_id", "_text"])
    # Only rows of one id and text need a choice between them.
    return kept.filter("_n = 1").select("_kept.*").unionByName(kept.filter("_n > 1").dropDuplicates(["_id", "_text"]).select("_kept.*"))
