"""Sharding by extendible hashing.

A row's address is ``BITS`` bits: a hash of doc_id, then one of doc_id and text, then one of the row's place in the input.  A
shard is an address prefix.  Starting with one bucket, only buckets above ``limit`` bytes split on their next bit.
Bytes are summed once by a prefix of ``STEP`` bits (at most 2**STEP rows after the partial aggregation) and rolled up over
the shorter prefixes, so that a split costs no pass over the documents.  Where a bucket is still too large after STEP bits,
the next bits of its own documents are summed in the same way.  So rows of one doc_id part on their texts, and equal
rows on their places.

The directory is a table with a row for each shard, and shards are at least as deep as the least deep one, so rows find theirs by
an ordinary join on a prefix of that depth, where few shards share one.

Defined cases: null or empty text has 0 bytes; a document larger than the limit ends alone in its shard
(``oversize``); an empty table gives an empty result; extra columns pass through, but for those that have the name of an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

STEP = 20
BITS = 192
LIMIT = 1 << 20
#: A directory of no more rows than this (some 10 MB) is sent to every task, which spares the rows an exchange; the join is the same.
SMALL = 1 << 16


def prefix(address: Column, bits: Column | int) -> Column:
    """The leading ``bits`` bits of an address (an array of words of 32 bits) as text of 0 and 1."""
    if isinstance(bits, int):
        whole, rest = divmod(bits, 32)
        parts = [F.lpad(F.bin(address[k]), 32, "0") for k in range(whole)]
        parts += [F.substring(F.lpad(F.bin(address[whole]), 32, "0"), 1, rest)] * (rest > 0)
        return F.concat(*parts) if parts else F.lit("")
    return F.substring(prefix(address, BITS), F.lit(1), bits)


def address(seed: int) -> Column:
    """Words of 32 bits from MD5 digests: of doc_id, of doc_id and text, of the row's place in the input."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    digests = (name, F.concat_ws(":", name, F.md5(F.col("text").cast("binary"))), F.concat_ws(":", F.lit(str(seed)), F.monotonically_increasing_id().cast("string")))
    return F.array(*[F.conv(F.substring(F.md5(d.cast("binary")), 8 * k + 1, 8), 16, 10).cast("long") for d in digests for k in range(2)])


def leaves(sums: DataFrame, known: int, depth: int, limit: int) -> DataFrame:
    """Split buckets down from prefix length ``known``: for each prefix of ``depth`` bits the first length at
    which its bucket fits (or holds a single document); null if none does."""
    lengths = sums.select("slot", "bytes", "docs", F.explode(F.sequence(F.lit(known), F.lit(depth))).alias("length"))
    bucket = lengths.groupBy("length", F.substring("slot", F.lit(1), F.col("length")).alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = bucket.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    # A fitting bucket is a shard when its parent does not fit.
    parents = fits.select(F.col("length").alias("_l"), F.col("shard").alias("_s"))
    parent = (F.col("_l") == F.col("length") - 1) & (F.col("_s") == F.substring("shard", F.lit(1), F.col("length") - 1))
    return fits.join(parents, parent, "left_anti")


def directory(addressed: DataFrame, limit: int) -> DataFrame:
    """(address, n_bytes) -> the shards: length, shard, shard_bytes, shard_docs."""
    found, open_, known = None, addressed, 0
    while True:
        depth = min(known + STEP, BITS)
        sums = open_.groupBy(prefix(F.col("address"), depth).alias("slot")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        sums = materialize(sums)
        total = sums.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
        got = materialize(leaves(sums, known, depth, limit))
        found = got if found is None else found.unionByName(got)
        covered = got.agg(F.coalesce(F.sum("shard_docs"), F.lit(0)).alias("n")).first()["n"]
        if covered == total:
            return found
        if depth == BITS:
            raise ValueError("rows with one address of all bits")
        open_ = materialize(assigned(open_, got).filter("shard is null").select(*addressed.columns))
        known = depth


def assigned(addressed: DataFrame, shards: DataFrame) -> DataFrame:
    """``addressed`` with shard, shard_bytes and shard_docs (null where no shard covers the address)."""
    ends = shards.agg(F.coalesce(F.min("length"), F.lit(0)).alias("low"), F.coalesce(F.max("length"), F.lit(0)).alias("high"), F.count(F.lit(1)).alias("n")).first()
    right = shards.select(F.substring("shard", 1, ends["low"]).alias("_base"), "shard", "shard_bytes", "shard_docs")
    if ends["n"] <= SMALL:
        right = F.broadcast(right)
    left = addressed.withColumn("_slot", prefix(F.col("address"), ends["high"])).withColumn("_left", F.substring("_slot", 1, ends["low"]))
    return left.join(right, (F.col("_left") == F.col("_base")) & F.startswith("_slot", "shard"), "left").drop("_slot", "_left", "_base")


ADDED = ("n_bytes", "shard", "depth", "shard_bytes", "oversize")


def shard(docs: DataFrame, limit: int = LIMIT, seed: int = 29, keep: list[str] | None = None) -> DataFrame:
    """Per row: the ``keep`` columns (doc_id), n_bytes, shard (address bits), depth, shard_bytes, oversize.

    Kept columns of these names give way to the new ones.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ADDED]
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    small = materialize(docs.select("doc_id", n_bytes, address(seed).alias("address")))
    found = directory(small.select("address", "n_bytes"), limit)
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept")
    rows = small.select(F.struct("doc_id").alias("_kept"), "n_bytes", "address") if keep == ["doc_id"] else docs.select(whole, n_bytes, address(seed).alias("address"))
    out = assigned(rows, found)
    return out.select("_kept.*", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def laid_out(sharded: DataFrame, part: int = 128 << 20) -> DataFrame:
    """Rows of a shard side by side in one partition, in order of shard and doc_id; partitions of about ``part`` bytes of text."""
    total = sharded.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    return sharded.repartition(int(total // part) + 1, "shard").sortWithinPartitions("shard", "doc_id")
