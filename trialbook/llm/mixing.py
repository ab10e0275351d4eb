"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

Targets: the sources, in code-point order with null last, weigh ``weights`` in turn and share ``growth`` times
the words of the corpus; a target stops at ``cap`` times its source and the excess is reshared by weight.  The
level of that water-filling has a closed form over the sources ordered by cap/weight, so no iteration is needed.

Quotas: every source is dealt, by a seeded hash of doc_id and text, into cells of about ``cell_words`` words.  Blocks of
``block`` words go first to sources and then to the cells of each source by highest quotients claim/(2k-1).
Only seats near the final divisor are ever enumerated (at most two or so for a claimant), so the ranking stays linear.
A cell holds ``cap`` times its words at most; blocks beyond that go to the next cells of its source that have room.

Selection: inside its cell a document stands at a seeded place; a cell's blocks run through that order, at most
``cap`` times, so ``taken`` of a document lies between 0 and ``cap`` times its size.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own; repeated rows
and rows without doc_id are documents of their own, each counted; equal rows are interchangeable; an empty table gives an empty
result; extra columns are ignored by ``mix`` and pass through ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BLOCK, CELL_WORDS, SEED = 8, 1 << 20, 17
#: So few sources are sent to every task, so that rows need no exchange by source and a hot one no task of its own.
SMALL = 1 << 16


def apportion(claims: DataFrame, within: list[str], key: list[str], claim: str, seats: Column) -> DataFrame:
    """``claims`` with a column ``quota``: ``seats`` (constant in each group of ``within``) shared out by
    Sainte-Laguë over the rows, ties by ``key``."""
    group = Window.partitionBy(*within)
    n, all_claims, rows = F.col("_seats"), F.col("_all"), F.col("_rows")
    at = claims.withColumn("_seats", seats.cast("double")).withColumn("_all", F.sum(claim).over(group)).withColumn("_rows", F.count(F.lit(1)).over(group))
    share = lambda room: F.when(all_claims > 0, F.floor(F.col(claim) * F.greatest(room, F.lit(0.0)) / all_claims + 0.5)).otherwise(0)
    at = at.withColumn("_base", F.greatest(share(n - rows / 2) - 1, F.lit(0)).cast("long")).withColumn("_top", (share(n + rows / 2) + 1).cast("long"))
    at = materialize(at)
    bids = at.filter(F.col(claim) > 0).select(*within, *key, claim, "_seats", F.explode(F.sequence(F.col("_base") + 1, F.col("_top"))).alias("_k"))
    given = at.filter(F.col(claim) > 0).groupBy(*within).agg(F.sum("_base").alias("_given"))
    order = Window.partitionBy(*within).orderBy(F.desc(F.col(claim) / (2 * F.col("_k") - 1)), *key)
    won = bids.join(given, within).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_seats") - F.col("_given"))
    won = won.groupBy(*within, *key).agg(F.count(F.lit(1)).alias("_won"))
    return at.join(won, [*within, *key], "left").withColumn("quota", F.when(F.col(claim) > 0, F.col("_base")).otherwise(0) + F.coalesce("_won", F.lit(0))).drop("_seats", "_all", "_rows", "_base", "_top", "_won")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], growth: float, cap: float) -> DataFrame:
    """(src, source_size) -> the same with ``target``; one row per source, so one small partition holds them."""
    everything = Window.partitionBy("_one")
    places = F.array(*[F.lit(float(w)) for w in weights])
    at = sizes.withColumn("_one", F.lit(1))
    at = at.withColumn("_w", F.get(places, ((F.row_number().over(everything.orderBy("src")) - 1) % len(weights)).cast("int")))
    at = at.withColumn("_cap", F.col("source_size") * cap)
    before = everything.orderBy(F.col("_cap") / F.col("_w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_left", F.sum("source_size").over(everything) * growth - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    at = at.withColumn("_room", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    at = at.withColumn("_level", F.max(F.col("_left") / F.col("_room")).over(everything))
    return at.select("src", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def _taken(docs: DataFrame, keep: list[str], weights: tuple[int, ...], growth: float, cap: int, block: int, cell_words: int, seed: int) -> DataFrame:
    """_kept (the ``keep`` columns), size, source_size, target, taken: a row for each row."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"),
        F.col("doc_id").alias("id"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("place"),
    )
    if keep == ["doc_id"]:
        rows = small = materialize(rows)
    else:
        small = materialize(rows.select("id", "src", "size", "place"))
    sources = source_targets(small.groupBy("src").agg(F.sum("size").alias("source_size")), weights, growth, cap).withColumn("_one", F.lit(1))
    sources = apportion(sources, ["_one"], ["src"], "target", F.round(F.sum("target").over(Window.partitionBy("_one")) / block)).drop("_one")
    # Powers of two, so that places are dealt evenly.
    cells = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("source_size") / cell_words, F.lit(1.0))))).cast("long")
    sources = materialize(sources.select("src", "source_size", "target", F.col("quota").alias("source_quota"), cells.alias("cells")))
    if sources.count() <= SMALL:
        sources = F.broadcast(sources)
    cell = small.filter("size > 0").join(sources, "src").groupBy("src", F.pmod("place", "cells").alias("cell")).agg(F.sum("size").alias("cell_words"), F.first("source_quota").alias("source_quota"))
    cell = apportion(cell, ["src"], ["cell"], "cell_words", F.col("source_quota"))
    # Blocks beyond a cell's room go to the next ones that have room.
    by_claim = Window.partitionBy("src").orderBy(F.desc("cell_words"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("_full", F.ceil(F.col("cell_words") * cap / block)).withColumn("_room", F.greatest(F.col("_full") - F.col("quota"), F.lit(0)))
    over = F.sum(F.greatest(F.col("quota") - F.col("_full"), F.lit(0))).over(Window.partitionBy("src"))
    more = F.least(F.greatest(over - F.coalesce(F.sum("_room").over(by_claim), F.lit(0)), F.lit(0)), F.col("_room"))
    cell = cell.withColumn("_blocks", F.least("quota", "_full") + more)
    cell = cell.select("src", "cell", "cell_words", F.least(F.col("_blocks") * block, F.col("cell_words") * cap).alias("cell_taken"))
    at = rows.join(sources, "src").withColumn("cell", F.pmod("place", "cells"))
    empty = at.filter("size = 0").select("_kept", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    at = at.filter("size > 0").join(cell, ["src", "cell"])
    ahead = Window.partitionBy("src", "cell").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    laps = F.floor(F.col("cell_taken") / F.col("cell_words"))
    rest = F.col("cell_taken") - laps * F.col("cell_words")
    taken = laps * F.col("size") + F.least(F.greatest(rest - F.col("_ahead"), F.lit(0)), F.col("size"))
    return at.select("_kept", "size", "source_size", "target", taken.cast("long").alias("taken")).unionByName(empty)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), growth: float = 1.5, cap: int = 2, block: int = BLOCK, cell_words: int = CELL_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken."""
    return _taken(docs, ["doc_id"], weights, growth, cap, block, cell_words, seed).select("_kept.doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), growth: float = 1.5, cap: int = 2, block: int = BLOCK, cell_words: int = CELL_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole document (0 to ``cap`` times)."""
    at = _taken(docs, docs.columns, weights, growth, cap, block, cell_words, seed).filter("size > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return at.filter(times > 0).select("_kept", F.explode(F.array_repeat(F.lit(0), times))).select("_kept.*")
