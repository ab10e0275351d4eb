"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from trialbook.llm import decontaminate, jaccard, language, media, mixing, passages, pseudonyms, repeats, sharding, tokens

#: Extra columns, some with names that the operators use themselves.
EXTRA = ("_id", "_copy", "_turn", "_found", "_kept", "_new", "_row", "_at", "_slot", "_hash", "kinds", "n_values", "held_out", "size", "place", "src", "set", "meeting", "row", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, copy int, kind string, target double, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = " ".join(f"word{k % 977} other{k}" for k in range(30_000))
ROWS = [
    (1, "the same text of several words that is here twice", "en", "a"),
    (2, "the same text of several words that is here twice", "en", None),
    (3, None, None, None),
    (4, "", "fr", "b"),
    (5, " \n\t ", None, "b"),
    (6, "1234 5678 !!", "de", "a"),
    (7, LONG, "en", "a"),
    (7, LONG, "en", "a"),
    (None, "a row without an id", "en", "c"),
    (None, None, None, None),
    (8, "short", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 0.5, "x", 1, "k", 2.0, *[f"my {c}" for c in EXTRA]) for i, t, la, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "several words that is here"), (2, None), (3, "tiny")], "item_id long, text string")


def untouched(df, but=()):
    """The extra columns hold what they held."""
    return all(r[c] == f"my {c}" for r in df.collect() for c in EXTRA if c not in but)


def key(r):
    return (r.doc_id is not None, r.doc_id or 0)


def test_language(docs, none):
    model = language.fit(docs, ~language.held_out())
    got = sorted(language.identify(docs, model).collect(), key=key)
    assert len(got) == len(ROWS)
    said = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (3, 4, 5, 6)) and said[1].lang_pred != "und"
    kept = language.recognized(docs, model, 0.0)
    assert kept.columns == docs.columns and untouched(kept) and kept.count() == 6
    assert language.recognized(none, None).count() == 0 and language.recognized(docs, None).count() == 0
    assert language.fit(none, ~language.held_out()) is None
    assert language.identify(none, None).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and untouched(mixed) and mixed.count() > 0
    assert mixing.mixed(none).count() == 0


def test_jaccard(docs, none):
    got = sorted(jaccard.join(docs).collect(), key=key)
    assert len(got) == len(ROWS)
    said = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert said[2] == (6, 1) and said[3] == (0, 3) and said[5] == (0, 5) and said[7][1] == 7 and said[8] == (1, 8)
    assert jaccard.join(none).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and untouched(kept) and jaccard.representatives(none).count() == 0
    assert sorted(key(r) for r in kept.collect()) == sorted(key(r) for r in docs.filter("doc_id is null or doc_id <> 2").dropDuplicates(["doc_id", "text"]).collect())


def test_repeats(docs, none):
    got = sorted(repeats.dedup(docs).collect(), key=key)
    assert len(got) == len(ROWS)
    both = [r for r in got if r.doc_id == 7]
    assert sorted(r.n_removed for r in both) == [0, len(LONG)]
    assert next(r for r in got if r.doc_id == 3).kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert repeats.dedup(none).count() == 0


def test_media(docs, none):
    got = media.media_columns(docs).collect()
    assert len(got) == len(ROWS)
    empty = [r for r in got if r.n_bytes == 0]
    assert len(empty) == 3 and all(r.payload_bytes == 64 and r.tail_crc32 == zlib.crc32(bytes(64)) for r in empty)
    assert media.media_columns(none).count() == 0


def test_leaks(spark, docs, none, items):
    got = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1)]
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 2 and untouched(clean)
    assert decontaminate.clean(none, items).count() == 0


def test_shards(docs, none):
    got = sharding.shard(docs, limit=500).collect()
    assert len(got) == len(ROWS)
    assert all(r.shard_bytes <= 500 or r.oversize for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 2  # equal rows overflow to pages
    assert sharding.shard(none).count() == 0
    whole = sharding.shard(docs, keep=docs.columns)
    assert set(docs.columns) <= set(whole.columns) and untouched(whole) and whole.count() == len(ROWS)
    assert sharding.laid_out(sharding.shard(none, keep=none.columns)).count() == 0


def test_pseudonyms(docs, none):
    out = pseudonyms.pseudonymize(docs, "k")
    assert out.count() == len(ROWS) and set(docs.columns) <= set(out.columns) and untouched(out, ("kinds", "n_values"))
    assert [r.text for r in out.filter("doc_id = 3").collect()] == [None]
    assert pseudonyms.pseudonymize(none, "k").count() == 0


def test_passages(docs, none):
    assert passages.repeated(docs).count() == 0  # rows of one doc_id are one document
    moved = docs.filter("doc_id = 7").limit(1).withColumn("doc_id", F.lit(9).cast("long"))
    got = passages.repeated(docs.unionByName(moved)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(9, 7)} and max(r.n_words for r in got) == 60_000
    assert passages.repeated(none).count() == 0


def test_tokens(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(tokens.token_files(docs, path).collect(), key=lambda r: r.start)
    assert len(got) == len(ROWS) and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [1, 1]
    assert tokens.token_files(none, path).count() == 0


def test_materialized_frames_keep_no_exchange(spark):
    """The files of exchanges go when a checkpoint replaces them, and the frame itself can run again."""
    import time

    from trialbook.llm.common import materialize

    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles
    before = {files().apply(k).getName() for k in range(files().size())}
    df = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count()
    found = [materialize(df) for _ in range(2)]
    until = time.time() + 20
    while time.time() < until and {files().apply(k).getName() for k in range(files().size())} - before:
        time.sleep(0.1)
    assert not {files().apply(k).getName() for k in range(files().size())} - before
    assert df.count() == 7 and all(sorted(f.collect()) == sorted(df.collect()) for f in found)


def test_passages_move_in_parts_and_leave_few_files(spark):
    """Rows come back from parts as they were, a bucket at a time; what steps hand on goes when the next one has it."""
    import os

    import numpy as np
    import pyarrow as pa

    from trialbook.llm import passages

    rng = np.random.default_rng(1)
    seed, doc = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-5, 2**40, 5000)
    beside = pa.array([b"x" * int(k) for k in rng.integers(0, 9, 5000)], pa.binary())
    rows = pa.record_batch([pa.array(seed), pa.array(doc), beside], names=["seed", "doc", "beside"])
    parts = pa.Table.from_batches(list(passages._in_parts(((passages._bucket(b.column(0).to_numpy(), 16), b) for b in (rows[:3000], rows[3000:])), 2000)))
    assert parts.num_rows <= 32
    found = list(passages._whole_buckets(parts.sort_by("bucket").to_batches(max_chunksize=3), ["seed", "doc"], "beside"))
    assert len(found) == 16 and all((np.diff(b.column(0).to_numpy()) >= 0).all() for b in found)
    back = pa.Table.from_batches(found)
    assert sorted(zip(*(back.column(c).to_pylist() for c in range(3)))) == sorted(zip(seed.tolist(), doc.tolist(), beside.to_pylist()))

    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    docs = spark.createDataFrame([(k, " ".join(words[:200] + [f"v{k}"] + words[200:])) for k in range(6)], "doc_id long, text string")
    folder = spark._jvm.java.net.URI(spark.sparkContext._jsc.sc().getCheckpointDir().get()).getPath() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    before = set(os.listdir(folder)) if folder else set()
    result = passages.repeated(docs)
    folder = spark._jvm.java.net.URI(spark.sparkContext._jsc.sc().getCheckpointDir().get()).getPath()
    assert len(set(os.listdir(folder)) - before) == 4  # chains, passages, further matches, their chains
    assert {r.doc_id for r in result.collect()} == {1, 2, 3, 4, 5}
