"""The pipeline's stages against brute-force decisions."""

import re

from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from trialbook.llm import common, decontaminate, jaccard, language


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    at, ids = docs, [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA).checkpoint()
        assert at.columns == docs.columns
        ids.append({r.doc_id for r in at.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    # Every text with a letter is in one of the languages here.
    assert ids[1] == {i for i, r in rows.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    texts = [rows[i].text for i in ids[2]]
    assert len(set(texts)) == len(texts)
    assert ids[2] - ids[3] == {i for i in ids[2] if any(x in rows[i].text for x in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
    assert last.count() == at.count() and "shard" in last.columns


def test_whole_run_is_stable(spark):
    a = sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "shard").collect())
    assert a == sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "shard").collect())


def test_language_stage_keeps_every_lettered_text(spark):
    """A larger table, with documents of one word or letter and of mixed languages."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = [r.text for r in docs.filter("text is not null").orderBy("doc_id").select("text").collect()]
    words = sorted({w for t in texts for w in t.split()})[::40]
    mixed = [" ".join(t[:40] for t in texts[k : k + 8]) for k in range(0, 400, 8)]
    short = ["A.", "De.", "Re.", "Edrere.", "Mentmentan.", "x", "\u00df", "7", "...", ""]
    extra = spark.createDataFrame([(10**9 + i, t, None, "short", len(t)) for i, t in enumerate(words + mixed + short)], docs.schema)
    rows = docs.unionByName(extra)
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, rows, DATA).select("doc_id").collect()}
    assert got == {r.doc_id for r in rows.collect() if r.text and re.search(r"[^\W\d_]", r.text)}


def test_stages_on_edge_rows(spark):
    """Nulls, empty texts, repeated rows, rows without id and clashing columns, then an empty table, through all stages."""
    text = "a text of many plain words that goes on for a while and then ends"
    rows = [(1, text, "en", "a", "x"), (2, text, "en", "b", "x"), (3, None, None, None, None), (4, "", "fr", "b", "y"), (5, "1234", None, "a", "y")]
    rows += [(6, f"another one with {k} in it, but the same id", "de", None, "z") for k in range(2)] + [(None, "no id here at all", "en", "c", "z")] * 3 + [(None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, _id string"
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.through(spark, docs, DATA)
    got = out.collect()
    assert out.columns[:5] == docs.columns and {r.doc_id for r in got} <= {1, 6, None} and 1 <= len(got) <= 6
    assert all(r._id == {1: "x", 6: "z", None: "z"}[r.doc_id] and r.shard_bytes <= 1 << 20 for r in got)
    assert corpus_pipeline.through(spark, docs.limit(0), DATA).count() == 0


def test_mix_of_the_pipeline_meets_its_targets(spark):
    """The mixing stage on what the stages before it keep: each source's words come near its target."""
    from trialbook.llm import mixing

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA).checkpoint()
    rows = {r.doc_id: r for r in docs.collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want, got, most = {}, {}, {}
    for r in mixing.mix(docs).collect():
        want[rows[r.doc_id].source] = r.target
        most[rows[r.doc_id].source] = max(most.get(rows[r.doc_id].source, 0), r.size)
    for r in corpus_pipeline.source_mix(spark, docs, DATA).collect():
        got[r.source] = got.get(r.source, 0) + words(r.text)
    assert all(abs(got.get(s, 0) - want[s]) <= most[s] for s in want)


def test_shards_are_laid_out(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = corpus_pipeline.shards(spark, docs, DATA).collect()
    total = {}
    for r in out:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
    assert len(total) > 2 and all(r.shard_bytes == total[r.shard] <= 1 << 20 for r in out)


def test_stages_send_small_batches(spark, monkeypatch):
    """Executors keep what batches took: those of 8 MB of text in one partition are bounded, and all rows come through."""
    texts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(230)), lambda i: F.hex(F.xxhash64("id", i))), " ")
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), texts.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    most, inner = 2 * corpus_pipeline.BATCH, common.slices

    def checked(batches, *args, **named):
        def seen():
            for b in batches:
                if b.column("text").nbytes > most:
                    raise ValueError(f"a batch of {b.column('text').nbytes} bytes")
                yield b

        return inner(seen(), *args, **named)

    for module in (decontaminate, jaccard, language):
        monkeypatch.setattr(module, "slices", checked)
    own = spark.conf.get(corpus_pipeline.BATCH_BYTES)
    out = corpus_pipeline.through(spark, docs, DATA)
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(2000))
    assert spark.conf.get(corpus_pipeline.BATCH_BYTES) == own


def test_a_smaller_limit_of_batches_stays(spark):
    own = spark.conf.get(corpus_pipeline.BATCH_BYTES)
    try:
        spark.conf.set(corpus_pipeline.BATCH_BYTES, "1000b")
        corpus_pipeline.language_id(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
        assert spark.conf.get(corpus_pipeline.BATCH_BYTES) in ("1000", "1000b")
    finally:
        spark.conf.set(corpus_pipeline.BATCH_BYTES, own)


def test_fit_starts_no_workers_for_its_counts(spark, monkeypatch):
    """A list handed to createDataFrame runs through Python workers of its own kind, which stay on the executors."""

    def refused(*args, **named):
        raise AssertionError("rows of the driver pass through Python workers")

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert language.fit(docs, ~language.held_out()).languages == sorted(r.lang for r in docs.filter("lang is not null").select("lang").distinct().collect())
    assert language.fit(docs.limit(0), ~language.held_out()) is None


def test_language_stage_identifies(spark):
    """Texts without a lang get the one that op1 predicts, given ones stay, and without any lang all lettered texts come through."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    rows = {r.doc_id: r for r in some.collect()}
    said = {r.doc_id: r.lang_pred for r in language.identify(some, language.fit(some, ~language.held_out())).collect()}
    letters = {i for i, r in rows.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    out = corpus_pipeline.language_id(spark, some, DATA)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == letters and sum(rows[i].lang is None for i in got) > 100
    assert all(r == (rows[i] if rows[i].lang is not None else type(r)(*[said[i] if c == "lang" else rows[i][c] for c in docs.columns])) for i, r in got.items())
    bare = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), DATA).collect()
    assert {r.doc_id for r in bare} == letters and all(r.lang is None for r in bare)
    # A language that is called as texts without a letter are.
    same = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(language.UNKNOWN)), DATA)
    assert {r.doc_id for r in same.collect()} == letters
