"""The operators against brute-force versions on small corpora."""

import datetime
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from trialbook.llm import decontaminate, jaccard, language, mixing, passages, pseudonyms, queries, repeats, sharding, tokens
from trialbook.llm.common import WORD

WORDS = re.compile(WORD)


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def noisy(seed=3):
    """Near copies at many distances, shared lines, periodic text."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    line = " ".join(rnd.choice(vocabulary) for _ in range(14))
    texts = []
    for size in (3, 5, 6, 9, 24, 30, 60, 150, 400):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
            one = [rnd.choice(vocabulary) if rnd.random() < share else w for w in base]
            if rnd.random() < 0.3:
                one.insert(rnd.randint(0, len(one)), line)
            texts.append(" ".join(one))
    texts += ["ab" * 200, "x" * 500, "ab" * 130 + "c" + "ab" * 90, line, line + "\n" + line]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(spark, seed):
    rows = noisy(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 2)
    monkeypatch.setattr(jaccard, "SIG_ROWS", 2)
    rows = noisy(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def brute_repeats(rows, span=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen:
                gone[s : s + span] = True
            seen.add(w)
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 6])
def test_repeats(spark, seed):
    rows = noisy(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("hot", [1, 2, 5])
def test_repeats_with_hot_minimizers(spark, hot):
    rows = noisy(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(frame(spark, rows), hot=hot).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_the_table(spark, table):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_maximal_repeats(spark, DATA).collect()}
    assert got == brute_repeats([(i, r.text) for i, r in table.items()])


def test_maximal_repeats_keep_all_occurrences():
    parts = [b"zz" + b"q" * 3 + bytes(range(65, 91)) * 5, b"y" + bytes(range(65, 91)) * 5, b"w" + bytes(range(65, 91)) * 5 + b"v"]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    segment, inner, length = repeats.maximal_repeats(raw, np.append(0, np.cumsum([len(p) for p in parts])), 100)
    assert {(int(s), int(i), int(n)) for s, i, n in zip(segment, inner, length)} >= {(1, 1, 130), (2, 1, 130)}


def test_language_accuracy(spark, table):
    got = queries.op1_language_id(spark, DATA).collect()
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == table[r.doc_id].lang for r in got if r.held_out and table[r.doc_id].lang]
    assert np.mean(right) >= 0.97


def test_presence_is_piecewise():
    text = "Bär und Öl " * 20
    whole = language.presence(pa.array([text, "x", None]))
    old, language.PIECE = language.PIECE, 7
    try:
        assert (language.presence(pa.array([text, "x", None])) == whole).all()
    finally:
        language.PIECE = old


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(spark, table):
    got = queries.op2_source_mix(spark, DATA).collect()
    size = {i: len(WORDS.findall(r.text or "")) for i, r in table.items()}
    sources, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sources[table[r.doc_id].source] += r.size
        taken[table[r.doc_id].source] += r.taken
    want = brute_targets(sources)
    for r in got:
        s = table[r.doc_id].source
        assert r.source_size == sources[s] and abs(r.target - want[s]) < 1e-3
    assert all(abs(taken[s] - want[s]) <= max(8, 0.01 * want[s]) for s in want)
    again = {r.doc_id: r.taken for r in queries.op2_source_mix(spark, DATA).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_apportionment_is_sainte_lague(spark):
    claims = {"a": 53, "b": 24, "c": 23, "d": 1, "e": 0}
    seats = 17
    got = {r.key: r.quota for r in mixing.apportion(spark.createDataFrame([(1, k, float(v)) for k, v in claims.items()], "g int, key string, claim double"), ["g"], ["key"], "claim", mixing.F.lit(seats)).collect()}
    want = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max(sorted(claims), key=lambda k: claims[k] / (2 * want[k] + 1))
        want[best] += 1
    assert got == want


def test_shards(spark, table):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sharding.shard(docs, limit=40_000).collect()
    total = defaultdict(int)
    for r in got:
        assert r.n_bytes == len((table[r.doc_id].text or "").encode()) and r.depth == len(r.shard)
        total[r.shard] += r.n_bytes
    assert all(r.shard_bytes == total[r.shard] for r in got) and sum(total.values()) == sum(r.n_bytes for r in got)
    assert all(r.shard_bytes <= 40_000 or r.oversize and len([x for x in got if x.shard == r.shard]) == 1 for r in got)
    shards = set(total)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    # Only oversized buckets were split.
    for s in shards:
        assert sum(v for k, v in total.items() if k.startswith(s[:-1])) > 40_000


def test_leaks(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, say(rnd.randint(15, 50))) for k in range(12)]
    rows, want = [], set()
    for i in range(60):
        k, text = i % 12, say(80)
        _, item = items[k]
        if i < 36:
            edits = int(0.08 * len(item)) if i >= 24 else i // 12 * 2
            edits = min(edits, (len(item) - decontaminate.Q) // decontaminate.Q)
            chars = list(item.upper() if i % 2 else item)
            for at in rnd.sample(range(len(chars)), edits):
                chars[at] = "#"
            text = say(rnd.randint(0, 30)) + " " + "".join(chars).replace(" ", "  \n") + " " + say(20)
            want.add((i, k))
        rows.append((i, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), benchmark).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), benchmark).collect()} == set(range(36, 60))


def test_banded_alignment_is_the_edit_distance():
    rnd = random.Random(2)
    for _ in range(60):
        item = [rnd.choice(b"abc") for _ in range(rnd.randint(12, 25))]
        text = [rnd.choice(b"abc") for _ in range(rnd.randint(0, 6))] + [c for c in item if rnd.random() > 0.08] + [rnd.choice(b"abc") for _ in range(4)]
        row = [0] * (len(text) + 1)
        for c in item:
            new = [row[0] + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        k = 6
        got = decontaminate.aligned(np.array(item, np.uint8), np.array(text, np.uint8), -8, 40, k)
        assert (got is None and min(row) > k) or got[2] == min(row)


def test_luhn_and_formats(spark):
    text = "card 4539 1488 0343 6467, bad 4539148803436468, call +1 (743) 555-3824 or mail ñez.34@mail7.example.com from 10.0.0.1 not 10.0.0.256 on 2024-02-29 (2023-02-29) ssn 219-09-9999 666-09-9999 v1.2.3.4.5"
    rows = [(1, text), (2, "again 4539148803436467 and 10.0.0.1"), (3, "nothing here")]
    out = {r.doc_id: r for r in pseudonyms.pseudonymize(frame(spark, rows), "secret").collect()}
    a, b = out[1].text, out[2].text
    assert out[1].kinds.asDict() == {"card": 1, "ssn": 1, "date": 1, "phone": 1, "ip": 1, "email": 1} and out[3].text == "nothing here"
    for gone in ("4539 1488 0343 6467", "555-3824", "ñez.34@", "10.0.0.1 ", "2024-02-29", "219-09-9999"):
        assert gone not in a
    for kept in ("4539148803436468", "10.0.0.256", "(2023-02-29)", "666-09-9999", "v1.2.3.4.5", "@mail7.example.com"):
        assert kept in a
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", a)[1]
    digits = [int(c) for c in card.replace(" ", "")][::-1]
    assert sum(digits[0::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    assert card.replace(" ", "") in b and re.search(r"from (\S+) not", a)[1] in b
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or", a)
    other = pseudonyms.pseudonymize(frame(spark, rows), "another").filter("doc_id = 2").first().text
    assert other != b


def test_feistel_permutes(spark):
    x, y = pseudonyms.feistel(mixing.F.floor(mixing.F.col("id") / 7), mixing.F.col("id") % 7, mixing.F.lit(9), mixing.F.lit(7), "t", "k")
    got = [(r.x, r.y) for r in spark.range(63).select(x.alias("x"), y.alias("y")).collect()]
    assert len(set(got)) == 63 and all(0 <= a < 9 and 0 <= b < 7 for a, b in got) and got != sorted(got)


@pytest.mark.parametrize("crowd", [2, 16])
def test_passages(spark, crowd):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(900)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = say(70)
    line = say(12)
    rows, planted = [], set()
    for i in range(60):
        text = say(rnd.randint(60, 200))
        if i % 3 == 0:
            one = [rnd.choice(vocabulary) if rnd.random() < 0.05 * (i % 2) else w for w in shared]
            if i % 4 == 0:
                del one[35]
            text[20:20] = one
            planted.add(i)
        if i % 5 == 0:
            text[5:5] = line
        rows.append((i, " ".join(text)))
    got = passages.repeated(frame(spark, rows).repartition(5), crowd=crowd).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == planted
    assert all(60 <= r.n_words <= 80 and r.other_id < r.doc_id for r in got)


def test_exact_repeats_are_found(spark, table):
    first, need = {}, set()
    for i in sorted(table):
        w = WORDS.findall((table[i].text or "").lower())
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        if any(first.get(g, i) != i for g in own):
            need.add(i)
        for g in own:
            first.setdefault(g, i)
    assert need <= {r.doc_id for r in queries.op9_fuzzy_passages(spark, DATA).collect()}


def test_bit_packing_round_trip():
    rnd = np.random.default_rng(1)
    for width in (1, 3, 8, 11, 16, 17, 31, 32):
        ids = rnd.integers(0, 1 << width, 1003, dtype=np.uint64).astype(np.uint32)
        assert (tokens.unpack(tokens.pack(ids, width), width, len(ids)) == ids).all()
        assert len(tokens.pack(ids, width)) == -(-len(ids) * width // 8)


def test_token_ids(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(queries.op10_packed_ids(spark, DATA).collect(), key=lambda r: r.doc_id):
        ids = [*plain.encode(table[r.doc_id].text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_texts_encode_alike():
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    bits = ["a", "don't", "'s", ".", " ", ",", "\n", "é", "1", "3.5", "  ", "\t", "\xa0", "<|endoftext|>", "..", "x²", ".\n", "\x00", "字", "A.b.c", "\x1c", "́"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(2000)] + ["", None, " "]
    ids, counts = encoder.ids(pa.array(texts, pa.string()))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_media(spark, table):
    for r in queries.op5_media_columns(spark, DATA).collect():
        b = (table[r.doc_id].text or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.width * r.height == r.payload_bytes


def test_media_headers(spark):
    from trialbook.llm import media
    from trialbook.llm.common import scratch_dir

    uri = scratch_dir(spark, "media-test")
    index = media.store(frame(spark, [(1, "a" * 100), (2, "b"), (3, "b")]), uri)
    got = {r.doc_id: r for r in media.with_metadata(media.in_order(index), uri).collect()}
    assert (got[1].width, got[1].height) == (64, 2) and got[2].height == 1
    assert (got[2].shard, got[2].offset) == (got[3].shard, got[3].offset) or got[2].digest == got[3].digest


def test_jaccard_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = set(con.sql(f"select doc_id, n_shingles, component_id from ({queries.oracle_sql()['op3_ngram_jaccard']})").fetchall())
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, DATA).collect()} == want


@pytest.mark.parametrize("step,small", [(2, 1 << 16), (3, 0)])
def test_shards_in_rounds(spark, table, monkeypatch, step, small):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    once = {(r.doc_id, r.shard, r.shard_bytes) for r in sharding.shard(docs, limit=60_000).collect()}
    monkeypatch.setattr(sharding, "STEP", step)
    monkeypatch.setattr(sharding, "SMALL", small)
    assert {(r.doc_id, r.shard, r.shard_bytes) for r in sharding.shard(docs, limit=60_000).collect()} == once


def test_composed_passages(spark):
    """Blocks of lines each of which came first in another document, against all earlier stretches of 52 words."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(2000)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    lines = [say(n) for n in (30, 30, 20, 20, 20, 15, 15, 15, 15)]
    parts = [[0], [1], [2, 3], [3, 4], [5, 6], [6, 7], [7, 8]] + [[0, 1], [2, 3, 4], [5, 6, 7, 8]] * 3
    rows = [(k, say(40) + [w for i in part for w in lines[i]] + say(40)) for k, part in enumerate(parts)]
    held, need = {}, set()
    for k, text in rows:
        own = {tuple(text[i : i + 52]) for i in range(len(text) - 51)}
        if own & held.keys():
            need.add(k)
        held.update(dict.fromkeys(own - held.keys(), k))
    assert need == set(range(10, 16))
    for crowd in (2, 16):
        got = passages.repeated(frame(spark, [(k, " ".join(text)) for k, text in rows]).repartition(3), crowd=crowd).collect()
        assert {(r.doc_id, r.other_id) for r in got} == {(k, 7 + (k - 7) % 3) for k in need}
        assert all(58 <= r.n_words <= 62 and r.n_agree >= 58 for r in got)


def test_passages_of_80_percent(spark):
    """Recall of 60-word passages at 80 to 90 % agreement, edits even or at random."""
    rnd = random.Random(12)
    fresh = iter(range(10**9))
    say = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    rows, need = [], {}

    def copied(words, edits):
        if isinstance(edits, int):
            return [f"e{next(fresh)}" if i % edits == edits - 1 else w for i, w in enumerate(words)], edits
        out, n = [], 0
        for w in words:
            kind = rnd.randrange(3) if rnd.random() < edits else None
            n += kind is not None
            out += [w] if kind is None else [[f"e{next(fresh)}"], [], [w, f"e{next(fresh)}"]][kind]
        return out, n

    for edits in (5, 6, 8, 0.1, 0.15):
        for _ in range(40):
            words = say(60)
            other, n = copied(words, edits)
            i = len(rows)
            rows += [(i, say(30) + words + say(30)), (i + 1, say(50) + other + say(20))]
            if isinstance(edits, int) or n <= 9:
                need[i + 1] = edits
    got = passages.repeated(frame(spark, [(i, " ".join(w)) for i, w in rows]).repartition(3)).collect()
    assert all(r.other_id == r.doc_id - 1 and r.n_words >= 45 and r.n_agree >= 0.8 * max(r.n_words, r.other_words) for r in got)
    assert set(need) <= {r.doc_id for r in got}


@pytest.mark.parametrize("every", [5, 8])
def test_edited_passages_of_common_lines(spark, every):
    """An edited passage each line of which came first in other documents, and one that only agrees with a later copy, are found."""
    rnd = random.Random(3)
    fresh = iter(range(10**9))
    say = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    edited = lambda words, at: [f"e{next(fresh)}" if i % every == at else w for i, w in enumerate(words)]
    rows, need = [], set()

    def add(*parts):
        rows.append((len(rows), " ".join(say(rnd.randint(10, 30)) + [w for p in parts for w in p] + say(20))))
        return len(rows) - 1

    for _ in range(15):
        lines = [say(10) for _ in range(6)]
        for line in lines * 3:
            add(line)
        a = add(*lines)
        need.add((add(edited([w for x in lines for w in x], every - 1)), a))
    for _ in range(15):
        words = say(60)
        add(edited(words, 0))
        b = add(edited(edited(words, 0), 2))
        need.add((add(edited(rows[b][1].split()[-80:-20], 4)), b))
    for crowd in (2, 16):
        got = passages.repeated(frame(spark, rows).repartition(3), crowd=crowd).collect()
        assert need <= {(r.doc_id, r.other_id) for r in got}
        assert all(r.n_words >= 45 and r.n_agree >= 0.8 * max(r.n_words, r.other_words) for r in got)


def test_common_lines_make_no_pairs(spark, monkeypatch):
    """Documents that share a line too short for a passage don't meet each other; one that repeats more of an earlier one is found."""
    fresh = iter(range(10**9))
    say = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    line = say(28)
    rows = [(k, " ".join(say(60) + line + say(60))) for k in range(80)]
    words = rows[50][1].split()[40:100]
    rows.append((80, " ".join(say(30) + [f"e{i}" if i % 8 == 7 else w for i, w in enumerate(words)] + say(30))))
    made, passages_of = [], passages._passages
    monkeypatch.setattr(passages, "_passages", lambda known, matches, *rest: made.append(matches.count()) or passages_of(known, matches, *rest))
    got = passages.repeated(frame(spark, rows).repartition(3)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(80, 50)}
    assert made[1] <= 40  # not 80 * 79 / 2 for every two seeds of the line


def test_alignment_columns():
    """Ends with a gap, gaps between runs, and a passage inside a longer chain of low agreement."""
    a = np.arange(100, 180, dtype=np.uint32)
    b = np.concatenate([a[:3], a[4:60], [7, 8], a[60:]]).astype(np.uint32)
    x, y, columns = passages.align(a, b, [(10, 9, 50), (60, 61, 10)])
    assert (x, y) == (0, 0) and (columns == passages.AGREE).sum() == 79
    assert (columns == passages.ONLY_A).sum() == 1 and (columns == passages.ONLY_B).sum() == 2
    mixed = np.array([0] * 50 + [1, 1, 0] * 20, np.int8)
    ((i, j),) = passages.spans(mixed, 45, 0.8)
    assert i == 0 and 50 <= j <= 75 and (mixed[i:j] == 0).sum() >= 0.8 * (j - i)


def test_neighbours_of_values(spark):
    """Cards beside other numbers, timestamps, dates with the year last and national phones."""
    card = "4539 1488 0343 6467"
    texts = [f"pay {card} 12/27 ok", "4539148803436467 2 items", f"12 {card} 345", f"{card} 10.0.0.1", f"{card} 2024-02-29", f"{card} {card}", f"nr {card} 2nd"]
    texts += ["at 2024-02-29T10:00:00Z", "am 29.02.2024.", "on 02/29/2024", "on 29/02/2024", "1/2/2024", "(555) 123-4567", "call 555-123-4567, 555.123.4567", "29.02.2023 13/13/2024 99.99.2024"]
    out = {r.doc_id: r for r in pseudonyms.pseudonymize(frame(spark, list(enumerate(texts))), "secret").collect()}
    new = re.search(r"pay (.{19}) 12/27 ok", out[0].text)[1]
    assert new != card and out[1].text == new.replace(" ", "") + " 2 items" and out[2].text == f"12 {new} 345"
    assert out[3].text.startswith(new) and out[3].kinds.ip == 1 and out[4].text.startswith(new) and out[4].kinds.date == 1
    assert out[5].text == f"{new} {new}" and out[5].kinds.card == 2 and out[6].text == f"nr {new} 2nd"
    assert re.fullmatch(r"at \d{4}-\d\d-\d\dT10:00:00Z", out[7].text) and re.fullmatch(r"am \d\d\.\d\d\.\d{4}\.", out[8].text)
    assert int(re.fullmatch(r"on (\d\d)/\d\d/\d{4}", out[9].text)[1]) <= 12 < int(re.fullmatch(r"on (\d\d)/\d\d/\d{4}", out[10].text)[1])
    assert all(out[i].kinds.date == 1 and out[i].text != texts[i] for i in range(7, 12))
    assert out[12].kinds.phone == 1 and out[13].kinds.phone == 2 and "123-4567" not in out[12].text + out[13].text
    assert out[14].text == texts[14] and out[14].n_values == 0
    days = [f"{d:02}/{m:02}/{y}" for y in (1800, 1900, 2000, 2199) for m in range(1, 13) for d in range(13, 29)]
    got = [r.text for r in pseudonyms.pseudonymize(frame(spark, list(enumerate(days))), "secret").collect()]
    assert len(set(got)) == len(days) and all(int(g[:2]) > 12 and datetime.date(int(g[6:]), int(g[3:5]), int(g[:2])) for g in got)


def test_passages_in_periodic_text(spark):
    """Texts that repeat themselves at once are tied place by place."""
    rnd = random.Random(4)
    say = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    for period in (1, 2, 5):
        rule = (["==", "--", "**", "++", "~~"][:period] * 100)[:90]
        rows = [(k, " ".join(say(30) + rule + say(30))) for k in range(3)] + [(3, " ".join(say(100)))]
        got = passages.repeated(frame(spark, rows)).collect()
        assert {(r.doc_id, r.other_id) for r in got} == {(1, 0), (2, 0)} and all(88 <= r.n_words <= 92 for r in got)


def test_passages_over_blocks(spark):
    """Long repeats cross block edges; a doc_id with two texts is compared with each."""
    words = [f"w{k}" for k in range(3 * passages.BLOCK)]
    rows = [(1, " ".join(words)), (2, "x y " + " ".join(words[100:700])), (3, "only this"), (3, " ".join(words[:300]))]
    got = {(r.doc_id, r.other_id, r.start_word, r.n_words, r.other_start, r.n_agree) for r in passages.repeated(frame(spark, rows)).collect()}
    assert got == {(2, 1, 2, 600, 100, 600), (3, 1, 0, 300, 0, 300)}


def test_files_are_read_back_in_many_tasks(spark, monkeypatch):
    """Tasks grow with the bytes of files and members, a doc_id or member that many rows share included."""
    import public_tokenizers

    from trialbook.llm import media
    from trialbook.llm.common import scratch_dir

    rows = frame(spark, [(None if k < 30 else 7, "the same words again " * 40) for k in range(60)])
    monkeypatch.setattr(tokens, "FILE", 4000)
    monkeypatch.setattr(media, "TASK", 300)
    uri = scratch_dir(spark, "tokens-test")
    files = tokens.write(rows, public_tokenizers.path("byte_bpe_50k.json"), uri)
    assert files.count() > 6
    got = sorted(tokens.read(files, uri).collect(), key=lambda r: r.start)
    assert tokens.read(files, uri).rdd.getNumPartitions() == files.count()
    assert [r.doc_id for r in got] == [None] * 30 + [7] * 30 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    uri = scratch_dir(spark, "media-test")
    assert media.in_order(media.store(rows, uri)).rdd.getNumPartitions() > 10


def test_other_tokenizers_encode_whole():
    """A tokenizer with another pre-tokenizer is not given pieces."""
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello there, you.", "  two  blanks ", "", None, "A.b.c don't\n"]
    ids, counts = encoder.ids(pa.array(texts, pa.string()))
    assert not encoder.apart
    assert [g.tolist() for g in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_leaks_in_periodic_text():
    """Texts and items that repeat themselves: passages are counted without overlap, in time that grows with the text."""
    import time

    def found(text, items):
        return {i: (n, e) for _, rows in decontaminate.scan(pa.record_batch({"text": [text]}), decontaminate.Items(list(range(len(items))), items, 0.08)) for i, n, e in rows}

    began = time.monotonic()
    assert found("=" * 1_000_000, ["=" * 300, "=" * 20_000]) == {0: (3333, 0), 1: (50, 0)}
    rule = "-" * 78 + "\n"
    assert found(rule * 2000, [rule * 4, "-" * 100])[0] == (500, 0)
    assert time.monotonic() - began < 60
    assert found("yes. a Yes yesterday, no-yes", ["yes", "no", "ye", " ", ""]) == {0: (3, 0), 1: (1, 0)}


def test_leaks_in_many_blocks(spark, monkeypatch):
    """Items in several files, documents in several groups."""
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(k, say(20)) for k in range(20)]
    rows = [(i, say(10) + " " + (items[i % 20][1] if i % 3 else "") + " " + say(10)) for i in range(60)]
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    monkeypatch.setattr(decontaminate, "GROUP", 1000)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.stored(benchmark)[1]) > 3
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), benchmark).collect()}
    assert got == {(i, i % 20) for i in range(60) if i % 3}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), benchmark).collect()} == set(range(0, 60, 3))


def test_shards_of_hot_ids(spark):
    """A third of the rows without id, some of them equal: they part on their texts and places, and no shard passes the limit."""
    rows = [(None if k % 3 == 0 else k, f"text {k if k % 2 else 0} " * 20) for k in range(300)]
    got = sharding.shard(frame(spark, rows), limit=1000).collect()
    total = defaultdict(int)
    for r in got:
        total[r.shard] += r.n_bytes
    assert len(got) == 300 and all(r.shard_bytes == total[r.shard] <= 1000 for r in got)
    out = sharding.laid_out(sharding.shard(frame(spark, rows), limit=1000), part=5000)
    at = [{r.shard for r in rows} for rows in out.rdd.glom().collect()]
    assert len(at) > 5 and sum(map(len, at)) == len(total)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_phones_are_linked_however_grouped(spark):
    texts = ["+17435553824", "+1 743 555 3824", "+1-743-555-3824", "743-555-3824", "+442071234567", "+44 2071 234567", "+420 601 123 456", "+420601123456"]
    out = [r.text for r in pseudonyms.pseudonymize(frame(spark, list(enumerate(texts))), "secret").orderBy("doc_id").collect()]
    bare = [re.sub(r"\D", "", t) for t in out]
    assert bare[0] == bare[1] == bare[2] == "1" + bare[3] and bare[0] != "17435553824" and bare[4] == bare[5] and bare[6] == bare[7]
    assert [re.sub(r"\d", "0", t) for t in out] == [re.sub(r"\d", "0", t) for t in texts]
    assert bare[0][0] == "1" and bare[4][:2] == "44" and bare[6][:3] == "420"


@pytest.mark.parametrize("small", [1 << 16, 0])
def test_mixed_counts_every_row(spark, monkeypatch, small):
    """Rows without id, and of one id, are documents of their own, whether or not the sources are sent to every task."""
    monkeypatch.setattr(mixing, "SMALL", small)
    rows = [(None if k % 2 else 5, " ".join(f"w{k}" for _ in range(100)), "a") for k in range(40)] + [(k, "x y z " * 50, "b") for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs)
    want = sum(r.target for r in taken.select("source_size", "target").distinct().collect())
    got = sum(len(r.text.split()) for r in mixing.mixed(docs).collect())
    assert abs(sum(r.taken for r in taken.collect()) - want) <= 16 and abs(got - want) <= 300


def test_jaccard_groups_that_centres_leave_open(spark, monkeypatch):
    """Sets that share keys with a centre they are not similar to, in large and small components."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 3)
    monkeypatch.setattr(jaccard, "SIG_ROWS", 3)
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rnd.choice((0, 2, 5, 8, 11, 14, 25))):
            at = rnd.randrange(len(words))
            words[at] = f"e{k}-{at}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_maximal_groups_are_all_maximal_repeats():
    """Against all substrings: every class of equal substrings that no single byte extends, with all its occurrences."""
    rnd = random.Random(6)
    for _ in range(60):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(3, 14))) for _ in range(rnd.randint(2, 5))]
        parts = list(dict.fromkeys(parts))
        span, places = 3, defaultdict(list)
        for k, p in enumerate(parts):
            for i in range(len(p)):
                for j in range(i + span, len(p) + 1):
                    places[p[i:j]].append((k, i))
        ends = lambda k, i: object() if i < 0 or i >= len(parts[k]) else parts[k][i]
        want = {w: sorted(at) for w, at in places.items() if len(at) > 1 and len({ends(k, i - 1) for k, i in at}) > 1 and len({ends(k, i + len(w)) for k, i in at}) > 1}
        raw = np.frombuffer(b"".join(parts), np.uint8)
        found = repeats.maximal_groups(raw, np.append(0, np.cumsum([len(p) for p in parts])), span)
        got = {parts[m[0][0]][m[0][1] : m[0][1] + n]: sorted(m) for n, m in found}
        assert got == want and len(found) == len(want)


def test_repeat_groups_hold_all_occurrences(spark):
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefghijklm") for _ in range(400))
    rows = [(k, f"{'xyz'[k] * 5}{passage[: 400 - 90 * k]}{'uvw'[k] * 3}") for k in range(3)] + [(3, "nothing here")]
    got = repeats.repeat_groups(frame(spark, rows)).collect()
    text = dict(rows)
    by_group = defaultdict(list)
    for r in got:
        by_group[r.group].append(r)
    for members in by_group.values():
        assert len({text[r.doc_id][r.start : r.start + r.length] for r in members}) == 1 and len(members) > 1 and members[0].length >= 100
    covered = {r.doc_id: set() for r in got}
    for r in got:
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert {k: len(v) for k, v in covered.items()} == {0: 310, 1: 310, 2: 220}


@pytest.mark.parametrize("loose", [False, True])
def test_alignments_are_filled_together(monkeypatch, loose):
    """Many alignments in a few tables, each with the fewest edits (loose: the most agreements less edits, in the band)."""
    rnd = np.random.default_rng(6)
    jobs, filled, tables = [], passages._filled, []
    for k in range(400):
        x = rnd.integers(0, 2 + k % 20, int(rnd.integers(0, 33))).astype(np.uint32)
        y = np.delete(x, rnd.integers(0, len(x), 3)) if k % 2 and len(x) else rnd.integers(0, 2 + k % 20, int(rnd.integers(0, 33))).astype(np.uint32)
        jobs.append((x, y))
    monkeypatch.setattr(passages, "_filled", lambda some, loose: tables.append(len(some)) or filled(some, loose))
    found = passages._paths(jobs, loose)
    assert sum(tables) == 400 and len(tables) <= 12
    for (x, y), columns in zip(jobs, found, strict=True):
        score = {(0, 0): 0}
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                if (i or j) and (not loose or abs(i - j) <= passages.BAND):
                    ways = [score[at] - 1 for at in ((i - 1, j), (i, j - 1)) if at in score]
                    ways += [score[i - 1, j - 1] + (1 if x[i - 1] == y[j - 1] else -1)] if (i - 1, j - 1) in score else []
                    score[i, j] = max(ways)
        i = j = 0
        for c in columns.tolist():
            i, j = i + (c != passages.ONLY_B), j + (c != passages.ONLY_A)
            assert c not in (passages.AGREE, passages.DIFFER) or (x[i - 1] == y[j - 1]) == (c == passages.AGREE)
        gain = int(np.where(columns == passages.AGREE, 1, -1).sum())
        assert gain == (max(score.values()) if loose else score[len(x), len(y)]) and (loose or (i, j) == (len(x), len(y)))


def test_plain_repeats_need_no_search(spark, monkeypatch):
    """Matches on one diagonal are a chain as they are, and only texts of documents with chains are fetched."""
    places = np.cumsum([0, 1, 2, 5, 40, 3, 1, 30, 2])
    batch = pa.record_batch({"a": [1] * 9 + [1] * 9, "b": [2] * 9 + [3] * 9, "at": [*(places + 7), *(places * 2)], "mark": [*(8 * places), *(8 * places)]}, schema=pa.schema([(c, pa.int64()) for c in ("a", "b", "at", "mark")]))
    search, asked = passages.chain, []
    monkeypatch.setattr(passages, "chain", lambda a, b: asked.append(len(a)) or search(a, b))
    out = [r for b in passages._chains(45, 0.8)(iter([batch])) for r in b.to_pylist()]
    assert asked == [9] and [r["runs"] for r in out if r["b"] == 2] == [[{"a": 7, "b": 0, "n": int(places[-1]) + passages.KMER}]]
    assert search(places + 7, places) == [list(range(9))]
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(100))) for k in range(20)]
    rows += [(20, rows[4][1]), (21, " ".join(rows[7][1].split()[:10]))]
    seen, blocks = [], passages._blocks
    monkeypatch.setattr(passages, "_blocks", lambda size, marks=None: seen.append(marks) or blocks(size, marks))
    assert {(r.doc_id, r.other_id) for r in passages.repeated(frame(spark, rows)).collect()} == {(20, 4)}
    assert seen[0] is not None and np.flatnonzero(np.unpackbits(seen[0])).tolist() == [4, 20]
