"""Token ids in bit-packed binary files.

Documents are dealt by ranges of doc_id, as many as ``FILE`` bytes of text go into the corpus, tokenized, and written in
ascending order, one file per range; as many tasks read the files back.  A file holds
blocks of ``BLOCK`` ids, each id in the least number of bits that the vocabulary needs (low bit first), then the blocks'
byte offsets, the documents' first ids and doc_ids, and a fixed-size trailer; so numpy unpacks any block
by itself and a document is reached without reading the ones before it.

Tokenizing: a text is split before each blank that stands between two other characters.  A byte-level BPE pre-tokenizer
always splits there, so the pieces' ids, back to back, are the text's ids; every distinct piece of a
batch goes to the tokenizers library once, and a bounded cache in the worker spares it further calls.  Texts in which
white space meets white space, or which hold a special token's characters, are encoded whole; with a tokenizer of another
kind (another pre-tokenizer, a normalizer, a prefix blank, truncation) all texts are.

Defined cases: null or empty text is the end id alone; a null doc_id comes first; rows of equal doc_id are ordered by
a hash of their text (and may lie in several files); an empty table writes no file and gives no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, slices
from .store import Folder, own_name

BLOCK = 1 << 16
FILE = 32 << 20
CACHE = 700_000
MAGIC = b"PACKEDID"
_MARK = "\x00"
_MEETING = r"[\s\pZ\x0b\x1c-\x1f\x{85}] | [\s\pZ\x0b\x1c-\x1f\x{85}]|\x00"


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits, low bit first, back to back."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _worker_state() -> types.ModuleType:
    """Survives from task to task in one worker process."""
    return sys.modules.setdefault("trialbook_worker_state", types.ModuleType("trialbook_worker_state"))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        plain = not any(spec[k] for k in ("normalizer", "truncation", "padding")) and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        #: Whether pieces may be encoded apart.
        self.apart = plain and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")

    @classmethod
    def of(cls, path: str) -> Encoder:
        state = _worker_state()
        held = state.__dict__.setdefault("encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Encoded distinct pieces; what the cache does not hold goes to the library in one call."""
        known = self.known
        found = [known.get(t) for t in texts]
        new = [t for t, ids in zip(texts, found, strict=True) if ids is None]
        made = dict(zip(new, self.encode(new), strict=True))
        if len(known) + len(made) > CACHE:
            known.clear()
            known.update((t, ids) for t, ids in zip(texts, found, strict=True) if ids is not None)
        known.update(made)
        return [known[t] if ids is None else ids for t, ids in zip(texts, found, strict=True)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids back to back, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        if not self.apart:
            found = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        odd = pc.match_substring_regex(texts, _MEETING)
        if self.special:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), " ", f"{_MARK} "), _MARK)
        chunks = lists.flatten().dictionary_encode()
        # Distinct chunks, split again where a letter meets a stop, share most of their pieces.
        inner = pc.replace_substring_regex(chunks.dictionary, r"([\pL\pN])([.,]\n?)(\pL)", f"\\1{_MARK}\\2{_MARK}\\3")
        inner = pc.split_pattern(pc.replace_substring_regex(inner, r"([\pL\pN])([.,])$", f"\\1{_MARK}\\2"), _MARK)
        parts = inner.flatten().dictionary_encode()
        found = self.pieces(parts.dictionary.to_pylist())
        whole = self.encode([t.as_py() for t in texts.filter(pa.array(odd))])
        flat = np.frombuffer(b"".join([*found, *whole]), "<u4")
        sizes = np.fromiter(map(len, [*found, *whole]), np.int64) // 4
        part_sizes = sizes[: len(found)]
        index = parts.indices.to_numpy()
        chunk_ids, counts = _gather(flat, part_sizes, index)
        per_chunk = _sums(counts, inner.value_lengths().to_numpy())
        # A text encoded whole is the one piece of its list (an empty string) put in another's place.
        per_text = lists.value_lengths().to_numpy()
        heads = np.cumsum(per_text) - per_text
        index = chunks.indices.to_numpy().astype(np.int64)
        index[heads[odd]] = len(per_chunk) + np.arange(len(whole))
        out, counts = _gather(np.concatenate([chunk_ids, flat[part_sizes.sum() :]]), np.concatenate([per_chunk, sizes[len(found) :]]), index)
        return out, _sums(counts, per_text)


def _gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (their sizes given) in the order of ``index``, and the sizes of those."""
    many = sizes[index]
    ends = np.cumsum(many)
    starts = (np.cumsum(sizes) - sizes)[index]
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - many), many)], many


def _sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    edges = np.append(0, np.cumsum(values))
    ends = np.cumsum(groups)
    return edges[ends] - edges[ends - groups]


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.rest = out, width, np.zeros(0, np.uint32)
        self.offsets, self.at = [0], 0
        self.counts, self.doc_ids, self.nulls = [], [], []

    def add(self, ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array) -> None:
        self.counts.append(counts)
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy())
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        starts = np.append(0, np.cumsum(counts)).astype("<i8")
        tail = [np.array(self.offsets, "<i8"), starts, np.concatenate([*self.doc_ids, np.zeros(0, np.int64)]).astype("<i8"), np.concatenate([*self.nulls, np.zeros(0, bool)]).astype(np.uint8)]
        for part in tail:
            self.out.write(part.tobytes())
        self.out.write(np.array([len(self.offsets), len(counts), starts[-1], self.width, BLOCK], "<i8").tobytes() + MAGIC)
        return int(starts[-1]), len(counts)


class Reader:
    """Random access to a packed file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 48)
        trailer = file.read(48)
        if trailer[40:] != MAGIC:
            raise ValueError("not a packed id file")
        blocks, docs, self.n_ids, self.width, self.block = np.frombuffer(trailer[:40], "<i8").tolist()
        file.seek(size - 48 - docs * 9 - (docs + 1 + blocks) * 8)
        self.offsets = np.frombuffer(file.read(blocks * 8), "<i8")
        self.starts = np.frombuffer(file.read((docs + 1) * 8), "<i8")
        self.doc_ids = np.frombuffer(file.read(docs * 8), "<i8")
        self.nulls = np.frombuffer(file.read(docs), np.uint8).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, -(-stop // self.block)
        self.file.seek(int(self.offsets[first]))
        parts = [unpack(self.file.read(int(self.offsets[k + 1] - self.offsets[k])), self.width, min(self.block, self.n_ids - k * self.block)) for k in range(first, last)]
        return np.concatenate([*parts, np.zeros(0, np.uint32)])[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, path: str, uri: str, end: int = 2) -> DataFrame:
    """Write all documents below ``uri``; one materialized row per file: part, name, n_ids, n_docs, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, folder, name = Encoder.of(path), Folder(uri), f"{own_name()}.ids"
        pieces = slices(batches, most=8 << 20)
        first = next(pieces, None)
        if first is None:
            return
        with folder.create(name) as out:
            writer = Writer(out, max(1, (max(encoder.size - 1, end)).bit_length()))
            while first is not None:
                ids, counts = encoder.ids(first.column("text"))
                writer.add(np.insert(ids, np.cumsum(counts), end), counts + 1, first.column("doc_id"))
                first = next(pieces, None)
            n_ids, n_docs = writer.close()
        yield pa.record_batch({"part": [TaskContext.get().partitionId()], "name": [name], "n_ids": [n_ids], "n_docs": [n_docs]})

    # Identical rows are told apart by their place in the input, so that no key is too large for a range.
    keys = ["doc_id", "_hash", "_row"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    dealt = dealt.repartitionByRange(parts(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = materialize(dealt.mapInArrow(run, "part long, name string, n_ids long, n_docs long"))
    # A row per file: the running sum over files is small whatever the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def parts(docs: DataFrame) -> int:
    """The number of files for a corpus."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // FILE) + 1


def read(files: DataFrame, uri: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, file, row.  A task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with folder.open(name) as file:
                    reader = Reader(file)
                    docs, at = len(reader.doc_ids), 0
                    while at < docs:
                        stop = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + 64 * BLOCK, side="right")) - 1)
                        stop = min(stop, docs)
                        edges = reader.starts[at : stop + 1]
                        data = reader.ids(int(edges[0]), int(edges[-1])).astype("<u4").tobytes()
                        inner = (edges - edges[0]) * 4
                        crc = [zlib.crc32(data[i:j]) for i, j in zip(inner, inner[1:])]
                        yield pa.record_batch({
                            "doc_id": pa.array(reader.doc_ids[at:stop], mask=reader.nulls[at:stop]),
                            "start": edges[:-1] + start, "n_tokens": np.diff(edges), "ids_crc32": np.array(crc, np.int64),
                            "file": pa.array([name] * (stop - at)), "row": np.arange(at, stop),
                        })
                        at = stop

    files = materialize(files.select("part", "name", "start"))
    # An explicit number of ranges, which adaptive execution leaves alone.
    dealt = files.repartitionByRange(max(files.count(), 1), "part").select("name", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, row long")


def token_files(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    uri = scratch_dir(docs.sparkSession, "tokens")
    return read(write(docs, path, uri, end), uri)
