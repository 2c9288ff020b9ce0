"""Token ids: cached BPE encoding, fixed-width bit packing, token files."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm.shared import bounded, fresh_path, keeps, materialise, prefix_sum, trim, working

#: Cached words of one Python worker; the cache starts anew beyond it.
CACHE_WORDS = 600_000
#: Characters of text that one vectorised step takes.
STEP_CHARS = 4_000_000


class Coder:
    """Ids of whole texts by a ``tokenizers`` file whose normaliser folds
    case and white space and whose pre-tokenizer never crosses white space or
    the border of letters and punctuation.

    For such a file a text's ids are its words' ids in a row. Words are found
    and made distinct by Arrow kernels; each distinct word is encoded once and
    kept. Texts with an added token's first characters, and files with other
    rules, take the library's plain path.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.bits = max(1, int(self.size - 1).bit_length())
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        for k, v in vocab.items():
            self.ends[v] = k.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.by_word = self._by_word()

    def _by_word(self) -> bool:
        import json

        spec = json.loads(self.tok.to_str())
        parts = (spec.get("normalizer") or {}).get("normalizers", [])
        return [p["type"] for p in parts] == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Letter-only words are encoded many in one string and parted where a
        word's last token ends; others one by one."""
        w = self.kind.itemsize
        pure = [x for x in new if x.isalpha()]
        rest = [x for x in new if not x.isalpha()]
        for i in range(0, len(pure), 256):
            some = pure[i : i + 256]
            ids = self.plain([" ".join(some)])[0]
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * w
            if len(cuts) != len(some):
                rest += some
                continue
            raw = ids.tobytes()
            self.words.update(zip(some, (raw[a:b] for a, b in pairwise([0, *cuts.tolist()])), strict=True))
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            self.words.update(zip(some, (x.tobytes() for x in self.plain(some)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the border positions (one more than texts)."""
        if not self.by_word or pc.any(pc.match_substring(texts, "<|")).as_py():
            parts = self.plain(texts.to_pylist())
            return np.concatenate([np.zeros(0, self.kind), *parts]), np.cumsum([0, *map(len, parts)])
        low = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])([ \n])", r"\1 \2\3")
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self._learn([x for x in words if x not in self.words])
        got = [self.words[x] for x in words]
        lens = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(got), self.kind)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = lens[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        at = np.repeat((np.cumsum(lens) - lens)[codes] - (ends - each), each) if len(codes) else np.zeros(0, np.int64)
        ids = pool[np.arange(len(at)) + at] if len(at) else np.zeros(0, self.kind)
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.concatenate([[0], ends])[borders]


_coders: dict[str, Coder] = {}


keeps("tokens", _coders.clear)


def coder(path: str) -> Coder:
    """One coder for a Python worker and file."""
    working("tokens")
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded text size (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each slice with the ids of its rows, ``end_id`` appended; null is empty."""
    c = coder(path)
    for batch in batches:
        for part in steps(batch, column):
            ids, borders = c.encode(pc.fill_null(part[column], ""))
            yield part, [np.append(ids[a:b], c.kind.type(end_id)) for a, b in pairwise(borders)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# Fixed-width bit packing -------------------------------------------------


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


MAGIC = b"FWIDS01\n"
#: magic; bits, ids in a block; ids, documents; where the index starts.
TAIL = struct.Struct("<8sIIQQQ")


class TokenFileWriter:
    """A token file: packed blocks of ``block`` ids, each on a byte border,
    then the index (block offsets, documents' first ids, doc_ids and which of
    those are null), then a tail of fixed size. Written front to back, so it
    needs no seek; holds one block and the index."""

    def __init__(self, sink, bits: int, block: int = 4096):
        self.sink, self.bits, self.block = sink, bits, block
        self.offsets, self.starts, self.docs = [0], [0], []
        self.rest: list[np.ndarray] = []
        self.waiting = self.at = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate([np.zeros(0, "<u4"), *self.rest]).astype("<u4")
        whole = len(ids) if all_ else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            raw = pack_bits(ids[i : min(i + self.block, whole)], self.bits)
            self.sink.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.rest = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.sink.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.sink.write(TAIL.pack(MAGIC, self.bits, self.block, self.starts[-1], len(self.docs), self.at))


class TokenFile:
    """Reads a token file; ``ids(a, b)`` reads only the blocks of that range."""

    def __init__(self, source):
        self.source = source
        n = source.size()
        source.seek(n - TAIL.size)
        magic, self.bits, self.block, self.n_ids, self.n_docs, index = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        blocks = -(-self.n_ids // self.block) + 1
        self.offsets = np.frombuffer(source.read(8 * blocks), "<u8")
        self.starts = np.frombuffer(source.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        docs = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        null = np.frombuffer(source.read(self.n_docs), np.uint8)
        self.docs = [None if z else int(d) for d, z in zip(docs, null, strict=True)]

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        if (self.block * self.bits) % 8 == 0:  # full blocks lie gapless
            n = min(self.n_ids, (last + 1) * self.block) - first * self.block
            got = unpack_bits(raw, n, self.bits)
        else:
            lo = int(self.offsets[first])
            got = np.concatenate([unpack_bits(raw[int(self.offsets[k]) - lo : int(self.offsets[k + 1]) - lo], min(self.n_ids, (k + 1) * self.block) - k * self.block, self.bits) for k in range(first, last + 1)])
        return got[a - first * self.block : b - first * self.block]

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it: local, hdfs, s3a (s3n), gs, abfs(s)."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block: int = 4096) -> DataFrame:
    """Encode every text and write token files in ascending doc_id order.

    Returns the manifest, one row per file in order: shard (its place), path,
    n_docs, n_ids, start (ids in all files before). Documents are dealt out by
    doc_id range (rows of one doc_id by text hash), so file order is document
    order; null doc_ids come first, null texts are empty, repeated rows are all
    kept. A retried task writes a file of its own; the manifest names only the
    finished one. An empty table gives an empty manifest.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        path = f"{base}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        c = coder(tokenizer)
        with fs.open_output_stream(path) as sink:
            out = TokenFileWriter(sink, max(c.bits, int(end_id).bit_length()), block)
            for part, ids in encoded(chain([first], batches), tokenizer, end_id):
                for d, x in zip(part["doc_id"].to_pylist(), ids, strict=True):
                    out.add(d, x)
            out.close()
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/{path.rpartition('/')[2]}"], "n_docs": [len(out.docs)], "n_ids": [out.starts[-1]]})

    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    manifest = materialise(bounded(dealt).mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    manifest = manifest.withColumn("hundreds", F.floor(F.col("shard") / 100))
    return prefix_sum(manifest, [], ["hundreds", "shard"], [F.col("path")], "n_ids", "start").drop("hundreds")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files of a manifest: doc_id, start (ids of all
    documents before it), n_tokens, ids (binary, little-endian unsigned 32 bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                fs, place = open_fs(path)
                with fs.open_input_file(place) as source:
                    f = TokenFile(source)
                    a = 0
                    while a < f.n_docs:
                        b = max(a + 1, int(np.searchsorted(f.starts, f.starts[a] + 1_000_000, "right")) - 1)
                        ids, at = f.ids(int(f.starts[a]), int(f.starts[b])), f.starts[a : b + 1] - f.starts[a]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(f.docs[a:b], pa.int64()),
                                "start": pa.array(f.starts[a:b] + start, pa.int64()),
                                "n_tokens": pa.array(np.diff(at), pa.int64()),
                                "ids": pa.array([ids[i:j].tobytes() for i, j in pairwise(at)], pa.binary()),
                            }
                        )
                        a = b

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
