"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A shard is three little-endian files: ``.bin`` (ids, uint16 if the vocabulary allows, else uint32), ``.idx``
(int64 token offsets, one more than there are documents) and ``.doc`` (int64 document ids). Shards hold
consecutive ranges of ``doc_id``; the base of each shard (tokens and documents before it) is a prefix sum over
the per-shard counts in the manifest, so that no shard has to know another one while it is written.

Defined cases: a null text counts as empty (only the end id is written); null ids sort first and come back as
null; equal ids keep one entry per row, ordered by a hash of the text, then the text; an empty table gives an empty
manifest; further columns are ignored. A rerun task writes the same bytes to a name of its own and renames it, so lost executors and
speculative attempts do no harm.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, work_dir

#: Entries a worker keeps of word -> ids.
CACHE_WORDS = 900_000
#: Chunks of more characters are not kept; characters of the longest text that is encoded whole as a check.
LONG_CHUNK, CHECKED = 100, 20_000
#: Bytes of input for each shard, at least as many shards as the session has shuffle partitions; documents read at a time.
SHARD_BYTES, PART = 64 << 20, 8192
# Fixed value: the pieces of the word-level tokenizer.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MANIFEST = "shard int, n_docs long, n_null_ids long, n_tokens long, width int, name string"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


class WordEncoder:
    """Whole texts to id bytes, through the tokenizers library.

    Where the tokenizer lower-cases and drops white space between pieces (its file says so), a text's ids are the ids of
    its chunks between spaces in turn; each new chunk is encoded once by the library and kept in a bounded table.
    With any other tokenizer the library gets the whole texts. The first text of each worker is encoded both ways.
    """

    def __init__(self, tokenizer_path: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        with open(tokenizer_path, encoding="utf-8") as f:
            self.chunked = drops_spaces(json.load(f))
        self.checked = not self.chunked
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.chunked:
            return self.whole(text)
        data = self._by_chunks(text)
        if not self.checked and " " in text and len(text) <= CHECKED:
            if data != self.whole(text):
                raise ValueError("the tokenizer does not encode chunks on their own")
            self.checked = True
        return data

    def _by_chunks(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        missing = set(chunks).difference(self.new)
        if missing:
            if len(self.new) + len(missing) > CACHE_WORDS:
                self.old, self.new, missing = self.new, {}, set(chunks)
            fresh = []
            for c in missing:
                if (ids := self.old.get(c)) is not None:
                    self.new[c] = ids
                else:
                    fresh.append(c)
            if fresh:
                self._learn(fresh)
        data = b"".join(map(self.new.__getitem__, chunks))
        for c in missing:
            if len(c) > LONG_CHUNK:
                del self.new[c]
        return data

    def _learn(self, fresh: list[str]) -> None:
        """Adds ``fresh`` chunks; the library gets each stem once.

        Where a chunk is ASCII, its lower-case form has the same ids (the tokenizer lower-cases), and full stops and
        commas after a letter or digit are a piece of their own.
        """
        stems = {c: _stem(c) for c in fresh}
        parts = {p for pair in stems.values() for p in pair if p and p not in self.new}
        parts = list(parts)
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.new[p] = np.array(e.ids, dtype=self.dtype).tobytes()
        for c, (stem, tail) in stems.items():
            self.new[c] = self.new[stem] + self.new[tail] if tail else self.new[stem] if stem else b""
        for p in parts:
            if len(p) > LONG_CHUNK and p not in stems:
                del self.new[p]


def drops_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file says that texts are lower-cased, and that pieces are the ``WORD_PIECES`` alone."""
    parts = lambda x, key: (x.get(key) or [x]) if x else []
    normal = [n["type"] for n in parts(spec.get("normalizer"), "normalizers")]
    split = parts(spec.get("pre_tokenizer"), "pretokenizers")
    if "Lowercase" not in normal or set(normal) - {"NFC", "Replace", "Lowercase"} or [p["type"] for p in split] != ["Split", "ByteLevel"]:
        return False
    first, second = split
    own = first["pattern"].get("Regex") == WORD_PIECES and first["behavior"] == "Removed" and first["invert"]
    return own and not second["add_prefix_space"] and not second["use_regex"] and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])


def _stem(chunk: str) -> tuple[str, str]:
    if not chunk.isascii() or "<|" in chunk:
        return chunk, ""
    low = chunk.lower()
    stem = low.rstrip(".,")
    return (stem, low[len(stem) :]) if stem and stem[-1].isalnum() else (low, "")


def id_width(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values())
    return 2 if max(top, end_id) < 1 << 16 else 4


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(*key) -> WordEncoder:
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def _write_shard(path: str, tokenizer_path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = _encoder(tokenizer_path, width)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        fs, root = _store(path)
        name, own = f"shard-{shard:06d}", f"{root}/.{uuid.uuid4().hex}"
        offsets, ids, nulls, out = array("q", [0]), array("q"), 0, None
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{own}.bin")
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + end
                out.write(data)
                offsets.append(offsets[-1] + len(data) // width)
                nulls += doc_id is None
                ids.append(doc_id or 0)
        if out is None:
            return
        out.close()
        for kind, values in (("idx", offsets), ("doc", ids)):
            with fs.open_output_stream(f"{own}.{kind}") as f:
                f.write(np.frombuffer(values, dtype=np.int64).astype("<i8").tobytes())
        for kind in ("bin", "idx", "doc"):
            fs.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
        row = [[shard], [len(ids)], [nulls], [offsets[-1]], [width], [name]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``path``; returns the manifest: one row per shard with its bases.

    ``shards`` (default: by ``SHARD_BYTES`` of the input's estimated size, the session's shuffle partitions at least) is the
    number of files; the range exchange by ``doc_id`` is the only shuffle of texts.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-size // SHARD_BYTES) if size < 1 << 55 else 0  # Spark's estimate of the unknown is above
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)
    width = id_width(tokenizer_path, end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text")
    done = laid.mapInArrow(_write_shard(path, tokenizer_path, end_id, width), MANIFEST)
    done.write.parquet(f"{path}/_counts")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = spark.read.schema(MANIFEST).parquet(f"{path}/_counts").select(
        "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("n_tokens", "base_token"), ("n_docs", "base_doc"))]
    )
    based.write.parquet(f"{path}/_manifest")
    return spark.read.schema(based.schema).parquet(f"{path}/_manifest")


class Shard:
    """One shard's ``bin`` (ids), ``idx`` (offsets) and ``doc`` (document ids): mapped where the path is local, else read by ranges."""

    def __init__(self, path: str, name: str, width: int):
        fs, root = _store(path)
        self.types = {"bin": np.dtype(f"<u{width}"), "idx": np.dtype("<i8"), "doc": np.dtype("<i8")}
        files = {kind: f"{root}/{name}.{kind}" for kind in self.types}
        self.mapped, self.open = {}, {}
        if isinstance(fs, pafs.LocalFileSystem):
            self.mapped = {k: np.memmap(f, dtype=self.types[k], mode="r") if os.path.getsize(f) else np.zeros(0, self.types[k]) for k, f in files.items()}
        else:
            self.open = {k: fs.open_input_file(f) for k, f in files.items()}

    def part(self, kind: str, start: int, stop: int) -> np.ndarray:
        if kind in self.mapped:
            return self.mapped[kind][start:stop]
        size = self.types[kind].itemsize
        return np.frombuffer(self.open[kind].read_at((stop - start) * size, start * size), dtype=self.types[kind])


def open_shard(path: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of one shard on a local path, memory-mapped."""
    shard = Shard(path, name, width)
    return shard.mapped["bin"], shard.mapped["idx"], shard.mapped["doc"]


def _read_shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            shard = Shard(path, row["name"], row["width"])
            for at in range(0, row["n_docs"], PART):
                upto = min(at + PART, row["n_docs"])
                ends, docs = shard.part("idx", at, upto + 1), shard.part("doc", at, upto)
                first = int(ends[0])
                ids = shard.part("bin", first, int(ends[-1]))
                crc = [zlib.crc32(ids[a - first : b - first].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                null = np.arange(at, upto) < row["n_null_ids"]
                columns = [pa.array(docs, mask=null), pa.array(ends[:-1] + row["base_token"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array([row["shard"]] * len(crc), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ.split(", ")])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""
    manifest = spark.read.parquet(f"{path}/_manifest").select("shard", "n_docs", "n_null_ids", "width", "name", "base_token")
    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").mapInArrow(_read_shards(path), READ)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
