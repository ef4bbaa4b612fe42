"""Byte-level BPE as a streaming transducer, and its inverse.

Encoding. A piece of text (one match of the pre-tokenizer's pattern) is fed byte by byte. Adding bytes at the
end of a string changes its segmentation only near the end: read the merges in order of rank and let ``p`` be the
place left of which the segmentations with and without the new bytes agree. Rule ``(a, b)`` moves ``p`` left by
``|a|`` at most, and only if a token that starts at ``p`` in one of the two is ``b``; that token then begins with
the left part of the rule that moved ``p`` last. The longest chain of rules of rising rank that links like that,
weighed by ``|a|``, is the sufficient lookahead: a token that ends so many bytes before the end of the input so
far is final. It is a property of the merge list, computed once. Tokens after a final boundary are segmented as if
the string began there, so the transducer holds a window of bounded length however long the piece is.

Decoding. Ids become bytes, and a state machine turns bytes into text as they come, holding at most the three
bytes of an unfinished character; what cannot be decoded becomes U+FFFD.

Defined cases: null text counts as empty and gives no ids and the empty string; a special token's string inside a
text becomes its id, as the tokenizers library does; equal rows and null ids are kept one row each.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re as stdre
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table, tidy

#: The pattern of the byte-level pre-tokenizer.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handed on at a time, entries kept of piece -> ids, characters of the longest piece kept.
CHUNK, CACHE_PIECES, KEPT = 1 << 16, 200_000, 32
#: Bytes up to which the best merge is sought by going through all; what stands for no merge; characters handled together.
SHORT, NO_MERGE, GROUP = 64, (1 << 40, -1), 1 << 20
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else code points from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token's end can no longer change. ``merges`` in order of rank; see the module's text."""
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    for a, b in merges:
        for part in (a, b):
            if len(part) > 1 and part not in left:
                raise ValueError("a merge uses a token that no earlier merge makes")
        far, spine = 0, b
        while True:
            far = max(far, reach.get(spine, 0))
            if spine not in left:
                break
            spine = left[spine]
        reach[a] = max(reach.get(a, 0), len(a) + far)
        left.setdefault(a + b, a)
    return max(reach.values(), default=0)


class Transducer:
    """Bytes of one piece in, final ids out; ``finish`` gives the rest. All ids but those of special tokens come from here."""

    def __init__(self, vocabulary: BpeVocabulary):
        self.v = vocabulary
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        v, out = self.v, []
        while len(self.held) >= v.window:
            head = self.held[: v.window]
            ids, sure, end = v.merge(head), [], 0
            for i in ids:
                if end + v.lengths[i] > len(head) - v.lookahead:
                    break
                end += v.lengths[i]
                sure.append(i)
            out += sure
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        ids, self.held = self.v.merge(self.held), b""
        return ids


def transduced(vocabulary: BpeVocabulary, piece: str) -> list[int]:
    """The ids of a whole piece."""
    run = Transducer(vocabulary)
    return run.feed(piece.encode()) + run.finish()


class BpeVocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in to_byte for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        tokens = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.tokens: list[bytes | None] = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.lengths, self.decimal = [len(t or b"") for t in self.tokens], [str(i) for i in range(len(self.tokens))]
        self.lookahead = sufficient_lookahead(pairs)
        self.window = 2 * (self.lookahead + max(map(len, vocab)))

    def merge(self, data: bytes) -> list[int]:
        """The ids of ``data`` by the merge list, lowest rank and leftmost first."""
        ids = [self.byte_id[b] for b in data]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank = self.rank
        ranks = [rank.get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not NO_MERGE:
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = rank[pair][1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in rank:
                    heapq.heappush(heap, (rank[p][0], a, p))
        return [i for i in ids if i is not None]


class Pieces:
    """Splits text that comes in parts into the pre-tokenizer's pieces; yields (text, whether the piece ends here)."""

    RUNS = {"L": regex.compile(r"\p{L}*+"), "N": regex.compile(r"\p{N}*+"), "P": regex.compile(r"[^\s\p{L}\p{N}]*+"), "S": regex.compile(r"\s*+")}
    pattern = regex.compile(PIECE)

    def __init__(self):
        self.held, self.run = "", ""

    def _kind(self, c: str) -> str:
        return next(k for k in "LNPS" if self.RUNS[k].match(c).end())

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[str, bool]]:
        buf = self.held + text
        at = 0
        if self.run:
            at = self.RUNS[self.run].match(buf).end()
            if at == len(buf) and not last:
                keep = 1 if self.run == "S" else 0
                if at > keep:
                    yield buf[: at - keep], False
                self.held = buf[at - keep :]
                return
            if self.run == "S" and at < len(buf) and at:
                at -= 1
            yield buf[:at], True
            self.run = ""
        if last:
            for p in self.pattern.findall(buf, at):
                yield p, True
            self.held = ""
            return
        sure = max(at, len(buf) - CHUNK // 4)
        done = at
        for m in self.pattern.finditer(buf, at):
            if m.end() > len(buf) - 3:
                break
            done = m.end()
            yield m[0], True
        self.held = buf[done:]
        if done < sure and (m := self.pattern.match(self.held)) and m.end() >= len(self.held) - 3:
            self.run = self._kind(self.held[min(1, len(self.held) - 1)])
            cut = m.end() - (1 if self.run == "S" else 0)
            yield self.held[:cut], False
            self.held = self.held[cut:]


class Known:
    """Piece -> ids as the transducer gave them, bounded: two generations, the older one goes when the younger one is full."""

    def __init__(self, vocabulary: BpeVocabulary):
        self.v, self.new, self.old = vocabulary, {}, {}

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """A table that has all of ``pieces``; new ones go through the transducer."""
        pieces = set(pieces)
        missing = pieces.difference(self.new)
        if len(self.new) + len(missing) > CACHE_PIECES:
            self.old, self.new = self.new, {}
            missing = pieces
        for p in missing:
            ids = self.old.get(p)
            self.new[p] = tuple(transduced(self.v, p)) if ids is None else ids
        return self.new


class StreamEncoder:
    """Text in parts -> ids, as soon as they are final. Memory does not depend on the length of the text."""

    def __init__(self, vocabulary: BpeVocabulary):
        self.v, self.pieces, self.open = vocabulary, Pieces(), None

    def take(self, text: str, last: bool = False) -> list[str | list[int]]:
        """The part's short pieces as they are, for a table of pieces, and the ids of long ones."""
        if last and self.open is None and not self.pieces.held:
            whole = Pieces.pattern.findall(text)
            if max(map(len, whole), default=0) <= KEPT:
                return whole
        out: list[str | list[int]] = []
        for piece, ends in self.pieces.feed(text, last):
            if ends and self.open is None and len(piece) <= KEPT:
                out.append(piece)
                continue
            self.open = self.open or Transducer(self.v)
            out.append(self.open.feed(piece.encode()))
            if ends:
                out.append(self.open.finish())
                self.open = None
        if last:
            self.pieces = Pieces()
        return out

    def _ids(self, items: list[str | list[int]]) -> list[int]:
        return list(chain.from_iterable(self.v.merge(x.encode()) if isinstance(x, str) else x for x in items))

    def feed(self, text: str) -> list[int]:
        return self._ids(self.take(text))

    def finish(self) -> list[int]:
        return self._ids(self.take("", last=True))


class StreamDecoder:
    """Ids in parts -> text; a state machine over bytes that holds an unfinished character at most."""

    def __init__(self, vocabulary: BpeVocabulary):
        self.tokens, self.machine = vocabulary.tokens, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        try:
            if ids and min(ids) < 0:
                raise IndexError
            data = b"".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            raise KeyError("an id that the vocabulary does not have") from None
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class Codec:
    """Encoder and decoder of whole texts, in parts of bounded size, with a table of pieces that it keeps."""

    def __init__(self, path: str):
        self.v = BpeVocabulary(path)
        self.known = Known(self.v)
        self.split = stdre.compile("(" + "|".join(map(stdre.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    def _items(self, text: str) -> Iterator[list[str | list[int]]]:
        spans = self.split.split(text) if self.split else [text]
        for k, span in enumerate(spans):
            if k % 2:
                yield [[self.v.special[span]]]
                continue
            run = StreamEncoder(self.v)
            for at in range(0, len(span), CHUNK):
                yield run.take(span[at : at + CHUNK], last=at + CHUNK >= len(span))

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids) part by part; texts of about ``GROUP`` characters are handled together."""
        held: list[tuple[int, list[str | list[int]]]] = []
        size = 0
        for k, text in enumerate(texts):
            for items in self._items(text):
                held.append((k, items))
                size += min(len(text), CHUNK)
                if size >= GROUP:
                    yield from self._flush(held)
                    held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[int, list[str | list[int]]]]) -> Iterator[tuple[int, list[int]]]:
        known = self.known.learn(x for _, items in held for x in items if x.__class__ is str)
        for k, items in held:
            yield k, list(chain.from_iterable([known[x] if x.__class__ is str else x for x in items]))

    def ids(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for k, ids in self.parts(texts):
            out[k] += ids
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded text) of each text."""
        out, at = [], -1
        decimal = self.v.decimal.__getitem__

        def close():
            text_hash.update(decoder.finish().encode())
            out.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))

        for k, ids in chain(self.parts(texts), [(len(texts), [])]):
            while at < k:
                if at >= 0:
                    close()
                at += 1
                n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder(self.v)
            if ids:
                ids_hash.update((("," if n else "") + ",".join(map(decimal, ids))).encode())
                n += len(ids)
                text_hash.update(decoder.feed(ids).encode())
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts(batches):
            found = c.digests([t or "" for t in part.column(1).to_pylist()])
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    tidy(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in parts(batches):
            ids = c.ids([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Null ids give null; an id out of the vocabulary raises KeyError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = codec(path).v
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                d = StreamDecoder(v)
                texts.append(None if ids is None else d.feed(ids) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
