"""Token files and streaming BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featuremill.llm import bpe_stream
from featuremill.llm.bpe_stream import BpeVocabulary, Codec, StreamDecoder, StreamEncoder, sufficient_lookahead
from featuremill.llm.common import work_dir
from featuremill.llm.token_files import open_shard, read_token_files, write_token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a", "I'll we're 's", "<|endoftext|>x<|endoftext|>", "É" * 300, "日本語 text", "a" * 5000, " " * 3000 + "b", "'" * 400 + "s", "\ttab\r\nline\x1c\x85 "]


@pytest.fixture(scope="module")
def codec():
    return Codec(BYTE)


def test_ids_equal_the_library(codec):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab cé'\n e1.日\t're") for _ in range(rng.randrange(80))) for _ in range(500)]
    for text, ids in zip(texts, codec.ids(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids
        d = StreamDecoder(codec.v)
        assert "".join(map(lambda i: d.feed([i]), ids)) + d.finish() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_any_cut_of_the_stream_gives_the_same_ids(codec, size):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice("abthe 'r\n1.é") * rng.choice([1, 1, 2, 30]) for _ in range(40))
        run = StreamEncoder(codec.v)
        ids = [i for at in range(0, len(text), size) for i in run.feed(text[at : at + size])] + run.finish()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_every_id_comes_out_of_the_transducer(monkeypatch):
    """Over all texts of the small documents table: what the transducer gives for each piece, weighed by its occurrences."""
    import pandas as pd

    given = {}
    feed, finish = bpe_stream.Transducer.feed, bpe_stream.Transducer.finish

    def counted(f):
        def run(self, *data):
            out = f(self, *data)
            self.seen = getattr(self, "seen", b"") + b"".join(data)
            self.n = getattr(self, "n", 0) + len(out)
            given[self.seen] = self.n
            return out

        return run

    monkeypatch.setattr(bpe_stream.Transducer, "feed", counted(feed))
    monkeypatch.setattr(bpe_stream.Transducer, "finish", counted(finish))
    texts = [t or "" for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text] + ODD
    ids = Codec(BYTE).ids(texts)
    library = Tokenizer.from_file(BYTE)
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    pieces = [p.encode() for t in texts for span in t.split("<|endoftext|>") for p in bpe_stream.Pieces.pattern.findall(span)]
    assert sum(given[p] for p in pieces) + sum(t.count("<|endoftext|>") for t in texts) == sum(map(len, ids))


@pytest.mark.parametrize("bad", [-1, 10_000_000])
def test_ids_out_of_the_vocabulary_raise(codec, bad):
    with pytest.raises(KeyError):
        StreamDecoder(codec.v).feed([5, bad])


def test_long_pieces_stream_with_a_bounded_window(codec):
    run = bpe_stream.Transducer(codec.v)
    data = ("antheringtion" * 4000).encode()
    ids = []
    for at in range(0, len(data), 100):
        ids += run.feed(data[at : at + 100])
        assert len(run.held) <= codec.v.window + 100
    assert ids + run.finish() == codec.v.merge(data)


def test_lookahead_rejects_an_improper_merge_list():
    assert sufficient_lookahead([(b"a", b"b"), (b"ab", b"c")]) >= 1
    with pytest.raises(ValueError):
        sufficient_lookahead([(b"ab", b"c")])


def test_undecodable_bytes_become_replacement_characters(codec):
    d = StreamDecoder(codec.v)
    lead = codec.v.byte_id[0xC3]
    assert d.feed([lead]) == "" and d.feed([codec.v.byte_id[0x41]]) == "�A" and d.finish() == ""


def test_encode_decode_frames(spark):
    rows = [(1, "a b", 9), (2, None, 9), (2, None, 9), (None, "ü", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe_stream.encode_decode(docs, BYTE).collect()
    assert len(out) == 4
    assert {(r.doc_id, r.decoded_sha256) for r in out} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    ids = bpe_stream.encode_ids(docs, BYTE)
    assert {r.text for r in bpe_stream.decode_ids(ids, BYTE).collect()} == {"a b", "", "ü"}
    assert bpe_stream.encode_decode(docs.limit(0), BYTE).count() == 0


def test_token_files_round_trip(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["The", "of", "x1", "Ünder", "tion!"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, shard string")
    path = work_dir(spark, "t")
    manifest = write_token_files(docs, path, WORD, shards=3)
    library = Tokenizer.from_file(WORD)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r)[:4] for r in read_token_files(spark, path).collect())
    assert got == sorted(want)
    for m in manifest.collect():
        ids, offsets, docs_ = open_shard(path, m.name, m.width)
        assert isinstance(ids, np.memmap) and ids.dtype == np.uint16 and len(offsets) == len(docs_) + 1 and offsets[-1] == len(ids)


def test_token_files_of_nothing(spark):
    path = work_dir(spark, "t")
    assert write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, WORD).count() == 0
    assert read_token_files(spark, path).count() == 0


def test_token_files_of_another_tokenizer(spark):
    """A tokenizer whose pieces hold their space gets whole texts, and its ids are the library's."""
    rows = [(k, t) for k, t in enumerate(["hello world again", "a  b c", None, "Ünder the\n sea"])]
    path = work_dir(spark, "t")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTE, end_id=50256, shards=2)
    library = Tokenizer.from_file(BYTE)
    want = {i: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 50256], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in read_token_files(spark, path).collect()} == want
    from featuremill.llm.token_files import drops_spaces
    import json

    assert drops_spaces(json.load(open(WORD))) and not drops_spaces(json.load(open(BYTE)))


def test_shards_are_read_by_ranges(spark, monkeypatch):
    from featuremill.llm import token_files

    rows = [(k, f"word{k} and more") for k in range(50)]
    path = work_dir(spark, "t")
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, WORD, shards=2).collect()
    fs, root = token_files._store(path)

    far = token_files.pafs.SubTreeFileSystem("/", fs)  # a store that is not the local one itself
    monkeypatch.setattr(token_files, "_store", lambda path: (far, root))
    for m in manifest:
        shard = token_files.Shard(path, m.name, m.width)
        assert not shard.mapped
        whole = np.fromfile(f"{root}/{m.name}.bin", f"<u{m.width}")
        ends = shard.part("idx", 0, m.n_docs + 1)
        assert ends[-1] == len(whole) and (shard.part("bin", int(ends[1]), int(ends[3])) == whole[ends[1] : ends[3]]).all()
