import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from wayloom.llm import byte_bpe, token_counts, token_files

ODD = ["a", "The", "the", " ", "  ", "\n", "\t", "▁", "ß", "É", "é", "İ", "ΑΣ", "日本", "😀", "<s>", "</s>", "<|endoftext|>", "<|", "'s", "'LL",
       "\x00", "\x1c", "\x85", "\xa0", "\r", "ﬁ", "1", "23", ".", "!?", "’", "²"]


def texts(seed, n=400, most=14):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(tik):
    c = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in [*texts(1, 3000), "a" * 30_000, "ab" * 4000 + "!?" * 3000]:
        assert c.encode(t) == tik.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_byte_bpe_any_merge_order():
    """A small rank file with overlapping merges, against the merges themselves."""
    import base64
    import tempfile

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaa", b"bb", b"cab", b"aabb", b"bca"]
    with tempfile.NamedTemporaryFile("w", suffix=".ranks") as f:
        f.writelines(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranks))
        f.flush()
        c = byte_bpe.ByteBPE(f.name, r"\S+|\s+")
    r = random.Random(5)
    for _ in range(4000):
        w = bytes(r.choice(b"abc") for _ in range(r.randint(1, 12)))
        want = [c.ranks[w]] if w in c.ranks else c.merged(w)
        assert c.piece(w) == want, w


def test_byte_bpe_rows(docs, tik):
    rows = [(1, "The cat"), (2, None), (3, ""), (None, "x y"), (1, "The cat"), (4, "long " * 20_000)]
    got = byte_bpe.byte_bpe_digest(docs(rows).withColumnRenamed("lang", "ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == 6
    want = sorted((i or 0, len(tik.encode_ordinary(t or "")), hashlib.sha256(np.array(tik.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or 0, *r[1:]) for r in got) == want
    whole = byte_bpe.byte_bpe(docs(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert {bytes(r.decoded) for r in whole} == {(t or "").encode() for _, t in rows}
    assert byte_bpe.byte_bpe_digest(docs([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_counts_equal_library(docs):
    model = token_counts.lengths(P.path("piece_bpe_32k.model"))
    assert model.exact
    for t in texts(2, 4000):
        assert model.count(t, {}) == len(model.model.encode(t))
    rows = [(k, t) for k, t in enumerate(texts(3, 60, 60))] + [(None, "a"), (3, None), (5, "word " * 5000)]
    got = token_counts.token_counts(docs(rows), P.path("piece_bpe_32k.model")).collect()
    want = sorted((i or -1, len((t or "").encode()), len(model.model.encode(t or "")), len(model.model.encode(t or "")) > 4096) for i, t in rows)
    assert sorted((r[0] or -1, *r[1:]) for r in got) == want and any(r.over_limit for r in got)
    assert token_counts.token_counts(docs([]), P.path("piece_bpe_32k.model")).count() == 0


def test_word_ids_equal_library():
    w = token_files.word_ids(P.path("word_bpe_49k.json"))
    assert w.apart
    some = texts(4, 4000)
    assert [a.tolist() for a in w.many(some)] == [e.ids for e in w.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_token_files_round_trip(spark, docs, tmp_path):
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts(6, 101, 40))] + [(200, None), (201, ""), (5, "again"), (None, "no id"), (300, "x " * 30_000)]
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(docs(rows), folder, P.path("word_bpe_49k.json"), end_id=1, shard_tokens=500, parts=4)
    lib = token_files.word_ids(P.path("word_bpe_49k.json")).tokenizer
    ids = [(i, lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))]
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in got] == ids
    assert [r.start for r in got] == [sum(len(x) for _, x in ids[:k]) for k in range(len(ids))]
    crc = token_files.read_token_files(spark, folder, digest=True).orderBy("start").collect()
    assert [r.ids_crc32 for r in crc] == [zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in ids]
    assert sorted(token_files.read_document(spark, folder, 5)) == sorted(x for i, x in ids if i == 5)
    assert token_files.read_document(spark, folder, 999) == []
    shard = spark.read.parquet(f"{folder}/shards")
    assert shard.count() > 4 and shard.select("dict_sha256").distinct().count() == 1
    token_files.write_token_files(docs([]), str(tmp_path / "none"), P.path("word_bpe_49k.json"), end_id=1)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_names_of_chunks_are_taken_in_one_go(monkeypatch):
    """The different chunks of a batch become strings without an Arrow scalar for each."""
    from types import SimpleNamespace

    import public_tokenizers
    import pyarrow.compute as pc

    from wayloom.llm import token_files

    class Names:
        def __init__(self, names):
            self.to_numpy = names.to_numpy

        def to_pylist(self):
            raise AssertionError("a scalar for each name")

    def split(texts):
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        marked = SimpleNamespace(dictionary=Names(coded.dictionary), indices=coded.indices)
        return SimpleNamespace(offsets=chunks.offsets, flatten=lambda: SimpleNamespace(dictionary_encode=lambda: marked))

    monkeypatch.setattr(token_files, "pc", SimpleNamespace(ascii_split_whitespace=split))
    coder = token_files.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Zw\u00f6lf Boxk\u00e4mpfer, 12 mal", "", "na\u00efve caf\u00e9s x\x00y", "\u6771\u4eac cafe\u0301", "a a a b"]
    assert [a.tolist() for a in coder.many(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
