"""Token ids of documents in files with a shared compression dictionary and access to single short documents.

A token table is a folder with two Parquet tables:

* ``dictionary``: one row with the Zstandard dictionary and its SHA-256;
* ``shards``: rows of ``part`` and ``shard`` (in ascending id order), ``n_docs``, ``n_tokens``, ``dict_sha256``, ``width``
  (bytes of an id), ``index`` (little-endian int64 triples: document id, first token of the document within the part, place
  of the frame in ``data``; nulls of ids sort first and are marked in ``null_ids``) and ``data``, the frames one after another.

Each document is a frame of its own, so one is read by unpacking one frame.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_text

#: Words and chunks that each half of a worker's tables remembers; when the newer half is full it becomes the older one.
CACHE = 1 << 18


class WordIds:
    """The ids of texts from a tokenizers file, remembered by word; texts with added tokens in them are encoded whole.

    Chunks between ASCII white space are encoded on their own, as the normaliser and patterns never join them."""

    def __init__(self, tokenizer_file: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        # white space separates, everything else is decided inside a chunk
        self.apart = kinds == ["NFC", "Replace", "Lowercase"] and bool(steps) and steps[0].get("behavior") == "Removed" and not spec.get("post_processor")
        pattern = steps[0]["pattern"]["Regex"] if self.apart else r"\S+"
        # texts of these characters alone compose with nothing and lower one by one; the pattern's classes are listed for them
        plain = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028))]
        listed = {k: "".join(re.escape(c) for c in plain if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}")}
        self.plain = re.compile("[\0-\x1b\x20-\u024f\u2010-\u2027]*").fullmatch  # not the separators that only Python has as spaces
        self.words = re.compile(re.sub(r"\\p\{[LN]\}", lambda m: listed[m[0]], pattern)).findall
        vocab = self.tokenizer.get_vocab()
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # of lowered chunks of plain texts; of others' chunks
        self.older: list[dict[str, bytes]] = [{}, {}]
        self.of_word: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _learn_words(self, words: list[str]) -> None:
        """Remember the ids of words that are one pre-token each; in one call, cut after the tokens that end a word."""
        for lo in range(0, len(words), 2048):
            part = words[lo:lo + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) == len(part) and cut[-1] == 4 * len(ids):
                raw, cut = ids.tobytes(), cut.tolist()
                self.of_word.update(zip(part, (raw[i:j] for i, j in zip([0, *cut[:-1]], cut))))
            else:
                self._learn(self.of_word, part)

    def _learn_plain(self, chunks: set[str]) -> None:
        whole = [c for c in chunks if c.isalpha()]  # letters alone are one word
        rest = [c for c in chunks if not c.isalpha()]
        parts = list(map(self.words, rest))
        if len(self.of_word) >= CACHE:
            self.older_words, self.of_word = self.of_word, {}
        fresh = set(chain(whole, *parts)).difference(self.of_word)
        again = fresh.intersection(self.older_words)
        self.of_word.update(zip(again, map(self.older_words.__getitem__, again)))
        self._learn_words(sorted(fresh.difference(again)))
        word, known = self.of_word.__getitem__, self.known[0]
        known.update(zip(whole, map(word, whole)))
        known.update(zip(rest, [b"".join(map(word, w)) for w in parts]))

    def _learn(self, known: dict[str, bytes], parts: list[str]) -> None:
        known.update(zip(parts, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))))

    def _chunk_ids(self, k: int, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts by their chunks: each different one is looked up once, and its ids are dealt to its places."""
        known, older = self.known[k], self.older[k]
        chunks = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts] if k == 0 else texts, pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes an Arrow scalar of each
        fresh = set(names).difference(known)
        again = fresh.intersection(older)
        known.update(zip(again, map(older.__getitem__, again)))
        if fresh := fresh.difference(again):
            self._learn_plain(fresh) if k == 0 else self._learn(known, sorted(fresh))
        ids = list(map(known.__getitem__, names))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = size[which]
        end = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[which] - end + each, each) + np.arange(end[-1] if len(end) else 0)]
        cut = np.append(0, end)[chunks.offsets.to_numpy()].tolist()
        if len(known) >= CACHE:
            self.older[k] = dict(known)
            known.clear()
        return [flat[i:j] for i, j in zip(cut, cut[1:])]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        places: tuple[list, list] = ([], [])
        for n, t in enumerate(texts):
            if not self.apart or any(a in t for a in self.added):
                out[n] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                places[0 if self.plain(t) else 1].append(n)
        for k, at in enumerate(places):
            if at:
                for n, got in zip(at, self._chunk_ids(k, [texts[n] for n in at])):
                    out[n] = got
        return out


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    """One tokenizer for each worker process, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(tokenizer_file)


def train_dictionary(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, sample: int = 1000, size: int = 64 << 10,
                     width: int = 2) -> bytes:
    """A Zstandard dictionary from the id arrays of ``sample`` documents with the smallest hashes; empty if too few."""
    import zstandard

    places = docs.filter(F.length(text_col) > 0).select(F.xxhash64(id_col, text_col).alias("place"))
    last = places.orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    picked = docs.filter((F.length(text_col) > 0) & (F.xxhash64(id_col, text_col) <= F.lit(last))).select(id_col, text_col).limit(2 * sample)

    def run(ids, texts):
        return {"raw": [a.astype(f"<u{width}").tobytes() for a in word_ids(tokenizer_file).many(texts)]}

    raw = [bytes(r.raw) for r in map_text(picked, id_col, text_col, run, "raw binary").collect()]
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:  # too few documents to learn from
        return b""


def _zstd(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d))


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                      shard_tokens: int = 1 << 21, sample: int = 1000, parts: int | None = None) -> None:
    """Encode whole texts, append ``end_id`` and write them to ``folder`` in ascending id order.

    ``sample`` bounds the documents that the dictionary is trained on; every document is written. A null text counts as
    empty (the end id alone); null ids come first; repeated rows are written repeatedly (ties by text); other columns do
    not matter; an empty table makes an empty folder of tables. One shuffle, of the texts by ranges of the id.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_file, id_col, text_col, sample, width=width)
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), mark)], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")
    kept = spark.sparkContext.broadcast(dictionary)
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dict_sha256", pa.string()),
                        ("width", pa.int32()), ("null_ids", pa.int64()), ("index", pa.binary()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        pack, _ = _zstd(kept.value)
        coder = word_ids(tokenizer_file)
        part, shard, total = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        first: list[int] = []
        frames: list[bytes] = []

        def shut():
            begin = np.cumsum([0] + [len(f) for f in frames])[:-1]
            index = np.stack([np.array([i or 0 for i in ids], np.int64), np.array(first, np.int64), begin], 1).astype("<i8")
            return pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "n_docs": len(ids), "n_tokens": total - first[0], "dict_sha256": mark, "width": width,
                "null_ids": sum(i is None for i in ids), "index": index.tobytes(), "data": b"".join(frames)}], schema)

        for b in batches:
            step = max(1, int(4_000_000 * b.num_rows / max(1, b.nbytes)))
            for lo in range(0, b.num_rows, step):
                some = b.slice(lo, step)
                for i, tokens in zip(some.column(0).to_pylist(), coder.many([t or "" for t in some.column(1).to_pylist()])):
                    ids.append(i)
                    first.append(total)
                    frames.append(pack.compress(np.append(tokens, end_id).astype(f"<u{width}").tobytes()))
                    total += len(tokens) + 1
                    if total - first[0] >= shard_tokens:
                        yield shut()
                        shard, ids, first, frames = shard + 1, [], [], []
        if ids:
            yield shut()

    dealt = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    dealt = dealt.repartitionByRange(parts, "id") if parts else dealt.repartitionByRange("id")
    dealt.sortWithinPartitions("id", "text").mapInArrow(
        run, "part int, shard int, n_docs bigint, n_tokens bigint, dict_sha256 string, width int, null_ids bigint, index binary, data binary"
    ).write.parquet(f"{folder}/shards")


def _dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary of {folder} is damaged")
    return dictionary, row.sha256


def _starts(shards: DataFrame) -> DataFrame:
    """Tokens before each part: a running sum over one row for each part of the table."""
    from pyspark.sql import Window

    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """All documents of a token table: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens`` and ``ids``.

    With ``digest``, ``ids_crc32`` (of the ids as 32-bit little-endian numbers) takes the place of ``ids``.
    """
    dictionary, mark = _dictionary(spark, folder)
    kept = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.parquet(f"{folder}/shards")
    last, kind = ("ids_crc32", "bigint") if digest else ("ids", "array<bigint>")

    def run(batches):
        _, unpack = _zstd(kept.value)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_sha256"] != mark:
                    raise ValueError("a shard was written with another dictionary")
                index = np.frombuffer(r["index"], "<i8").reshape(-1, 3)
                ends = np.append(index[1:, 2], len(r["data"]))
                data = memoryview(r["data"])
                got, n = [], []
                for lo, hi in zip(index[:, 2], ends):
                    ids = np.frombuffer(unpack.decompress(data[lo:hi]), f"<u{r['width']}")
                    n.append(len(ids))
                    got.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
                doc = [None] * r["null_ids"] + index[r["null_ids"]:, 0].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(index[:, 1] + r["before"]), pa.array(n, pa.int64()),
                     pa.array(got, pa.int64() if digest else pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", last])

    return shards.join(F.broadcast(_starts(shards)), "part").select("dict_sha256", "width", "null_ids", "index", "data", "before").mapInArrow(
        run, f"doc_id bigint, start bigint, n_tokens bigint, {last} {kind}")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with its id): its shards' indexes are searched and single frames unpacked."""
    dictionary, _ = _dictionary(spark, folder)
    _, unpack = _zstd(dictionary)
    out = []
    shards = spark.read.parquet(f"{folder}/shards")

    def holds(batches):
        for b in batches:
            yield b.filter(pa.array([bool((np.frombuffer(i, "<i8").reshape(-1, 3)[k:, 0] == doc_id).any())
                                     for i, k in zip(b.column("index").to_pylist(), b.column("null_ids").to_pylist())], pa.bool_()))

    near = shards.select("part", "shard", "index", "null_ids").mapInArrow(holds, "part int, shard int, index binary, null_ids bigint").select("part", "shard")
    for r in near.join(shards, ["part", "shard"]).orderBy("part", "shard").toLocalIterator():
        index = np.frombuffer(r["index"], "<i8").reshape(-1, 3)
        ends = np.append(index[1:, 2], len(r.data))
        for k in np.flatnonzero(index[:, 0] == doc_id):
            if k >= r.null_ids:
                out.append(np.frombuffer(unpack.decompress(bytes(r.data[index[k, 2]:ends[k]])), f"<u{r.width}").tolist())
    return out
