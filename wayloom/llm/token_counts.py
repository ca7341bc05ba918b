"""Token counts of whole texts by a sentencepiece BPE model, one pre-token at a time."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_text

#: Pre-token lengths that a worker remembers besides the shared table; a full cache is emptied.
CACHE = 1 << 18
#: A run of spaces with the word after it, a line end, or spaces before a line end.
PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")
SPACE = "▁"


class PieceLengths:
    """Counts tokens as the model's own ``encode`` does, by adding up the lengths of pre-tokens.

    Adding up is exact because no piece of the model holds a space after another character or a line end beside anything:
    merges stay inside a pre-token. This is checked when the model is loaded; a model without it, or one whose normaliser
    changes texts, is encoded whole.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        apart = all(SPACE not in p.lstrip(SPACE) and ("\n" not in p or p == "\n") for p in pieces)
        probe = "a  b\n c  é é ﬁ \t x\n\n  Ａ "
        self.exact = apart and self.model.decode(self.model.encode(probe)) == probe and self.model.encode("a  ") != self.model.encode("a")
        self.line_end = len(self.model.encode("\n")) - 1
        self.lengths: dict[str, int] = {}

    def of(self, pre_token: str) -> int:
        """Tokens of a pre-token inside a text."""
        if pre_token == "\n":
            return self.line_end
        if pre_token[0] != " ":  # follows a line end; alone it would get a space in front
            return len(self.model.encode("\n" + pre_token)) - 1 - self.line_end
        if pre_token == " ":
            return 1
        return len(self.model.encode(pre_token[1:]))  # the model itself puts one space in front

    def count(self, text: str, shared: dict[str, int]) -> int:
        if not text:
            return 0
        if not self.exact or "\0" in text:
            return len(self.model.encode(text))
        n, own = 0, self.lengths
        for w in PRE_TOKEN.findall(" " + text.replace(SPACE, " ")):
            k = shared.get(w) or own.get(w)
            if k is None:
                k = self.of(w)
                if len(w) <= 64:
                    if len(own) >= CACHE:
                        own.clear()
                    own[w] = k
            n += k
        return n


@lru_cache(maxsize=2)
def lengths(model_file: str) -> PieceLengths:
    """One model for each worker process."""
    return PieceLengths(model_file)


def frequent_lengths(docs: DataFrame, model_file: str, text_col: str = "text", size: int = 8192, per_task: int = 512) -> dict[str, int]:
    """The lengths of at most ``size`` frequent pre-tokens.

    Each task counts its own pre-tokens in a table of bounded size (rare ones are thinned out) and hands on its
    ``per_task`` most frequent; only these summaries are added up. The table only saves work, so counts need not be exact.
    """
    def top(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(PRE_TOKEN.findall(" " + t) if t else ())
                if len(seen) > 4 * CACHE:
                    seen = Counter(dict(heapq.nlargest(CACHE, seen.items(), key=lambda x: x[1])))
        best = [(w, n) for w, n in heapq.nlargest(per_task, seen.items(), key=lambda x: (x[1], x[0])) if n > 1 and len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["w", "n"])

    counts = docs.select(text_col).mapInArrow(top, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    words = [r.w for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]
    own = lengths(model_file)
    return {w: own.of(w) for w in words} if own.exact else {}


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of each whole text.

    Two tiers: a shared table of frequent pre-token lengths goes to all tasks; other pre-tokens are encoded and remembered
    per worker. No pre-token is shuffled. A null text counts as empty (0 tokens); null ids are kept; repeated rows come
    out repeated; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_file, text_col))

    def run(ids, texts):
        own, table = lengths(model_file), shared.value
        n = [own.count(t or "", table) for t in texts]
        return {"id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_text(docs, id_col, text_col, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "over_limit")
