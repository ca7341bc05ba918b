"""Byte-level BPE: whole texts to token ids and back, equal to the merges of a rank file."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_text

#: Encoded pre-tokens and judged neighbour pairs that a worker remembers; a full cache is emptied, never trusted less.
CACHE = 1 << 18


class ByteBPE:
    """Encoder and decoder for a rank file and a pre-token pattern.

    A sequence of tokens is what the merges give exactly if each two neighbours are what the merges give for their joined
    bytes. So the longest match is taken at each place, shorter ones (or a step back) where a neighbour does not fit; a
    place found dead is not entered again, which keeps the work linear in the pre-token's length.
    """

    def __init__(self, rank_file: str, pattern: str):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.lens = [0] * (max(self.bytes_of) + 1)
        for i, t in self.bytes_of.items():
            self.lens[i] = len(t)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # by both ids in one number
        self.made: dict[int, tuple[int, int] | None] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The merges of a rank below a bound, lowest rank and then leftmost first; only for short byte strings."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= below:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; none for single bytes and for tokens that the merges never make."""
        if token not in self.made:
            raw, made = self.bytes_of[token], None
            if len(raw) > 1 and self.merged(raw) == [token]:
                before = self.merged(raw, below=token)
                made = (before[0], before[1]) if len(before) == 2 else None
            self.made[token] = made
        return self.made[token]

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes leave the seam between ``a`` and ``b`` as it is; ``a`` -1: ``b`` alone.

        Undo the merges at the seam from the latest on. A merge across the seam wins if it comes before the merge undone:
        its rank is lower, or equal and further left.
        """
        ok = len(self.bytes_of[b]) == 1 or self._parts(b) is not None
        if a >= 0 and ok:
            x, y, before, never = a, b, 1 << 60, 1 << 61
            while True:
                if self.ranks.get(self.bytes_of[x] + self.bytes_of[y], never) < before:
                    ok = False
                    break
                px, py = self._parts(x), self._parts(y)
                if px is None and py is None:
                    break
                if py is None or px is not None and x > y:
                    x, before = px[1], x
                else:
                    y, before = py[0], y + 1
        if len(self.fits) >= CACHE:
            self.fits.clear()
        self.fits[a << 32 | b] = ok
        return ok

    def piece(self, raw: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        lens, fits = self.lens, self.fits
        matches: list[list[int]] = [[] for _ in range(n)]
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            matches[end + 1 - lens[i]].append(i)  # shorter ones end earlier: each list rises in length
        dead: set[int] = set()
        tokens: list[int] = []
        left: list[int] = []  # untried matches at the place of each token
        at, last, here = 0, -1, matches[0]
        k = len(here)
        while at < n:
            while k:
                k -= 1
                i = here[k]
                ok = fits.get(last << 32 | i)
                if ok is None:
                    ok = self._fit(last, i)
                if ok and at + lens[i] not in dead:
                    tokens.append(i)
                    left.append(k)
                    at += lens[i]
                    last = i
                    if at < n:
                        here = matches[at]
                        k = len(here)
                    break
            else:
                if not tokens:
                    return self.merged(raw)  # a rank file that lacks single bytes; not met with public files
                dead.add(at)
                at -= lens[tokens.pop()]
                last = tokens[-1] if tokens else -1
                here, k = matches[at], left.pop()
        return tokens

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self.words
        for w in self.pattern.findall(text):
            got = words.get(w)
            if got is None:
                got = tuple(self.piece(w.encode("utf-8")))
                if len(w) <= 64:
                    if len(words) >= CACHE:
                        words.clear()
                    words[w] = got
            ids += got
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> ByteBPE:
    """One coder for each worker process."""
    return ByteBPE(rank_file, pattern)


def byte_bpe(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text, and the bytes that the ids decode to.

    One row per input row: the id column, ``ids`` array of int, ``decoded`` binary. A null text counts as empty and gives
    no ids; null ids are kept; repeated rows come out repeated; other columns do not matter. No shuffle.
    """
    def run(ids, texts):
        c = coder(rank_file, pattern)
        tokens = [np.array(c.encode(t or ""), np.int32) for t in texts]
        return {"id": ids, "ids": tokens, "decoded": [c.decode(t.tolist()) for t in tokens]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def byte_bpe_digest(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``byte_bpe`` with counts and digests in place of the ids and bytes, taken where they are made.

    ``n_tokens`` and the lowercase hex SHA-256 of the ids (32-bit little-endian) and of the decoded bytes.
    """
    def run(ids, texts):
        c = coder(rank_file, pattern)
        tokens = [c.encode(t or "") for t in texts]
        return {"id": ids, "n_tokens": [len(t) for t in tokens],
                "ids_sha256": [hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest() for t in tokens],
                "decoded_sha256": [hashlib.sha256(c.decode(t)).hexdigest() for t in tokens]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").select(
        F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
