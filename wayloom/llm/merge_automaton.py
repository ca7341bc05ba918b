"""Pair-merge encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with an arc for every base symbol, and accepts all strings. Each merge
(a, b -> c), in order of rank, is one gadget: the state that a's arcs lead to is copied without its arc b, a's arcs lead to
the copy, and every state with an arc a gets an arc c to where b's arc leads. After the last gadget a string of base symbols
has one path, its right tokenization. All arcs of a token lead to one state, so the table is kept as the gadgets made it:
a token's successive states by the first of them and the arcs that were cut since, a token's arcs by the token beside whose
arcs they stand.

Words are encoded by the same automaton read symbol by symbol: the determinised states (what can still become a token, from
which state) and their transitions are filled in on first use, and each transition names the token that ends there.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from .batches import map_text

#: Entries of a worker's tables of chunks, words, arcs and determinised states.
CACHE = 1 << 18
#: ASCII white space parts chunks: no rule of normaliser or pattern reaches over it.
CHUNKS = re.compile(r"[^ \t\n\r\f\v]+").findall


class Remembered(dict):
    """A table of bounded size: when it is full it becomes the older half, from which entries that are met again come back."""

    def __init__(self, make, size: int = CACHE):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """To be called now and then, when no entry is in use."""
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()


class MergeAutomaton:
    """Arcs between states, labelled by token numbers; ``merges`` are (left, right, whole) numbers in order of rank."""

    def __init__(self, tokens: list[str | bytes], merges: list[tuple[int, int, int]]):
        made = {c for _, _, c in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make one token")
        self.size = len(tokens)
        self.target: list[int] = [0 if t not in made else -1 for t in range(self.size)]  # the state that a token's arcs lead to
        self.follows = [-1] * self.size  # the token whose arcs a made token's arcs stand beside
        self.token_age = [-1] * self.size
        self.owner, self.state_age = [-1], [-1]  # of a state: the token whose arcs lead to it since that gadget
        self.first = list(self.target)  # the state that a token's arcs led to at first
        self.ages: list[list[int]] = [[] for _ in tokens]  # of the gadgets that copied a token's state
        self.copies: list[list[int]] = [[] for _ in tokens]  # and the states that they made
        self.cut_at: dict[int, int] = {}  # the gadget that cut an arc, by left token times tokens plus right token
        self.arcs = Remembered(self._has_arc, 4 * CACHE)
        for k, (a, b, c) in enumerate(merges):
            self._gadget(k, a, b, c)
        self.arcs = Remembered(self._has_arc, 4 * CACHE)
        # tokens as paths of base symbols, in a trie
        path: dict[int, tuple[int, ...]] = {}
        for a, b, c in merges:
            path[c] = path.get(a, (a,)) + path.get(b, (b,))
        self.length = [len(path.get(t, (t,))) for t in range(self.size)]
        self.below: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for t in range(self.size):
            if self.target[t] >= 0:
                node = 0
                for s in path.get(t, (t,)):
                    if s not in self.below[node]:
                        self.below[node][s] = len(self.below)
                        self.below.append({})
                        self.token_at.append(-1)
                    node = self.below[node][s]
                if self.token_at[node] >= 0:
                    raise ValueError("two tokens are of the same symbols")
                self.token_at[node] = t
        self.reset()

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        state = self.target[a]
        if state < 0 or self.target[b] < 0 or not self._has_arc(state * self.size + b):
            return  # a and b never stand side by side when this merge is due
        onward = state if a == b else self.target[b]
        self.target[a] = len(self.owner)
        self.owner.append(a)
        self.state_age.append(k)
        self.ages[a].append(k)
        self.copies[a].append(self.target[a])
        self.cut_at[a * self.size + b] = k
        self.target[c], self.first[c], self.follows[c], self.token_age[c] = onward, onward, a, k

    def _has_arc(self, key: int) -> bool:
        """Whether a state has an arc of a token (``key``: state times tokens plus token): what is younger is traced back to
        what it was made from."""
        s, t = divmod(key, self.size)
        if self.target[t] < 0:
            return False
        while s or self.follows[t] >= 0:
            if self.token_age[t] >= self.state_age[s]:
                t = self.follows[t]
                continue
            a = self.owner[s]
            if self.cut_at.get(a * self.size + t, self.state_age[s] + 1) <= self.state_age[s]:
                return False
            older = bisect_right(self.ages[a], self.token_age[t])  # the copies of that token's state up to when t came
            s = self.copies[a][older - 1] if older else self.first[a]
        return True

    def reset(self) -> None:
        """Forget the determinised states but the first."""
        self.inside: list[tuple[int, ...]] = [(0,)]  # of each, the numbers (trie node times states plus state)
        self.number = {self.inside[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _move(self, at: int, symbol: int) -> tuple[int, int]:
        states, below, arcs = len(self.owner), self.below, self.arcs
        pending, ended = [], -1
        for place in self.inside[at]:
            node, state = divmod(place, states)
            node = below[node].get(symbol)
            if node:
                token = self.token_at[node]
                if ended < 0 and token >= 0 and arcs[state * self.size + token]:
                    ended = token
                if below[node]:
                    pending.append(node * states + state)
        if ended < 0:
            raise ValueError(f"symbol {symbol} is not in the vocabulary")
        pending.append(self.target[ended])
        key = tuple(pending)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.inside)
            self.inside.append(key)
            self.moves.append({})
        move = self.moves[at][symbol] = to, ended
        return move

    def encode(self, symbols: list[int]) -> list[int]:
        """The tokens of a word given by its base symbols."""
        if len(self.inside) >= CACHE:
            self.reset()
            self.arcs.turn()
        at, last, moves = 0, [], self.moves
        for s in symbols:
            move = moves[at].get(s) or self._move(at, s)
            at = move[0]
            last.append(move[1])
        out, k = [], len(last)
        while k:
            out.append(last[k - 1])
            k -= self.length[last[k - 1]]
        return out[::-1]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Texts to (ids, labels) by a tokenizers file of words with an end mark; the library only normalises and splits."""

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "ignore_merges") if model.get(k)]
        if (model["type"] != "BPE" or odd or normal != ["NFC", "Replace", "Lowercase"] or len(steps) != 2 or steps[1]["type"] != "ByteLevel"
                or steps[1]["use_regex"] or steps[0].get("behavior") != "Removed" or not steps[0].get("invert") or spec.get("decoder")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])):
            raise ValueError("not a tokenizer of lower-case words over bytes")
        self.library = Tokenizer.from_file(tokenizer_file)
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.label = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t for t, i in self.added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_letters()
        self.byte_of = {ord(c): b for b, c in letters.items()}
        missing = [c for c in letters.values() if c not in vocab or c + end not in vocab]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton([self.label.get(i, "") for i in range(max(self.label) + 1)],
                                        [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        # texts of these characters alone compose with nothing and lower one by one; the pattern's classes are listed for them
        plain = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028))]
        listed = {k: "".join(re.escape(c) for c in plain if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}")}
        self.plain = re.compile("[\0-\x1b\x20-\u024f\u2010-\u2027]*").fullmatch
        self.words = re.compile(re.sub(r"\\p\{[LN]\}", lambda m: listed[m[0]], steps[0]["pattern"]["Regex"])).findall
        # (ids, labels), a space after each: of words, of lowered chunks of plain texts, of other texts' chunks
        self.of_word = Remembered(self._word)
        self.of_plain = Remembered(lambda chunk: self._joined([w.encode() for w in self.words(chunk)]))
        self.of_other = Remembered(self._other)

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        ids = self.automaton.encode([*map(self.symbol.__getitem__, word[:-1]), self.last[word[-1]]])
        return "".join([f"{i} " for i in ids]).encode(), "".join([self.label[i] + " " for i in ids]).encode()

    def _joined(self, words: list[bytes]) -> tuple[bytes, bytes]:
        if len(words) == 1:
            return self.of_word[words[0]]
        got = [self.of_word[w] for w in words]
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got])

    def _other(self, chunk: str) -> tuple[bytes, bytes]:
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return self._joined([bytes(map(self.byte_of.__getitem__, map(ord, w))) for w, _ in split if w])

    def _segment(self, text: str) -> list[tuple[bytes, bytes]]:
        if self.plain(text):
            return list(map(self.of_plain.__getitem__, text.lower().split()))
        return list(map(self.of_other.__getitem__, CHUNKS(text)))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The decimal ids joined by a space, and their labels joined by a space (the decoded text) in UTF-8."""
        if self.specials and any(s in text for s in self.added):
            got = list(chain.from_iterable(
                [(f"{self.added[part]} ".encode(), f"{part} ".encode())] if part in self.added else self._segment(part)
                for part in self.specials.split(text) if part))
        else:
            got = self._segment(text)
        for table in (self.of_word, self.of_plain, self.of_other):
            table.turn()
        return b"".join([g[0] for g in got])[:-1], b"".join([g[1] for g in got])[:-1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs that the ids name; ids without a label say nothing."""
        return " ".join([self.label[i] for i in ids if i in self.label])


@lru_cache(maxsize=2)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One automaton for each worker process."""
    return WordEncoder(tokenizer_file)


def automaton_bpe(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids`` of each whole text and ``decoded`` (their labels), with the id column.

    A null text counts as empty (no ids, empty decoded text); ids of documents may be of any type, null or repeated: each row
    is encoded by itself. The strings of added tokens are those tokens. Other columns do not matter; an empty table gives an
    empty result; very long texts are encoded whole. No shuffle: a worker holds one automaton and its tables of bounded size.
    """
    def run(keys, texts):
        coder = word_encoder(tokenizer_file)
        got = [coder.encode(t or "")[0] for t in texts]
        ids = [[int(i) for i in g.split()] for g in got]
        return {"id": keys, "ids": ids, "decoded": [coder.decode(i) for i in ids]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def automaton_bpe_digest(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space) and ``decoded_sha256`` of each text; else as
    ``automaton_bpe``, whose ids and texts are digested in the worker instead of leaving it."""
    def run(keys, texts):
        coder = word_encoder(tokenizer_file)
        n, ids_sha, decoded_sha = [], [], []
        for t in texts:
            ids, decoded = coder.encode(t or "")
            n.append(ids.count(b" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded).hexdigest())
        return {"id": keys, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
