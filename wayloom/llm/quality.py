"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_text

#: Kinds of bytes whose shares of a line are features.
KINDS = ("upper", "lower", "digit", "space", "symbol", "stop", "other_mark", "high")
#: Features of a line: shares of the kinds, length, word length, share of distinct words, share of words with a symbol at
#: the end, whether an earlier line of the document is equal, whether it is blank, the share of words that repeat the word
#: before, whether that is high, whether most words are in capitals; then the mean of the same for the two neighbouring lines.
N_OWN = len(KINDS) + 9


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("other_mark"), np.uint8)
    kind[128:] = KINDS.index("high")
    for chars, name in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"abcdefghijklmnopqrstuvwxyz", "lower"), (b"0123456789", "digit"),
                        (b" \t\r\n\x0b\x0c", "space"), (b"#$%&*+/<=>@\\^_`{|}~", "symbol"), (b".,;:?!'\"()-", "stop")):
        kind[list(chars)] = KINDS.index(name)
    return kind


_KIND = _kinds()
_TAIL = frozenset("#$%&*+/<=>@\\^_`{|}~!")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x 2*N_OWN+1) and weights (bytes + 1) of the lines of a text; an empty text has one empty line."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    n = len(ends)
    x = np.zeros((n, N_OWN), np.float64)
    kind = _KIND[raw]
    for k in range(len(KINDS)):
        c = np.append(0, np.cumsum(kind == k))
        x[:, k] = c[ends] - c[starts]
    x[:, : len(KINDS)] /= np.maximum(size, 1)[:, None]
    k = len(KINDS)
    x[:, k] = np.log1p(size) / 8
    seen: set[str] = set()
    for j, line in enumerate(text.split("\n")):
        words = line.split()
        if words:
            x[j, k + 1] = min(len(line) / len(words), 40) / 10
            x[j, k + 2] = len(set(words)) / len(words)
            x[j, k + 3] = sum(w[-1] in _TAIL for w in words) / len(words)
            x[j, k + 4] = line in seen
            seen.add(line)
            x[j, k + 6] = sum(map(str.__eq__, words, words[1:])) / len(words)
            x[j, k + 8] = sum(map(str.isupper, words)) > len(words) / 2
        x[j, k + 5] = not words
    x[:, k + 7] = x[:, k + 6] > 0.1
    near = np.zeros_like(x)
    if n > 1:
        near[1:-1] = (x[:-2] + x[2:]) / 2
        near[0], near[-1] = x[1], x[-2]
    return np.hstack([np.ones((n, 1)), x, near]), size + 1.0


@dataclass
class LineCRF:
    """Weights: of the features for a good line, of the change scores [bad, good] x [bad, good], of the first line."""

    w: np.ndarray
    change: np.ndarray
    first: np.ndarray

    def marginals(self, lines: list[np.ndarray], pairs: bool = False):
        """The probability of ``good`` of each line of each document; with ``pairs`` also sums that training needs."""
        order = np.argsort([-len(x) for x in lines], kind="stable")
        sizes = np.array([len(lines[i]) for i in order])
        top = sizes[0]
        active = np.searchsorted(-sizes, -np.arange(top), side="left")  # documents with a line t come first
        e = np.concatenate([lines[i] for i in order]) @ self.w
        at = np.append(0, np.cumsum(sizes))[:-1]
        fwd = np.zeros((len(e), 2))
        bwd = np.zeros((len(e), 2))

        def total(a):
            m = a.max(-1, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(-1, keepdims=True)))[..., 0]

        fwd[at] = self.first
        fwd[at, 1] += e[at]
        for t in range(1, top):
            k = active[t]
            here = at[:k] + t
            fwd[here] = total((fwd[here - 1][:, :, None] + self.change).transpose(0, 2, 1))
            fwd[here, 1] += e[here]
        for t in range(top - 2, -1, -1):
            k = active[t + 1]
            here = at[:k] + t
            after = bwd[here + 1].copy()
            after[:, 1] += e[here + 1]
            bwd[here] = total(after[:, None, :] + self.change)
        z = np.repeat(total(fwd[at + sizes - 1]), sizes)
        good = np.exp(fwd[:, 1] + bwd[:, 1] - z)
        if not pairs:
            out: list = [None] * len(lines)
            for i, a, n in zip(order, at, sizes):
                out[i] = good[a:a + n]
            return out
        inner = np.ones(len(e), bool)
        inner[at] = False
        here = np.flatnonzero(inner)
        after = bwd[here].copy()
        after[:, 1] += e[here]
        both = np.exp(fwd[here - 1][:, :, None] + self.change + after[:, None, :] - z[here][:, None, None])
        return order, sizes, at, good, both


def train_crf(lines: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.1, l2: float = 1e-4) -> LineCRF:
    """Weights that make the documents' labels, held by every line, likely (penalised log-likelihood, Adam, fixed start)."""
    every = np.concatenate(lines)
    mid, spread = every.mean(0), every.std(0)
    mid[0], spread[0] = 0, 1
    spread[spread < 1e-6] = 1
    lines = [(x - mid) / spread for x in lines]
    y_doc = np.array(labels)
    share = np.array([1 / np.sqrt(len(x)) for x in lines])  # long documents count for more, but not by all their lines
    share /= share @ np.array([len(x) for x in lines])
    model = LineCRF(np.zeros(every.shape[1]), np.zeros((2, 2)), np.zeros(2))
    params = [model.w, model.change, model.first]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        order, sizes, at, good, both = model.marginals(lines, pairs=True)
        if step == 1:
            y, weight, x = np.repeat(y_doc[order], sizes), np.repeat(share[order], sizes), np.concatenate([lines[i] for i in order])
            inner = np.delete(weight, at)
            wanted = np.zeros((2, 2))
            for label in (0, 1):
                wanted[label, label] = inner[np.delete(y, at) == label].sum()
            held = np.array([weight[at][y[at] == label].sum() for label in (0, 1)])
        start = np.array([(weight * (1 - good))[at].sum(), (weight * good)[at].sum()])
        slopes = [x.T @ (weight * (y - good)) - l2 * model.w, wanted - (both * inner[:, None, None]).sum(0) - l2 * model.change,
                  held - start - l2 * model.first]
        for p, g, m, v in zip(params, slopes, mean, var):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = model.w / spread
    w[0] -= (model.w / spread) @ mid
    return LineCRF(w, model.change, model.first)


def held_out(id_col: str = "doc_id"):
    """Documents that no label is learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_lines: int = 500, id_col: str = "doc_id", text_col: str = "text") -> LineCRF:
    """A model from at most ``sample`` labelled documents that are not held out, picked by a hash of their ids.

    Every line carries its document's label. Of a document of more than ``most_lines`` lines, so many in a row are learned
    from, beginning at a place that hangs on the text. Labels that are null, and labels without a document, are passed over.
    Without any label every score is 0.5. Only the sample's line features reach the driver, bounded by the two numbers.
    """
    picked = labels.filter(F.col("quality").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)  # bounded by ``sample``

    def run(ids, texts):
        out = []
        for t in texts:
            lines = line_features(t or "")[0].astype("<f4")
            begin = zlib.crc32((t or "").encode()) % max(1, len(lines) - most_lines + 1)
            out.append(lines[begin:begin + most_lines].tobytes())
        return {"id": ids, "x": out}

    feats = map_text(rows.select(F.struct(id_col, "quality").alias("k"), text_col), "k", text_col, run,
                     f"id struct<{id_col}:{docs.schema[id_col].dataType.simpleString()},quality:int>, x binary")
    got = sorted(((r.id[0], r.id[1], bytes(r.x)) for r in feats.collect()), key=lambda r: (r[0], r[2]))
    width = 2 * N_OWN + 1
    if not got:
        return LineCRF(np.zeros(width), np.zeros((2, 2)), np.zeros(2))
    return train_crf([np.frombuffer(x, "<f4").reshape(-1, width).astype(np.float64) for _, _, x in got], [int(q > 0) for _, q, _ in got])


def quality_scores(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of each whole text.

    The score is the mean over lines of the probability of ``good`` given all lines (forward and backward sums), weighted
    by line length. A null text counts as empty: one empty line, scored like any other. Null ids are kept and not held
    out; repeated rows come out repeated; other columns do not matter.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        feats = [line_features(t or "") for t in texts]
        good = kept.value.marginals([f for f, _ in feats])
        score = [float(np.clip((g * w).sum() / w.sum(), 0, 1)) for g, (_, w) in zip(good, feats)]
        return {"id": ids, "score": score}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs, id_col, text_col, run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame, sample: int = 3000, **names) -> DataFrame:
    """``fit_quality`` and ``quality_scores`` in one."""
    return quality_scores(docs, fit_quality(docs, labels, sample, **names), **names)
