"""Merge automaton, whitening and hard negatives against the library, exact linear algebra and brute force."""

import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from wayloom.llm import hard_negatives as H
from wayloom.llm import whitening as W
from wayloom.llm.merge_automaton import MergeAutomaton, automaton_bpe, automaton_bpe_digest, word_encoder

FILE = P.path("word_bpe_49k.json")


def merged(symbols, merges):
    """All merges one after another, each from left to right."""
    out = list(symbols)
    for a, b, c in merges:
        k = 0
        while k + 1 < len(out):
            if out[k] == a and out[k + 1] == b:
                out[k:k + 2] = [c]
            k += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_automaton_of_random_merges(seed):
    r = random.Random(seed)
    merges, n, names = [], 3, ["a", "b", "c"]
    for _ in range(r.randint(0, 25)):
        a, b = r.randrange(n), r.randrange(n)
        if names[a] + names[b] not in names:
            merges.append((a, b, n))
            names.append(names[a] + names[b])
            n += 1
    machine = MergeAutomaton([str(i) for i in range(n)], merges)
    for _ in range(200):
        word = [r.randrange(3) for _ in range(r.randint(1, 30))]
        assert machine.encode(word) == merged(word, merges)


def test_two_merges_of_one_token():
    with pytest.raises(ValueError):
        MergeAutomaton(["a", "b", "c"], [(0, 1, 2), (1, 0, 2)])


ODD = ["", None, " \n\t ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>!", "<|ENDOFTEXT|>", "ΑΣ ΟΔΥΣΣΕΥΣ", "İı ẞß ﬃ Ǻ ́x",
       "a" * 3000, "ha" * 500 + "." * 777, "it's they'll I'd o'clock ''s 's", "x y z\x85w\x1cv\x00u", "漢字かな交じり文😀👩‍👩‍👧", "١٢٣ 123 ½ 3a4", "word " * 20_000]


def test_encodes_as_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(FILE)
    rows = [(k % 7 or None, t, "clash", "clash") for k, t in enumerate(ODD + ODD[:3])]
    got = automaton_bpe(spark.createDataFrame(rows, "doc_id int, text string, id string, ids string"), FILE).collect()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, lib.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, ((r.doc_id, r.ids, r.decoded) for r in got))) == sorted(map(repr, want))
    none = spark.createDataFrame([], "doc_id string, text string")
    assert automaton_bpe(none, FILE).count() == 0 and automaton_bpe_digest(none, FILE).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_tables_turn_over(monkeypatch):
    coder = word_encoder(FILE)
    texts = ["the cat sat on the mat", "other words stand here", "the cat again"]
    want = [coder.encode(t) for t in texts]
    for table in (coder.of_word, coder.of_plain):
        monkeypatch.setattr(table, "size", 2)
    monkeypatch.setattr("wayloom.llm.merge_automaton.CACHE", 4)
    for _ in range(3):
        assert [coder.encode(t) for t in texts] == want


def polynomial(roots):
    p = [1]
    for r in roots:
        p = [a - r * b for a, b in zip([0, *p], [*p, 0])]
    return p


@pytest.mark.parametrize("roots", [[5, 5, 3, 1], [7, 7, 7, 2, 2], [4], [1, 1], [10**20 + 1, 10**20, 3], [9] * 4, [8, 4, 2, 1], [16, 8, 8, 4]])
def test_roots(roots):
    got = W.largest_roots(polynomial(roots), len(roots))
    assert [round(r.value()) for r in got for _ in range(r.times)] == sorted(roots, reverse=True)
    assert all(r.bits >= W.SPARE_BITS for r in got)


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_polynomial(spark, d):
    a = np.random.default_rng(d).integers(-9, 9, (d + 1, d)).astype(object)
    a[:, d // 2] = 0  # rank below d
    m = a.T @ a
    want, power = [0] * d + [1], np.zeros((d, d), object)
    for k in range(1, d + 1):  # Faddeev and LeVerrier
        power = m.dot(power) + want[d - k + 1] * np.identity(d, int).astype(object)
        want[d - k] = -int(np.trace(m.dot(power))) // k
    assert W.characteristic_polynomial(spark, m.tolist()) == want


def whitened_directly(x):
    u = np.unique(x, axis=0)
    c = u - u.sum(0) / len(u)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    order = [k for k in np.argsort(-e) if e[k] > 1e-9 * max(e)]
    return (x - u.sum(0) / len(u)) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum(), ((len(u) * x - u.sum(0)) ** 2).sum(1), len(u)


def test_whitening(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(60, 6)).astype(np.float32)
    v[:, 4], v[:, 5] = 0.5, v[:, 0]  # a fixed and a doubled dimension: rank 4
    v[50:] = v[:10]
    bad = [(None, None, 1), (101, [1.0] * 5 + [None], 2), (102, [math.nan] + [1.0] * 5, 3), (103, [math.inf] * 6, 4), (104, [], 5), (105, [1.0, 2.0], 6)]
    rows = [(None if k == 3 else k, x.tolist(), k) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, n int").withColumnRenamed("n", "component")
    got = W.whiten(df).collect()
    x = np.floor(64 * v.astype(float)).astype(np.int64)
    want, explained, deviation, n = whitened_directly(x)
    assert want.shape[1] == 4 and len(got) == 240 and {g.n for g in got} == {n}
    assert max(g.identity_error for g in got) < 1e-12 and len({g.identity_error for g in got}) == 1
    by = {(g.vec_id, g.component): g for g in got}
    for k in range(60):
        k = None if k == 3 else k
        for c in range(4):
            g = by[k, c + 1]
            assert g.deviation == deviation[3 if k is None else k] and abs(g.explained - explained[c]) < 1e-12
            assert abs(abs(g.whitened) - abs(want[3 if k is None else k, c])) < 1e-9
    for k in range(10):  # repeated rows come out alike
        assert all(abs(by[k if k != 3 else None, c].whitened - by[50 + k, c].whitened) < 1e-12 for c in (1, 2, 3, 4))


def test_whitening_of_equal_variances_and_of_nothing(spark):
    rows = [(k, [float(a), float(b), float(c)]) for k, (a, b, c) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert len(got) == 18 and max(g.identity_error for g in got) < 1e-12 and all(abs(g.explained - 1 / 3) < 1e-15 for g in got)
    for few in ([], rows[:1], rows[:1] * 3, [(1, None)]):
        out = W.whiten(spark.createDataFrame(few, "vec_id int, embedding array<double>"))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute_negatives(rows, anchors):
    out = []
    q = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    for a in anchors:
        s = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in q if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if label[i] == label[a]][:5]:
            hits = [i for i in order if label[i] != label[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            out += [(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("dims, size", [(3, 4.0), (8, 0.6), (19, 1.0)])
def test_hard_negatives(spark, dims, size):
    r = np.random.default_rng(dims)
    rows = [(k, (np.round(r.normal(size=dims) * size * 4) / 4).tolist(), int(r.integers(0, 3)) if k % 3 else 7) for k in range(300)]
    rows[20] = (20, [0.0] * dims, 7)
    bad = [(None, rows[0][1], 1), (500, None, 1), (550, [None] * dims, 1), (600, [math.nan] * dims, 1), (650, rows[0][1], None), (700, [], 2), (750, [1.0], 2)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows + bad + rows[:40]], "vec_id bigint, embedding array<double>, label int, row string, i int")
    got = H.hard_negatives(df, "vec_id % 10 = 0", block=4, slice_rows=16).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, range(0, 300, 10))


def test_hard_negatives_of_little(spark):
    shape = "vec_id bigint, embedding array<float>, label int"
    assert H.hard_negatives(spark.createDataFrame([], shape), "true").count() == 0
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], shape), "vec_id = 2").count() == 0
    assert H.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], shape), "true").count() == 0  # no positive
    got = H.hard_negatives(spark.createDataFrame([(1, [-1.0, 2.0], 1), (2, [-1.0, 2.0], 1), (3, [-0.5, 1.5], 2)], shape), "vec_id = 1").collect()
    assert [tuple(g) for g in got] == [(1, 2, 1, 3, 5 << 16, 7 << 15)]
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([(1, [1e30], 1)], shape), "true")


def test_planes():
    x = np.random.default_rng(1).integers(-300, 300, (50, 13))
    a = np.random.default_rng(2).integers(-300, 300, (7, 13))
    planes = H.bit_planes(x, 10)
    assert (H.from_planes(planes, 13) == x).all()
    for bound in (1 << 30, 1 << 40):
        assert (H.scores(a, planes, bound) == a @ x.T).all()
