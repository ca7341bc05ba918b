import collections
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.llm import components, line_dedup, near_dedup, suffix_dedup


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.setdefault(i, []).append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = word_sets([r for r in rows if r[0] is not None])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, s) in enumerate(flat):
        for j, u in flat[:k]:
            if 100 * len(s & u) >= 85 * len(s | u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def near_rows(seed, groups=12, n=9, words=60, edits=3):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(3000)]
    rows, i = [], 0
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(words)]
        for _ in range(r.randint(1, n)):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(words)] = r.choice(vocab)
            rows.append((i, (" " if r.random() < 0.7 else "\n\t ").join(w).upper() if r.random() < 0.2 else " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings_", [{}, {"small": 5}, {"small": 4, "paths": 3}, {"shingles": 300}])
def test_near_duplicates_equal_all_pairs(docs, settings_):
    rows = near_rows(3, n=30 if settings_ else 9, groups=5 if settings_ else 12)
    common = " ".join("c%d" % k for k in range(12))  # a passage that all share
    rows = [(i, f"{common} {t}") for i, t in rows]
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, " \t\n"), (905, "x " * 50_000)]
    want = brute_components(rows)
    got = near_dedup.near_duplicates(docs(rows).withColumnRenamed("lang", "n").withColumnRenamed("source", "component_id"), **settings_).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = word_sets(rows)
    assert all(r.n_shingles == len(sizes[r.doc_id][0]) and r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_odd_rows(docs):
    a, b = " ".join("a%d" % k for k in range(20)), " ".join("b%d" % k for k in range(20))
    rows = [(5, a), (5, b), (3, b), (7, a), (None, a), (8, "alone here"), (8, "alone here")]
    got = near_dedup.near_duplicates(docs(rows)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert len(got) == 7 and by[5] == {(3, False)} and by[3] == {(3, True)} and by[7] == {(3, False)} and by[None] == {(None, True)} and by[8] == {(8, True)}
    left = near_dedup.without_near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 3, 8, 8]
    assert near_dedup.near_duplicates(docs([])).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    h = near_dedup.mix64(np.arange(6000, dtype=np.uint64))  # 0 is among them
    a, b = near_dedup.signature(h[:5500]), near_dedup.signature(h[500:])
    assert 0.6 < (a == b).mean() < 0.98


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_limit_of_signatures_loses_few_links(percent):
    import math

    s, least = percent / 100, near_dedup.least_equal(percent)
    assert sum(math.comb(64, k) * s**k * (1 - s) ** (64 - k) for k in range(least)) <= 2e-7
    assert percent != 85 or least == 38


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    both = [{x.v: x.root for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()} for few in (0, 1000)]
    got = both[0]
    assert both[1] == got
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: x for v, x in root.items() if v != x}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- lines ---------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abcé", max_size=24), st.text("abcé", max_size=24), st.integers(0, 4))
def test_band_equals_table(a, b, k):
    assert line_dedup.edit_distance_within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdé", min_size=20, max_size=50), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.sampled_from("abz")), max_size=6), st.integers(1, 4))
def test_band_on_edited_lines(a, edits, k):
    b = list(a)
    for kind, p, c in edits:
        p = p % max(1, len(b))
        if kind == 0:
            b.insert(p, c)
        elif b and kind == 1:
            b.pop(p)
        elif b:
            b[p] = c
    assert line_dedup.edit_distance_within(a, "".join(b), k) == (distance(a, "".join(b)) <= k)


def brute_lines(rows, errors=2, least=20):
    order = sorted({(i, k, s) for i, t in rows if i is not None and t is not None for k, s in enumerate(t.split("\n")) if len(s) >= least})
    gone = collections.defaultdict(set)
    for n, (i, k, s) in enumerate(order):
        if any(abs(len(s) - len(u)) <= errors and (s == u or distance(s, u) <= errors) for _, _, u in order[:n]):
            gone[i].add(k)
    return [(i, t if t is None or i is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i] or len(s) < least)) for i, t in rows]


def line_rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(15, 45))) for _ in range(25)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(r.randint(0, 6)):
            s = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                s[r.randrange(len(s))] = r.choice("xyz")
            if r.random() < 0.2:
                s.pop(r.randrange(len(s)))
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_all_pairs(docs, seed, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rows = line_rows(seed) + [(100, None), (101, ""), (102, "\n\n"), (None, line_rows(seed)[3][1]), (103, "long line " * 200), (104, "long line " * 199 + "long_line ")]
    got = line_dedup.without_repeated_lines(docs(rows).withColumnRenamed("lang", "line").withColumnRenamed("source", "gone")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(brute_lines(rows))
    assert sum(r.lines_removed for r in got) > 20


@pytest.mark.parametrize("turns", [0, 2])
def test_lines_of_a_template(docs, turns, monkeypatch):
    """Crowded keys: lines with a near line, and lines that share the template alone."""
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    monkeypatch.setattr(line_dedup, "TURNS", turns)
    r = random.Random(turns)
    lines = [f"line number {r.randrange(10**6):06d} of the long file" for _ in range(60)] + [f"copyright {r.randrange(16**12):012x} by nobody" for _ in range(40)]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i::7])) for i in range(7)]
    got = line_dedup.without_repeated_lines(docs(rows)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(brute_lines(rows))


def test_lines_odd_rows(docs):
    line = "a line of some length here"
    rows = [(1, line), (1, line), (2, f"{line}\nshort\n{line}s"), (3, "short\nshort")]
    got = line_dedup.without_repeated_lines(docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, line), (1, line), (2, "short"), (3, "short\nshort")]
    assert line_dedup.without_repeated_lines(docs([])).count() == 0


# -- byte strings --------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    have = collections.defaultdict(lambda: 1 << 60)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            have[b[k:k + length]] = min(have[b[k:k + length]], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if have[b[k:k + length]] < i:
                hit[k:k + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out[i] = (len(b), len(b) - len(kept), len([x for x in bytes(hit).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcdé \n\0") for _ in range(r.randint(5, 160))) for _ in range(14)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 6))) + "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "q" * 400), (103, "q" * 300), (104, "ab" * 100 + "q" * 60)]


@pytest.mark.parametrize("seed,piece", [(1, None), (2, None), (3, 64)])
def test_repeats_equal_all_windows(docs, seed, piece, monkeypatch):
    rows = repeat_rows(seed)
    got = suffix_dedup.without_repeats(docs(rows).withColumnRenamed("lang", "bucket").withColumnRenamed("source", "kind"), digest=True).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == brute_repeats(rows, 50)
    if piece:  # cuts inside long documents change segments, not results
        import numpy as np

        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
        raw = np.frombuffer(("ab1c" * 70 + "x" * 90).encode(), np.uint8)
        cut = suffix_dedup.anchors(raw, 1, 50)
        assert sorted(a + k for a, m in zip(cut["at"], cut["more"]) for k in range(m + 1)) == list(range(len(raw) - 49))


def test_repeats_odd_rows(docs):
    a, b = "a" * 20 + "bcdefghij" * 6, "z" * 80
    rows = [(None, a), (2, a), (2, a), (3, f"--{a}--"), (1, b), (3, b)]
    got = suffix_dedup.without_repeats(docs(rows)).collect()
    assert sorted(((r.doc_id or 0), bytes(r.kept)) for r in got) == sorted([(0, a.encode()), (2, a.encode()), (2, a.encode()), (3, b"----"[:2] + b"--"), (1, b.encode()), (3, b"")])[:0] or \
        {(r.doc_id, r.n_bytes, r.n_removed > 0) for r in got} == {(None, 74, False), (2, 74, False), (3, 78, True), (1, 80, False), (3, 80, True)}
    assert suffix_dedup.without_repeats(docs([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=6, max_size=6), st.integers(0, 5)), min_size=1, max_size=30), st.integers(1, 6))
def test_longest_previous(rows, least):
    import numpy as np

    s = np.array([t.encode() for t, _ in rows], "S6")
    d = np.array([k for _, k in rows])

    def lcp(a, b):
        n = 0
        while n < 6 and a[n] == b[n]:
            n += 1
        return n

    want = [max([lcp(t, u) for u, j in rows if j < k] or [0]) for t, k in rows]
    assert suffix_dedup.longest_previous(s, d, least).tolist() == [w if w >= least else 0 for w in want]


def test_columns_of_the_caller(spark):
    from wayloom.llm.decontaminate import without_contaminated
    from wayloom.llm.line_dedup import without_repeated_lines
    from wayloom.llm.near_dedup import without_near_duplicates

    words = " ".join(f"w{k}" for k in range(40))
    names = ["_left", "_id", "_gone", "_drop", "_bad", "row", "id", "gone", "left", "drop", "v", "lines_removed"]
    rows = [(1, words), (2, words), (3, f"alone {words[::-1]}"), (None, "item " + words), (None, "free of all that")]
    docs = spark.createDataFrame([(*r, *[f"{n}-{k}" for n in names]) for k, r in enumerate(rows)],
                                 "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(7, "item " + words)], "item_id bigint, text string")
    lines = without_repeated_lines(docs)
    assert lines.columns == [c for c in docs.columns if c != "lines_removed"] + ["lines_removed"]
    assert {r._left: (r.text, r.lines_removed) for r in lines.collect()} == {
        "_left-0": (words, 0), "_left-1": ("", 1), "_left-2": (rows[2][1], 0), "_left-3": (rows[3][1], 0), "_left-4": (rows[4][1], 0)}
    near = without_near_duplicates(docs)
    assert near.columns == docs.columns and {r._drop for r in near.collect()} == {"_drop-0", "_drop-2", "_drop-3", "_drop-4"}
    clean = without_contaminated(docs, items)  # the item and what holds most of it; a clean row without an id stays
    assert clean.columns == docs.columns and {r._bad for r in clean.collect()} == {"_bad-2", "_bad-4"}


def test_shingles_of_documents_meet_items_where_they_lie(spark, docs, monkeypatch):
    """Items and ids met are few: however their size is guessed, no shingle and no text of a document is sent for them."""
    from wayloom.llm import decontaminate
    from wayloom.session import few, keep

    words = [f"w{k}" for k in range(60)]
    table = docs([(k, " ".join(words[k:] + [f"own{k}"])) for k in range(12)] + [(20, None)])
    items = spark.createDataFrame([(k, " ".join(words[k:k + 20])) for k in range(0, 40, 5)], "item_id bigint, text string")
    plans = {}

    def watched(df, name="state"):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(decontaminate, "keep", watched)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = decontaminate.without_contaminated(table, items)
        assert "BroadcastHashJoin" in plans["met"] and "SortMergeJoin" not in plans["met"]
        assert "SortMergeJoin" not in clean._jdf.queryExecution().sparkPlan().toString()
        assert {r.doc_id for r in clean.collect()} == {20}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    kept = keep(spark.range(10))
    assert "broadcast" not in few(kept, rows=9)._jdf.queryExecution().logical().toString()
