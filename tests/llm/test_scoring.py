import random
import re
import zlib

import numpy as np
import pytest

from wayloom.llm import decontaminate, hash_forest, html_main, quality

# -- quality -------------------------------------------------------------------------------------------------------------


def sample(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        lines = []
        for _ in range(r.randint(1, 6)):
            words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(4, 15))]
            lines.append(" ".join(words).capitalize() + "." if good else " | ".join(w + "###" for w in words))
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return rows, labels


def brute_marginals(model, x):
    """All labelings of a document."""
    import itertools

    total, good = 0.0, np.zeros(len(x))
    for y in itertools.product((0, 1), repeat=len(x)):
        s = model.first[y[0]] + sum(model.change[a, b] for a, b in zip(y, y[1:])) + sum((x[k] @ model.w) * y[k] for k in range(len(x)))
        total += np.exp(s)
        good += np.exp(s) * np.array(y)
    return good / total


def test_marginals_equal_all_labelings():
    r = np.random.default_rng(1)
    model = quality.LineCRF(r.normal(size=4), r.normal(size=(2, 2)), r.normal(size=2))
    docs = [r.normal(size=(n, 4)) for n in (3, 1, 5, 5, 2)]
    for got, x in zip(model.marginals(docs), docs):
        assert np.allclose(got, brute_marginals(model, x))


def test_quality_held_out(spark, docs):
    rows, labels = sample(300, 1)
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "word " * 40_000), (0, rows[0][1])]
    table = spark.createDataFrame(labels + [(2000, 1), (0, 1)], "doc_id bigint, quality int").unionAll(spark.createDataFrame([(1, None)], "doc_id bigint, quality int"))
    got = quality.scored(docs(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300)) and not by[None].held_out
    out = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert len(out) > 30 and np.mean([p == y for p, y in out]) > 0.95
    assert by[1000].score == by[1001].score
    assert quality.scored(docs([]), table).count() == 0
    none = quality.scored(docs(rows[:5]), table.filter("false")).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)


def test_quality_labels_of_held_out_rows_are_not_used(spark, docs):
    rows, labels = sample(120, 2)
    wrong = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in quality.scored(docs(rows), spark.createDataFrame(t, "doc_id bigint, quality int")).collect()) for t in (labels, wrong))
    assert a == b


# -- pages ---------------------------------------------------------------------------------------------------------------

LONG = "The roads of the town are on the map, and it is not for us to say that they were drawn by the hand of one who has seen them."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>{LONG}";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- <p>{LONG}</p> --><div class="cookie notice">{LONG}</div>
<article><h1>Title &amp; more</h1><p>{LONG}<p>Short&nbsp;one.<br>Next   line</p><div class="share">Share {LONG}</div><form><p>{LONG}</p></form>
<p><b>bold <i>text</i>  &#233;&lt;b&gt;</b></p></article><aside><p>{LONG}</p></aside><section id="comments"><p>{LONG} I think.</p></section><footer>&copy; x</footer></body></html>"""


def test_page_article():
    assert html_main.main_text(PAGE).split("\n") == ["Title & more", LONG, "Short one. Next line", "bold text é<b>"]


def test_page_without_article():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><p>{LONG * 2}</p><p>Short.</p><p>{LONG}</p><ul><li><a href=3>more of the same and so on</a></li></ul></body>"
    assert html_main.main_text(page).split("\n") == [LONG * 2, "Short.", LONG]


def test_page_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p"), (1, "u", PAGE), (4, "x", "<article><p>" + "word " * 50_000 + "</article>"),
            (5, "y", "<script>never closed <p>text"), (6, "z", "a < b <p title=\">\">c</p> <!-- open")]
    got = html_main.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as id", "2 as text")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[2] == by[None] == by[3] == by[5] == "" and len(by[4]) == 249_999
    assert html_main.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# -- test items ----------------------------------------------------------------------------------------------------------


def brute_items(rows, items, percent=80):
    def sets(t):
        w = [x for x in re.split("[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    mine = {}
    for i, t in rows:
        mine.setdefault(i, set()).update(sets(t))
    out = {}
    for i, have in mine.items():
        held = {j for j, t in items if j is not None and sets(t) and 100 * len(have & sets(t)) >= percent * len(sets(t))}
        out[i] = (len(held), min(held) if held else None, bool(held))
    return out


def test_contamination_equals_all_pairs(spark, docs):
    r = random.Random(4)
    vocab = ["v%d" % k for k in range(400)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([2, 4, 5, 8, 20, 40, 60])))) for k in range(40)]
    items += [(100, items[4][1]), (101, None), (102, ""), (None, "v1 v2 v3 v4 v5 v6"), (4, items[4][1])]
    rows = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 30, 400]))]
        for _ in range(r.randint(0, 2)):
            part = r.choice(items)[1]
            part = (part or "").split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if part:
                    part[r.randrange(len(part))] = "edit"
            at = r.randint(0, len(w))
            w[at:at] = part
        rows.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    rows += [(500, None), (501, ""), (502, items[0][1]), (None, items[5][1]), (3, items[6][1]), (503, "x " * 100_000 + items[7][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as id", "2 as h")
    got = decontaminate.contamination(docs(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "h"), bench).collect()
    assert {r.doc_id: (r.n_items, r.first_item, r.contaminated) for r in got} == brute_items(rows, items)
    assert sum(r.contaminated for r in got) > 20
    left = decontaminate.without_contaminated(docs(rows), bench)
    want = brute_items(rows, items)
    assert sorted((r.doc_id or -1) for r in left.collect()) == sorted((i or -1) for i, _ in rows if not want[i][2])
    assert decontaminate.contamination(docs([]), bench).count() == 0
    assert all(not r.contaminated for r in decontaminate.contamination(docs(rows), bench.filter("false")).collect())
    plan = decontaminate.contamination(docs(rows), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- vectors -------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, queries, k):
    clean = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(np.isfinite(v)) and any(v) and len(v) == 8:
            clean[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in queries:
        if q in clean:
            s = sorted(((-float((clean[q] * x).sum()), i) for i, x in clean.items() if i != q))[:k]
            out[q] = [i for _, i in s]
    return out


def vector_rows(n, seed, scale=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 8)).astype(np.float32) * (r.uniform(0.2, 3, (n, 1)) if scale else 1)
    return [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]


@pytest.mark.parametrize("scale", [False, True])
def test_forest_small_table_is_exact(spark, scale):
    rows = vector_rows(300, 2, scale)
    same = rows[7][1]
    rows += [(1000 + k, same) for k in range(40)] + [(400, None), (420, []), (440, [0.0] * 8), (460, [1.0, None] + [0.0] * 6), (480, [float("nan")] + [1.0] * 7),
                                                   (500, [float("inf")] + [1.0] * 7), (520, [1.0, 2.0]), (None, same), rows[3], rows[20]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as rep", "2 as key")
    got = hash_forest.nearest(df, df.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append(r.vec_id)
    assert mine == brute_nearest(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert [r.rank for r in got] == [k + 1 for v in mine.values() for k in range(len(v))]
    none = df.filter("false")
    assert hash_forest.nearest(none, none).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert hash_forest.nearest(few, few.filter("vec_id = 0")).count() == 2


def test_forest_recall_in_slices(spark):
    rows = vector_rows(3000, 5)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = hash_forest.nearest(df, df.filter("vec_id % 20 = 0"), k=10, trees=12, candidates=12 * 200, slice_rows=150, sample=500).collect()
    want = brute_nearest(rows, range(0, 3000, 20), 10)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.9 * 10 * 150


@pytest.mark.parametrize("n", [2000, 8000])
def test_forest_recall_holds_as_rows_grow(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    got = hash_forest.nearest(df, df.filter("vec_id % 100 = 0"), k=10, trees=8, candidates=8 * 50, slice_rows=1500).collect()
    score = x[::100].astype(float) @ x.T.astype(float)
    score[np.arange(n // 100), np.arange(0, n, 100)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :10]
    assert sum(r.vec_id in want[r.query_id // 100] for r in got) >= 0.9 * want.size


def test_forest_stops_deep_where_neighbours_share_prefixes(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(100, 24)), 20, axis=0) + r.normal(size=(2000, 24)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "rep bigint, x array<float>")
    planes = spark.sparkContext.broadcast(hash_forest.fit_planes(df, 24, 8, 20, 500))
    assert hash_forest.stop_level(df, df.filter("rep % 20 = 0"), planes, 10, 50, 0.95) >= 5
    df = df.withColumnsRenamed({"rep": "vec_id", "x": "embedding"})
    got = hash_forest.nearest(df, df.filter("vec_id % 20 = 0"), k=10, trees=8, candidates=8 * 25).collect()
    assert sum(q.vec_id // 20 == q.query_id // 20 for q in got) >= 0.9 * 10 * 100


def test_ties_between_different_vectors(spark):
    from wayloom.llm.hash_forest import nearest

    rows = [(0, [1.0, 0.0, 0.0])] + [(k, [0.0, float(k % 13 + 1), float(k)]) for k in range(1, 169)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in nearest(df, df.filter("vec_id = 0")).collect())
    assert got == [(k, k, 0.0) for k in range(1, 21)]


def test_scores_of_doubles(spark):
    from wayloom.llm.hash_forest import nearest

    df = spark.createDataFrame([(1, [0.1, 0.7]), (2, [0.3, 0.1]), (3, [1e-9 + 1, 0.0])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in nearest(df, df).collect()}
    assert got[1, 2] == 0.1 * 0.3 + 0.7 * 0.1 and got[2, 3] == 0.3 * (1e-9 + 1) and len(got) == 6
