import corpus_pipeline

import __spark_entry__ as entry
from wayloom.llm import quality

FOLDER = "/root/testdata/sf0.001"
OPERATORS = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_"]


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(p) for n in names) for p in OPERATORS) and "pipeline" in names


def test_stages(spark):
    """Each stage's rows against what the operators' own brute-force tests say of its input."""
    from test_dedup import brute_components, brute_lines
    from test_scoring import brute_items
    from wayloom.llm.byte_bpe import coder
    import public_tokenizers as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = [f for _, f in corpus_pipeline.STAGES]
    rows = {r.doc_id: r for r in docs.collect()}
    good = stage[0](spark, docs, FOLDER)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = {r.doc_id for r in docs.filter(quality.held_out()).collect()}
    kept = {r.doc_id: r for r in good.collect()}
    judged = [i for i in labels if i in held and i in rows]
    assert sum((i in kept) == bool(labels[i]) for i in judged) >= 0.9 * len(judged)
    assert all(kept[i] == rows[i] for i in kept)

    some = spark.createDataFrame(sorted(kept.values(), key=lambda r: len(r.text))[:90], docs.schema)
    lines = stage[1](spark, some, FOLDER).collect()
    want = brute_lines([(r.doc_id, r.text) for r in some.collect()])
    before = {r.doc_id: r.text for r in some.collect()}
    assert {r.doc_id: r.text for r in lines} == {i: t for i, t in want if t == before[i] or t.strip()}

    some = spark.createDataFrame(lines, docs.schema)
    first = stage[2](spark, some, FOLDER).collect()
    groups = brute_components([(r.doc_id, r.text) for r in lines])
    assert {r.doc_id for r in first} == set(groups.values())

    some = spark.createDataFrame(first, docs.schema)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = stage[3](spark, some, FOLDER).collect()
    held_items = brute_items([(r.doc_id, r.text) for r in first], items)
    assert {r.doc_id for r in clean} == {i for i, x in held_items.items() if not x[2]}

    ids = stage[4](spark, spark.createDataFrame(clean, docs.schema), FOLDER).collect()
    c = coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: (r.ids, r.decoded) for r in ids} == {r.doc_id: (c.encode(r.text), r.text) for r in clean}


def test_odd_rows_go_through(spark, docs):
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    for t in ("labels", "benchmark"):
        shutil.copy(f"{FOLDER}/{t}.parquet", folder)
    text = "The cat and the dog are on the road to the town, and it is not far for them to go there."
    odd = docs([(1, text), (1, text), (2, text + " Or so."), (3, None), (4, ""), (None, text), (5, text + "\n" + "word " * 30_000)])
    for rows in (odd, odd.filter("false")):
        now = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{folder}/{rows is odd}-{k}"
            stage(spark, now, folder).write.parquet(path)
            now = spark.read.parquet(path)
        assert now.columns == ["doc_id", "n_tokens", "ids", "decoded"]
        if rows is not odd:
            assert now.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 50


def brute_groups(rows, percent):
    """First ids of the groups of links of ``percent``, from all pairs."""
    from test_dedup import word_sets

    sets = {i: s[0] for i, s in word_sets(rows).items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return set(root.values())


def test_near_copies_of_080_go(spark, docs):
    words = ["g%d" % k for k in range(400)]
    rows = [(0, " ".join(words))]
    for k, edits in enumerate((4, 6, 7, 8, 9, 10, 14), 1):  # each changes five shingles of 396
        w = ["h%d-%d" % (k, x) for x in range(400)] if k == 7 else list(words)
        for e in range(edits):
            w[20 + 30 * e if edits < 12 else 5 + 20 * e] = f"edit{k}-{e}"
        rows.append((k, " ".join(w)))
    want = brute_groups(rows, 80)
    assert want != brute_groups(rows, 85)
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs(rows), FOLDER).collect()} == want
