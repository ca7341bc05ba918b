"""The registered queries on the smallest tables against brute force."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def answer(spark, name, key):
    got = entry.queries()[name](spark, FOLDER).collect()
    by = {r[key]: r for r in got}
    assert len(by) == len(got)
    return by


def test_op1(spark, rows):
    from test_dedup import brute_components, word_sets

    got, want, sizes = answer(spark, "op1_near_dedup", "doc_id"), brute_components(rows), word_sets(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sizes[i][0]) and r.kept == (want[i] == i) for i, r in got.items())


def test_op2(spark, rows):
    from test_dedup import brute_repeats

    assert {i: tuple(r)[1:] for i, r in answer(spark, "op2_suffix_dedup", "doc_id").items()} == brute_repeats(rows, 50)


def test_op3(spark, rows):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = answer(spark, "op3_byte_bpe", "doc_id")
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op4(spark, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = answer(spark, "op4_token_counts", "doc_id")
    for i, t in rows:
        n = len(lib.encode(t or ""))
        assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 4096)


def test_op5(spark):
    data = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    mine: dict = {}
    for r in sorted(entry.queries()["op5_hash_forest"](spark, FOLDER).collect(), key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = (x[k] * x).sum(1)
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        got = mine.pop(int(ids[k]))
        assert len(got) == 20 and all(abs(s[np.flatnonzero(ids == i)[0]] - v) < 1e-12 for i, v in got)
        hits += len(set(best) & {i for i, _ in got})
    assert not mine and hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_op6(spark, rows):
    from wayloom.llm.line_dedup import edit_distance_within

    first: dict[str, None] = {}
    by_size: dict[int, list] = {}
    got = answer(spark, "op6_line_dedup", "doc_id")
    for i, t in rows:
        left = []
        for s in t.split("\n"):
            if len(s) >= 20:
                if s in first or any(edit_distance_within(u, s, 2) for n in range(len(s) - 2, len(s) + 3) for u in by_size.get(n, [])):
                    gone = True
                else:
                    gone = False
                if s not in first:
                    first[s] = None
                    by_size.setdefault(len(s), []).append(s)
                if gone:
                    continue
            left.append(s)
        text = "\n".join(left)
        assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest(), i
        assert got[i].lines_removed == len(t.split("\n")) - len(left)


def test_op7(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, start = answer(spark, "op7_token_files", "doc_id"), 0
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark, rows):
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    got = answer(spark, "op8_quality", "doc_id")
    assert set(got) == {i for i, _ in rows} and all(r.predicted == int(r.score >= 0.3) for r in got.values())
    right = [r.predicted == labels[i] for i, r in got.items() if r.held_out and i in labels]
    assert right and np.mean(right) >= 0.85


def test_op9(spark):
    pages = duckdb.connect().execute(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall()
    got = answer(spark, "op9_main_text", "page_id")
    for i, page in pages:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        text = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks) if x)
        assert got[i].text == text and got[i].n_chars == len(text)


def test_op10(spark):
    from oracle import compare, duck

    problem, _, _, _ = compare(spark, duck(FOLDER), FOLDER, entry.queries()["op10_decontamination"], entry.oracle_sql()["op10_decontamination"])
    assert problem is None, problem


def test_op11(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = answer(spark, "op11_merge_automaton", "doc_id")
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op12(spark):
    from test_exact import whitened_directly

    data = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.floor(64 * np.array([v for _, v in data], np.float64)).astype(np.int64) + 1_000_000
    want, explained, deviation, n = whitened_directly(x)
    got = {(r.vec_id, r.component): r for r in entry.queries()["op12_whitening"](spark, FOLDER).collect()}
    assert len(got) == 16 * len(data)
    for c in range(16):
        mine = np.array([got[i, c + 1].whitened for i, _ in data])
        assert np.abs(mine * np.sign((mine * want[:, c]).sum()) - want[:, c]).max() < 1e-8
    for (i, _), d in zip(data, deviation):
        assert all(got[i, c + 1].deviation == d and got[i, c + 1].n == n and got[i, c + 1].identity_error < 1e-4
                   and abs(got[i, c + 1].explained / explained[c] - 1) < 1e-6 for c in range(16))


def test_op13(spark):
    from oracle import compare, duck

    problem, n, _, _ = compare(spark, duck(FOLDER), FOLDER, entry.queries()["op13_hard_negatives"], entry.oracle_sql()["op13_hard_negatives"])
    assert problem is None and n, problem


def test_densities_without_article_elements():
    """Without the elements and with other class names, length, links, stop words and neighbours have to find the text."""
    from collections import Counter

    from wayloom.llm.html_main import main_text

    right = extra = missed = 0
    for (page,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        bare = re.sub(r'(class|id)="[^"]*"', r'\1="x1"', re.sub(r"</?article[^>]*>", "", page))
        want, got = (Counter(t.split("\n") if t else []) for t in (main_text(page), main_text(bare)))
        size = lambda blocks: sum(len(t) * n for t, n in blocks.items())
        right, extra, missed = right + size(want & got), extra + size(got - want), missed + size(want - got)
    assert right / (right + extra) > 0.98 and right / (right + missed) > 0.75
