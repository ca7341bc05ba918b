"""Near-copies of lines across documents: a segment-partition join under an edit distance."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, keep_counted
from .batches import Rolling, by_group, hash_part, map_text, mix64
from .dealing import bucket_count, drop_spent, packed, unpacked

#: Lines of a segment group that one task compares with as many others; larger groups are dealt in blocks.
BLOCK = 400
#: Times that a crowded group is dealt anew before what is left is compared with all of it.
TURNS = 3
ENTRY = np.dtype([("key", "<i8"), ("line", "<i8")])
_rolling = Rolling(77)


def line_id(line: str) -> int:
    """62-bit hash of a line."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8")) >> 2


def segments(length: np.ndarray, errors: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of ``errors`` + 1 nearly equal segments of lines of these lengths; later ones are longer."""
    base, extra = length // (errors + 1), length % (errors + 1)
    out, at = [], np.zeros_like(length)
    for i in range(errors + 1):
        size = base + (i >= errors + 1 - extra)
        out.append((at, size))
        at = at + size
    return out


def segment_keys(lines: list[str], errors: int, least: int) -> np.ndarray:
    """Entries of the lines: keys of their own segments, and of the substrings that may equal a segment of a shorter or equal line.

    A line within ``errors`` edits of another has a substring equal to one of its segments, near the segment's place: the
    i-th segment moves by at most i places counted from the left and, given the length difference, from the right. The
    lowest bit of ``line`` tells a line's own segment (1) from a substring (0).
    """
    size = np.array([len(s) for s in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = _rolling.sums_of(codes)
    begin = np.append(0, np.cumsum(size))[:-1]
    ident = np.array([line_id(s) for s in lines], np.int64)
    keys, names = [], []

    def add(some, length, i, start, width, role):
        with np.errstate(over="ignore"):
            h = _rolling.between(sums, start, start + width) + (length * 64 + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(mix64(h).view(np.int64))
        names.append(ident[some] * 2 + role)

    for shorter in range(errors + 1):
        length = size - shorter
        for i, (at, width) in enumerate(segments(length, errors)):
            if shorter == 0:
                add(slice(None), length, i, begin + at, width, 1)
            lo = np.maximum(np.maximum(at - i, at + shorter - (errors - i)), 0)
            hi = np.minimum(np.minimum(at + i, at + shorter + (errors - i)), size - width)
            for step in range(2 * errors + 1):
                some = np.flatnonzero((lo + step <= hi) & (length >= least))
                if len(some):
                    add(some, length[some], i, begin[some] + lo[some] + step, width[some], 0)
    out = np.empty(sum(map(len, keys)), ENTRY)
    out["key"], out["line"] = np.concatenate(keys), np.concatenate(names)
    return out


def edit_distance_within(a: str, b: str, errors: int) -> bool:
    """Whether at most ``errors`` edits of single characters turn ``a`` into ``b``, by bit-parallel steps in a diagonal band.

    Bit vectors hold the vertical differences of the 2*errors+1 cells around the diagonal; the band moves down a row with
    each character of ``b``.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > errors:
        return False
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a:  # equal ends cost nothing
        n = min(64, hi_a - lo)
        if a[lo:lo + n] == b[lo:lo + n]:
            lo += n
        elif n == 1 or a[lo] != b[lo]:
            break
        else:
            lo += 1
    while hi_a > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    m, n, k = len(a), len(b), errors
    if m <= k:
        return _plain(a, b) <= k
    at: dict[str, int] = {}
    for p, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << p
    width = 4 * k + 8  # rows above the band as well, so that what is cut off below never reaches it
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score = full ^ ((1 << (width - k - 1)) - 1), 0, k
    mark = top >> 1
    for j, c in enumerate(b):
        shift = j + k + 1 - width  # row of the lowest bit
        eq = at.get(c, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        h_plus = (minus | ~(zero | plus)) & full
        h_minus = zero & plus
        if j < m - k:
            score += not zero & top
        else:
            score += bool(h_plus & mark) - bool(h_minus & mark)
            mark >>= 1
        if score > 2 * k + n - m:
            return False
        plus = (h_minus | ~((zero >> 1) | h_plus)) & full
        minus = (zero >> 1) & h_plus
    return score <= k


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _near_earlier(t: pa.Table, errors: int) -> dict | None:
    """Open lines of a group within the distance of an earlier one. Rows come in order of first appearance."""
    line, judged = t.column("line").to_numpy(), np.array(t.column("open").to_pylist(), bool)
    if not judged.any() or len(line) < 2:
        return None
    text, own = t.column("text").to_pylist(), np.array(t.column("own").to_pylist(), bool)
    size = np.array([len(s) for s in text])
    counts = np.zeros((len(line), 64), np.int32)
    for i, s in enumerate(text):
        raw = np.frombuffer(s.encode("utf-8"), np.uint8)
        counts[i] = np.bincount(raw & 63, minlength=64)
    out = []
    for j in np.flatnonzero(judged):
        near = np.flatnonzero((abs(size[:j] - size[j]) <= errors) & (own[:j] | own[j]) & (line[:j] != line[j]))
        if len(near):  # an edit changes the byte counts by 8 at most
            apart = abs(counts[near] - counts[j]).sum(1)
            near = near[np.argsort(apart, kind="stable")[:np.count_nonzero(apart <= 8 * errors)]]  # the likeliest first
        if any(edit_distance_within(text[i], text[j], errors) for i in near):
            out.append(int(line[j]))
    return {"line": out} if out else None


def _near_lines(met: DataFrame, texts: DataFrame, errors: int) -> DataFrame:
    """The lines of ``met`` (key, line, own) that are near an earlier line of one of their keys.

    One earlier line settles a line, so a key that very many lines share (of a template) is first gone through in small
    groups, dealt anew each time; only lines that found none are then compared with all lines of the key, block by block.
    """
    sizes = keep(met.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")), "key-sizes")
    rows = keep(met.join(sizes, "key").join(texts, "line"), "key-lines")
    judge = lambda df, unit: by_group(df, unit, ["id", "no"], lambda t: _near_earlier(t, errors), "line bigint").distinct()
    near = keep(judge(rows.withColumns({"a": hash_part("line", F.col("n")).cast("int"), "open": F.lit(True)}), ["key", "a"]), "near-lines")
    crowded, n = keep_counted(rows.filter("n > 1"), "crowded-lines", n=F.count(F.lit(1)))
    if not n["n"]:
        return near
    opened = lambda found: crowded.join(found.withColumn("near", F.lit(True)), "line", "left").withColumn("open", F.col("near").isNull()).drop("near")
    for turn in range(TURNS):
        part = F.pmod(F.xxhash64("line", F.lit(turn)), F.col("n")).cast("int")
        more = judge(opened(near).withColumn("a", part), ["key", "a"])
        near = keep(near.unionAll(more).distinct(), "near-lines")
    left = opened(near)
    still = keep(left.filter("open").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")), "open-keys")
    left = left.join(still, "key")
    witness = left.withColumns({"a": hash_part("line", F.col("n")).cast("int"), "open": F.lit(False)}).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    asking = left.filter("open").withColumn("b", hash_part("line", F.col("m")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    last = judge(witness.unionByName(asking), ["key", "a", "b"])
    return keep(near.unionAll(last).distinct(), "near-lines")


def line_marks(docs: DataFrame, errors: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``copy`` (number of the row among those of its id and text) and the line numbers ``gone`` of the documents that lose lines."""
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    def places(ids, texts):
        out: dict[str, list] = {"id": [], "no": [], "line": []}
        for i, t in zip(ids, texts):
            got = [(k, line_id(s)) for k, s in enumerate(t.split("\n")) if len(s) >= least]
            out["id"] += [i] * len(got)
            out["no"] += [k for k, _ in got]
            out["line"] += [h for _, h in got]
        return out

    lines = keep(map_text(rows, "id", "text", places, "id bigint, no int, line bigint"), "lines")
    first = keep(lines.groupBy("line").agg(F.min(F.struct("id", "no")).alias("first")), "first-lines")

    def entries(batches):
        met: set[str] = set()

        def flush(held):
            e = segment_keys(held, errors, least)
            return packed(e, e["key"].copy(), buckets)

        held: list[str] = []
        n = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                for s in t.split("\n"):
                    if len(s) >= least and s not in met:  # lines seen before need no second entry
                        met.add(s)
                        held.append(s)
                        n += len(s)
                        if n >= 2_000_000:
                            yield flush(held)
                            held, n = [], 0
                            if len(met) > 1 << 18:
                                met.clear()
        if held:
            yield flush(held)

    def shared(t: pa.Table):
        e = unpacked(t, ENTRY)
        e = e[np.lexsort((e["line"], e["key"]))]
        e = e[np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["line"][1:] != e["line"][:-1]))]
        start = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1]))
        own = np.add.reduceat(e["line"] & 1, start)
        name = e["line"] >> 1
        new = np.diff(name, prepend=-1) != 0
        new[start] = True
        good = np.repeat((np.add.reduceat(new.astype(np.int64), start) > 1) & (own > 0), np.diff(np.append(start, len(e))))
        # a line's own segment stands before its equal substring
        keep_ = good & new
        last = np.append(np.flatnonzero(new)[1:], len(e)) - 1
        has_own = np.zeros(len(e), bool)
        has_own[np.flatnonzero(new)] = (e["line"][last] & 1).astype(bool)
        return {"key": e["key"][keep_].tolist(), "line": name[keep_].tolist(), "own": has_own[keep_].tolist()} if keep_.any() else None

    dealt = rows.select("text").mapInArrow(entries, "bucket int, data binary")
    met = keep(by_group(dealt, ["bucket"], [], shared, "key bigint, line bigint, own boolean", parts=buckets), "met-lines")
    drop_spent(spark)
    # the texts of lines that share a segment with another, from their first places
    wanted = met.select("line").distinct().join(first, "line").select(F.col("first.id").alias("id"), F.col("first.no").alias("no"), "line")
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("no", "line")).alias("want"))  # at most a document's own lines

    def fetch(keys, texts):
        out: dict[str, list] = {"line": [], "id": [], "no": [], "text": []}
        for k, t in zip(keys, texts):
            parts = t.split("\n")
            for w in k["want"]:
                if w["no"] < len(parts) and line_id(parts[w["no"]]) == w["line"]:  # of several rows with this id, the right one
                    for name, v in (("line", w["line"]), ("id", k["id"]), ("no", w["no"]), ("text", parts[w["no"]])):
                        out[name].append(v)
        return out

    texts = rows.join(wanted, "id").select(F.struct("id", "want").alias("k"), "text")
    texts = keep(map_text(texts, "k", "text", fetch, "line bigint, id bigint, no int, text string").dropDuplicates(["line"]), "line-texts")
    drop_spent(spark)
    near = _near_lines(met, texts, errors).withColumn("near", F.lit(True))
    marks = lines.join(first.join(near, "line", "left"), "line").filter("near or id <> first.id or no <> first.no")
    return marks.groupBy("id").agg(F.collect_set("no").alias("gone"))


def without_repeated_lines(docs: DataFrame, errors: int = 2, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each line removed that is within ``errors`` edits of an earlier line of any document; and ``lines_removed``.

    Lines are parted by line feeds; distance counts code points. Earlier is by document id, then line number. All lines of
    at least ``least`` code points are judged, on the input and not on what is left; shorter ones (headings, blanks) stay.
    Null texts stay null; empty ones stay; rows of a null id stay as they are and remove nothing. Rows with an equal id are
    one document of which each row loses the lines that are repeats at their number. An empty table gives an empty result. The
    columns are those of ``docs`` and the number; a column ``lines_removed`` of ``docs`` is replaced.
    """
    marks = line_marks(docs, errors, least, id_col, text_col)
    names = [c for c in docs.columns if c != "lines_removed"]
    whole = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(marks, "id", "left")
    split = F.split("text", "\n", -1)
    numbered = F.transform(split, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    stay = F.filter(numbered, lambda x: ~F.array_contains("gone", x.k) | (F.char_length(x.s) < least))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda x: x.s), "\n"))
    out = whole.select("row", "gone", "text", left.alias("left"), F.when(
        F.col("gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size(split) - F.size(stay)).cast("bigint").alias("lines_removed"))
    return out.select(*[F.col("left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], "lines_removed")
