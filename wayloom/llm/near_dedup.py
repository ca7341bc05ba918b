"""Near-duplicate documents: chosen-path set similarity join over minwise tokens, and the groups of its links."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, keep_counted
from .batches import Rolling, by_group, hash_part, map_text, mix64
from .components import components

#: Minwise tokens of a document's signature.
TOKENS = 64
_rolling = Rolling()
_SEEDS = (mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[:, None]
_SHIFTS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]


def normal_words(text: str | None) -> bytes:
    """The words (between blanks and tab to carriage return, A-Z lower-cased) with one blank between."""
    return b" ".join((text or "").encode("utf-8").lower().split())


def shingle_set(words: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``width`` words; of the whole sequence if shorter; empty without words."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(words, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    sums = _rolling.sums(raw)
    k = min(width, len(starts))
    return np.unique(_rolling.between(sums, starts[: len(starts) - k + 1], ends[k - 1:]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of each of ``TOKENS`` hash functions, as 32-bit numbers."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 4096):  # in pieces that stay in the processor's cache
            h = shingles[lo:lo + 4096] * _SEEDS + _SHIFTS
            h ^= h >> np.uint64(31)
            out = np.minimum(out, ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def _node(parent: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(parent.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + coordinate.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                     + token.astype(np.uint64)).astype(np.int64)


def branch(rows: DataFrame, paths: int, first: list[int] | None = None) -> DataFrame:
    """Children of (``node``, ``v``, ``n``, ``size``, ``sig``): one for each token that the node selects; of the root, for tokens ``first``.
    ``above`` is the size of the parent."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, TOKENS)
            node = b.column("node").to_numpy()
            for p in range(len(first) if first else paths):
                pick = np.full(len(node), first[p]) if first else (mix64(node.astype(np.uint64) + np.uint64(p + 1)) % np.uint64(TOKENS)).astype(np.int64)
                child = _node(node, pick, sig[np.arange(len(node)), pick])
                yield pa.RecordBatch.from_arrays([pa.array(child), b.column("v"), b.column("n"), b.column("size")], ["node", "v", "n", "above"])

    return rows.select("node", "v", "n", "size", "sig").mapInArrow(run, "node bigint, v bigint, n int, above bigint")


def _unpacked(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, TOKENS)


def least_equal(percent: int, miss: float = 2e-7) -> int:
    """The most equal tokens that a signature pair of a link may be asked for, so that it fails with a probability of at most ``miss``."""
    s, below = percent / 100, 0.0
    for k in range(TOKENS + 1):
        below += math.comb(TOKENS, k) * s**k * (1 - s) ** (TOKENS - k)
        if below > miss:
            return k
    return TOKENS


def _alike(t: pa.Table, least: int, percent: int) -> dict | None:
    """Members of a unit whose signature agrees enough with that of a member of another group."""
    v, root, n, sig = t.column("v").to_numpy(), t.column("root").to_numpy(), t.column("n").to_numpy(), _unpacked(t)
    if (root == root[0]).all():
        return None
    hit = np.zeros(len(v), bool)
    for i in range(len(v) - 1):
        rest = np.flatnonzero((root[i + 1:] != root[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= percent * np.maximum(n[i + 1:], n[i]))) + i + 1
        if len(rest):
            good = rest[(sig[rest] == sig[i]).sum(1) >= least]
            if len(good):
                hit[good] = hit[i] = True
    if not hit.any():
        return None
    return {"node": t.column("node").to_numpy()[hit].tolist(), "part": t.column("part").to_numpy()[hit].tolist(), "v": v[hit].tolist()}


def _links(t: pa.Table, percent: int) -> dict | None:
    """Links of a unit, found by comparing full sets of members of different groups; one chain of links for each group."""
    v, root = t.column("v").to_numpy(), t.column("root").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.append(0, np.cumsum(size))
    group = np.unique(root, return_inverse=True)[1].copy()
    mark = np.zeros(len(every), bool)
    out: dict[str, list] = {"a": [], "b": []}
    for i in range(len(v) - 1):
        if (group[i + 1:] == group[i]).all():
            continue
        own = place[ends[i]:ends[i + 1]]
        mark[own] = True
        later = slice(ends[i + 1], None)
        both = np.bincount(owner[later][mark[place[later]]], minlength=len(v))
        mark[own] = False
        for j in np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (np.arange(len(v)) > i)):
            if group[i] != group[j]:
                out["a"].append(int(v[i]))
                out["b"].append(int(v[j]))
                group[group == group[j]] = group[i]
    return out if out["a"] else None


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, trees: int = 4, paths: int = 2, small: int = 3000,
                    shingles: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_shingles``, ``component_id`` and ``kept`` of each document; links are pairs of sets with intersection * 100 >= union * ``percent``.

    Documents with the same words are one set, whose links its smallest id stands for. A signature of minwise tokens makes
    the paths: below the root, each of ``trees`` trees takes ``paths`` tokens, and documents with an equal token share a
    node; a node of more than ``small`` sets, or with more than ``shingles`` of them in all, branches again over ``paths`` tokens that it selects itself. Small nodes are
    compared exhaustively: signatures first, then the full sets of those that agree in at least ``least_equal`` tokens, which a
    link of ``percent`` fails with a probability below 2e-7. A link of similarity 0.85 is missed by all paths of the
    default settings with a probability below 6e-6 however deep they branch, so in all below 1e-5; one of 0.80 with ``trees=6`` as well.

    A first tree of one path runs before the others; its links join most groups, and from then on only nodes that hold sets of
    different groups matter. That, and comparing the members of a large node with two of its members, keeps large groups of
    near copies from being branched again and again. A large node that branching leaves at over 0.7 of its parent's size holds
    sets that are alike, though not linked: it is compared whole, in blocks. Nothing is cut off.

    Empty and null texts have 0 shingles and no links. Rows of a null id have no links, a null component, and are kept. Rows
    with equal ids are one document: each row shows its own text's shingles, all share the component. An empty table gives
    an empty result; other columns do not matter.
    """
    least = least_equal(percent)

    def describe(ids, texts):
        out: dict[str, list] = {"id": ids, "key": [], "n": [], "sig": []}
        for t in texts:
            words = normal_words(t)
            s = shingle_set(words, width)
            out["key"].append(hashlib.md5(words, usedforsecurity=False).digest())
            out["n"].append(len(s))
            out["sig"].append(signature(s).tobytes())
        return out

    rows = keep(map_text(docs.withColumn("_id", F.col(id_col).cast("bigint")), "_id", text_col, describe, "id bigint, key binary, n int, sig binary"), "texts")
    sets = keep(rows.filter("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("v"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")

    def parts(size, total):
        """Units of bounded size that a node is cut into; more than one if it is large."""
        return F.greatest(F.ceil(size / small), F.ceil(total / shingles)).cast("int")

    def occupied(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Rows of nodes that hold two sets or more, of different groups if these are known; with the node's ``size``,
        and whether it is ``dense``: large, and branching has hardly made it smaller."""
        named = nodes.withColumn("root", F.col("v")) if roots is None else nodes.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        stat = named.groupBy("node").agg(F.count("*").alias("size"), parts(F.count("*"), F.sum("n")).alias("parts"), F.max("above").alias("_above"), F.min("root").alias("lo"), F.max("root").alias("hi"),
                                         F.min_by("v", F.xxhash64("v")).alias("one"), F.max_by("v", F.xxhash64("v")).alias("two"))
        stat = stat.filter("size > 1 and lo <> hi")
        dense = (F.col("parts") > 1) & (F.col("size") > 0.7 * F.col("_above"))
        return named.join(stat.withColumn("dense", dense).drop("lo", "hi", "_above"), "node")

    def sliced(nodes: DataFrame) -> DataFrame:
        """Units of bounded size: a small node whole; of a large one slices, each with the same two members."""
        own = nodes.select("node", hash_part("v", F.col("parts")).cast("int").alias("part"), "v")
        lead = nodes.filter("parts > 1").groupBy("node", "one", "two").agg(F.max("parts").alias("parts"))
        lead = lead.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "one", "two").select(
            "node", "part", F.explode(F.array("one", "two")).alias("v"))
        return own.unionAll(lead).distinct()

    def blocked(nodes: DataFrame) -> DataFrame:
        """Units of every two blocks of a node."""
        blocks = 2 * F.col("parts")
        mine = nodes.withColumn("i", hash_part("v", blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return mine.select(F.xxhash64("node", F.least("i", "j")).alias("node"), F.greatest("i", "j").alias("part"), "v").distinct()

    def signed(units: DataFrame) -> DataFrame:
        return units.join(sets.select("v", "n", "sig"), "v")

    def active(units: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        named = signed(units).withColumn("root", F.col("v")) if roots is None else signed(units).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        return by_group(named, ["node", "part"], ["v"], lambda t: _alike(t, least, percent), "node bigint, part int, v bigint")

    def whole_sets(members: DataFrame) -> DataFrame:
        """The full sets of the named documents, from their texts."""
        some = docs.select(F.col(id_col).cast("bigint").alias("v"), F.col(text_col).alias("text")).join(members.select("v").distinct(), "v", "left_semi")
        return map_text(some, "v", "text", lambda ids, texts: {"id": ids, "set": [shingle_set(normal_words(t), width).tobytes() for t in texts]},
                        "id bigint, set binary").filter(F.length("set") > 0).withColumnRenamed("id", "v").dropDuplicates(["v", "set"])

    def links(units: DataFrame, full: DataFrame, roots: DataFrame | None) -> DataFrame:
        have = units.join(full, "v")
        have = have.withColumn("root", F.col("v")) if roots is None else have.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        mixed = have.groupBy("node", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("node", "part")
        if roots is not None:
            have = have.join(mixed, ["node", "part"], "left_semi")
        return by_group(have, ["node", "part"], ["v"], lambda t: _links(t, percent), "a bigint, b bigint")

    def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
        """``roots`` after further links: only the groups that these touch are gone through again."""
        side = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
        named = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        up = components(named)
        moved = roots.join(up.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left")
        return keep(moved.select("v", F.coalesce("to", "root").alias("root")).unionAll(up.select("v", "root")), "groups")

    root = sets.withColumns({"node": F.lit(0).cast("bigint"), "size": F.lit(1 << 60).cast("bigint")})
    # all trees' nodes below the root; a tree's first tokens are its own
    near: list[DataFrame] = []
    for name, tokens in (("first", [0]), ("paths", list(range(1, 1 + trees * paths)))):
        spread = occupied(branch(root, paths, tokens), None)
        nodes, seen = keep_counted(spread, f"{name}-nodes", large=F.count_if(F.col("parts") > 1))
        near.append(keep(active(sliced(nodes)), name))
        if name == "paths":
            large, n_large = nodes.filter("parts > 1"), seen["large"]
    full = keep(whole_sets(near[0].select("v").unionAll(near[1].select("v")).unionAll(large.select("v"))), "full")
    roots = keep(components(links(near[0], full, None)), "groups")
    roots = joined(roots, links(near[1], full, roots))
    while n_large:
        mixed = occupied(large.select("node", "v", "n", "above"), roots)
        spread = occupied(branch(mixed.select("node", "v", "size").join(sets.select("v", "n", "sig"), "v"), paths), roots)
        nodes, seen = keep_counted(spread, "nodes", large=F.count_if((F.col("parts") > 1) & ~F.col("dense")))
        units = sliced(nodes.filter("not dense")).unionAll(blocked(nodes.filter("dense")))
        large, n_large = nodes.filter("parts > 1 and not dense"), seen["large"]
        some = keep(active(units, roots), "near")
        roots = joined(roots, links(some, full, roots))
    # a document whose rows have several texts stands for each of them
    name = rows.filter("id is not null").join(sets.select("key", "v"), "key", "left").select("id", F.coalesce("v", "id").alias("v")).filter("v <> id").distinct()
    several = rows.filter("id is not null and n > 0").select("id", "key").distinct().groupBy("id").count().filter("count > 1").select("id")
    bridged = name.join(several, "id", "left_semi")
    if not bridged.isEmpty():
        roots = joined(roots, bridged.select(F.col("id").alias("a"), F.col("v").alias("b")))
    out = rows.join(sets.select("key", "v"), "key", "left").withColumn("v", F.when(F.col("id").isNotNull(), F.coalesce("v", "id")))
    out = out.join(roots.withColumnRenamed("root", "_root"), "v", "left").withColumn("component_id", F.coalesce("_root", "v"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), "component_id",
                      (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, and rows without an id."""
    drop = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).filter("not kept").select(F.col(id_col).alias("drop")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"))
    return rows.join(drop, F.col("id") == F.col("drop"), "left_anti").select("row.*")
