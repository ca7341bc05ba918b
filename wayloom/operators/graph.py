"""Graph tables: nodes(tile_id, node_id, x, y) and edges(tile_id, src, dst), many graphs in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.coords import metre_distance
from ..functions.geometry import crossing_point, point_segment_distance, segment_box
from ..session import FEW, few, forget, is_kept, keep, keep_counted
from .spatial import KEY, box_join, dense_ids, id_chunk, radius_join, running_start, sliced_join, spread_out



ENDS = ("ax", "ay", "bx", "by")


# ---- edge sets -------------------------------------------------------------------------------------------

def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reverses; other columns such as scores are copied."""
    return edges.unionByName(reversed_edges(edges))


def undirected(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """Each unordered edge once, as (smaller, larger)."""
    flat = edges.select(*KEY, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (flat if self_loops else flat.filter("src <> dst")).distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """A directed edge that is already there is not added again; its highest score stays."""
    rest = [c for c in edges.columns if c not in (*KEY, "src", "dst")]
    if not rest:
        return edges.select(*KEY, "src", "dst").distinct()
    return edges.groupBy(*KEY, "src", "dst").agg(*[F.max(c).alias(c) for c in rest])


def degrees(edges: DataFrame, once: bool = False) -> DataFrame:
    """Number of distinct neighbours over in and out links, the node itself not counted. ``once`` says that each unordered
    edge is there once, as ``undirected`` and ``densify`` return them: then links are counted without being compared first."""
    both = symmetric(edges.select(*KEY, "src", "dst")).filter("src <> dst")
    both = both if once else both.distinct()
    return both.groupBy(*KEY, F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour) over in and out links, without the node itself."""
    both = symmetric(edges.select(*KEY, "src", "dst")).filter("src <> dst").distinct()
    return both.select(*KEY, F.col("src").alias("node_id"), F.col("dst").alias("neighbour"))


def adjacency_sets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, nbrs) with an empty set for nodes without out edges. A set is as long as one node's degree."""
    sets = edges.groupBy(*KEY, F.col("src").alias("node_id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
    empty = F.array().cast("array<bigint>")
    return nodes.join(sets, [*KEY, "node_id"], "left").withColumn("nbrs", F.coalesce("nbrs", empty))


def inspect(nodes: DataFrame, edges: DataFrame, close: float = 0.1) -> DataFrame:
    """Per tile: edges without their reverse, and node pairs closer than ``close``."""
    e = edges.select(*KEY, "src", "dst").distinct()
    lone = e.join(reversed_edges(e), [*KEY, "src", "dst"], "left_anti").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("one_way"))
    other = nodes.select(*KEY, F.col("node_id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = radius_join(nodes, other, close, strict=True, cell=max(close * 2, 1.0)).filter("node_id < id2")
    twins = near.groupBy(*KEY).agg(F.count(F.lit(1)).alias("close_pairs"))
    tiles = nodes.select(*KEY).distinct()
    return (
        tiles.join(lone, list(KEY), "left").join(twins, list(KEY), "left")
        .select(*KEY, F.coalesce("one_way", F.lit(0)).alias("one_way"), F.coalesce("close_pairs", F.lit(0)).alias("close_pairs"))
    )


# ---- relabelling -----------------------------------------------------------------------------------------

def with_ends(edges: DataFrame, nodes: DataFrame, cols: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Edges with the positions of both ends: (…, ax, ay, bx, by)."""
    u, v = cols
    a = nodes.select(*KEY, F.col("node_id").alias("src"), F.col(u).alias("ax"), F.col(v).alias("ay"))
    b = nodes.select(*KEY, F.col("node_id").alias("dst"), F.col(u).alias("bx"), F.col(v).alias("by"))
    return edges.join(a, [*KEY, "src"]).join(b, [*KEY, "dst"])


def renumber(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the nodes 0, 1, 2, … by id and carry the edges along; edges that lost an end are dropped."""
    numbered = dense_ids(nodes, ["node_id"], "_new")
    ids = numbered.select(*KEY, "node_id", "_new")
    new_edges = (
        edges.join(ids.select(*KEY, F.col("node_id").alias("src"), F.col("_new").alias("_s")), [*KEY, "src"])
        .join(ids.select(*KEY, F.col("node_id").alias("dst"), F.col("_new").alias("_d")), [*KEY, "dst"])
        .withColumns({"src": F.col("_s"), "dst": F.col("_d")})
        .select(*edges.columns)
    )
    return numbered.withColumn("node_id", F.col("_new")).select(*nodes.columns), new_edges


def keep_nodes(nodes: DataFrame, edges: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    return renumber(nodes.filter(condition), edges)


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes without edges and renumber the rest in order of their ids."""
    used = symmetric(edges.select(*KEY, "src", "dst")).select(*KEY, F.col("src").alias("node_id")).distinct()
    return renumber(nodes.join(used, [*KEY, "node_id"], "left_semi"), edges)


def combine(nodes: DataFrame, edges: DataFrame, part: str = "part") -> tuple[DataFrame, DataFrame]:
    """Union of the graphs named by ``part`` inside each tile, node ids moved up by the sizes of earlier parts.

    Ids inside a part must be 0, 1, 2, …
    """
    sizes = nodes.groupBy(*KEY, part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_start(sizes, [part], F.col("_n"), "_off", [F.col(part)]).select(*KEY, part, "_off")
    n = nodes.join(offsets, [*KEY, part]).withColumn("node_id", F.col("node_id") + F.col("_off"))
    e = edges.join(offsets, [*KEY, part]).withColumns(
        {"src": F.col("src") + F.col("_off"), "dst": F.col("dst") + F.col("_off")})
    return n.select(*nodes.columns), e.select(*edges.columns)


def drop_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the nodes listed in ``gone`` (tile_id, node_id) with all their edges; ids stay."""
    out = gone.select(*KEY, "node_id").distinct()
    e = edges.join(out.withColumnRenamed("node_id", "src"), [*KEY, "src"], "left_anti")
    e = e.join(out.withColumnRenamed("node_id", "dst"), [*KEY, "dst"], "left_anti")
    return nodes.join(out, [*KEY, "node_id"], "left_anti"), e.select(*edges.columns)


def drop_dead_ends(nodes: DataFrame, edges: DataFrame, spared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One simultaneous pass over dead ends: one neighbour, or no way in, or no way out; ``spared`` nodes stay."""
    e = edges.select(*KEY, "src", "dst").distinct()
    links = e.select(*KEY, F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    links = links.unionByName(
        e.select(*KEY, F.col("dst").alias("node_id"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    flat = links.groupBy(*KEY, "node_id", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    stat = flat.groupBy(*KEY, "node_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("o").alias("outs"), F.sum("i").alias("ins"))
    dead = stat.filter("degree = 1 or outs = 0 or ins = 0").select(*KEY, "node_id")
    lonely = nodes.select(*KEY, "node_id").join(stat, [*KEY, "node_id"], "left_anti")
    dead = dead.unionByName(lonely)
    if spared is not None:
        dead = dead.join(spared.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
    return drop_node(nodes, edges, dead)


# ---- crossings, subdivision, densifying ------------------------------------------------------------------

def crossovers(nodes: DataFrame, edges: DataFrame, cell: float = 48.0) -> DataFrame:
    """Points where two edges of a tile properly cross: (src, dst, src2, dst2, x, y), each edge pair once."""
    box = ("x0", "y0", "x1", "y1")
    e = with_ends(undirected(edges), nodes).select(
        *KEY, "src", "dst", *ENDS, *[v.alias(c) for c, v in zip(box, segment_box(*[F.col(c) for c in ENDS]))])
    f = e.select(*KEY, *[F.col(c).alias(c + "2") for c in ("src", "dst", *ENDS, *box)])
    pairs = box_join(e, f, [F.col(c) for c in box], [F.col(c + "2") for c in box], cell)
    # taken by an observer, pairs leave the join: in one piece with it, crossings are too much code to be compiled
    pairs = pairs.filter("src < src2 or (src = src2 and dst < dst2)").observe(Observation(), F.count(F.lit(1)).alias("pairs"))
    p = crossing_point(*[F.col(c) for c in ("ax", "ay", "bx", "by", "ax2", "ay2", "bx2", "by2")])
    return (
        pairs.withColumn("_p", p).filter("_p is not null")
        .select(*KEY, "src", "dst", "src2", "dst2", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    )


def subdivide(nodes: DataFrame, edges: DataFrame, resolution: float) -> tuple[DataFrame, DataFrame]:
    """Cut each edge into max(1, int(length / resolution)) equal pieces; old nodes keep their ids."""
    n = F.greatest(F.lit(1), (F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2) / resolution).cast("int"))
    cut = with_ends(edges, nodes).withColumn("_n", n)
    base = nodes.groupBy(*KEY).agg((F.max("node_id") + 1).alias("_base"))
    cut = sliced_join(running_start(cut, ["src", "dst"], F.col("_n") - 1, "_off"), base, KEY, both=False)
    piece = cut.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    first = F.col("_base") + F.col("_off") - 1
    t = F.col("_i") / F.col("_n")
    points = piece.filter("_i < _n").select(
        *KEY, (first + F.col("_i")).alias("node_id"),
        (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"),
        (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"),
    )
    links = piece.select(
        *KEY,
        F.when(F.col("_i") == 1, F.col("src")).otherwise(first + F.col("_i") - 1).alias("src"),
        F.when(F.col("_i") == F.col("_n"), F.col("dst")).otherwise(first + F.col("_i")).alias("dst"),
    )
    old = nodes.select(*KEY, "node_id", F.col("x").cast("double"), F.col("y").cast("double"))
    return old.unionByName(points), links


#: The largest number below a half: added to a half it still makes one, and to anything less it does not.
HALF = 0.49999999999999994


def _half_up(v: Column) -> Column:
    """``round`` to a whole number, halves away from zero. Spark's own goes through decimals, which takes microseconds."""
    return (F.signum(v) * F.floor(F.abs(v) + HALF)).cast("bigint")


def location_id(lat: Column, lon: Column) -> Column:
    """The 7-decimal location key packed in one number."""
    a, b = _half_up(lat * 1e7) + 900_000_000, _half_up(lon * 1e7) + 1_800_000_000
    return a * F.lit(4_294_967_296).cast("bigint") + b



def _cut(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by the positions of their ends, with the number ``_n`` of pieces."""
    e = spread_out(with_ends(edges.select(*KEY, "src", "dst"), nodes, ("lat", "lon")), *KEY, *ENDS)
    d = metre_distance(*[F.col(c) for c in ENDS])
    return keep(e.withColumn("_n", F.when(d > 3.0, (d / 2.0).cast("int") + 1).otherwise(1)), "cut")


def _place(i: Column) -> tuple[Column, Column]:
    """Where the i-th cut of an edge lies."""
    w = i / F.col("_n")
    # the ends come out exactly, as one share is 0 and the other 1 there
    return F.col("ax") * (1 - w) + F.col("bx") * w, F.col("ay") * (1 - w) + F.col("by") * w


def _with_spots(rows: DataFrame, **at: Column) -> DataFrame:
    """Location ids of the cuts ``at``. Places are columns of their own first, else each id would work them out anew."""
    places = [v.alias(f"_{c}_{name}") for name, i in at.items() for c, v in zip(("lat", "lon"), _place(i))]
    out = rows.select("*", *places)
    ids = [location_id(F.col(f"_lat_{name}"), F.col(f"_lon_{name}")).alias(name) for name in at]
    return out.select("*", *ids).drop(*[f"_{c}_{name}" for name in at for c in ("lat", "lon")])


def _dense_edges(cut: DataFrame) -> DataFrame:
    step = cut.select(*KEY, *ENDS, "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    pair = _with_spots(step, src=F.col("_i") - 1, dst=F.col("_i")).select(*KEY, F.explode(F.array(F.struct("src", "dst"))).alias("_e"))
    # taken out of a struct, since Spark would work out both ids anew for each place where they are compared
    return undirected(pair.select(*KEY, "_e.src", "_e.dst"), self_loops=False)


def densify(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut edges longer than 3 m into int(d / 2) + 1 pieces and unify nodes that share the 7-decimal location.

    Nodes need (lat, lon). Isolated nodes vanish. The result's edges are undirected.
    """
    cut = _cut(nodes, edges)
    lat, lon = _place(F.col("_i"))
    spots = cut.select(*KEY, *ENDS, "_n", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_i")).select(*KEY, lat.alias("lat"), lon.alias("lon"))
    dense = spots.groupBy(*KEY, location_id(F.col("lat"), F.col("lon")).alias("node_id")).agg(F.min(F.struct("lat", "lon")).alias("_at"))
    return dense.select(*KEY, "node_id", F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon")), _dense_edges(cut)


def densify_in_stretches(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``densify`` with the pieces of each edge kept together: (nodes, edges, stretches, steps).

    ``stretches``: (tile_id, a, s, t, b, steps), runs of pieces whose inner nodes have exactly the two neighbours that lie
    before and behind them, from a over its first stop s and its last stop t to b, each run once, a < b, or a = b and s <= t.
    ``steps``: (tile_id, a, s, k, x, y), the k-th piece of the stretch that leaves a over s, from x to y. An edge is cut into several
    stretches where another edge meets one of its inner nodes.
    """
    cut = _cut(nodes, edges)
    i, n = F.col("_i"), F.col("_n")
    lat, lon = _place(i)
    spots = cut.select(*KEY, *ENDS, "_n", F.explode(F.sequence(F.lit(0), n)).alias("_i"))
    spots = _with_spots(spots, node_id=i, before=i - 1, behind=i + 1).select(
        *KEY, *ENDS, "_n", "_i", "node_id", lat.alias("lat"), lon.alias("lon"), F.when(i > 0, F.col("before")).alias("_p"), F.when(i < n, F.col("behind")).alias("_q"))
    low, high = F.least("_p", "_q"), F.greatest("_p", "_q")
    end = F.col("_p").isNull() | F.col("_q").isNull()
    dense = keep(spots.groupBy(*KEY, "node_id").agg(
        F.min(F.struct("lat", "lon")).alias("_at"), F.max(end).alias("_end"), F.min(end).alias("_only"),
        F.min(low).alias("_l1"), F.max(low).alias("_l2"), F.min(high).alias("_h1"), F.max(high).alias("_h2")).select(
        *KEY, "node_id", F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"),
        F.expr("not _only and (_end or _l1 <> _l2 or _h1 <> _h2 or _l1 = _h1 or _l1 = node_id or _h1 = node_id)").alias("_met")), "dense")
    met = keep(dense.filter("_met").select(*KEY, "node_id"), "met")
    stops = spots.filter(~end).join(few(met), [*KEY, "node_id"]).groupBy(*KEY, *ENDS).agg(F.sort_array(F.collect_set("_i")).alias("_stops"))
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("_stops", F.array().cast("array<int>")), F.array(n))
    runs = cut.join(stops, [*KEY, *ENDS], "left").select(*KEY, *ENDS, "_n", F.explode(F.arrays_zip(
        F.slice(bounds, F.lit(1), F.size(bounds) - 1).alias("lo"), F.slice(bounds, F.lit(2), F.size(bounds) - 1).alias("hi"))).alias("_r"))
    runs = runs.select(*KEY, *ENDS, "_n", F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    runs = _with_spots(runs, a=lo, s=lo + 1, t=hi - 1, b=hi)
    runs = runs.filter("a <> b or _hi - _lo > 1").withColumn("_back", F.expr("a > b or (a = b and s > t)"))
    turn = lambda u, v: F.when(F.col("_back"), F.col(v)).otherwise(F.col(u))
    runs = runs.select(*KEY, turn("a", "b").alias("a"), turn("s", "t").alias("s"), F.struct(
        turn("t", "s").alias("t"), turn("b", "a").alias("b"), (hi - lo).cast("bigint").alias("steps"), *ENDS, "_n", "_lo", "_hi", "_back").alias("_r"))
    runs = keep(runs.groupBy(*KEY, "a", "s").agg(F.min("_r").alias("_r")).select(*KEY, "a", "s", "_r.*"), "stretches")
    k = F.col("k")
    at = lambda j: F.when(F.col("_back"), hi - j).otherwise(lo + j)
    steps = _with_spots(runs.select("*", F.explode(F.sequence(F.lit(0), hi - lo - 1)).alias("k")), x=at(k), y=at(k + 1)).select(
        *KEY, "a", "s", k.cast("bigint").alias("k"), "x", "y")
    return dense.drop("_met"), _dense_edges(cut), runs.select(*KEY, "a", "s", "t", "b", "steps"), steps


# ---- components, merging, splitting ----------------------------------------------------------------------

def components(pairs: DataFrame) -> DataFrame:
    """Connected components of (tile_id, a, b): (tile_id, node, label), label = smallest member.

    Large-star and small-star steps in turn, so long paths close in a logarithmic number of rounds. Every step is
    a grouped minimum joined back; hub nodes are dealt over several tasks by the sliced join.
    """
    first = pairs.filter("a <> b").select(*KEY, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = keep_counted(first, "pairs", n=F.count(F.lit(1)))
    mark = None
    while True:
        both = state.unionByName(state.select(*KEY, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*KEY, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sliced_join(both.filter("b > a"), low, [*KEY, "a"], rows=seen["n"], both=False).select(*KEY, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy(*KEY, "a").agg(F.min("b").alias("m"))
        moved = sliced_join(large, low2, [*KEY, "a"], rows=seen["n"], both=False)
        small = moved.filter("b <> m").select(*KEY, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low2.select(*KEY, "a", F.col("m").alias("b"))).distinct()
        spent = state
        state, seen = keep_counted(
            small, "stars", n=F.count(F.lit(1)), h=F.bit_xor(F.xxhash64(*small.columns)))
        forget(spent)
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    tops = state.select(*KEY, F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return state.select(*KEY, F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)


def merge_nodes(nodes: DataFrame, edges: DataFrame, distance: float) -> tuple[DataFrame, DataFrame]:
    """Put each cluster of nodes (linked by steps of at most ``distance``) in one node at its mean position.

    Nodes in one grid cell of diagonal ``distance`` belong together anyway, so only cells are compared, never all
    pairs of a crowded place. Clusters are numbered by their smallest member.
    """
    side = distance / (2 ** 0.5)
    inside = nodes.select(
        *KEY, "node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
        F.floor(F.col("x") / side).alias("_gx"), F.floor(F.col("y") / side).alias("_gy"))
    heads = inside.groupBy(*KEY, "_gx", "_gy").agg(F.min("node_id").alias("head"))
    inside = keep(sliced_join(inside, heads, [*KEY, "_gx", "_gy"], both=False).drop("_gx", "_gy"), "cells")
    places = inside.select(*KEY, "x", "y", "head").distinct()
    other = places.select(*KEY, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("head").alias("head2"))
    touch = radius_join(places, other, distance).filter("head < head2").select(
        *KEY, F.col("head").alias("a"), F.col("head2").alias("b")).distinct()
    label = components(touch).withColumnRenamed("node", "head")
    placed = inside.join(label, [*KEY, "head"], "left").withColumn("label", F.coalesce("label", "head"))
    centres = placed.groupBy(*KEY, F.col("label").alias("node_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    ids = dense_ids(centres, ["node_id"], "_new")
    to_new = keep(placed.select(*KEY, "node_id", "label").join(
        ids.select(*KEY, F.col("node_id").alias("label"), "_new"), [*KEY, "label"]).select(*KEY, "node_id", "_new"), "relabel")
    moved = (
        edges.select(*KEY, "src", "dst")
        .join(to_new.select(*KEY, F.col("node_id").alias("src"), F.col("_new").alias("_s")), [*KEY, "src"])
        .join(to_new.select(*KEY, F.col("node_id").alias("dst"), F.col("_new").alias("_d")), [*KEY, "dst"])
        .select(*KEY, F.col("_s").alias("src"), F.col("_d").alias("dst"))
    )
    return ids.select(*KEY, F.col("_new").alias("node_id"), "x", "y"), undirected(moved, self_loops=False)


def split_edges(nodes: DataFrame, edges: DataFrame, distance: float, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Split edges at the nearest other node closer than ``distance``, again and again, then drop duplicates.

    A candidate lies in the upright box around the flat-ended strip along the edge. An edge that was handled
    before is not handled again, so a split that leads back to itself ends.
    """
    todo = keep(undirected(edges), "todo")
    seen: list[DataFrame] = []
    final: list[DataFrame] = []
    point = nodes.select(*KEY, F.col("node_id").alias("nid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    while True:
        e = with_ends(todo, nodes)
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
        px, py = F.coalesce(F.abs(dy) / length, F.lit(0.0)) * distance, F.coalesce(F.abs(dx) / length, F.lit(0.0)) * distance
        e = e.select(
            *KEY, "src", "dst", "ax", "ay", "bx", "by",
            (F.least("ax", "bx") - px).alias("x0"), (F.least("ay", "by") - py).alias("y0"),
            (F.greatest("ax", "bx") + px).alias("x1"), (F.greatest("ay", "by") + py).alias("y1"))
        near = box_join(point, e, (F.col("x"), F.col("y")), [F.col(c) for c in ("x0", "y0", "x1", "y1")], cell or max(16 * distance, 64.0))
        d = point_segment_distance(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")])
        near = near.filter(
            "nid <> src and nid <> dst and x between x0 and x1 and y between y0 and y1").withColumn("d", d).filter(F.col("d") < distance)
        best = near.groupBy(*KEY, "src", "dst").agg(F.min(F.struct("d", "nid")).alias("_b"))
        step, n = keep_counted(
            todo.join(best, [*KEY, "src", "dst"], "left").select(*KEY, "src", "dst", F.col("_b.nid").alias("nid")),
            "split", cut=F.count("nid"))
        seen.append(step.select(*KEY, "src", "dst"))
        final.append(step.filter("nid is null").select(*KEY, "src", "dst"))
        if not n["cut"]:
            break
        halves = step.filter("nid is not null").select(*KEY, F.explode(F.array(
            F.struct(F.col("src").alias("src"), F.col("nid").alias("dst")),
            F.struct(F.col("nid").alias("src"), F.col("dst").alias("dst")))).alias("_h")).select(*KEY, "_h.src", "_h.dst")
        todo = keep(undirected(halves).join(reduce(DataFrame.unionByName, seen), [*KEY, "src", "dst"], "left_anti"), "todo")
    return nodes, reduce(DataFrame.unionByName, final).distinct()


def merge_into_large_graph(nodes: DataFrame, edges: DataFrame, merge_distance: float, split_distance: float):
    """Drop isolated nodes, merge close nodes, split edges at nodes on them, drop isolated nodes."""
    n, e = drop_isolated(nodes.select(*KEY, "node_id", "x", "y"), undirected(edges))
    n, e = merge_nodes(n, e, merge_distance)
    n, e = split_edges(n, e, split_distance)
    return drop_isolated(n, e)


# ---- bounded search --------------------------------------------------------------------------------------

#: A source with so many stops at most takes them along as a list.
STOPS_LISTED = 64


def reach(edges: DataFrame, sources: DataFrame, depth: int, stops: DataFrame | Column | None = None) -> DataFrame:
    """Breadth-first search from many sources: (source, node, depth), at most ``depth`` hops, edges undirected.

    ``sources``: (tile_id, source, node). ``stops``: (tile_id, source, node) that are entered but not left, or a
    condition on these columns. Back over an undirected edge lies one of the last two fronts or a stop, so a step is held
    against these fronts alone; a stop that is entered again from farther away leads nowhere, and its lowest depth counts. Where
    no source has many stops, its list travels with its front, so that a hop does not read the table of all stops.
    """
    links = symmetric(edges.select(*KEY, "src", "dst")).filter("src <> dst")
    # edges that were written down are read from there; their reverses and what repeats among them need no table of their own
    links = links if is_kept(edges) else keep(links.distinct(), "links")
    links = links.select(*KEY, F.col("src").alias("node"), F.col("dst").alias("next"))
    at = [*KEY, "source", "node"]
    listed, lists, along, most = None, None, [], FEW
    if isinstance(stops, DataFrame):
        listed = keep(stops.select(*at).distinct().withColumn("_in", F.lit(True)), "stops")
        per = listed.groupBy(*KEY, "source")
        if (per.agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= STOPS_LISTED:
            lists, along, most = per.agg(F.collect_list("node").alias("_stops")), ["_stops"], FEW // 4

    def marked(rows: DataFrame) -> DataFrame:
        if lists is not None:
            here = F.coalesce(F.array_contains("_stops", F.col("node")), F.lit(False))
            return rows.withColumn("_stop", here).withColumn("_stops", F.when(~F.col("_stop"), F.col("_stops")))
        if listed is not None:
            return rows.join(listed, at, "left").withColumn("_stop", F.coalesce("_in", F.lit(False))).drop("_in")
        return rows.withColumn("_stop", F.lit(False) if stops is None else F.coalesce(stops, F.lit(False)))

    first = sources.select(*at).distinct()
    if lists is not None:
        first = first.join(lists, [*KEY, "source"], "left")
    front = keep(marked(first.withColumn("depth", F.lit(0))), "front")
    found = [front]
    for hop in range(1, depth + 1):
        stepped = links.join(few(front, front.filter("not _stop"), most), [*KEY, "node"]).select(*KEY, "source", F.col("next").alias("node"), *along)
        known = reduce(DataFrame.unionByName, [f.select(*at) for f in found[-2:]])
        fresh = stepped.dropDuplicates(at).join(known, at, "left_anti").withColumn("depth", F.lit(hop))
        front, n = keep_counted(marked(fresh), "front", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        found.append(front)
    out = reduce(DataFrame.unionByName, found).select(*at, "depth")
    return out if stops is None else out.groupBy(*at).agg(F.min("depth").alias("depth"))


def metre_weight(lat1, lon1, lat2, lon2) -> Column:
    """Edge length in whole centimetres, cut off, so that path sums are exact."""
    return (metre_distance(lat1, lon1, lat2, lon2) * 100.0).cast("bigint")

