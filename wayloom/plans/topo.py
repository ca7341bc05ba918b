"""Marble-and-hole comparison of a proposed road graph with the true one, for all tiles in one job.

From matched start places both graphs are walked and points are dropped at equal steps; the share of points that
find a partner gives precision and recall. Graphs are (nodes(tile_id, node_id, lat, lon), edges(tile_id, src,
dst)). Lengths along roads are whole numbers of 1e-12 degree, so sums do not depend on order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import angle_gap, degree_distance, direction_distance, inside_margin, latlon_to_pixel, unit_direction
from ..functions.geometry import point_segment_distance
from ..operators.chains import chains
from ..operators.graph import symmetric, with_ends
from ..operators.paths import position_distances, spread
from ..operators.sampling import uniform
from ..operators.select import greedy_keep
from ..operators.spatial import KEY, box_join, dense_ids, sliced_join
from ..session import keep

PICO = 1e12
# Fixed values of the method, in degrees: doubled points are moved by this much, starts compete within these.
TWIN_SHIFT = 0.00001
RIVAL_BOX, RIVAL_LIMIT, RIVAL_DISTANCE = 0.00030, 0.00030, 0.00020
EDGE_GAP, POINT_GAP, SOFT_GAP, SOFT_MISS = 0.04, 0.29, 0.3, 1.15


def pico(v: float) -> int:
    return int(round(v * PICO))


def measured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges with their length ``len``."""
    e = edges.select(*KEY, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()
    e = with_ends(e, nodes, ("lat", "lon"))
    d = degree_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return e.select(*KEY, "src", "dst", F.round(d * PICO).cast("bigint").alias("len"))


def starting_points(
    nodes: DataFrame,
    edges: DataFrame,
    region: DataFrame | None = None,
    spacing: float = 0.00050,
    margin: float = 0.07,
    tunnels: DataFrame | None = None,
    mask: tuple[DataFrame, int, int] | None = None,
) -> DataFrame:
    """Evenly spread places on every chain: (tile_id, start, lat, lon, n1, n2, d1, d2).

    A chain of length L gets max(int(L / spacing), 1) places at fractions i/(n+1), none when L is under half the
    spacing. Places must lie inside the region's margin, or on a pixel of ``mask`` = (pixels(tile_id, r, c), rows,
    cols). Places on an edge of ``tunnels`` (tile_id, src, dst) are left out.
    """
    gap = pico(spacing)
    links, segments, _ = chains(measured(nodes, edges))
    seg = segments.filter(F.col("total") * 2 >= gap).select(
        *KEY, "s0", "s1", "total", F.greatest(F.expr(f"total div {gap}"), F.lit(1)).alias("n"))
    on = links.join(seg, [*KEY, "s0", "s1"])
    on = on.withColumns({
        "_lo": F.expr("off * (n + 1) div total + 1"), "_hi": F.least(F.expr("(off + len) * (n + 1) div total"), F.col("n"))})
    on = on.filter("_lo <= _hi").withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    at = F.expr("i * total div (n + 1)")
    on = on.withColumns({"d1": at - F.col("off"), "d2": F.col("off") + F.col("len") - at})
    if tunnels is not None:
        on = _off_tunnels(on, tunnels)
    a = nodes.select(*KEY, F.col("node_id").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = nodes.select(*KEY, F.col("node_id").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    on = on.join(a, [*KEY, "a"]).join(b, [*KEY, "b"])
    t = F.col("d1") / F.col("len")
    out = on.select(
        *KEY, F.struct("s0", "s1", "i").alias("start"), ((1 - t) * F.col("alat") + t * F.col("blat")).alias("lat"),
        ((1 - t) * F.col("alon") + t * F.col("blon")).alias("lon"), F.col("a").alias("n1"), F.col("b").alias("n2"), "d1", "d2")
    if region is None:
        return out
    box = [F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    placed = sliced_join(out, region.select(*KEY, "min_lat", "min_lon", "max_lat", "max_lon"), KEY, both=False)
    if mask is None:
        return placed.filter(inside_margin(F.col("lat"), F.col("lon"), *box, margin)).select(*out.columns)
    pixels, rows, cols = mask
    r, c = latlon_to_pixel(F.col("lat"), F.col("lon"), *box, rows, cols)
    lit = pixels.select(*KEY, F.col("r").cast("int").alias("_r"), F.col("c").cast("int").alias("_c"))
    lit = lit.filter(f"_r > 0 and _r < {rows} and _c > 0 and _c < {cols}")
    return placed.withColumns({"_r": r, "_c": c}).join(lit, [*KEY, "_r", "_c"], "left_semi").select(*out.columns)


def _off_tunnels(rows: DataFrame, tunnels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    both = symmetric(tunnels.select(*KEY, "src", "dst")).distinct()
    return rows.join(both.select(*KEY, F.col("src").alias(a), F.col("dst").alias(b)), [*KEY, a, b], "left_anti")


def match_edges(
    starts: DataFrame,
    start_nodes: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    threshold: float = 0.00010,
    only: DataFrame | None = None,
    single: bool = False,
) -> DataFrame:
    """The nearest edge of another graph for each start: (tile_id, start, lat, lon, n1, n2, d1, d2).

    The edge is nearer than ``threshold`` and nearly parallel to the start's own edge; with a list ``only``
    (tile_id, src, dst) of edges the direction does not matter. d1 and d2 are the distances from the edge's ends to
    the start. ``single`` keeps the first matched start of each tile.
    """
    e = edges.select(*KEY, "src", "dst").distinct()
    if only is not None:
        e = e.join(only.select(*KEY, "src", "dst"), [*KEY, "src", "dst"], "left_semi")
    e = with_ends(e, nodes, ("lat", "lon"))
    p1 = start_nodes.select(*KEY, F.col("node_id").alias("n1"), F.col("lat").alias("lat3"), F.col("lon").alias("lon3"))
    p2 = start_nodes.select(*KEY, F.col("node_id").alias("n2"), F.col("lat").alias("lat4"), F.col("lon").alias("lon4"))
    s = starts.select(*KEY, "start", "lat", "lon", "n1", "n2").join(p1, [*KEY, "n1"]).join(p2, [*KEY, "n2"]).drop("n1", "n2")
    # what hangs on one side alone is worked out before pairs are made: angles are dear, and a cell has many pairs
    way = unit_direction(F.col("lat4") - F.col("lat3"), F.col("lon4") - F.col("lon3"))
    s = s.select(*KEY, "start", "lat", "lon", way[0].alias("v0"), way[1].alias("v1"))
    k = F.cos(F.radians("ax"))
    way = unit_direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    e = e.withColumns({"ek": k, "ex": F.col("bx") - F.col("ax"), "ey": (F.col("by") - F.col("ay")) * k, "u0": way[0], "u1": way[1]})
    pad = 2 * threshold
    box = (F.least("ax", "bx") - pad, F.least("ay", "by") - pad, F.greatest("ax", "bx") + pad, F.greatest("ay", "by") + pad)
    near = box_join(s, e, (F.col("lat"), F.col("lon")), box, max(8 * threshold, 0.0005))
    # a cell holds many edges for each one whose box has the start in it
    near = near.filter(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    # the few that are left go to their start first: in one piece with the join, distances are too much code to be compiled
    near = near.select(
        *KEY, "start", "lat", "lon", "src", "dst", "ax", "ay", "bx", "by", "ek", "ex", "ey", "u0", "u1", "v0", "v1").repartition(*KEY, "start")
    zero = F.lit(0.0)
    dist = point_segment_distance(zero, zero, F.col("ex"), F.col("ey"), F.col("lat") - F.col("ax"), (F.col("lon") - F.col("ay")) * F.col("ek"))
    fits = dist < threshold
    if only is None:
        fits = fits & (angle_gap((F.col("u0"), F.col("u1")), (F.col("v0"), F.col("v1"))) < EDGE_GAP)
    length = lambda u, v: F.round(degree_distance(F.col(u), F.col(v), F.col("lat"), F.col("lon")) * PICO).cast("bigint")
    # a filter would be moved into the join again
    pick = near.select(*KEY, "start", F.when(fits, F.struct(
        F.round(dist, 12).alias("dist"), "src", "dst", "lat", "lon", length("ax", "ay").alias("d1"), length("bx", "by").alias("d2"))).alias("_m"))
    best = pick.groupBy(*KEY, "start").agg(F.min("_m").alias("_m")).filter("_m is not null")
    best = best.select(*KEY, "start", "_m.lat", "_m.lon", F.col("_m.src").alias("n1"), F.col("_m.dst").alias("n2"), "_m.d1", "_m.d2")
    if single:
        first = best.groupBy(*KEY).agg(F.min("start").alias("start"))
        best = best.join(first, [*KEY, "start"], "left_semi")
    return best


def match_nodes(
    nodes: DataFrame,
    edges: DataFrame,
    other_nodes: DataFrame,
    other_edges: DataFrame,
    threshold: float = 0.00010,
    directed: bool = False,
    mask: tuple[DataFrame, DataFrame, int, int] | None = None,
    deleted: DataFrame | None = None,
) -> DataFrame:
    """Nearest node of the other graph with an agreeing road direction: (tile_id, node_id, other_id, distance).

    Candidates are ends of edges whose node and edge scores (``node_score``, ``edge_score``, where present) are at
    least 1 and that are not in ``deleted``. Directions are those of out links, reversed too unless ``directed``;
    some pair must differ by less than 0.1. ``mask`` = (pixels, region, rows, cols) limits the other nodes to
    lit pixels. Of several nodes that pick one target the nearest stays, then the lowest id.
    """
    good = edges
    if "edge_score" in edges.columns:
        good = good.filter("edge_score >= 1")
    usable = nodes.filter("node_score >= 1") if "node_score" in nodes.columns else nodes
    if deleted is not None:
        usable = usable.join(deleted.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
    ok = usable.select(*KEY, "node_id")
    good = good.join(ok.withColumnRenamed("node_id", "src"), [*KEY, "src"], "left_semi").join(
        ok.withColumnRenamed("node_id", "dst"), [*KEY, "dst"], "left_semi")
    ends = good.select(*KEY, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    cand = nodes.join(ends, [*KEY, "node_id"], "left_semi").select(*KEY, "node_id", "lat", "lon")
    targets = other_nodes.select(*KEY, F.col("node_id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    if mask is not None:
        pixels, region, rows, cols = mask
        r, c = latlon_to_pixel(F.col("lat2"), F.col("lon2"), *[F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")], rows, cols)
        lit = pixels.select(*KEY, F.col("r").cast("int").alias("_r"), F.col("c").cast("int").alias("_c"))
        lit = lit.filter(f"_r > 0 and _r < {rows} and _c > 0 and _c < {cols}")
        targets = sliced_join(targets, region, KEY, both=False).withColumns({"_r": r, "_c": c}).join(lit, [*KEY, "_r", "_c"], "left_semi").select(
            *KEY, "other_id", "lat2", "lon2")

    def directions(n, e, key, name):
        d = with_ends(e.select(*KEY, "src", "dst").distinct(), n, ("lat", "lon")).select(
            *KEY, F.col("src").alias(key), (F.col("bx") - F.col("ax")).alias("u"), (F.col("by") - F.col("ay")).alias("v"))
        if not directed:
            d = d.unionByName(d.withColumns({"u": -F.col("u"), "v": -F.col("v")}))
        return d.groupBy(*KEY, key).agg(F.collect_set(F.struct("u", "v")).alias(name))  # one node's links

    box = (F.col("lat2") - threshold, F.col("lon2") - threshold, F.col("lat2") + threshold, F.col("lon2") + threshold)
    near = box_join(cand, targets, (F.col("lat"), F.col("lon")), box, 4 * threshold, levels=False)
    d = degree_distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    near = near.withColumn("distance", d).filter(F.col("distance") <= threshold)
    near = near.join(directions(nodes, edges, "node_id", "da"), [*KEY, "node_id"]).join(
        directions(other_nodes, other_edges, "other_id", "db"), [*KEY, "other_id"])
    agree = F.exists("da", lambda p: F.exists("db", lambda q: direction_distance(p["u"], p["v"], q["u"], q["v"]) < 0.1))
    near = near.filter(agree)
    mine = near.groupBy(*KEY, "node_id").agg(F.min(F.struct("distance", "other_id")).alias("_m"))
    mine = mine.select(*KEY, "node_id", F.col("_m.other_id").alias("other_id"), F.col("_m.distance").alias("distance"))
    one = mine.groupBy(*KEY, "other_id").agg(F.min(F.struct("distance", "node_id")).alias("_m"))
    return one.select(*KEY, F.col("_m.node_id").alias("node_id"), "other_id", F.col("_m.distance").alias("distance"))


def walk_points(
    nodes: DataFrame,
    edges: DataFrame,
    starts: DataFrame,
    step: float,
    reach: float,
    twins: bool = False,
    directed: bool = False,
    tunnels: DataFrame | None = None,
    where: Column | None = None,
    together: bool | int = False,
) -> DataFrame:
    """Points at multiples of ``step`` along all roads within ``reach`` of each start: (tile_id, start, u, v, o,
    twin, tunnel, lat, lon, dlat, dlon).

    ``starts``: (tile_id, start, n1, n2, d1, d2), a place on edge n1-n2, or a node when n1 = n2. The start's own
    edge is sampled from its second end; paths do not come back to its ends. Where two directions meet on an
    edge, each covers its side. ``twins`` doubles points on two-way edges, moved a little, so that two points of
    the other graph can find a partner there. ``tunnel`` marks points on listed edges; ``where`` is a condition
    on lat and lon. ``together`` brings a start's stretches of road to one partition before they are cut into points, for
    callers that join or count points by start: there they meet without being sent or written. A number is that of the
    partitions (see ``parts_of_starts``), the same for all sides that are to meet.
    """
    st, lim = pico(step), pico(reach)
    size = measured(nodes, edges)
    ways = edges.select(*KEY, "src", "dst").filter("src <> dst").distinct()
    flat = ways.groupBy(*KEY, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        (F.count(F.lit(1)) > 1).alias("two_way"), F.max(F.col("src") < F.col("dst")).alias("fwd"), F.max(F.col("src") > F.col("dst")).alias("bwd"))
    flat = size.join(flat, [*KEY, "src", "dst"])
    if tunnels is not None:
        t = tunnels.select(*KEY, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(True).alias("tunnel")).distinct()
        flat = flat.join(t, [*KEY, "src", "dst"], "left").withColumn("tunnel", F.coalesce("tunnel", F.lit(False)))
    else:
        flat = flat.withColumn("tunnel", F.lit(False))
    flat = with_ends(flat, nodes, ("lat", "lon"))
    back = flat.select(
        *KEY, F.col("dst").alias("u"), F.col("src").alias("v"), F.col("len").alias("w"), "two_way", "tunnel", F.col("bwd").alias("there"),
        F.col("bx").alias("ulat"), F.col("by").alias("ulon"), F.col("ax").alias("vlat"), F.col("ay").alias("vlon"))
    roads = keep(flat.select(
        *KEY, F.col("src").alias("u"), F.col("dst").alias("v"), F.col("len").alias("w"), "two_way", "tunnel", F.col("fwd").alias("there"),
        F.col("ax").alias("ulat"), F.col("ay").alias("ulon"), F.col("bx").alias("vlat"), F.col("by").alias("vlon")).unionByName(back), "roads")
    passable = roads.filter("there") if directed else roads
    src = F.struct(F.col("start").alias("start"), F.col("n1").alias("n1"), F.col("n2").alias("n2"))
    seeds = starts.select(*KEY, src.alias("source"), F.explode(F.array(
        F.struct(F.col("n1").alias("node"), F.col("d1").alias("d")), F.struct(F.col("n2").alias("node"), F.col("d2").alias("d")))).alias("_s"))
    dist = spread(seeds.select(*KEY, "source", "_s.node", "_s.d"), passable.select(*KEY, "u", "v", "w"), lim)
    here = dist.select(*KEY, "source", F.col("node").alias("u"), F.col("d").alias("du"), F.col("seed").alias("su"))
    there = dist.select(*KEY, "source", F.col("node").alias("v"), F.col("d").alias("dv"), F.col("seed").alias("sv"))
    on = here.join(passable, [*KEY, "u"]).filter("v <> source.n1 and v <> source.n2")
    on = on.join(there, [*KEY, "source", "v"], "left")
    first = F.expr(f"(du + {st - 1}) div {st} * {st} - du")
    # twice the offset may not pass the meeting point with the way from the other end
    meet = F.when(F.col("su") | F.coalesce("sv", F.lit(False)) | F.col("dv").isNull(), F.col("w") - 1).otherwise(
        F.expr("(dv + w - du - CASE WHEN u < v THEN 0 ELSE 1 END) div 2"))
    last = F.least(meet, F.col("w") - 1, F.lit(lim) - F.col("du"))
    on = on.withColumns({"_f": first, "_l": last}).filter("_f <= _l and w > 0")
    cols = ["two_way", "tunnel", "w"]
    none = F.lit(None).cast("bigint")
    # one row for each stretch of road, from p to q
    walked = on.select(
        *KEY, F.col("source.start").alias("start"), "u", "v", *cols, "_f", "_l",
        F.col("ulat").alias("plat"), F.col("ulon").alias("plon"), F.col("vlat").alias("qlat"), F.col("vlon").alias("qlon"),
        (F.col("vlat") - F.col("ulat")).alias("dlat"), (F.col("vlon") - F.col("ulon")).alias("dlon"), none.alias("d1"), none.alias("d2"))
    own = starts.select(*KEY, "start", F.col("n1").alias("u"), F.col("n2").alias("v"), "d1", "d2").join(roads, [*KEY, "u", "v"]).filter("w > 0")
    # the offset runs from the second end; points of tunnels on the start's own edge are not marked
    own = own.select(
        *KEY, "start", "u", "v", "two_way", F.lit(False).alias("tunnel"), "w", F.lit(0).cast("bigint").alias("_f"), F.col("w").alias("_l"),
        F.col("vlat").alias("plat"), F.col("vlon").alias("plon"), F.col("ulat").alias("qlat"), F.col("ulon").alias("qlon"),
        (F.col("vlat") - F.col("ulat")).alias("dlat"), (F.col("vlon") - F.col("ulon")).alias("dlon"), "d1", "d2")
    stretches = walked.unionByName(own)
    if together:
        parts = [] if together is True else [together]
        stretches = keep(stretches, "stretches").repartition(*parts, *KEY, "start")
    points = stretches.withColumn("o", F.explode(F.sequence("_f", "_l", F.lit(st).cast("bigint"))))
    points = points.filter(F.col("d1").isNull() | (F.col("d1") - (F.col("w") - F.col("o")) < lim) | (F.col("d2") - F.col("o") < lim))
    a = F.col("o") / F.col("w")
    points = points.select(
        *KEY, "start", "u", "v", "o", "two_way", "tunnel",
        (F.col("qlat") * a + F.col("plat") * (1 - a)).alias("lat"), (F.col("qlon") * a + F.col("plon") * (1 - a)).alias("lon"), "dlat", "dlon")
    if twins:
        n = F.explode(F.when(F.col("two_way"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        points = points.withColumn("twin", n)
        shift = F.col("twin") * TWIN_SHIFT
        points = points.withColumns({"lat": F.col("lat") + shift, "lon": F.col("lon") + shift})
    else:
        points = points.withColumn("twin", F.lit(0))
    if where is not None:
        points = points.filter(where)
    return points.drop("two_way")


def walk_from_nodes(nodes, edges, starts, step, reach, directed: bool = False, scored: bool = False, together: bool | int = False) -> DataFrame:
    """Walk from nodes (tile_id, start, node_id); ``scored`` uses only nodes and edges with a score above zero."""
    if scored:
        edges = edges.filter("edge_score > 0")
        good = nodes.filter("node_score > 0").select(*KEY, "node_id")
        enter = edges.join(good.withColumnRenamed("node_id", "dst"), [*KEY, "dst"], "left_semi")
        edges = enter.join(good.withColumnRenamed("node_id", "src"), [*KEY, "src"], "left_semi")
    zero = F.lit(0).cast("bigint")
    s = starts.select(*KEY, "start", F.col("node_id").alias("n1"), F.col("node_id").alias("n2"), zero.alias("d1"), zero.alias("d2"))
    return walk_points(nodes, edges, s, step, reach, directed=directed, together=together)


#: Starts whose points, at the full settings some six hundred each, are worked on by one task at once.
STARTS_A_TASK = 1000


def parts_of_starts(starts: DataFrame) -> int:
    """Partitions in which starts (a kept table) are walked, so that a task holds the points of about as many whatever the data."""
    return max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-starts.count() // STARTS_A_TASK))


def numbered(points: DataFrame) -> DataFrame:
    """Number the points of each start; their count is bounded by the reach."""
    w = Window.partitionBy(*KEY, "start").orderBy("u", "v", "o", "twin")
    return points.withColumn("n", F.row_number().over(w).cast("bigint"))


def point_pairs(marbles: DataFrame, holes: DataFrame, threshold: float, gap_limit: float = POINT_GAP, soft: bool = False) -> DataFrame:
    """Marble and hole numbers of one start that are near and nearly parallel: (tile_id, start, m, h, twin, tunnel, dist, gap)."""
    m = marbles.select(*KEY, "start", F.col("n").alias("m"), F.col("lat").alias("mlat"), F.col("lon").alias("mlon"), F.col("dlat").alias("ma"), F.col("dlon").alias("mb"))
    h = holes.select(*KEY, "start", F.col("n").alias("h"), "twin", "tunnel", "lat", "lon", "dlat", "dlon")
    rr = threshold * 1.8 + 0.00001
    # a start's points are few: all are compared where they lie, as cells would send them anew
    near = m.join(h, [*KEY, "start"]).filter((F.abs(F.col("mlat") - F.col("lat")) <= rr) & (F.abs(F.col("mlon") - F.col("lon")) <= rr))
    d = degree_distance(F.col("mlat"), F.col("mlon"), F.col("lat"), F.col("lon"))
    gap = angle_gap(unit_direction(F.col("ma"), F.col("mb")), unit_direction(F.col("dlat"), F.col("dlon")))
    if not soft:
        # the direction is not looked at when both parts of one are equal
        gap = F.when((F.col("ma") != F.col("mb")) & (F.col("dlat") != F.col("dlon")), gap).otherwise(F.lit(0.0))
    near = near.withColumns({"dist": d, "gap": gap}).filter((F.col("dist") < threshold) & (F.col("gap") < gap_limit))
    return near.select(*KEY, "start", "m", "h", "twin", "tunnel", "dist", "gap")


def matching_size(left: list[int], right: list[int]) -> int:
    """Size of a largest matching, by augmenting paths. What a search without success has reached leads nowhere later either,
    so no later search goes there again."""
    options: dict[int, list[int]] = {}
    for a, b in zip(left, right):
        options.setdefault(a, []).append(b)
    of_right: dict[int, int] = {}
    of_left: dict[int, int] = {}
    spent: set[int] = set()
    for root in options:
        reached_from: dict[int, int] = {}
        todo, free = [root], None
        while todo and free is None:
            a = todo.pop()
            for b in options[a]:
                if b not in reached_from and b not in spent:
                    reached_from[b] = a
                    if b not in of_right:
                        free = b
                        break
                    todo.append(of_right[b])
        if free is None:
            spent.update(reached_from)
        while free is not None:
            a = reached_from[free]
            given_up = of_left.get(a)
            of_left[a], of_right[free] = free, a
            free = given_up
    return len(of_right)


def _largest(pairs: pd.Series) -> pd.DataFrame:
    def sizes(p):
        m, rest = np.divmod(p, 1 << 32)
        h, plain = np.divmod(rest, 2)
        bare = plain == 1
        return matching_size(m.tolist(), h.tolist()), matching_size(m[bare].tolist(), h[bare].tolist())

    return pd.DataFrame([sizes(p) for p in pairs], columns=["made", "found"])


def matched_counts(pairs: DataFrame) -> DataFrame:
    """Largest one-to-one matchings per start: ``made`` over all holes, ``found`` over plain ones.

    A start's pairs are bounded by its reach, so a start is one row with a short list.
    """
    one = F.col("m") * (1 << 32) + F.col("h") * 2 + F.expr("cast(twin = 0 and not tunnel as bigint)")
    lists = pairs.groupBy(*KEY, "start").agg(F.collect_list(one).alias("pairs"))
    return lists.select(*KEY, "start", F.pandas_udf(_largest, "made bigint, found bigint")("pairs").alias("_n")).select(*KEY, "start", "_n.made", "_n.found")


def _cheapest(cost: pd.Series, pairs: pd.Series) -> pd.DataFrame:
    def taken(c, p):
        order = np.lexsort((p, c))
        m, h = (x.tolist() for x in np.divmod(p[order], 1 << 32))
        ms, hs, total = set(), set(), 0.0
        for i, (a, b) in enumerate(zip(m, h)):
            if a not in ms and b not in hs:
                ms.add(a)
                hs.add(b)
                total += c[order[i]]
        return len(ms), total

    return pd.DataFrame([taken(c, p) for c, p in zip(cost, pairs)], columns=["matched", "cost"])


def cheapest_counts(pairs: DataFrame) -> DataFrame:
    """Greedy matching per start, pairs (tile_id, start, m, h, cost) being taken by rising cost, then numbers, when both ends
    are free: how many and their cost. A start's pairs are bounded by its reach (see ``cheapest_matching`` for any others)."""
    one = F.struct("cost", (F.col("m") * (1 << 32) + F.col("h")).alias("pair"))
    lists = pairs.groupBy(*KEY, "start").agg(F.collect_list(one).alias("p"))
    return lists.select(*KEY, "start", F.pandas_udf(_cheapest, "matched bigint, cost double")("p.cost", "p.pair").alias("_n")).select(*KEY, "start", "_n.matched", "_n.cost")


def start_scores(marbles: DataFrame, holes: DataFrame, starts: DataFrame, threshold: float, one_to_one: bool = True) -> DataFrame:
    """Precision and recall per start; starts without marbles or without holes are skipped.

    ``holes`` hold twins and tunnel marks; recall uses neither. Both are walked ``together``; they meet, are matched and
    counted where they lie and are not written down.
    """
    pairs = point_pairs(numbered(marbles), numbered(holes), threshold)
    nm = marbles.groupBy(*KEY, "start").agg(F.count(F.lit(1)).alias("marbles"))
    nh = holes.filter("twin = 0 and not tunnel").groupBy(*KEY, "start").agg(F.count(F.lit(1)).alias("holes"))
    base = starts.join(nm, [*KEY, "start"]).join(nh, [*KEY, "start"])
    if one_to_one:
        got = matched_counts(pairs)
    else:
        got = pairs.groupBy(*KEY, "start").agg(
            F.count(F.lit(1)).alias("made"), F.count_if(F.expr("twin = 0 and not tunnel")).alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return base.join(got, [*KEY, "start"], "left").withColumns({
        "precision": zero("made") / F.col("marbles"), "recall": zero("found") / F.col("holes")}).drop("made", "found")


def thin_starts(scores: DataFrame, nodes: DataFrame, edges: DataFrame, compat: bool = False) -> DataFrame:
    """One-to-one thinning: by falling precision a start drops rivals closer than a set network distance, unless
    their precision is at least 0.9."""
    s = keep(scores.withColumn("id", F.struct("start")), "starts")
    a = s.select(*KEY, F.col("id").alias("p"), "lat", "lon", F.col("precision").alias("pp"))
    b = s.select(*KEY, F.col("id").alias("q"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("precision").alias("pq"))
    tol = 0.000001
    wide = RIVAL_BOX + tol
    lonr = F.lit(RIVAL_BOX) / F.cos(F.radians("lat2")) + tol
    box = (F.col("lat2") - wide, F.col("lon2") - lonr, F.col("lat2") + wide, F.col("lon2") + lonr)
    near = box_join(a, b, (F.col("lat"), F.col("lon")), box, 0.001)
    near = near.filter((F.abs(F.col("lat") - F.col("lat2")) <= wide) & (F.abs(F.col("lon") - F.col("lon2")) <= lonr))
    near = keep(near.filter("pp > pq or (pp = pq and p > q)").select(*KEY, "p", "q"), "rivals")
    size = measured(nodes, edges)
    links = size.select(*KEY, F.col("src").alias("u"), F.col("dst").alias("v"), F.col("len").alias("w"))
    links = links.unionByName(links.select(*KEY, F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    d = position_distances(s.select(*KEY, "id", "n1", "n2", "d1", "d2"), near, links, pico(RIVAL_LIMIT), compat)
    rivals = d.filter(F.col("d") < pico(RIVAL_DISTANCE)).select(*KEY, F.col("p").alias("first"), F.col("q").alias("second"))
    kept = greedy_keep(s.select(*KEY, "id", (F.col("precision") >= 0.9).alias("always")), rivals)
    return s.join(kept, [*KEY, "id"], "left_semi").drop("id")


def tile_summary(kept: DataFrame, starts: DataFrame) -> DataFrame:
    """Per tile: mean precision and recall of the kept starts, coverage, and recall times coverage."""
    all_ = starts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("starts"))
    mean = kept.groupBy(*KEY).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.join(mean, list(KEY), "left").select(
        *KEY, "starts", F.coalesce("kept", F.lit(0)).alias("kept"), zero("precision").alias("precision"), zero("recall").alias("recall"),
        (F.coalesce("kept", F.lit(0)) / F.col("starts")).alias("coverage")).withColumn("overall_recall", F.col("recall") * F.col("coverage"))


def dataset_summary(tiles: DataFrame, mean_of_f1: bool = True) -> DataFrame:
    """One row over all tiles: the mean of the tiles' F1, or the F1 of mean precision and recall over tiles that
    have any."""
    f1 = lambda p, r: F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    p, r = F.col("precision"), F.col("overall_recall")
    if mean_of_f1:
        return tiles.agg(F.avg(f1(p, r)).alias("topo"), F.avg(p).alias("precision"), F.avg(r).alias("recall"))
    means = tiles.filter(p + r != 0).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"))
    return means.select(f1(F.col("precision"), F.col("recall")).alias("topo"), "precision", "recall")


def compare_graphs(
    truth: tuple[DataFrame, DataFrame],
    proposal: tuple[DataFrame, DataFrame],
    region: DataFrame,
    step: float = 0.00005,
    reach: float = 0.00300,
    threshold: float = 0.00015,
    match_threshold: float = 0.00010,
    one_to_one: bool = True,
    tunnels: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole comparison: (scores of all matched starts, kept starts, tile summary)."""
    tn, te = (keep(df, "truth") for df in truth)
    pn, pe = (keep(df, "proposal") for df in proposal)
    starts = keep(starting_points(tn, te, region, tunnels=tunnels), "starts")
    matched = keep(match_edges(starts, tn, pn, pe, match_threshold), "matched")
    used = starts.join(matched.select(*KEY, "start"), [*KEY, "start"], "left_semi")
    parts = parts_of_starts(matched)
    marbles = walk_points(pn, pe, matched, step, reach, together=parts)
    holes = walk_points(tn, te, used, step, reach, twins=True, tunnels=tunnels, together=parts)
    scores = keep(start_scores(marbles, holes, matched, threshold, one_to_one), "scores")
    kept = keep(thin_starts(scores, pn, pe), "thinned")
    return scores, kept, tile_summary(kept, starts)


def soft_scores(
    truth: tuple[DataFrame, DataFrame],
    proposal: tuple[DataFrame, DataFrame],
    starts: DataFrame,
    matched: DataFrame,
    step: float = 0.00005,
    reach: float = 0.00300,
    threshold: float = 0.00015,
    soft: bool = True,
    where: Column | None = None,
) -> DataFrame:
    """Soft comparison per start: cheapest greedy matching with a cost for distance and direction:
    (tile_id, start, marbles, holes, matched, cost, score, f).

    Points are matched where they lie, start by start (see ``cheapest_counts``)."""
    starts, matched = keep(starts, "starts"), keep(matched, "matched")
    used = starts.join(matched.select(*KEY, "start"), [*KEY, "start"], "left_semi")
    parts = parts_of_starts(matched)
    marbles = walk_points(*proposal, matched, step, reach, together=parts)
    holes = walk_points(*truth, used, step, reach, where=where, together=parts)
    pairs = point_pairs(numbered(marbles), numbered(holes), threshold, SOFT_GAP, soft=True)
    cost = F.greatest((F.col("dist") - threshold / 3) * 1.5, F.lit(0.0)) + F.col("gap") * threshold * 0.5
    got = cheapest_counts(pairs.withColumn("cost", cost))
    nm = marbles.groupBy(*KEY, "start").agg(F.count(F.lit(1)).alias("marbles"))
    nh = holes.groupBy(*KEY, "start").agg(F.count(F.lit(1)).alias("holes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = matched.select(*KEY, "start").join(nm, [*KEY, "start"], "left").join(nh, [*KEY, "start"], "left").join(got, [*KEY, "start"], "left")
    s = s.select(*KEY, "start", zero("marbles").alias("marbles"), zero("holes").alias("holes"), zero("matched").alias("matched"),
                 (F.coalesce("cost", F.lit(0.0)) if soft else F.lit(0.0)).alias("cost"))
    miss = threshold * SOFT_MISS
    part = lambda n: 1.0 - (F.col("cost") + (F.col(n) - F.col("matched")) * miss) / F.nullif(F.col(n) * miss, F.lit(0.0))
    p, r = part("marbles"), part("holes")
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return s.withColumns({
        "score": F.col("cost") + (F.col("marbles") - F.col("matched")) * miss, "f": F.when(F.col("marbles") == 0, F.lit(0.0)).otherwise(f)})


def soft_summary(scores: DataFrame) -> DataFrame:
    """Per tile: total score, mean F, number of holes."""
    return scores.groupBy(*KEY).agg(F.sum("score").alias("score"), F.avg("f").alias("f"), F.sum("holes").alias("holes"))


def compare_from_nodes(
    truth: tuple[DataFrame, DataFrame],
    proposal: tuple[DataFrame, DataFrame],
    pairs: DataFrame,
    step: float = 0.00005,
    reach: float = 0.00300,
    threshold: float = 0.00015,
    longer_holes: bool = False,
) -> DataFrame:
    """Node starts: the share of marbles with any hole near, and the reverse: (tile_id, start, precision, recall).

    ``pairs``: (tile_id, node_id, other_id), a proposal node with its true node. ``longer_holes`` walks the truth
    one step farther.
    """
    p = keep(pairs.select(*KEY, F.struct("node_id", "other_id").alias("start"), "node_id", "other_id").distinct(), "node-pairs")
    parts = parts_of_starts(p)
    marbles = walk_from_nodes(*proposal, p.select(*KEY, "start", "node_id"), step, reach, together=parts)
    holes = walk_from_nodes(
        *truth, p.select(*KEY, "start", F.col("other_id").alias("node_id")), step, reach + (step if longer_holes else 0.0), together=parts)
    m = marbles.select(*KEY, "start", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    h = holes.select(*KEY, "start", "lat", "lon")
    far = degree_distance(F.col("mlat"), F.col("mlon"), F.col("lat"), F.col("lon"))
    on = [m[k] == h[k] for k in (*KEY, "start")]
    # a start's points are few: all are compared where they lie, as cells would send them anew. A point counts once some other
    # is near, so no pairs are made; no walk has a point twice
    near = reduce(Column.__and__, on) & (F.abs(F.col("mlat") - F.col("lat")) < threshold) & (far < threshold)
    count = lambda df, name: df.groupBy(*KEY, "start").agg(F.count(F.lit(1)).alias(name))
    out = count(marbles, "marbles").join(count(holes, "holes"), [*KEY, "start"])
    out = out.join(count(m.join(h, near, "left_semi"), "mm"), [*KEY, "start"], "left").join(count(h.join(m, near, "left_semi"), "hh"), [*KEY, "start"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*KEY, "start", (zero("mm") / F.col("marbles")).alias("precision"), (zero("hh") / F.col("holes")).alias("recall"))


def random_node_pairs(truth_nodes: DataFrame, nodes: DataFrame, edges: DataFrame, n: int, threshold: float, seed: int) -> DataFrame:
    """n draws with replacement per tile among proposal nodes that have a true node within ``threshold``, each
    with its nearest: (tile_id, draw, node_id, other_id)."""
    ends = edges.select(*KEY, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    cand = nodes.join(ends, [*KEY, "node_id"], "left_semi").select(*KEY, "node_id", "lat", "lon")
    t = truth_nodes.select(*KEY, F.col("node_id").alias("other_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    box = (F.col("lat2") - threshold, F.col("lon2") - threshold, F.col("lat2") + threshold, F.col("lon2") + threshold)
    near = box_join(cand, t, (F.col("lat"), F.col("lon")), box, 4 * threshold, levels=False)
    near = near.withColumn("d", degree_distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter(F.col("d") <= threshold)
    best = near.groupBy(*KEY, "node_id").agg(F.min(F.struct("d", "other_id")).alias("_m")).select(*KEY, "node_id", F.col("_m.other_id").alias("other_id"))
    listed = dense_ids(best, ["node_id"], "_k")
    total = listed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    draws = total.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("_k", F.floor(uniform(seed, *KEY, "draw") * F.col("_n")).cast("bigint"))
    return draws.join(listed, [*KEY, "_k"]).select(*KEY, "draw", "node_id", "other_id")
