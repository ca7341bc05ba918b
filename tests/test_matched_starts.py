"""Marble comparisons match the points of a start where they lie."""

import random

from pyspark.sql import functions as F

from wayloom.operators.select import cheapest_matching
from wayloom.plans import topo
from wayloom.session import keep


def pairs_of(spark, seed):
    rng = random.Random(seed)
    rows = {(1, s, rng.randrange(9), rng.randrange(9)) for s in range(6) for _ in range(30)}
    rows = [(*r, r[2] % 2, r[3] % 3 == 0, rng.choice([0.0, 0.25, 0.5, rng.random()])) for r in sorted(rows)]
    return spark.createDataFrame(rows, "tile_id bigint, start bigint, m bigint, h bigint, twin int, tunnel boolean, cost double")


def test_cheapest_pairs_of_a_start(spark):
    p = pairs_of(spark, 3)
    rounds = cheapest_matching(p.select(F.struct("tile_id", "start").alias("tile_id"), F.col("m").alias("a"), F.col("h").alias("b"), "cost"))
    want = {r.tile_id.start: (r.n, round(r.c, 9)) for r in rounds.groupBy("tile_id").agg(F.count("a").alias("n"), F.sum("cost").alias("c")).collect()}
    assert {r.start: (r.matched, round(r.cost, 9)) for r in topo.cheapest_counts(p).collect()} == want


def test_largest_matchings_of_a_start(spark):
    p = pairs_of(spark, 5)
    rows = p.collect()
    for r in topo.matched_counts(p).collect():
        mine = [q for q in rows if q.start == r.start]
        plain = [q for q in mine if q.twin == 0 and not q.tunnel]
        size = lambda qs: topo.matching_size([q.m for q in qs], [q.h for q in qs])
        assert (r.made, r.found) == (size(mine), size(plain))


def test_points_of_matched_starts_are_not_sent(spark, frame):
    n = frame([(i, 41.0 + 0.0004 * i, -71.0) for i in range(6)], "node_id bigint, lat double, lon double")
    e = frame([(i, i + 1) for i in range(5)] + [(i + 1, i) for i in range(5)], "src bigint, dst bigint")
    starts = keep(topo.starting_points(n, e))
    matched = keep(topo.match_edges(starts, n, n, e))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = topo.soft_scores((n, e), (n, e), starts, matched)
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert {round(r.f, 6) for r in out.collect()} == {1.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    deep = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    cuts = [i for i, line in enumerate(lines) if "Generate explode(sequence(_f" in line]
    assert cuts  # points are cut inside the plan and not written down
    for i in cuts:
        level = deep(lines[i])
        for above in reversed(lines[:i]):
            if deep(above) < level:
                level = deep(above)
                if "Aggregate" in above:
                    break  # a row for each start from here on
                assert "Exchange" not in above


def test_searches_without_success_are_not_repeated():
    def simple(left, right):
        options, of = {}, {}
        for a, b in zip(left, right):
            options.setdefault(a, []).append(b)

        def found(a, seen):
            for b in options[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in of or found(of[b], seen):
                        of[b] = a
                        return True
            return False

        return sum(found(a, set()) for a in options)

    rng = random.Random(9)
    for n in range(400):
        pairs = [(rng.randrange(12), rng.randrange(2 + n % 11)) for _ in range(rng.randrange(1, 40))]
        left, right = [p[0] for p in pairs], [p[1] for p in pairs]
        assert topo.matching_size(left, right) == simple(left, right)

    class Counted(int):
        looked = 0

        def __hash__(self):
            Counted.looked += 1
            return int.__hash__(self)

    pairs = [(a, Counted(b)) for a in range(200) for b in range(20)]
    assert topo.matching_size([a for a, _ in pairs], [b for _, b in pairs]) == 20
    assert Counted.looked < 5 * len(pairs), Counted.looked
