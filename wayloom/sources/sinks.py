"""Writing graphs, masks and scores as tables and interchange files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import to_latlon
from ..operators.graph import renumber, symmetric, undirected, with_ends
from ..operators.spatial import KEY, sliced_join


def rounded_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph to adjacency: coordinates (r, c) rounded half to even, edges in both directions, neighbours a set."""
    n = nodes.withColumns({"x": F.bround("r").cast("bigint"), "y": F.bround("c").cast("bigint")})
    both = with_ends(symmetric(edges.select(*KEY, "src", "dst")), n)
    spot = lambda a, b: F.struct(F.col(a).alias("r"), F.col(b).alias("c"))
    sets = both.groupBy(*KEY, spot("ax", "ay").alias("node")).agg(F.sort_array(F.collect_set(spot("bx", "by"))).alias("nbrs"))
    keys = n.select(*KEY, spot("x", "y").alias("node")).distinct()
    return keys.join(sets, [*KEY, "node"], "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast(sets.schema["nbrs"].dataType)))


def graph_json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of each tile's JSON document [nodes, edges]: (tile_id, part, a, b, line), in that order.

    ``nodes`` have (r, c); nodes are numbered by id and undirected edges appear once, an edge to an unknown node
    is an error. A tile is never gathered in one row: its document is the concatenation of its lines.
    """
    known = nodes.select(*KEY, "node_id")
    ends = edges.select(*KEY, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    lost = ends.join(known, [*KEY, "node_id"], "left_anti").select(
        *KEY, F.lit(9).alias("part"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.raise_error(F.format_string("edge end %d is not a node", F.col("node_id"))).cast("string").alias("line"))
    n, e = renumber(nodes, undirected(edges))
    lat, lon = to_latlon(F.col("r"), F.col("c"))
    at = F.when(F.col("node_id") == 0, F.lit("[[")).otherwise(F.lit(","))
    rows = n.select(
        *KEY, F.lit(0).alias("part"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.concat(at, F.format_string("[%.9f, %.9f]", lat, lon)).alias("line"))
    lead = e.groupBy(*KEY).agg(F.min(F.struct("src", "dst")).alias("_m"))
    first = sliced_join(e, lead, KEY, both=False).withColumn("_f", F.struct("src", "dst") == F.col("_m"))
    links = first.select(
        *KEY, F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"),
        F.concat(F.when(F.col("_f"), F.lit("")).otherwise(F.lit(",")), F.format_string("[%d, %d]", "src", "dst")).alias("line"))
    frame = n.select(*KEY).distinct().select(*KEY, F.explode(F.array(
        F.struct(F.lit(1).alias("part"), F.lit("],[").alias("line")), F.struct(F.lit(3).alias("part"), F.lit("]]").alias("line")))).alias("_x"))
    frame = frame.select(*KEY, "_x.part", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "_x.line")
    return rows.unionByName(links).unionByName(frame).unionByName(lost)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, partitions: int | None = None) -> None:
    """One folder per tile; its part files, read in name order, are the tile's document."""
    lines = graph_json_lines(nodes, edges)
    order = [*KEY, "part", "a", "b"]
    spread = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).select(*KEY, "line").write.partitionBy(*KEY).text(path)


def _shelf(shelves: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(shelves)).cast("int").alias("shelf")


def write_graph_shelves(nodes: DataFrame, edges: DataFrame, path: str, shelves: int = 256) -> None:
    """All tiles in ``shelves`` folders by a hash of the tile, for many tiles: the lines of their documents as JSON rows
    (tile_id, part, a, b, line) in order, a tile of any size running on from file to file. ``read_graph_shelves`` reads
    them back; a tile's document is the concatenation of its ``line`` values."""
    order = ["shelf", *KEY, "part", "a", "b"]
    lines = graph_json_lines(nodes, edges).select("*", _shelf(shelves))
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shelf").json(path)


def write_masks(masks: DataFrame, path: str, shelves: int | None = None) -> None:
    """Fused masks as pixel rows, one folder per tile and band; with ``shelves`` that many folders by a hash of the tile
    in place of one for each tile."""
    flat = masks.select(*KEY, "y", "x", F.explode(F.create_map(
        F.lit("keypoint"), F.col("keypoint").cast("double"), F.lit("road"), F.col("road").cast("double"))).alias("band", "value"))
    if shelves:
        flat.select("*", _shelf(shelves)).write.partitionBy("shelf", "band").parquet(path)
    else:
        flat.write.partitionBy(*KEY, "band").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Per-start logs, per-tile summaries or data-set scores as JSON lines."""
    scores.write.json(path)


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str, shelves: int | None = None) -> None:
    """Rounded adjacency, one folder per tile or, with ``shelves``, that many folders by a hash of the tile."""
    rows = rounded_adjacency(nodes, edges)
    if shelves:
        rows.select("*", _shelf(shelves)).write.partitionBy("shelf").parquet(path)
    else:
        rows.write.partitionBy(*KEY).parquet(path)
