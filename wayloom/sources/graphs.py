"""Reading graphs: JSON documents, adjacency tables, forest dumps; tile filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import METRES_PER_DEGREE, in_crop, location_key, to_latlon
from ..operators.graph import symmetric
from ..operators.spatial import KEY, cell_chunk, dense_ids

GRAPH_JSON = "array<array<array<double>>>"


def read_graph_json(spark: SparkSession, path: str, tile: str = r"([^/]+)\.json$") -> tuple[DataFrame, DataFrame]:
    """Files with one graph each, [[[lat, lon], …], [[i, j], …]]; the tile name is taken from the file name.

    What ``write_graph_json`` has written, a folder per tile whose part files make up the document, is read as well, line by
    line, so that no tile has to fit in a row.
    """
    files = spark.read.text(path, wholetext=True)
    if "tile_id" in files.columns:
        return _read_graph_lines(spark.read.text(path))
    return parse_graph_json(files.select(F.regexp_extract(F.input_file_name(), tile, 1).alias("tile_id"), F.col("value").alias("doc")))


def _read_graph_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of documents, one node or edge each. A node's number is the count of node lines before its own in the
    files of its tile: they are counted per piece of a file, and only the counts are run up over the pieces."""
    pair = F.from_json(F.regexp_extract("value", r"\[[^\[\]]+\]", 0), "array<double>")
    rows = lines.select(
        *KEY, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").contains(".").alias("_node"), pair.alias("_p"))
    rows = rows.filter("_p is not null")
    places = rows.filter("_node").select(*KEY, "_file", "_from", "_line", F.col("_p")[0].alias("lat"), F.col("_p")[1].alias("lon"))
    nodes = dense_ids(places, ["_file", "_from", "_line"], "node_id", [F.col("_file"), F.col("_from")])
    edges = rows.filter("not _node").select(*KEY, F.col("_p")[0].cast("bigint").alias("src"), F.col("_p")[1].cast("bigint").alias("dst"))
    return _located(nodes.select(*KEY, "node_id", "lat", "lon")), edges


def _located(nodes: DataFrame) -> DataFrame:
    nodes = nodes.withColumn("loc_key", location_key(F.col("lat"), F.col("lon")))
    first = nodes.groupBy(*KEY, "loc_key").agg(F.min("node_id").alias("first_id"))
    return nodes.join(first, [*KEY, "loc_key"]).select(*KEY, "node_id", "lat", "lon", "loc_key", "first_id")


def read_graph_shelves(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all tiles that ``write_graph_shelves`` has written."""
    rows = spark.read.json(path, schema="tile_id string, part int, a bigint, b bigint, line string")
    pair = F.from_json(F.regexp_extract("line", r"\[[^\[\]]+\]", 0), "array<double>")
    nodes = rows.filter("part = 0").withColumn("_p", pair).select(
        *KEY, F.col("a").alias("node_id"), F.col("_p")[0].alias("lat"), F.col("_p")[1].alias("lon"))
    return _located(nodes), rows.filter("part = 2").select(*KEY, F.col("a").alias("src"), F.col("b").alias("dst"))


def parse_graph_json(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile_id, doc) to nodes (tile_id, node_id, lat, lon, loc_key, first_id) and edges.

    ``first_id`` is the lowest id at the same location up to 7 decimals; all nodes remain.
    """
    g = docs.select(*KEY, F.from_json("doc", GRAPH_JSON).alias("g"))
    nodes = g.select(*KEY, F.posexplode(F.col("g")[0]).alias("i", "p")).select(
        *KEY, F.col("i").cast("bigint").alias("node_id"), F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))
    edges = g.select(*KEY, F.explode(F.col("g")[1]).alias("e")).select(
        *KEY, F.col("e")[0].cast("bigint").alias("src"), F.col("e")[1].cast("bigint").alias("dst"))
    return _located(nodes), edges


def adjacency_table(nodes: DataFrame, edges: DataFrame, cols: tuple[str, str] = ("r", "c")) -> DataFrame:
    """(tile_id, node, nbrs): each node's position with the positions of its neighbours, edges in both directions."""
    u, v = cols
    at = lambda name, key: nodes.select(*KEY, F.col("node_id").alias(key), F.struct(F.col(u).alias("r"), F.col(v).alias("c")).alias(name))
    both = symmetric(edges.select(*KEY, "src", "dst")).distinct().join(at("nbr", "dst"), [*KEY, "dst"])
    sets = both.groupBy(*KEY, "src").agg(F.sort_array(F.collect_set("nbr")).alias("nbrs"))
    out = at("node", "src").join(sets, [*KEY, "src"], "left")
    return out.select(*KEY, "node", F.coalesce("nbrs", F.array().cast(sets.schema["nbrs"].dataType)).alias("nbrs"))


def from_adjacency(
    adjacency: DataFrame, transform: Callable[[Column, Column], tuple[Column, Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Adjacency to nodes (tile_id, node_id, r, c) and directed edges, which are not deduplicated.

    Neighbours that are no keys become nodes too. Ids are dense, by position: rows have no order of first sight.
    ``transform`` makes new (x, y) coordinates of the nodes from (r, c), which they take the place of.
    """
    links = adjacency.select(*KEY, "node", F.explode("nbrs").alias("nbr"))
    spots = adjacency.select(*KEY, "node").unionByName(links.select(*KEY, F.col("nbr").alias("node"))).distinct()
    nodes = dense_ids(spots.select(*KEY, "node.r", "node.c"), ["r", "c"], "node_id", cell_chunk("r", "c")).select(*KEY, "node_id", "r", "c")
    at = lambda name, key: nodes.select(*KEY, F.struct("r", "c").alias(name), F.col("node_id").alias(key))
    edges = links.join(at("node", "src"), [*KEY, "node"]).join(at("nbr", "dst"), [*KEY, "nbr"]).select(*KEY, "src", "dst")
    if transform is not None:
        x, y = transform(F.col("r"), F.col("c"))
        nodes = nodes.select(*KEY, "node_id", x.alias("x"), y.alias("y"))
    return nodes, edges


def crop_adjacency(adjacency: DataFrame, size: int = 400, margin: int = 24) -> DataFrame:
    """Keep keys and neighbours inside the margin and move them by it."""
    kept = adjacency.filter(in_crop(F.col("node.r"), F.col("node.c"), size, margin))
    move = lambda p: F.struct((p["r"] - margin).alias("r"), (p["c"] - margin).alias("c"))
    nbrs = F.transform(F.filter("nbrs", lambda p: in_crop(p["r"], p["c"], size, margin)), move)
    return kept.select(*KEY, move(F.col("node")).alias("node"), nbrs.alias("nbrs"))


def road_graph(adjacency: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A directed road graph in latlon: nodes and edges with scores of 100, and each tile's region.

    Edges are those of the adjacency, each once. The region starts from the frame's corner and takes the extrema
    of the tile's key nodes, wider by 300 m in latitude and 500 m in longitude.
    """
    nodes, edges = from_adjacency(adjacency)
    lat, lon = to_latlon(F.col("r"), F.col("c"))
    nodes = nodes.select(*KEY, "node_id", lat.alias("lat"), lon.alias("lon"), F.lit(100).alias("node_score"))
    edges = edges.distinct().withColumn("edge_score", F.lit(100))
    klat, klon = to_latlon(F.col("node.r"), F.col("node.c"))
    region = adjacency.groupBy(*KEY).agg(F.min(klat).alias("low"), F.max(klon).alias("high")).select(
        *KEY, (F.least(F.col("low"), F.lit(41.0)) - 300 / METRES_PER_DEGREE).alias("min_lat"),
        F.lit(-71.0 - 500 / METRES_PER_DEGREE).alias("min_lon"), F.lit(41.0 + 300 / METRES_PER_DEGREE).alias("max_lat"),
        (F.greatest(F.col("high"), F.lit(-71.0)) + 500 / METRES_PER_DEGREE).alias("max_lon"))
    return nodes, edges, region


def non_empty(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop tiles whose graph has no nodes."""
    return tiles.join(nodes.select(*KEY).distinct(), list(KEY), "left_semi")


def with_prediction(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Only tiles for which a prediction exists."""
    return truth.join(prediction.select(*KEY).distinct(), list(KEY), "left_semi")


def load_forest(forest: DataFrame, box: tuple[float, float, float, float] | None = None):
    """Forest dump to (nodes, edges, terminals).

    ``forest``: (tile_id, tree_id, id, lat, lon, parent, similar_tree, similar_id, out_region); a node is named by the
    struct (tree_id, id), so that ids of any length stay apart. A row with an alias (similar_tree <> -1) takes the alias's name and place; rows
    outside ``box`` (min_lat, min_lon, max_lat, max_lon) are skipped; ``out_region`` marks the parent terminal.
    """
    name = lambda t, i: F.struct(F.col(t).cast("bigint").alias("tree_id"), F.col(i).cast("bigint").alias("id"))
    spot = forest.select(*KEY, "tree_id", F.col("id").alias("_i"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rows = forest
    if box is not None:
        rows = rows.filter(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    up = spot.select(*KEY, "tree_id", F.col("_i").alias("parent"), F.col("_lat").alias("plat"), F.col("_lon").alias("plon"))
    alias = spot.select(*KEY, F.col("tree_id").alias("similar_tree"), F.col("_i").alias("similar_id"), F.col("_lat").alias("slat"), F.col("_lon").alias("slon"))
    full = rows.join(up, [*KEY, "tree_id", "parent"]).join(alias, [*KEY, "similar_tree", "similar_id"], "left")
    aliased = F.col("similar_tree") != -1
    e = full.select(
        *KEY, name("tree_id", "parent").alias("src"), "plat", "plon", "out_region",
        F.when(aliased, name("similar_tree", "similar_id")).otherwise(name("tree_id", "id")).alias("dst"),
        F.when(aliased, F.col("slat")).otherwise(F.col("lat")).alias("lat"), F.when(aliased, F.col("slon")).otherwise(F.col("lon")).alias("lon"))
    edges = e.select(*KEY, "src", "dst").distinct()
    ends = e.select(*KEY, F.col("src").alias("node_id"), F.struct(F.col("plat").alias("lat"), F.col("plon").alias("lon")).alias("at")).unionByName(
        e.select(*KEY, F.col("dst").alias("node_id"), F.struct("lat", "lon").alias("at")))
    nodes = ends.groupBy(*KEY, "node_id").agg(F.min("at").alias("at")).select(*KEY, "node_id", "at.lat", "at.lon")
    terminals = e.filter("out_region = 1").select(*KEY, F.col("src").alias("node_id")).distinct()
    return nodes, edges, terminals


__all__ = [
    "read_graph_json", "read_graph_shelves", "parse_graph_json", "adjacency_table", "from_adjacency", "crop_adjacency", "road_graph", "non_empty",
    "with_prediction", "load_forest",
]
