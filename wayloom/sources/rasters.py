"""Reading image tiles and split manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL_SCHEMA = "tile_id string, y int, x int, band string, value double"


def read_image_pixels(spark: SparkSession, path: str, tile: str = r"([^/]+)\.[A-Za-z]+$", gray_band: str = "gray") -> DataFrame:
    """Image files as pixel rows (tile_id, y, x, band, value); bands red, green, blue, or one gray band.

    The built-in image source decodes files in the JVM; its bytes (blue, green, red per pixel) are unfolded in
    Arrow batches.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.regexp_extract("image.origin", tile, 1).alias("tile_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def unfold(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                h, w, n = row["height"], row["width"], row["nChannels"]
                names = [gray_band] if n == 1 else ["blue", "green", "red"]
                cube = np.frombuffer(row["data"], dtype=np.uint8).reshape(h * w, n)
                for lo in range(0, h * w, 1 << 18):  # some rows of the image at a time
                    at = np.arange(lo, min(h * w, lo + (1 << 18)), dtype=np.int32)
                    y, x = np.divmod(at, np.int32(w))
                    for i, band in enumerate(names):
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(row["tile_id"], pa.string()), len(at)), pa.array(y), pa.array(x),
                             pa.repeat(pa.scalar(band, pa.string()), len(at)), pa.array(cube[at, i].astype(np.float64))],
                            names=["tile_id", "y", "x", "band", "value"])

    return img.mapInArrow(unfold, PIXEL_SCHEMA)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Manifest {train, valid or validation, test} to (tile_id, split); tile names as text."""
    doc = spark.read.json(path, multiLine=True)
    names = {"train": "train", "valid": "validation", "validation": "validation", "test": "test"}
    parts = [
        doc.select(F.explode(F.col(c).cast("array<string>")).alias("tile_id"), F.lit(names[c]).alias("split"))
        for c in doc.columns if c in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
