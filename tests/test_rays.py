"""Places where rays hit, at halves of the last figure shown: a quotient rounded once is exact there."""

from fractions import Fraction

from pyspark.sql import functions as F

from wayloom.functions.geometry import ray_hit


def test_hits_of_whole_numbers_are_rounded_once(spark):
    rows = [(29, 4, -3, 11, 1, 1, 48, 42)] + [
        (i % 31, i % 7, 1 + i % 5, i % 11 - 5, 40 + i % 13, -60 - i % 17, 41 + i % 19, 70 + i % 23) for i in range(3000)]
    df = spark.createDataFrame(rows, "bx long, by long, ux long, uy long, ax long, ay long, cx long, cy long")
    hit = ray_hit(*[F.col(c) for c in df.columns]).alias("h")
    seen = 0
    for r in df.select("*", hit).collect():
        if r["h"] is None:
            continue
        wx, wy = r["cx"] - r["ax"], r["cy"] - r["ay"]
        t = Fraction(wx * (r["by"] - r["ay"]) - wy * (r["bx"] - r["ax"]), wy * r["ux"] - wx * r["uy"])
        assert (r["h"]["x"], r["h"]["y"]) == (float(r["bx"] + t * r["ux"]), float(r["by"] + t * r["uy"]))
        seen += 1
    assert seen > 1000
