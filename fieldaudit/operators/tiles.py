"""Regions on a tile grid: JOI7, JOI8, FN22, AGG33."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions import geometry as g


def grid():
    """The fixed grid as an array of (tile, x, y), row by row."""
    nx, ny = g.tile_count()
    return F.array(*[
        F.struct(F.lit(j * nx + i).alias("tile"), F.lit(i * g.STRIDE).alias("tx"), F.lit(j * g.STRIDE).alias("ty"))
        for j in range(ny) for i in range(nx)])


def with_tiles(rows: DataFrame) -> DataFrame:
    """JOI8, FN22. Every tile of every row with its label. The grid is fixed, so it is exploded, not joined."""
    region = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    tiled = rows.withColumn("_g", F.explode(grid())).select("*", "_g.*").drop("_g")
    return tiled.withColumn("tile_label", g.tile_label(region, F.col("tx"), F.col("ty")))


def training_tiles(images: DataFrame, regions: DataFrame, key: str = "image_id") -> DataFrame:
    """JOI7, FLT6. Tiles of genuine and C1 images joined to their edit regions; ignored tiles dropped."""
    joined = images.where(F.col("forgery_category").isin("C0", "C1")).join(regions, key, "left")
    return with_tiles(joined).where(F.col("tile_label") != -1)


def document_scores(tiles: DataFrame, key: str, tile: str, logit: str) -> DataFrame:
    """AGG33. Highest tile score per document and the first tile that reaches it."""
    best = F.max(F.struct(F.col(logit).alias("logit"), (-F.col(tile)).alias("_t")))
    return tiles.groupBy(key).agg(best.alias("_b")).select(
        key, F.col("_b.logit").alias("logit"), (-F.col("_b._t")).alias("top_tile"))


def best_person(cases: DataFrame, op_weight: dict[str, int], field_weight: dict[str, int]) -> DataFrame:
    """TOP5. Person whose clean C1 edits show best; ties go to the smallest id."""
    def points(column, weights):
        out = F.lit(0)
        for name, w in weights.items():
            out = F.when(F.col(column) == name, w).otherwise(out)
        return out

    c1 = cases.where((F.col("forgery_category") == "C1") & (F.col("quality_tier") == "clean"))
    per = c1.groupBy("person_id").agg(
        F.countDistinct("doc_type").alias("docs"), F.sum(points("c1_op", op_weight) + points("c1_field", field_weight)).alias("s"),
        F.max((F.col("naming_stratum") == "surname_last").cast("int")).alias("last"))
    scored = per.where(F.col("docs") == 2).select("person_id", (F.col("s") + 2 * F.col("last")).alias("points"))
    return scored.agg(F.max(F.struct("points", (-F.col("person_id")).alias("i"))).alias("b")).select(
        (-F.col("b.i")).alias("person_id"), "b.points")
