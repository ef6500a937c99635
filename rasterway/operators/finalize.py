"""Collected routes: length multipliers, a floor on lengths, and the features they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, MissingLayerError
from rasterway.grid import Grid
from rasterway.operators.zonal import crossed_cells

MILE_KM = 1.609344
# Lengths in km up to which routes cost more, and by how much.
SHORT_CUTOFF, MEDIUM_CUTOFF, SHORT_MULT, MEDIUM_MULT = 3 * MILE_KM, 10 * MILE_KM, 1.5, 1.2


def length_multiplier(length_km: Column, kind: str = "linear") -> Column:
    """1 for long routes; more for short ones, in steps or along a line."""
    if kind.casefold() == "step":
        return F.when(length_km < SHORT_CUTOFF, SHORT_MULT).when(length_km <= MEDIUM_CUTOFF, MEDIUM_MULT).otherwise(1.0)
    if kind.casefold() == "linear":
        slope = (1 - SHORT_MULT) / (MEDIUM_CUTOFF - SHORT_CUTOFF / 2)
        return F.when(length_km <= MEDIUM_CUTOFF, F.lit(slope) * (length_km - F.lit(MEDIUM_CUTOFF)) + 1).otherwise(1.0)
    raise ConfigError(f"unknown kind of length multiplier {kind!r}")


def _need(routes: DataFrame) -> None:
    if "length_km" not in routes.columns:
        raise MissingLayerError("routes have no length_km")


def with_length_multiplier(routes: DataFrame, kind: str = "linear") -> DataFrame:
    """length_mult, raw_cost, and cost times the multiplier."""
    _need(routes)
    out = routes.withColumn("length_mult", length_multiplier(F.col("length_km"), kind)).withColumn("raw_cost", F.col("cost"))
    return out.withColumn("cost", F.col("cost") * F.col("length_mult"))


def with_length_floor(routes: DataFrame, least_km: float) -> DataFrame:
    """Short routes get the least length and a cost in proportion; of no length, the same cost."""
    _need(routes)
    short, length = F.col("length_km") < least_km, F.col("length_km")
    cost = F.when(short & (length > 0), F.col("cost") * (F.lit(float(least_km)) / length)).otherwise(F.col("cost"))
    return routes.withColumn("cost", cost).withColumn("length_km", F.when(short, F.lit(float(least_km))).otherwise(length))


def finalized(routes: DataFrame, kind: str | None = "linear", least_km: float | None = None) -> DataFrame:
    """Multiplier on the unfloored length first, then the floor; raw_cost stays as it was."""
    out = with_length_multiplier(routes, kind) if kind else routes
    return with_length_floor(out, least_km) if least_km is not None else out


def collected(spark, pattern: str, schema=None) -> DataFrame:
    """All route files of a pattern in one table; none is an error, and so are mixed kinds."""
    kinds = [k for k in (".csv", ".parquet", ".json") if pattern.rstrip("*").endswith(k)]
    if len(kinds) != 1:
        raise ConfigError(f"route files need one kind: {pattern}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kinds[0] == ".csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(pattern)
    return reader.parquet(pattern) if kinds[0] == ".parquet" else reader.json(pattern)


def dissolved(features: DataFrame, key: str, geometry: str = "wkt", order: list[str] | None = None) -> DataFrame:
    """One row a feature id: the attributes of its first row, and all geometries as a collection.

    Rows come in the ``order`` of these columns, or of all attributes and the geometry.
    """
    rest = [c for c in features.columns if c not in (key, geometry)]
    by = F.struct(*(order or [*rest, geometry]))
    first = F.min_by(F.struct(*rest), by).alias("_first") if rest else F.lit(None).alias("_first")
    out = features.groupBy(key).agg(first, F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(F.array_sort(F.collect_list(geometry)), ", "), F.lit(")")).alias(geometry))
    return out.select(key, *(F.col(f"_first.`{c}`").alias(c) for c in rest), geometry)


def end_cells(routes: DataFrame, features: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, col, ``key``) of end cells of routes that features (``key``, points) pass through.

    A buffer of 1.1 diagonals around the centre of an end cell holds all of that cell, so
    of what lies in the buffers just the features through the end cells decide.
    """
    ends = routes.select(F.col("end_row").alias("row"), F.col("end_col").alias("col")).distinct()
    at = crossed_cells(features.select(F.col(key).alias("id"), F.col("points").alias("ring")), grid)
    return at.join(ends, ["row", "col"], "left_semi").select("row", "col", F.col("id").alias(key)).distinct()


def with_features(routes: DataFrame, feature_cells: DataFrame, features: DataFrame, key: str, suffix: str = "_trans") -> DataFrame:
    """Routes with the feature whose cells hold their end, then that feature's attributes.

    ``feature_cells`` has row, col and ``key``; where features share a cell the largest
    key counts.  Attribute names that clash get the suffix.
    """
    owner = feature_cells.groupBy(F.col("row").alias("end_row"), F.col("col").alias("end_col")).agg(F.max(key).alias(key))
    out = routes.join(owner, ["end_row", "end_col"], "left")
    renamed = {c: f"{c}{suffix}" for c in features.columns if c != key and c in out.columns}
    return out.join(features.withColumnsRenamed(renamed), key, "left")
