"""Substations, lines and regions of a transmission network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway.functions import geometry as G
from rasterway.operators.route_tables import nearest_region

#: Substations below this voltage are dropped.
LEAST_KV = 69
#: Half the length of the line that stands for a point of interconnection.
DUMMY_HALF_LENGTH = 25.0


def substation_voltages(substations: DataFrame, lines: DataFrame, least_kv: float = LEAST_KV) -> DataFrame:
    """``substations`` (gid, trans_gids as a JSON list) with min_volts and max_volts of their lines; weak ones go."""
    pairs = substations.select("gid", F.explode(F.from_json("trans_gids", "array<bigint>")).alias("trans_gid")).distinct()
    volts = pairs.join(lines.select("trans_gid", "voltage"), "trans_gid").groupBy("gid").agg(F.min("voltage").alias("min_volts"), F.max("voltage").alias("max_volts"))
    return substations.join(volts, "gid").where(F.col("max_volts") >= least_kv)


def substations_of_category(features: DataFrame, category: str = "Substation", least_kv: float = LEAST_KV) -> DataFrame:
    """Features (gid, category, trans_gids, voltage, ...) of a category as substations (trans_gid, ...) with min_volts and max_volts.

    Voltages are those of all features that a substation lists; weak substations and columns without any value go.
    """
    own = features.where(F.col("category") == category)
    some = own.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in own.columns)).first()
    lines = features.select(F.col("gid").alias("trans_gid"), "voltage")
    return substation_voltages(own.select(*(c for c in own.columns if some[c] or c in ("gid", "trans_gids"))), lines, least_kv).withColumnRenamed("gid", "trans_gid")


def substations_in_regions(substations: DataFrame, regions: DataFrame, key: str = "rid") -> DataFrame:
    """Each substation (gid, x, y, ...) with its nearest region."""
    return nearest_region(substations.withColumnRenamed("gid", "id"), regions, key).withColumnRenamed("id", "gid").drop("distance")


def substations_of_connections(connections: DataFrame) -> DataFrame:
    """Distinct rows of substations of a connection table, so one at two places has two; rows without a place are dropped."""
    columns = [c for c in ("poi_gid", "poi_lat", "poi_lon", "region") if c in connections.columns]
    return connections.select(*columns).dropna(subset=[c for c in columns if c != "region"]).dropDuplicates(columns)


def regions_of_nodes(nodes: DataFrame, regions: DataFrame, key: str = "rid") -> DataFrame:
    """Network nodes (id, x, y, ...) with their region."""
    return nearest_region(nodes, regions, key).drop("distance")


def region_centroids(regions: DataFrame) -> DataFrame:
    """Regions (ring, ...) with cx and cy."""
    return regions.withColumn("_c", G.centroid(F.col("ring"))).withColumn("cx", F.col("_c.x")).withColumn("cy", F.col("_c.y")).drop("_c")


def poi_lines(pois: DataFrame) -> DataFrame:
    """Points of interconnection (name, state, voltage, x, y) as short lines, and one far line that nothing reaches."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    line = F.array(G.point(x, y), G.point(x + 2 * DUMMY_HALF_LENGTH, y))
    out = pois.select(F.monotonically_increasing_id().alias("_o"), "name", "state", F.col("voltage").cast("double").alias("voltage"), line.alias("points"))
    out = out.select(F.xxhash64("name", "state", "voltage", F.to_json("points")).alias("gid"), "name", "state", "voltage", F.lit("Substation").alias("category"), "points")
    spark: SparkSession = pois.sparkSession
    far = spark.range(1).select(F.lit(-1).cast("bigint").alias("gid"), F.lit("fake").alias("name"), F.lit("").alias("state"), F.lit(0.0).alias("voltage"), F.lit("TransLine").alias("category"), F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(100000), F.lit(100000))).alias("points"))
    return out.unionByName(far).withColumn("wkt", G.to_wkt(F.col("points")))
