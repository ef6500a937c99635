"""Transmission tables: voltages, capacities, regions, costs; as dimensions for broadcast joins.

Every table is replaceable; the defaults are fixed values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway.errors import ConfigError

# Default transmission tables.
BASE_LINE_COSTS = {
    "TEPPC": {"102": 983701, "205": 1180083, "400": 1579572, "1500": 3052857, "3000": 2525849},
    "SCE": {"102": 1524000, "205": 2084122, "400": 3034000, "1500": 4777000, "3000": 3952357},
    "MISO": {"102": 1254921, "205": 1446469, "400": 1694747, "1500": 2787303, "3000": 2306137},
    "Southeast": {"102": 818852, "205": 984325, "400": 1567655, "1500": 4056410, "3000": 3356161},
}
ISO_LOOKUP = {"TEPPC": 1, "SCE": 2, "MISO": 3, "Southeast": 4}
ISO_MULTIPLIERS = [
    {"iso": "TEPPC", "land_use": {"cropland": 1, "forest": 2.25, "suburban": 1.3, "urban": 1.59, "wetland": 1.2}, "slope": {"hill_mult": 1.4, "hill_slope": 2, "mtn_mult": 1.75, "mtn_slope": 8}},
    {"iso": "SCE", "land_use": {"cropland": 1, "forest": 3, "suburban": 2, "urban": 3, "wetland": 2}, "slope": {"hill_mult": 1.5, "hill_slope": 2, "mtn_mult": 2, "mtn_slope": 8}},
    {"iso": "MISO", "land_use": {"cropland": 1.03, "forest": 1.2, "suburban": 1.08, "urban": 1.2, "wetland": 1.8}, "slope": {"hill_mult": 1.1, "hill_slope": 2, "mtn_mult": 1.21, "mtn_slope": 8}},
    {"iso": "Southeast", "land_use": {"cropland": 1, "forest": 1.47, "suburban": 1.75, "urban": 1.12, "wetland": 1.33}, "slope": {"hill_mult": 1.2, "hill_slope": 2, "mtn_mult": 1.6, "mtn_slope": 8}},
]
LAND_USE_CLASSES = {"cropland": [80, 81], "forest": [41, 42, 43], "suburban": [21, 22, 23], "urban": [24], "wetland": [90, 95]}
NEW_SUBSTATION_COSTS = {
    "TEPPC": {"69": 3498000, "138": 5541000, "230": 9171000, "500": 15489000},
    "SCE": {"69": 3975000, "138": 8870000, "230": 17525000, "500": 37017000},
    "MISO": {"69": 5700000, "138": 7800000, "230": 9700000, "500": 20300000},
    "Southeast": {"69": 3064000, "138": 4692000, "230": 5732000, "500": 20364000},
}
UPGRADE_SUBSTATION_COSTS = {
    "TEPPC": {"69": 1352000, "138": 2198000, "230": 5500000, "500": 10236000},
    "SCE": {"69": 767000, "138": 1117000, "230": 3975000, "500": 9665000},
    "MISO": {"69": 1100000, "138": 1600000, "230": 2200000, "500": 5300000},
    "Southeast": {"69": 917000, "138": 1179000, "230": 2210000, "500": 8340000},
}
POWER_CLASSES = {"100MW": 102, "200MW": 205, "400MW": 400, "1000MW": 1500, "3000MW": 3000}
POWER_TO_VOLTAGE = {"68": 46, "102": 69, "171": 115, "205": 138, "240": 161, "343": 230, "400": 230, "750": 345, "1500": 500, "3000": 500}
TRANSFORMER_COSTS = {
    "69": {"69": 4720, "115": 3840, "138": 4260, "161": 4480, "230": 4970, "345": 6100, "500": 7860},
    "115": {"69": 3840, "115": 5230, "138": 4260, "161": 4480, "230": 4970, "345": 5790, "500": 7110},
    "138": {"69": 4260, "115": 4260, "138": 5790, "161": 4720, "230": 4970, "345": 5790, "500": 7110},
    "161": {"69": 4480, "115": 4480, "138": 4720, "161": 6420, "230": 5230, "345": 6100, "500": 7490},
    "230": {"69": 4970, "115": 4970, "138": 4970, "161": 5230, "230": 7110, "345": 6100, "500": 7490},
    "345": {"69": 6100, "115": 5790, "138": 5790, "161": 6100, "230": 6100, "345": 8670, "500": 7860},
    "500": {"69": 7860, "115": 7110, "138": 7110, "161": 7490, "230": 7490, "345": 7860, "500": 11610},
}


def capacity_class(capacity: int | float | str) -> str:
    """'100MW' of 100 or '100'."""
    if not isinstance(capacity, str):
        return f"{int(capacity)}MW"
    return capacity if capacity.endswith("MW") else f"{capacity}MW"


@dataclass
class Transmission:
    """The tables of one study; any of them may be given anew, by value or as a JSON file."""

    base_line_costs: dict = field(default_factory=lambda: BASE_LINE_COSTS)
    iso_lookup: dict = field(default_factory=lambda: ISO_LOOKUP)
    iso_multipliers: list = field(default_factory=lambda: ISO_MULTIPLIERS)
    land_use_classes: dict = field(default_factory=lambda: LAND_USE_CLASSES)
    new_substation_costs: dict = field(default_factory=lambda: NEW_SUBSTATION_COSTS)
    upgrade_substation_costs: dict = field(default_factory=lambda: UPGRADE_SUBSTATION_COSTS)
    power_classes: dict = field(default_factory=lambda: POWER_CLASSES)
    power_to_voltage: dict = field(default_factory=lambda: POWER_TO_VOLTAGE)
    transformer_costs: dict = field(default_factory=lambda: TRANSFORMER_COSTS)

    @staticmethod
    def load(config: "Transmission | dict | str | None" = None) -> "Transmission":
        if isinstance(config, Transmission):
            return config
        if isinstance(config, str):
            with open(config) as f:
                config = json.load(f)
        given = {}
        for name, table in (config or {}).items():
            if name not in Transmission.__dataclass_fields__:
                raise ConfigError(f"unknown transmission table {name!r}")
            if isinstance(table, str):
                with open(table) as f:
                    table = json.load(f)
            given[name] = table
        return Transmission(**given)

    def capacity_to_kv(self, capacity) -> int:
        return int(self.power_to_voltage[str(self.power_classes[capacity_class(capacity)])])

    def kv_to_capacity(self, kv: int) -> int:
        """The capacity class of a voltage; of several powers at one voltage the last listed counts."""
        power = {v: p for p, v in self.power_to_voltage.items()}[kv]
        classes = {p: c for c, p in self.power_classes.items()}
        return int(classes[int(power)].removesuffix("MW"))

    # Dimensions -----------------------------------------------------------

    def line_costs(self, spark: SparkSession) -> DataFrame:
        """(iso, power, cost_per_mile)."""
        rows = [(self.iso_lookup[name], int(p), float(c)) for name, costs in self.base_line_costs.items() for p, c in costs.items()]
        return spark.createDataFrame(rows, "iso int, power int, cost_per_mile double")

    def substation_costs(self, spark: SparkSession) -> DataFrame:
        """(region, voltage, upgrade_cost, new_cost)."""
        rows = [(self.iso_lookup[name], int(v), float(c), float(self.new_substation_costs[name][v])) for name, costs in self.upgrade_substation_costs.items() for v, c in costs.items()]
        return spark.createDataFrame(rows, "region int, voltage int, upgrade_cost double, new_cost double")

    def transformers(self, spark: SparkSession) -> DataFrame:
        """(tie_voltage, class_voltage, cost_per_mw)."""
        rows = [(int(t), int(v), float(c)) for t, costs in self.transformer_costs.items() for v, c in costs.items()]
        return spark.createDataFrame(rows, "tie_voltage int, class_voltage int, cost_per_mw double")

    def with_transformer_cost(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (feature_voltage, tie_voltage) with the cost of the smallest class that is enough, else of the largest."""
        costs = F.broadcast(self.transformers(pairs.sparkSession).groupBy("tie_voltage").agg(F.array_sort(F.collect_list(F.struct("class_voltage", "cost_per_mw"))).alias("classes")))
        enough = F.filter("classes", lambda c: c["class_voltage"] >= F.col("feature_voltage"))
        pick = F.when(F.size(enough) > 0, enough[0]).otherwise(F.element_at("classes", -1))
        return pairs.join(costs, "tie_voltage").withColumn("transformer_cost", pick["cost_per_mw"]).drop("classes")
