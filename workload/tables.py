"""The operators' input tables, derived by Spark from the driver's tables.

Every definition here has its SQL twin in ``workload/oracle.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessarea.functions import ratio, round_half_even
from tessarea.operators.deprivation import quintile
from tessarea.operators.frame import model_frame
from tessarea.operators.graph import contiguity
from tessarea.operators.model import rates_fit
from tessarea.plans.levels import level_counts, level_scores, stored_cases
from tessarea.session import cut_lineage, tune

# Fixed values of the driver's customer table, in order of the SA1 digit.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def rectangle(x0: Column, y0: Column, width: float, height: float) -> Column:
    """One closed ring around a rectangle."""
    corners = ((0, 0), (width, 0), (width, height), (0, height), (0, 0))
    return F.array(
        *[
            F.struct(
                (x0 + F.lit(float(dx))).cast("double").alias("x"),
                (y0 + F.lit(float(dy))).cast("double").alias("y"),
            )
            for dx, dy in corners
        ]
    )


def mean_balance() -> Column:
    """Rounded mean balance; summed in whole cents, so free of summation order."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return round_half_even(ratio(F.sum(cents), F.count(F.lit(1)) * F.lit(100.0)))


class Tables:
    """Lazy inputs of one scale-factor folder; serves as study inputs for the plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.schemas: dict[str, StructType] = {}
        self._counts: dict[str, DataFrame] = {}

    def scan(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in self.schemas:  # footers are read once, not by every scan
            self.schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[path]).parquet(path)

    @cached_property
    def mesh(self) -> DataFrame:
        """One mesh block per customer; nation is SA2, region SA3, its parity SA4."""
        return self.mesh_balances.drop("c_acctbal")

    @cached_property
    def mesh_balances(self) -> DataFrame:
        """The mesh blocks with the balance that scores are made of."""
        segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
        code = F.col("n_nationkey").cast("bigint")
        queensland = F.col("n_nationkey") < 20
        return (
            self.scan("customer")
            .join(self.scan("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("MB_CODE16"),
                (code * 10 + segment).alias("SA1_MAIN16"),
                code.alias("SA2_MAIN16"),
                F.col("n_name").alias("SA2_NAME16"),
                F.col("n_regionkey").cast("bigint").alias("SA3_CODE16"),
                (F.col("n_regionkey") % 2).cast("bigint").alias("SA4_CODE16"),
                F.when(queensland, "3").otherwise("1").alias("STE_CODE16"),
                F.when(queensland, "Queensland").otherwise("Other").alias("STE_NAME16"),
                "c_acctbal",
            )
        )

    @cached_property
    def population(self) -> DataFrame:
        """Persons of a mesh block: the customer's urgent orders."""
        urgent = (
            self.scan("orders")
            .where("o_orderpriority = '1-URGENT'")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        return (
            self.scan("customer")
            .select("c_custkey")
            .join(urgent, "c_custkey", "left")
            .select(F.col("c_custkey").alias("MB_CODE_2016"), F.coalesce("_n", F.lit(0)).alias("Person"))
        )

    @cached_property
    def line_cells(self) -> DataFrame:
        """Returned and all order lines per nation, status and line number."""
        homes = (
            self.scan("orders")
            .select("o_orderkey", "o_custkey", "o_orderstatus")
            .join(
                self.scan("customer").select("c_custkey", "c_nationkey"),
                F.col("o_custkey") == F.col("c_custkey"),
            )
            .select("o_orderkey", "o_orderstatus", "c_nationkey")
        )
        returned = F.col("l_returnflag") == "R"
        # Grouped before the area names are looked up: the lookup meets few rows.
        cells = (
            self.scan("lineitem")
            .select("l_orderkey", "l_linenumber", "l_returnflag")
            .join(homes, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("c_nationkey", "o_orderstatus", "l_linenumber")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(returned).alias("n_returned"))
        )
        return cells.join(self.scan("nation"), F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def area_scores(self) -> DataFrame:
        """``sa2_name, irsdscore`` per nation."""
        score = self.scan("customer").groupBy("c_nationkey").agg(
            mean_balance().alias("irsdscore")
        )
        return score.join(
            self.scan("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(F.col("n_name").alias("sa2_name"), "irsdscore")

    @cached_property
    def cases(self) -> DataFrame:
        """Observed and expected cases per SA2, sex and site."""
        overall = (
            self.scan("lineitem")
            .agg(ratio(F.count_if(F.col("l_returnflag") == "R"), F.count(F.lit(1))).alias("_s"))
            .scalar()
        )
        return self.line_cells.select(
            F.col("n_nationkey").cast("bigint").alias("sa2"),
            F.col("n_name").alias("sa2_name"),
            F.col("o_orderstatus").alias("sex"),
            F.col("l_linenumber").alias("site10group"),
            F.col("n_returned").cast("double").alias("count"),
            (F.col("n_lines") * overall).alias("expect"),
        )

    @cached_property
    def scored_cases(self) -> DataFrame:
        """The cases with the score of their SA2."""
        return self.cases.join(self.area_scores, "sa2_name")

    @cached_property
    def concordance(self) -> DataFrame:
        """Every fifth nation gives a quarter of its cases to the next one."""
        nation = self.scan("nation")
        code = F.col("n_nationkey")
        split = code % 5 == 0
        links = nation.select(
            F.col("n_name").alias("SA2_NAME_2011"),
            F.inline(
                F.when(
                    split,
                    F.array(
                        F.struct(code.alias("_to"), F.lit(0.75).alias("RATIO")),
                        F.struct(((code + 1) % 25).alias("_to"), F.lit(0.25).alias("RATIO")),
                    ),
                ).otherwise(F.array(F.struct(code.alias("_to"), F.lit(1.0).alias("RATIO"))))
            ),
        )
        return links.join(nation, F.col("_to") == F.col("n_nationkey")).select(
            "SA2_NAME_2011",
            F.col("_to").cast("bigint").alias("SA2_MAINCODE_2016"),
            F.col("n_name").alias("SA2_NAME_2016"),
            "RATIO",
        )

    @cached_property
    def scores(self) -> DataFrame:
        """``SA1_MAIN16, SA1_irsdscore, SA1_pop``."""
        score = (
            self.mesh_balances.join(
                self.population.withColumnRenamed("MB_CODE_2016", "MB_CODE16"), "MB_CODE16"
            )
            .groupBy("SA1_MAIN16")
            .agg(mean_balance().alias("SA1_irsdscore"), F.sum("Person").alias("SA1_pop"))
        )
        # An input file of the real study, so a stored table here as well.
        return cut_lineage(score, "sa1-scores")

    @cached_property
    def mesh_layer(self) -> DataFrame:
        """Unit squares, fifty to a row."""
        code = F.col("MB_CODE16")
        rings = F.array(rectangle(code % 50, F.floor(code / 50), 1, 1))
        return self.mesh.withColumn("rings", rings)

    @cached_property
    def sa1_layer(self) -> DataFrame:
        """Each SA2 square of side 5 cut into five strips, one per SA1."""
        code = F.col("SA1_MAIN16")
        parent = F.floor(code / 10)
        rings = F.array(
            rectangle((parent % 5) * 5 + code % 10, F.floor(parent / 5) * 5, 1, 5)
        )
        return self.mesh.select("SA1_MAIN16").distinct().withColumn("rings", rings)

    @cached_property
    def sa2_layer(self) -> DataFrame:
        """Squares of side 5; the last one lies apart and is an island."""
        code = F.col("SA2_MAIN16")
        shift = F.when(code == 24, 1000).otherwise(0)
        rings = F.array(rectangle((code % 5) * 5 + shift, F.floor(code / 5) * 5, 5, 5))
        return self.mesh.select("SA2_MAIN16").distinct().withColumn("rings", rings)

    @cached_property
    def sa3_layer(self) -> DataFrame:
        code = F.col("SA3_CODE16")
        return (
            self.mesh.select("SA3_CODE16")
            .distinct()
            .withColumn("rings", F.array(rectangle(code * 5, F.lit(0), 5, 25)))
        )

    @cached_property
    def sa4_layer(self) -> DataFrame:
        """Multipolygons of the SA3 rectangles of one parity."""
        code = F.col("SA3_CODE16")
        ring = rectangle(code * 5, F.lit(0), 5, 25)
        return (
            self.mesh.select("SA3_CODE16", "SA4_CODE16")
            .distinct()
            .groupBy("SA4_CODE16")
            .agg(F.array_sort(F.collect_list(ring)).alias("rings"))
        )

    @cached_property
    def layers(self) -> dict[str, DataFrame]:
        return {
            "Mesh": self.mesh_layer,
            "SA1": self.sa1_layer,
            "SA2": self.sa2_layer,
            "SA3": self.sa3_layer,
            "SA4": self.sa4_layer,
        }

    @cached_property
    def sa2(self) -> DataFrame:
        """Cases on the new boundaries, one row per area, stored for the joins below it."""
        return stored_cases(self)

    def counts(self, level: str) -> DataFrame:
        if level not in self._counts:
            self._counts[level] = level_counts(self, level, self.sa2)
        return self._counts[level]

    @cached_property
    def mesh_frame(self) -> DataFrame:
        """Mesh-block model frame with deprivation classes."""
        scores = cut_lineage(level_scores(self, "Mesh"), "scores")
        classes = quintile(scores, "score", "quintile")
        joined = self.counts("Mesh").join(classes.select("MB_CODE16", "quintile"), "MB_CODE16")
        return model_frame(joined, "MB_CODE16", "count", "expect", "quintile")

    @cached_property
    def stored_frame(self) -> DataFrame:
        """The mesh-block frame, written once for queries that read it several times."""
        return cut_lineage(self.mesh_frame, "frame")

    @cached_property
    def mesh_edges(self) -> DataFrame:
        return contiguity(self.mesh_layer, "MB_CODE16")

    @cached_property
    def scored_blocks(self) -> DataFrame:
        """Mesh blocks with a score of their own: the balance is not negative."""
        return self.scan("customer").where("c_acctbal >= 0").select(
            F.col("c_custkey").alias("MB_CODE16")
        )

    @cached_property
    def fit(self) -> DataFrame:
        """Fitted counts of the quintile rate model, for all mesh blocks."""
        return rates_fit(self.stored_frame, "quintile")

    @cached_property
    def partial_fit(self) -> DataFrame:
        """The same for scored mesh blocks only: input of the merges, fills and audits."""
        return rates_fit(
            self.stored_frame.join(self.scored_blocks, "MB_CODE16", "left_semi"), "quintile"
        )

    @cached_property
    def draws(self) -> DataFrame:
        """Events as draws: the event type is the level, the event id the iteration."""
        return self.scan("events").select(
            F.col("event_type").alias("level"),
            F.lit("nc").alias("variant"),
            F.lit("beta").alias("param"),
            F.lit(1).alias("idx"),
            F.col("event_id").alias("iter"),
            "value",
        )

    @cached_property
    def draw_fits(self) -> DataFrame:
        """Fifty wobbling draws of every mesh block's fitted count."""
        wobble = (F.col("iter") * 7 + F.col("MB_CODE16") * 3) % 11 - 5
        return self.stored_frame.select(
            "MB_CODE16", "expected", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("iter")
        ).select(
            "MB_CODE16", "iter", (F.col("expected") * F.exp(0.01 * wobble)).alias("fitted")
        )
