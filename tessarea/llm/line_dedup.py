"""Line deduplication by spread over distinct sites.

Each line hash has a HyperLogLog sketch of its sites; sketches merge map-side and
across tasks by aggregation, so a line that every document has costs one sketch
per task. Lines whose estimate is near the threshold get an exact distinct count.
Lines on too many sites are boilerplate and are removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, prepare

MIN_SITES = 5
# Estimates within this factor of the threshold are counted exactly.
NEAR = 1.5
LOG_REGISTERS = 12


def line_list(text: str) -> Column:
    return F.split(F.col(text).cast("string"), "\n")


def _keys(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Adds two hashes that name a row by identifier and text; equal rows share them."""
    return docs.withColumns({"__k1": F.xxhash64(ident, text), "__k2": F.xxhash64(F.lit(1), text, ident)})


def site_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``__k1, __k2, at, h1, h2, site`` of every line that is not blank."""
    cut = _keys(docs.select(ident, text, site), ident, text).select(
        "__k1", "__k2", F.col(site).cast("string").alias("site"), F.posexplode(line_list(text)).alias("at", "line")
    )
    line = F.trim("line")
    return cut.where(line != "").select(
        "__k1", "__k2", "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "site"
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """``h1, h2`` of lines on at least ``min_sites`` distinct sites; null sites do not count."""
    spread = cut_lineage(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"))
        .where(F.col("sites") >= min_sites / near),
        "line-spread",
    )
    unsure = spread.where(F.col("sites") <= min_sites * near).select("h1", "h2")
    exact = (
        lines.join(unsure, ["h1", "h2"])
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    sure = spread.where(F.col("sites") > min_sites * near)
    return sure.select("h1", "h2").unionAll(exact.select("h1", "h2"))


def remove_boilerplate(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", site: str = "source",
    min_sites: int = MIN_SITES, near: float = NEAR,
) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines`` and ``n_removed`` beside its columns.

    Lines are parted by line feeds and compared without outer spaces; blank lines
    stay. A null text stays null and has no lines. Repeated rows are treated alike,
    null identifiers too. An empty table gives no rows. Columns of the names
    ``n_lines`` and ``n_removed`` are replaced.
    """
    prepare(docs.sparkSession)
    lines = cut_lineage(site_lines(docs, ident, text, site), "lines")
    common = cut_lineage(boilerplate(lines, min_sites, near), "boilerplate")
    gone = cut_lineage(
        lines.join(common, ["h1", "h2"]).groupBy("__k1", "__k2").agg(F.collect_set("at").alias("__gone")), "lines-gone"
    )
    found = _keys(docs, ident, text).join(gone, ["__k1", "__k2"], "left")
    none = F.array().cast("array<int>")
    kept = F.filter(line_list(text), lambda line, at: ~F.array_contains(F.coalesce("__gone", none), at))
    return found.withColumns(
        {
            "n_lines": F.coalesce(F.size(line_list(text)), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(F.coalesce("__gone", none)), F.lit(0)).cast("long"),
            text: F.array_join(kept, "\n"),
        }
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0))).drop("__k1", "__k2", "__gone")
