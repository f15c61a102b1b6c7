"""Mode of the spatial smoothing model by Newton steps with conjugate gradients.

The model is ``O ~ Poisson(E * exp(b_q + phi + theta))`` with a level effect per
factor class q, a spatially structured effect phi and an unstructured theta. A
Newton step solves one linear system per model. Theta is eliminated from it row by
row, which leaves

    (W + L / tau2) dphi + W db = rhs,    W = mu / (1 + mu * sigma2)

with the graph Laplacian L, plus one equation per class. It is solved by conjugate
gradients, preconditioned by the diagonal, in the form that needs one product with
the edge table and one reduction per iteration. All models (areal level x variant)
run in the same jobs, each at its own stage: one may be in the middle of a solve
while another takes its step, and a settled one leaves.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict, namedtuple
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage, scratch_path, ship
from .blocks import (
    EFFECTS,
    FIXED_SCHEMA,
    MESSAGES,
    NUMBERS,
    SENT,
    SENT_STATE,
    STATE_SCHEMA,
    STEP_LENGTHS,
    SUMS,
    VECTORS,
    Scalars,
    build,
    effects,
    receiver,
    sender,
    started,
)
from .graph import edges_between

ZERO_CASES = 0.001
# An area of more neighbours than this gets their sum from each block, not their values.
HOT_DEGREE = 4096
# Rows of a block, about, or more where there would be more blocks than the second number.
ROWS_PER_BLOCK, MOST_BLOCKS = 16_384, 4096
# Rows of a task, about; there are no more tasks than shuffle partitions.
ROWS_PER_TASK = 32_768
# Settled: the gradient's Euclidean norm is below this.
TOL = 1e-6
# A solve ends once its preconditioned residual fell to this share of the first.
FORCING = 0.03
# What an objective may lose by rounding, relative to its size.
SLACK = 1e-12
# Models x factor classes whose sums may pass through the driver.
MOST_CLASSES = 100_000
MOST_ITERATIONS = 1000


@dataclass(frozen=True)
class BymFit:
    """Result of :func:`bym_map`.

    ``areas``: ``by..., area, observed, expected, covariate, beta, phi, theta, fitted``;
    ``trace``: ``by..., step, objective, gradient, products``: the penalised
    log-likelihood without constants and the norm of its gradient before each Newton
    step and at the end, and the products with the edge table so far.
    ``settled`` says whether every model's gradient came below the tolerance;
    ``rounds`` counts the products that the job made for all models together. Each
    took two Spark jobs: one writes the state, one reduces it.
    """

    areas: DataFrame
    trace: DataFrame
    settled: bool
    rounds: int


def bucketed_copy(
    df: DataFrame, keys: Sequence[str], path: str, buckets: int
) -> tuple[DataFrame, str]:
    """A copy in the shared folder that joins on ``keys`` read without a shuffle, and its table name."""
    table = f"tessarea_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table), table


# Fitted counts from the effects.
MU = "(e * exp(beta + phi + theta))"
ClassSums = namedtuple("ClassSums", ["q", *SUMS])


class _Model:
    """Scalars of one model on the driver: where it is, and its class parts."""

    def __init__(self, classes: Sequence[Row]):
        self.rows = sum(c.rows for c in classes)
        self.beta = {c.q: math.log(max(c.o, ZERO_CASES) / c.e) for c in classes}
        self.step, self.products, self.solving = 0, 0, False
        self.before = {q: (0.0, 0.0) for q in self.beta}
        self._clear()
        self.kind, self.length, self.centre = "move", 0.0, 0.0

    def _clear(self) -> None:
        self.x, self.p, self.s, self.r = ({q: 0.0 for q in self.beta} for _ in range(4))
        self.a = self.bc = self.gamma = self.first = None
        self.iterations = 0

    def moved(self, classes: Sequence[Row]) -> tuple[float, float]:
        """After a move: the objective and the norm of the gradient."""
        self._clear()
        self.w = {c.q: c.w for c in classes}
        self.r = {c.q: c.rb for c in classes}
        square = sum(c.g_theta + c.g_phi + c.gap * c.gap for c in classes)
        self.kind, self.next_a, self.next_bc = "solve", 0.0, 0.0
        return sum(c.objective_0 for c in classes), math.sqrt(square)

    def solved(self, classes: Sequence[Row], forcing: float) -> None:
        """After a product: the next iteration's scalars, or the move that ends the solve."""
        u = {q: self.r[q] / self.w[q] for q in self.w}
        v = {c.q: c.wu + self.w[c.q] * u[c.q] for c in classes}
        gamma = sum(c.ru for c in classes) + sum(self.r[q] * u[q] for q in u)
        delta = sum(c.uv for c in classes) + sum(v[q] * u[q] for q in u)
        self.iterations += 1
        if self.first is None:
            self.first = gamma
        if gamma <= forcing * forcing * self.first or self.iterations > MOST_ITERATIONS:
            self._choose(classes)
            return
        bc = 0.0 if self.gamma is None else gamma / self.gamma
        a = gamma / (delta - (bc * gamma / self.a if self.a else 0.0))
        self.a, self.gamma, self.next_a, self.next_bc = a, gamma, a, bc
        for q in u:
            self.p[q] = u[q] + bc * self.p[q]
            self.s[q] = v[q] + bc * self.s[q]
            self.x[q] += a * self.p[q]
            self.r[q] -= a * self.s[q]

    def _choose(self, classes: Sequence[Row]) -> None:
        """The longest step whose objective does not fall, and the constant that centres phi."""
        now = sum(c.objective_0 for c in classes)
        self.length = STEP_LENGTHS[-1]
        for k, length in enumerate(STEP_LENGTHS, 1):
            there = sum(getattr(c, f"objective_{k}") for c in classes)
            if there >= now - SLACK * abs(now):
                self.length = length
                break
        self.centre = sum(c.phi + self.length * c.x for c in classes) / self.rows
        self.kind = "move"

    def apply_move(self) -> None:
        """The class parts of a move; the rows follow in the next job."""
        for q in self.beta:
            self.beta[q] += self.length * self.x[q] + self.centre

    def scalars(self) -> tuple[tuple[bool, float, float], dict[str, tuple]]:
        """For the next round: whether it moves, two factors, and the class parts before and after."""
        if self.kind == "move":
            factors = (True, self.length, self.centre)
            after = {q: (self.beta[q], 0.0, 0.0) for q in self.beta}
        else:
            factors = (False, self.next_a, self.next_bc)
            after = {q: (self.beta[q], self.x[q], self.r[q] / self.w[q]) for q in self.beta}
        parts = {q: (*self.before[q], *after[q]) for q in self.beta}
        self.before = {q: after[q][:2] for q in self.beta}
        return factors, parts


def bym_map(
    frame: DataFrame,
    edges: DataFrame,
    tau2: float | Column,
    sigma2: float | Column,
    tol: float = TOL,
    max_steps: int = 50,
    area: str = "area",
    covariate: str | None = None,
    by: Sequence[str] = (),
    edge_by: Sequence[str] = (),
    hot_degree: int = HOT_DEGREE,
    forcing: float = FORCING,
) -> BymFit:
    """Penalised-likelihood mode of the smoothing model for given variances.

    ``frame`` has ``by..., area, observed, expected`` (positive) and optionally a
    factor covariate; ``edges`` has ``edge_by..., src, dst`` in both directions, where
    ``edge_by`` are those of ``by`` that tell layers apart (variants of one level
    share a graph). Edges to areas that have no row are left out. Areas without
    neighbours belong in neither: see ``drop_islands``. ``tau2`` and ``sigma2`` are
    numbers or expressions over ``by``. A model is settled, and leaves the job, once
    its gradient is shorter than ``tol``; ``max_steps`` Newton steps are a guard. Phi
    has mean zero per model.

    Areas are dealt into blocks once, by ranges of their keys, each with its part of the
    graph in positions (``blocks``). A product exchanges the values at the borders of
    blocks only; of an area with more than ``hot_degree`` neighbours, their sum per block.
    The state is written once per product, in turn to two paths. Sums per block and class
    pass through the driver; more than ``MOST_CLASSES`` classes are refused.
    """
    by, edge_by = list(by), list(edge_by)
    spark = frame.sparkSession
    ship(spark)
    root = scratch_path(spark, "bym")

    factor = F.lit(None).cast("string") if covariate is None else F.col(covariate).cast("string")
    start = frame.select(
        *by,
        F.col(area).alias("area"),
        F.col("observed").cast("double").alias("o"),
        F.col("expected").cast("double").alias("e"),
        F.coalesce(factor, F.lit("")).alias("q"),
        (F.lit(float(tau2)) if not isinstance(tau2, Column) else tau2.cast("double")).alias("tau2"),
        (F.lit(float(sigma2)) if not isinstance(sigma2, Column) else sigma2.cast("double")).alias("sigma2"),
    )
    # Read several times below; what is behind the frame runs once.
    rows = cut_lineage(start.withColumn("log_e", F.ln("e")), "bym", f"{root}/rows")
    areas = rows.select(*edge_by, "area").distinct()
    used_edges = cut_lineage(edges_between(areas, edges, "area", edge_by), "bym", f"{root}/used-edges")
    degrees = used_edges.groupBy(*edge_by, F.col("dst").alias("area")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    key_fields = [f for f in rows.schema.fields if f.name in by]
    key_names = [f.name for f in key_fields]
    key_schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields]

    def local_table(found: list[tuple], schema: str) -> DataFrame:
        """A few rows that stay a local relation of the plan: no job is run for them."""
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        columns = zip(*found) if found else [()] * len(arrow)
        arrays = [pa.array(values, kind) for values, kind in zip(columns, arrow.types)]
        return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow))

    first = rows.groupBy(*by, "q").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o").alias("o"), F.sum("e").alias("e")
    )
    found = first.limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes of all models together")
    groups = defaultdict(list)
    for row in sorted(found, key=lambda c: c.q):
        groups[tuple(row[k] for k in key_names)].append(row)
    models = {k: _Model(classes) for k, classes in groups.items()}
    numbers = {k: number for number, k in enumerate(models)}
    class_number = {(k, row.q): n for n, (k, row) in enumerate((k, row) for k, rows_of in groups.items() for row in rows_of)}
    class_name = {n: (k, q) for (k, q), n in class_number.items()}

    # Ranges of keys, as areas with near keys are often neighbours; a range of two models gives two blocks.
    total = sum(row.rows for row in found)
    ranges = max(1, math.ceil(total / max(ROWS_PER_BLOCK, total // MOST_BLOCKS)))
    ranged = rows.repartitionByRange(ranges, *by, "area").withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "bym", f"{root}/ranged")
    parts = [tuple(row) for row in ranged.select(*key_names, "part").distinct().collect()]
    parts = [(*row, number, numbers[row[:-1]]) for number, row in enumerate(sorted(parts, key=lambda row: (numbers[row[:-1]], row[-1])))]
    part_table = local_table(parts, ", ".join([*key_schema, "part int, block int, model int"]))
    class_table = local_table(
        [(*k, q, n) for (k, q), n in class_number.items()], ", ".join([*key_schema, "q string, class int"])
    )
    in_block = W.partitionBy("block").orderBy("area")
    placed = (
        ranged.join(F.broadcast(part_table), [*by, "part"])
        .join(F.broadcast(class_table), [*by, "q"])
        .join(degrees, [*edge_by, "area"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0.0)))
        .drop("part")
        .withColumns({"pos": F.row_number().over(in_block) - 1, "key": F.dense_rank().over(in_block) - 1})
    )
    placed = cut_lineage(placed, "bym", f"{root}/placed")
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_TASK + 1))
    tables = [f"tessarea_{uuid.uuid4().hex}" for _ in range(3)]

    def stored(df: DataFrame, path: str, table: str) -> DataFrame:
        """A copy that joins and groups by block without a shuffle."""
        writer = df.write.mode("overwrite").bucketBy(buckets, "block").sortBy("block").option("path", f"{root}/{path}")
        writer.saveAsTable(table)
        return spark.table(table)

    trace: list[tuple] = []
    finished: list[DataFrame] = []
    betas: dict[tuple, float] = {}
    rounds = 0
    try:
        rows_of = placed.select("block", "model", "pos", "key", "class", *NUMBERS)
        links = cut_lineage(_links(placed, used_edges, by, edge_by, hot_degree), "bym", f"{root}/links")
        built = rows_of.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(build, FIXED_SCHEMA)
        fixed = stored(built, "blocks", tables[2])
        state = stored(fixed.select("block", "model", "classes", "key").mapInArrow(started, STATE_SCHEMA), "state-0", tables[0])
        working = dict(models)
        while working:
            rounds += 1
            values = np.zeros((len(class_number), 5))
            factors = {}
            for k, model in working.items():
                factors[numbers[k]], after = model.scalars()
                for q, of_class in after.items():
                    values[class_number[k, q]] = of_class
            state = stored(advance(fixed, state, Scalars(factors, values), buckets), f"state-{rounds % 2}", tables[rounds % 2])
            sums = defaultdict(list)
            for n, of_class in _sums_of(state).items():
                k, q = class_name[n]
                sums[k].append(ClassSums(q, *of_class))
            leaving = []
            for k, model in list(working.items()):
                model.products += 1
                if model.kind == "solve":
                    model.solved(sums[k], forcing)
                    if model.kind == "move":
                        model.apply_move()
                    continue
                objective, gradient = model.moved(sums[k])
                trace.append((*k, model.step, objective, gradient, model.products))
                model.settled = gradient < tol
                if model.settled or model.step >= max_steps:
                    leaving.append(k)
                    del working[k]
                    betas |= {(k, q): beta for q, beta in model.beta.items()}
                model.step += 1
            if leaving:
                rest = state.where(F.col("model").isin([numbers[k] for k in leaving])).select("block", "phi", "theta")
                finished.append(cut_lineage(rest.mapInArrow(effects, EFFECTS), "bym", f"{root}/done-{len(finished)}"))
    finally:
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    done = reduce(DataFrame.unionByName, finished) if finished else local_table([], EFFECTS)
    ended = local_table([(class_number[key], beta) for key, beta in betas.items()], "class int, beta double")
    lost = F.col("o").isNull() | F.col("e").isNull() | F.col("tau2").isNull() | F.col("sigma2").isNull()
    effect = {name: F.when(~(lost & F.isnan(name)), F.col(name)) for name in ("phi", "theta")}
    found = (
        placed.join(done, ["block", "pos"])
        .withColumns(effect)
        .join(F.broadcast(ended), "class")
        .select(
            *by,
            F.col("area").alias(area),
            F.col("o").alias("observed"),
            F.col("e").alias("expected"),
            *([F.col("q").alias(covariate)] if covariate is not None else []),
            "beta",
            "phi",
            "theta",
            F.expr(MU).alias("fitted"),
        )
    )
    trace_schema = ", ".join([*key_schema, "step int, objective double, gradient double, products int"])
    settled = all(m.settled for m in models.values())
    return BymFit(found, spark.createDataFrame(trace, trace_schema).select(*by, "step", "objective", "gradient", "products"), settled, rounds)


def _links(placed: DataFrame, edges: DataFrame, by: list[str], edge_by: list[str], hot_degree: int) -> DataFrame:
    """Both ends of what blocks send: ``block, other, label, key, times, receives``.

    A label names a slot between two blocks: the key that is sent, or, below zero, the
    key of very many neighbours that takes a sum.
    """
    keys = placed.select(*by, "area", "block", "key", (F.col("n") > hot_degree).alias("hot")).distinct()
    to = keys.withColumnRenamed("area", "src")
    of = keys.select(*by, F.col("area").alias("dst"), F.col("block").alias("other"), F.col("key").alias("far"))
    met = edges.join(to, [*edge_by, "src"]).join(of, [*by, "dst"])
    label = F.when(F.col("hot"), -1 - F.col("key")).otherwise(F.col("far"))
    met = met.select("block", "key", "other", "far", label.alias("label"), "hot")
    count = F.count(F.lit(1)).cast("double")
    received = met.groupBy("block", "other", "label", "key", "hot").agg(count.alias("times"))
    sent = met.groupBy(
        F.col("other").alias("block"), F.col("block").alias("other"), "label", F.col("far").alias("key"), "hot"
    ).agg(count.alias("times"))
    # Repeated edges count once: in the sum that is sent, or where a key's value is taken.
    received = received.withColumn("times", F.when(F.col("hot"), F.lit(1.0)).otherwise(F.col("times")))
    sent = sent.withColumn("times", F.when(F.col("hot"), F.col("times")).otherwise(F.lit(1.0)))
    return received.withColumn("receives", F.lit(True)).unionByName(sent.withColumn("receives", F.lit(False))).drop("hot")


def border_values(fixed: DataFrame, state: DataFrame, scalars: Scalars) -> DataFrame:
    """What blocks send each other in a round: ``block, sender, data``."""
    own = fixed.select(*SENT).hint("merge").join(state.select("block", *SENT_STATE), "block")
    return own.mapInArrow(sender(scalars), MESSAGES)


def advance(fixed: DataFrame, state: DataFrame, scalars: Scalars, buckets: int) -> DataFrame:
    """The blocks of every unsettled model after its next move or iteration.

    Only the values at the borders are exchanged; the step before them is done twice.
    """
    messages = border_values(fixed, state, scalars).repartition(buckets, "block")
    own = fixed.hint("merge").join(state.select("block", *VECTORS), "block")
    return own.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(receiver(scalars), STATE_SCHEMA)


def _sums_of(state: DataFrame) -> dict[int, np.ndarray]:
    """Sums of each class over its blocks, in the order of the blocks."""
    found: dict[int, np.ndarray] = {}
    for _, classes, sums in sorted(state.select("block", "classes", "sums").collect()):
        table = np.frombuffer(sums, np.float64).reshape(-1, len(SUMS))
        for n, of_class in zip(np.frombuffer(classes, np.int32).tolist(), table):
            found[n] = found[n] + of_class if n in found else of_class
    return dict(sorted((n, of_class.tolist()) for n, of_class in found.items()))


def fit_all(
    frames: DataFrame,
    edges: DataFrame,
    variances: DataFrame,
    tol: float = TOL,
    max_steps: int = 50,
    area: str = "area",
    covariate: str = "quintile",
) -> BymFit:
    """All models of all areal levels and variants as one job.

    ``frames`` has ``level, variant, area, observed, expected, quintile`` (NULL in
    a variant without covariate), ``edges`` has ``level, variant, src, dst`` and
    ``variances`` has ``level, variant, tau2, sigma2``.
    """
    keyed = frames.join(variances, ["level", "variant"])
    return bym_map(
        keyed,
        edges,
        F.col("tau2"),
        F.col("sigma2"),
        tol=tol,
        max_steps=max_steps,
        area=area,
        covariate=covariate,
        by=("level", "variant"),
        edge_by=("level", "variant"),
    )
