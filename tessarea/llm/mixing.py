"""Mixing sources to target weights over a tree of domains, languages and sources.

The budget runs down the tree by weight. Where a node cannot use its share, for
its leaves hold too few tokens even when repeated ``epochs`` times, its siblings
take the rest by their weights; only what all siblings together cannot use goes
to the siblings of their parent. At each node this is one filling level, found
by a window over the children in the order of capacity to weight.

A leaf's budget buys whole epochs and then a prefix of one more. Each epoch has
its own order, by a digest of seed, epoch and identifier. Token prefixes are
found by buckets of that digest first, so no window spans a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut_lineage, prepare

LEVELS = ("domain", "lang", "source")
# Share of all tokens that the mixture holds, most epochs, and seed of the orders.
SHARE, EPOCHS, SEED = 0.6, 2, 13
# Hexadecimal digits of the digest that number a bucket.
DIGITS = 3
NONE = "(none)"


def domain_of(source: str = "source") -> Column:
    """The given tables have no domain: the first digit of the source's MD5, by four."""
    digit = F.expr(f"cast(conv(substring(md5(cast(coalesce({source}, '{NONE}') AS binary)), 1, 1), 16, 10) AS int)")
    return F.concat(F.lit("d"), F.floor(digit / 4).cast("string"))


def token_count(text: str = "text") -> Column:
    """Words of a text, at least one."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), rf"^{WHITE}|{WHITE}$", "")
    return F.size(F.split(trimmed, WHITE)).cast("long")


def node_weight(level: str) -> Column:
    """Default weights: languages and sources alike, the first domain twice."""
    return F.when(F.col(level) == "d0", F.lit(2.0)).otherwise(F.lit(1.0)) if level == "domain" else F.lit(1.0)


def fill(children: DataFrame, parents: list[str]) -> DataFrame:
    """Adds ``budget`` to children with ``weight``, ``capacity`` and ``given`` (the parent's budget).

    Children are filled to ``level * weight``, or to their capacity where that is
    less, so that all ``given`` is used, or all capacity.
    """
    keys = ", ".join(f"`{c}`" for c in parents)
    part = f"PARTITION BY {keys} " if keys else ""
    before = f"OVER ({part}ORDER BY ratio, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"OVER ({part}ORDER BY ratio, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    ranked = children.withColumn("ratio", F.expr("capacity / weight"))
    summed = ranked.withColumns(
        {"full": F.expr(f"coalesce(sum(capacity) {before}, 0)"), "open": F.expr(f"sum(weight) {after}")}
    )
    # (given - full) / open rises while children are full, and falls after the last full one.
    level = F.expr(f"max((given - full) / open) OVER ({part.strip()})")
    return (
        summed.withColumn("level", level)
        .withColumn("budget", F.expr("least(cast(capacity AS double), level * weight)"))
        .drop("ratio", "full", "open", "level")
    )


def budgets(leaves: DataFrame, total: Column | float, levels=LEVELS, weight=node_weight, epochs: int = EPOCHS) -> DataFrame:
    """``levels..., supply, budget`` (whole tokens) of each leaf ``levels..., supply``."""
    level_rows = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("supply") * epochs).alias("capacity"))
        nodes = nodes.withColumns({"weight": weight(level), "node": F.col(level)})
        if depth:
            nodes = nodes.join(level_rows, path[:-1])
        else:
            nodes = nodes.withColumn("given", total if isinstance(total, Column) else F.lit(float(total)))
        filled = fill(nodes, path[:-1])
        level_rows = filled.select(*path, F.col("budget").alias("given"))
    return leaves.join(
        level_rows.select(*levels, F.floor(F.col("given") + 0.5).cast("long").alias("budget")), list(levels)
    )


def _order(seed: int, ident: Column) -> Column:
    """Place of a row in the order of its ``epoch``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), ident).cast("binary"))


def select_prefixes(
    rows: DataFrame, plan: DataFrame, levels=LEVELS, epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """The rows of each epoch that a leaf's budget buys, with ``epoch`` and ``mix_order``.

    ``rows`` has the levels, ``doc_id``, ``tokens`` and ``tie``. A row is taken while
    the tokens before it are less than what is left of the budget: the last row of
    a prefix may pass it.
    """
    part = ", ".join(f"`{c}`" for c in levels)
    wanted = plan.select(
        *levels,
        "supply",
        "budget",
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"),
    ).withColumn("left", F.expr("least(supply, budget - epoch * supply)")).where("left > 0")
    wanted = cut_lineage(wanted, "mix-plan")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))
    dealt = rows.join(wanted, list(levels)).withColumn("mix_order", _order(seed, ident))
    dealt = dealt.withColumn("bucket", F.substring("mix_order", 1, DIGITS))
    sizes = dealt.groupBy(*levels, "epoch", "bucket", "left").agg(F.sum("tokens").alias("n"))
    ends = sizes.withColumn(
        "low",
        F.expr(
            f"coalesce(sum(n) OVER (PARTITION BY {part}, epoch ORDER BY bucket "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ),
    )
    # Buckets wholly inside the prefix need no order; the one that the budget cuts does.
    taken = cut_lineage(
        ends.where("low < left").select(*levels, "epoch", "bucket", "low", (F.col("low") + F.col("n") > F.col("left")).alias("cut")),
        "mix-buckets",
    )
    near = dealt.join(taken, [*levels, "epoch", "bucket"])
    whole = near.where("NOT cut")
    edge = near.where("cut").withColumn(
        "before",
        F.expr(
            f"low + coalesce(sum(tokens) OVER (PARTITION BY {part}, epoch, bucket ORDER BY mix_order, tie "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ),
    )
    return whole.unionByName(edge.where("before < left").drop("before")).drop("low", "cut", "bucket", "left", "supply", "budget")


def _levels() -> dict[str, Column]:
    """The levels of a row of documents; null is a node of its own."""
    return {
        "domain": domain_of(),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
    }


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, tie``: what the mixture needs to know of each row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[value.alias(c) for c, value in _levels().items()],
        token_count().alias("tokens"),
        F.xxhash64("text").alias("tie"),
    )


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weight=node_weight) -> DataFrame:
    """``doc_id, epoch, domain, lang, source, tokens, tie`` of every chosen copy of ``docs``.

    The mixture holds ``share`` of all tokens (white-space words, one at least).
    Null levels are the node ``(none)``; a null id counts as that word. Repeated
    rows count each; of rows with equal order the one with the smaller text hash
    comes first. An empty table gives no rows.
    """
    return _chosen(docs, share, epochs, seed, weight).select("doc_id", "epoch", *LEVELS, "tokens", "tie")


def _chosen(docs: DataFrame, share: float, epochs: int, seed: int, weight) -> DataFrame:
    prepare(docs.sparkSession)
    rows = cut_lineage(described(docs), "mix-rows")
    leaves = cut_lineage(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")), "mix-leaves")
    total = (leaves.agg(F.sum("supply")).first()[0] or 0) * share
    plan = budgets(leaves, total, weight=weight, epochs=epochs)
    return select_prefixes(rows, plan, epochs=epochs, seed=seed)


def apply_mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weight=node_weight) -> DataFrame:
    """The rows of ``docs``, once for each epoch that chose them, with all columns.

    A prefix ends at one place of an epoch's order, so that each row is held against
    the last place of its leaf: a small table, and no text is moved. Rows that agree
    in identifier and text share their place and are chosen together.
    """
    chosen = _chosen(docs, share, epochs, seed, weight)
    last = chosen.groupBy(*LEVELS, "epoch").agg(F.max(F.struct("mix_order", "tie")).alias("__last"))
    last = cut_lineage(last, "mix-last").withColumnsRenamed({c: f"__{c}" for c in LEVELS})
    leaf = {f"__own_{c}": value for c, value in _levels().items()}
    rows = docs.withColumns(leaf | {"__tie": F.xxhash64("text")})
    own = [F.col(f"__own_{c}") == F.col(f"__{c}") for c in LEVELS]
    ident = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(NONE))
    place = F.struct(_order(seed, ident).alias("mix_order"), F.col("__tie").alias("tie"))
    taken = rows.join(last, reduce(lambda x, y: x & y, own)).where(place <= F.col("__last"))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
