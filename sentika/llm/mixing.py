"""Mixing sources to target weights by budgets over a tree of domains, languages and sources.

A token budget runs from the root to the leaves. At every node it is split over the children by
weight; a child that cannot use its share, even with ``max_epochs`` passes over its documents,
leaves the rest to its siblings. What a whole subtree cannot use is left to the siblings of its
root, because a subtree never gets more than it can hold.

A leaf's budget becomes whole epochs and the prefix of one more: documents in the order of a
hash of seed, epoch and id, as many as fit. The prefix is stated as the largest hash that is in,
so choosing documents is a comparison with one small row per leaf, and no text is shuffled.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentika.llm.common import written
from sentika.session import broadcast_if_small

#: Tokens are runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Hashes have 60 bits; the leading 12 name the bucket in which a leaf's prefix ends.
HASH_BITS, BUCKET_BITS = 60, 12
EXACT = "decimal(38,0)"


def tokens_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, id_col: str) -> Column:
    """A document's place in an epoch; rows of one id share it."""
    key = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level, {})
    if any(w < 0 or w != int(w) for w in given.values()):
        raise ValueError("weights are whole numbers from 0")
    if not given:
        return F.lit(1).cast("long")
    pairs = [F.lit(x) for item in given.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level).cast("string")), F.lit(1)).cast("long")


def _filled(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """``budget`` of each child from its siblings' ``given``, ``cap`` and ``weight``.

    Children are full in the order of capacity per weight, as far as the share of the rest
    reaches; the others split what is left by weight, rounded down.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("cap") / F.col("weight"), F.col(level).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    exact = lambda c: F.col(c).cast(EXACT)
    full = exact("cap") * F.sum(exact("weight")).over(rest) <= (
        exact("given") - F.coalesce(F.sum(exact("cap")).over(before), F.lit(0).cast(EXACT))
    ) * exact("weight")
    ranked = nodes.withColumn("full", (F.col("weight") > 0) & full)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0).cast("long"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    ranked = ranked.withColumns({"used": used, "open_weight": open_weight})
    share = F.expr("cast((cast(given - used as decimal(38,0)) * weight) div open_weight as bigint)")
    budget = F.when(F.col("full"), F.col("cap")).when(F.col("weight") > 0, F.least(share, "cap")).otherwise(0)
    return ranked.withColumn("budget", budget.cast("long")).drop("full", "used", "open_weight", "given", "cap", "weight")


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    budget_share: float,
    max_epochs: int,
) -> DataFrame:
    """``budget`` of each leaf, from one row of ``tokens`` for each leaf.

    The windows are over the siblings of a node: their number is that of distinct level values,
    not of documents.
    """
    total = leaves.agg(F.sum("tokens").alias("t")).select(
        F.coalesce(F.floor(F.col("t") * F.lit(budget_share)), F.lit(0)).cast("long").alias("given")
    )
    parents = total
    for k, level in enumerate(levels):
        own, above = list(levels[: k + 1]), list(levels[:k])
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).alias("cap")).withColumn("weight", _weight(level, weights))
        if above:
            given = parents.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("budget").alias("given"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above]
            nodes = nodes.join(given, same).drop(*[f"_{c}" for c in above])
        else:
            nodes = nodes.crossJoin(F.broadcast(parents))  # the one row of the root
        parents = _filled(nodes, above, level)
    return parents


def mixing_plan(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    budget_share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 1,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row a leaf: its levels, ``leaf_tokens``, ``budget``, ``epochs`` and ``last_hash``.

    ``docs`` needs the id, the levels and ``tokens``. A leaf's documents are taken ``epochs``
    times, those with a hash up to ``last_hash`` once more.
    """
    leaves = docs.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, levels, weights, budget_share, max_epochs)
    mine = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in levels]
    plan = leaves.alias("l").join(budgets.alias("b"), mine("l", "b")).select("l.*", "b.budget")
    plan = plan.withColumn("epochs", F.expr("cast(if(tokens > 0, budget div tokens, 0) as bigint)"))
    plan = plan.withColumn("rest", F.expr("if(tokens > 0, budget % tokens, 0)")).withColumnRenamed("tokens", "leaf_tokens")
    plan = written(plan, "mixing-budgets")
    small = broadcast_if_small(plan.where("rest > 0").select(*levels, "epochs", "rest"))
    hashed = docs.select(id_col, *levels, "tokens").alias("d").join(small.alias("p"), mine("d", "p")).select(
        "d.*", "p.rest", order_hash(seed, F.col("p.epochs"), id_col).alias("h")
    )
    hashed = hashed.withColumn("bucket", F.shiftright("h", HASH_BITS - BUCKET_BITS))
    sums = hashed.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*levels).orderBy("bucket")
    cut = (
        sums.withColumn("before", F.sum("t").over(upto) - F.col("t"))
        .where("before <= rest AND before + t > rest")
        .select(*levels, "bucket", "before")
    )
    in_cut = hashed.alias("h").join(
        broadcast_if_small(cut).alias("c"), [*mine("h", "c"), F.col("h.bucket") == F.col("c.bucket")]
    ).select("h.*", "c.before")
    # one bucket of each leaf is put in order, one part in 4096 of a leaf
    running = Window.partitionBy(*levels).orderBy("h")
    fits = (
        in_cut.withColumn("upto", F.sum("tokens").over(running) + F.col("before"))
        .groupBy(*levels)
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("fit"), F.max("bucket").alias("bucket"))
    )
    last = F.coalesce("fit", F.shiftleft(F.col("bucket"), HASH_BITS - BUCKET_BITS) - 1, F.lit(-1))
    return plan.alias("p").join(fits.alias("f"), mine("p", "f"), "left").select(
        *[F.col(f"p.{c}") for c in levels], "leaf_tokens", "budget", "epochs", last.cast("long").alias("last_hash")
    )


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    budget_share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns plus ``tokens``, ``budget`` (of the leaf) and ``copies`` (0: left out).

    The root's budget is ``budget_share`` of all tokens. Weights are whole numbers by level and
    value; values without one weigh 1, a weight of 0 leaves a branch out. Null level values are
    a branch of their own. A null text has no tokens; a leaf without tokens is left out. Rows
    that share an id are taken together. Columns of the added names are replaced. Less than a
    token for each child of a node is lost to rounding.
    """
    counted = docs.drop("tokens", "budget", "copies").withColumn("tokens", tokens_of(text_col))
    narrow = written(counted.select(id_col, *levels, "tokens"), "mixing-tokens")
    plan = written(mixing_plan(narrow, levels, weights, budget_share, max_epochs, seed, id_col), "mixing-plan")
    renamed = plan.select(*[F.col(c).alias(f"_{c}") for c in levels], F.col("budget"), F.col("epochs").alias("_epochs"), F.col("last_hash").alias("_last"))
    joined = counted.join(broadcast_if_small(renamed), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels], "left")
    more = (order_hash(seed, F.col("_epochs"), id_col) <= F.col("_last")).cast("int")
    copies = (F.col("_epochs") + more).cast("int")
    return joined.withColumn("copies", copies).drop(*[f"_{c}" for c in levels], "_epochs", "_last")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy")


#: The tree and the weights of the registered query and of the pipeline.
LEVELS = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"d0": 4, "d1": 2, "d2": 2, "d3": 2},
    "lang": {"en": 10, "de": 3, "fr": 3, "es": 2},
    "source": {"src0": 8},
}


def domain_of(source: str = "source") -> Column:
    """The given tables name no domain: sources are dealt to four by their number, others to ``none``."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "none").otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))
