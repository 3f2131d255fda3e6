"""Mixing sources to target weights by hierarchical budgets.

The tree is domain / language / source. A node's budget is shared among its children in proportion to
their weights, but no child gets more than its subtree can give in `epochs` passes; what one lacks goes
to its siblings first, and only what all siblings together lack is missing in the budget of their
ancestors, which share it out among theirs. Closed form for one set of siblings: with the children by
capacity / weight, those are full whose ratio is under the water level.

A leaf's stream is its documents in the seeded order of epoch 0, then of epoch 1, and so on; it gives the
longest prefix of whole documents within its budget. All epochs before the last one are taken whole, so
only the last needs a cut: token sums of `BUCKETS` ranges of the order find the range that holds it, and
only that range is summed document by document. Texts are never shuffled, and the largest leaf is spread
over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, stored

BUCKETS = 4096
#: Plans of up to this many leaves are broadcast; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 20_000
LEVELS = ("domain", "lang", "source")
#: A document's place in the order: 60 bits of an MD5, of which the highest 12 are its range.
_BITS, _RANGE = 15, 48


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document comes in the order of an epoch."""
    text = F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS), 16, 10).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent..., w, cap, budget of the parent) with their own budget as `got`."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    key = [c for c in LEVELS if c in nodes.columns]
    upto = by.orderBy((F.col("cap") / F.col("w")).asc(), *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = nodes.withColumn("all_w", F.sum("w").over(by)).withColumn("cap_to", F.sum("cap").over(upto)).withColumn("w_to", F.sum("w").over(upto))
    full = F.col("cap_to") + F.col("cap") / F.col("w") * (F.col("all_w") - F.col("w_to")) <= F.col("budget")
    r = r.withColumn("full", full)
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(by)
    left = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(by)
    return r.withColumn("level", rest / F.nullif(left, F.lit(0.0))).withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("level") * F.col("w")).cast("double")))


def budgets(leaves: DataFrame, weight: Column, total: float, epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `budget` in tokens. weight: a number over 0,
    from the columns level_no (0 domain, 1 lang, 2 source), domain, lang and source (empty below a node's level)."""
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    above: DataFrame | None = None
    for k, name in enumerate(LEVELS):
        keys = list(LEVELS[: k + 1])
        nodes = caps.groupBy(*keys).agg(F.sum("cap").alias("cap")).where("cap > 0").withColumn("level_no", F.lit(k))
        at = nodes.select("*", *[F.lit("").alias(c) for c in LEVELS[k + 1 :]]).withColumn("w", weight).select(*keys, "cap", "w")
        at = at.withColumn("budget", F.lit(float(total))) if above is None else at.join(above, list(LEVELS[:k]))
        above = _share(at, list(LEVELS[:k])).select(*keys, F.col("got").alias("budget"))
    return leaves.join(above, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))


def mix(df: DataFrame, domain: Column, weight: Column, total: float | None = None, share: float = 1.0, epochs: int = 4, seed: int = 1, tokens: Column | None = None, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text", mix_col: str = "mix", measured: DataFrame | None = None) -> DataFrame:
    """df's rows that are drawn, as they are, with a column mix_col (domain, epoch, tokens); a row comes once for each epoch that draws it.

    total: the budget in tokens, else share times all tokens. tokens: of a row, else a quarter of its
    UTF-8 bytes, rounded up; a null text has none. A null language, source or domain is a branch of its
    own, `unknown`. Rows with the same id, or without one, share a place in the order and are drawn
    together or not at all; rows of no tokens are drawn if their place lies in the prefix. A document longer
    than what is left of a budget ends the prefix; texts are only measured, however long. Siblings that fill
    at the same level are taken by name. An empty table gives no rows. Other columns are kept, whatever their
    names, but for one named mix_col.
    measured: the id, language, source and tokens of df's rows, from which all is worked out; df is then read
    only where its rows are drawn, and need not have the tokens, which are null in mix_col.
    """
    import math

    key = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    size = F.ceil(F.octet_length(F.col(f"`{text_col}`")) / 4) if tokens is None else tokens
    own = (df if measured is None else measured).select(key(domain).alias("domain"), key(F.col(f"`{lang_col}`")).alias("lang"), key(F.col(f"`{source_col}`")).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("tokens"), F.col(f"`{id_col}`").alias("id"))
    leaves = stored(own.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    n, whole = leaves.agg(F.count("*"), F.sum("tokens")).first()
    wanted = float(total) if total is not None else math.floor(share * float(whole or 0))
    plan = budgets(leaves, weight, wanted, epochs)
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = stored(plan.withColumn("rest", (F.col("budget") - F.col("passes") * F.col("tokens")).cast("long")), "mix-plan")
    small = (lambda x: F.broadcast(x)) if n <= BROADCAST_LEAVES else (lambda x: x)

    last = own.join(small(plan.select(*LEVELS, "passes", "rest")), list(LEVELS)).where("rest > 0").withColumn("place", place(seed, F.col("passes"), F.col("id")))
    ranges = last.withColumn("range", F.shiftright("place", _RANGE)).groupBy(*LEVELS, "rest", "range").agg(F.sum("tokens").alias("t"))
    so_far = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ranges.withColumn("upto", F.sum("t").over(so_far)).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("before"))).alias("c")).select(*LEVELS, F.col("c.range").alias("range"), F.col("c.before").alias("before"))
    cut = stored(cut, "mix-cuts")
    near = last.withColumn("range", F.shiftright("place", _RANGE)).join(small(cut), [*LEVELS, "range"])
    near = near.groupBy(*LEVELS, "rest", "before", "place").agg(F.sum("tokens").alias("tokens"))  # rows that share a place, as those without an id do, are one
    in_order = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("upto", F.col("before") + F.sum("tokens").over(in_order)).where("upto <= rest").groupBy(*LEVELS).agg(F.max("place").alias("to"))
    edge = cut.join(near, list(LEVELS), "left").withColumn("to", F.coalesce("to", F.shiftleft(F.col("range"), _RANGE) - 1)).select(*LEVELS, "to")
    # no cut: the whole last epoch is within the rest (only where the rest is all of it)
    upto = F.when(F.col("rest") > 0, F.coalesce("to", F.lit((1 << 60) - 1))).otherwise(F.lit(-1)).cast("long")
    df = df.drop(mix_col)
    leaf, told = [spare(df, f"mix_{c}") for c in LEVELS], spare(df, "mix_draw")
    draw = plan.join(edge, list(LEVELS), "left").select(*[F.col(c).alias(n) for c, n in zip(LEVELS, leaf, strict=True)], F.struct("passes", upto.alias("to")).alias(told))
    draw = stored(draw, "mix-draw")

    out = df.select("*", *[x.alias(n) for x, n in zip((key(domain), key(F.col(f"`{lang_col}`")), key(F.col(f"`{source_col}`"))), leaf, strict=True)]).join(small(draw), leaf)
    passes, to = F.col(f"`{told}`.passes"), F.col(f"`{told}`.to")
    times = passes + F.when(place(seed, passes, F.col(f"`{id_col}`")) <= to, 1).otherwise(0)
    epochs_of = F.when(times > 0, F.sequence(F.lit(0), times - 1))
    at = spare(df, "mix_epoch")
    drawn = F.coalesce(size, F.lit(0)).cast("long") if measured is None else F.lit(None).cast("long")
    given = F.struct(F.col(f"`{leaf[0]}`").alias("domain"), F.col(f"`{at}`").cast("long").alias("epoch"), drawn.alias("tokens")).alias(mix_col)
    return out.withColumn(at, F.explode(epochs_of)).select(*[F.col(f"`{c}`") for c in df.columns], given)
