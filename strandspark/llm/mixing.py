"""Mixing sources to target weights by capped water-filling.

The budget is shared among the sources by weight; a source whose share is over
its cap (maximum epochs times its size) is clamped there and the excess is shared
again by weight, until none is above. That water level has a closed form over
the sources ordered by cap/weight. Each document is then taken whole as many
times as the epochs of its source are whole, and once more if a seeded order puts
it into the source's fractional epoch, which is filled up to the target.

The fractional epoch is cut in two steps, so that no source is ever sorted in one
place: words are summed per (source, hash slice), the slice that the target falls
into is found, and only documents of that slice are ordered.

Defined results: a null text has size 0; documents without a source form one
source, the last; an empty table gives an empty result; repeated rows are
documents of their own (equal ones are alike, so reruns agree); very long texts are
sized whole; other columns, whatever their names, go through unseen. One row per source
is ordered in one place, never the documents. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.texts import n_words
from strandspark.runtime import fewer, written

#: Slices of the seeded order; three hexadecimal digits.
DIGITS = 3
#: Rows of the plan (one per source) up to which it is broadcast.
MAX_BROADCAST_SOURCES = 20_000


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight): one row per source."""
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumns({"budget": F.sum("source_size").over(everything) * F.lit(float(budget_share)), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("weight_left"))
    s = s.withColumn("water", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))).drop("budget", "capped", "weight_left", "level", "water", "cap")


def by_rank(weights: tuple[int, ...]) -> Column:
    """Weight by the source's rank in code point order, nulls last, repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    out = docs.withColumns({"mix_id": F.col(id_col), "mix_source": F.col(source_col), "mix_size": n_words(F.col(text_col)), "mix_key": key})
    return out.withColumn("mix_slice", F.substring("mix_key", 1, DIGITS))


def _plan(keyed: DataFrame, n: int, weights: tuple[int, ...], budget_share: float, max_epochs: float) -> DataFrame:
    """One row per source of ``n`` documents: size, target, whole epochs, words of the fractional epoch,
    the slice that it ends in and the words before that slice."""
    slices = written(fewer(keyed.groupBy("mix_source", "mix_slice").agg(F.sum("mix_size").alias("words")), n), "mix-slices")
    sources = slices.groupBy(F.col("mix_source").alias("source")).agg(F.sum("words").alias("source_size"))
    sources = water_fill(sources.withColumn("weight", by_rank(weights)), budget_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(epochs)).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = written(sources.drop("weight", "water"), "mix-sources")
    upto = Window.partitionBy("mix_source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = slices.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cuts = cuts.join(sources.select("source", "extra"), F.col("mix_source").eqNullSafe(F.col("source")), "inner").drop("source")
    cuts = cuts.where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("words") >= F.col("extra")))
    cuts = cuts.select(F.col("mix_source").alias("s"), F.col("mix_slice").alias("cut"), F.col("before").alias("cut_before"))
    plan = sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return written(plan.select(*[F.col(c).alias(f"mix_{c}" if c != "source" else "mix_s") for c in plan.columns]), "mix-plan")


def _copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``mix_copies``: how often each row is taken."""
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    own = keyed.join(plan, F.col("mix_source").eqNullSafe(F.col("mix_s")), "left").drop("mix_s")
    cut = F.col("mix_slice").eqNullSafe(F.col("mix_cut"))
    within = Window.partitionBy("mix_source", "mix_slice").orderBy("mix_key", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    inside = own.where(cut).withColumn("mix_upto", F.sum("mix_size").over(within) + F.col("mix_cut_before"))
    inside = inside.withColumn("mix_more", (F.col("mix_upto") - F.col("mix_size") / 2 <= F.col("mix_extra")).cast("long")).drop("mix_upto")
    before = F.coalesce((F.col("mix_extra") > 0) & (F.col("mix_slice") < F.col("mix_cut")), F.lit(False))
    outside = own.where(~cut).withColumn("mix_more", before.cast("long"))
    return inside.unionByName(outside).withColumn("mix_copies", (F.col("mix_whole") + F.col("mix_more")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: float, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every document."""
    keyed = _keyed(docs.select(id_col, text_col, source_col), seed, id_col, text_col, source_col).select("mix_id", "mix_source", "mix_size", "mix_key", "mix_slice")
    keyed = written(keyed, "mix-sizes")
    out = _copies(keyed, _plan(keyed, keyed.count(), weights, budget_share, max_epochs))
    return out.select(
        F.col("mix_id").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: float, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # out of the way of the operator's own columns
    keyed = _keyed(docs.select(id_col, text_col, source_col, row.alias("mix_row")), seed, id_col, text_col, source_col)
    keyed = keyed.select("mix_id", "mix_source", "mix_size", "mix_key", "mix_slice", "mix_row")
    out = _copies(keyed, _plan(keyed, docs.count(), weights, budget_share, max_epochs))
    return out.where("mix_copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))), "mix_row").select("mix_row.*")
