"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.ordering import globally_sorted, with_position, with_sum_before
from textlake.llm.runtime import discard, drop_extra, materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Sources beyond this many are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Words to take from each source.

    ``sources``: (source, source_size). Sources in code point order, null last, get ``weights`` in turn and
    divide ``share`` times all words by them; none gets over ``cap`` times its own size, what is over is
    divided again among the others by weight until no source is above. That fixed point is
    min(cap * size, level * weight), the level being the largest that any of the sources would see if those
    with a smaller cap * size / weight had theirs: one ordered pass, over range partitions as for rows.
    """
    s = with_position(globally_sorted(sources, [F.col("source").asc_nulls_last()]))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", pick.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    s = globally_sorted(s, [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()])
    s = with_sum_before(s, "_cap").withColumnRenamed("_before", "_caps")
    s = with_sum_before(s, "_w").withColumnRenamed("_before", "_ws")
    total = s.agg(F.sum("source_size").alias("words"), F.sum("_w").alias("w")).first()
    level = (F.lit(float(share) * (total.words or 0)) - F.col("_caps")) / (F.lit(total.w or 1.0) - F.col("_ws"))
    most = s.agg(F.max(level)).first()[0] or 0.0
    return s.select("source", "source_size", F.least(F.col("_cap"), F.lit(most) * F.col("_w")).alias("target"))


def _tilted(size: Column, tilt: float) -> Column:
    return F.pow(size.cast("double"), F.lit(float(tilt)))


def _expected(cap: float, tilt: float) -> Column:
    """Copies that a document is expected to give: its source's level times its size to the ``tilt``."""
    return F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.col("_level") * _tilted(F.col("size"), tilt))).otherwise(F.lit(0.0))


def _rank(part: Column) -> Column:
    """Odds of the uniform number divided by the odds of inclusion: the Pareto order."""
    return (F.col("u") / (1 - F.col("u"))) / (part / (1 - part))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, tilt: float) -> DataFrame:
    """One row a source: _source, source_size, target, _level and _cut, the (rank, n) of the last document drawn."""
    sizes = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("k")))
    goal = targets(sizes.groupBy("source").agg(F.sum(F.col("k") * F.col("size")).alias("source_size")), weights, share, cap)
    goal = materialize(goal.withColumnRenamed("source", "_source"))
    s = sizes.join(_small(goal), F.col("source").eqNullSafe(F.col("_source")))
    # the same fixed point as for sources, over a source's different sizes, the largest ones capped first
    mass = F.col("k") * F.col("size")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    open_ = F.sum(mass * _tilted(F.col("size"), tilt)).over(rest)
    level = (F.col("target") - F.coalesce(F.sum(mass * F.lit(float(cap))).over(larger), F.lit(0.0))) / F.nullif(open_, F.lit(0.0))
    s = s.withColumn("_at", level).withColumn("_level", F.coalesce(F.max("_at").over(Window.partitionBy("source")), F.lit(0.0)))
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap) * (1 - 1e-12))
    s = s.withColumn("_level", F.when(full, F.lit(float("inf"))).otherwise(F.col("_level"))).withColumn("_copies", _expected(cap, tilt))
    drawn = F.when(F.col("_copies") > F.floor("_copies"), mass).otherwise(F.lit(0))
    s = s.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_level").alias("_level"),
        F.sum(F.floor("_copies") * mass).alias("_whole"), F.sum(drawn).alias("_drawn"),
    )
    plan = materialize(s.withColumnRenamed("source", "_source"))
    part = _expected(cap, tilt)
    ranked = sized.join(_small(plan), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_part", part - F.floor(part)).where("_part > 0")
    ranked = ranked.select("source", "size", "n", _rank(F.col("_part")).alias("rank"), (F.col("target") - F.col("_whole")).alias("_rest"))
    ranked = globally_sorted(ranked, [F.col("source").asc_nulls_last(), F.col("rank"), F.col("n")])
    before = with_sum_before(ranked, "size")
    first = before.groupBy("source").agg(F.min("_before").alias("_first")).withColumnRenamed("source", "_of")
    before = before.join(_small(materialize(first)), F.col("source").eqNullSafe(F.col("_of")))
    # the words of the first documents in this order come nearest to the rest
    taken = before.where(2 * (F.col("_before") - F.col("_first")) + F.col("size") <= 2 * F.col("_rest"))
    cut = taken.groupBy("source").agg(F.max(F.struct("rank", "n")).alias("_cut")).withColumnRenamed("source", "_of")
    plan = materialize(plan.join(cut, F.col("_source").eqNullSafe(F.col("_of")), "left").select("_source", "source_size", "target", "_level", "_cut"))
    discard(sizes, ranked)
    return plan


def _small(plan: DataFrame) -> DataFrame:
    """A table of a row a source, broadcast while there are few sources."""
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def _decided(sized: DataFrame, plan: DataFrame, cap: float, tilt: float) -> DataFrame:
    """``sized`` with source_size, target and copies: each row is held against its source's cut."""
    d = sized.join(_small(plan), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", _expected(cap, tilt))
    part = F.col("_copies") - F.floor("_copies")
    drawn = F.when(part > 0, F.coalesce(F.struct(_rank(part).alias("rank"), F.col("n")) <= F.col("_cut"), F.lit(False))).otherwise(F.lit(False))
    return d.withColumn("copies", F.floor("_copies").cast("long") + drawn.cast("long"))


def _keys(seed: int) -> list[Column]:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return [F.col("source"), word_count(F.col("text")).alias("size"), u.alias("u")]


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, tilt: float = 0.5, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    A document is expected to give level * size ** tilt copies, ``cap`` at most, the level such that its source
    is expected to give its target: longer documents have the greater inclusion (tilt 0: all the same). Whole
    copies are certain. What is left of a document's expectation is its inclusion probability in a Pareto order
    sample without replacement: documents rank by the odds of a uniform number divided by the odds of their
    inclusion, and the sample is of fixed size in words: the first ones that bring the words taken nearest to
    the rest of the target are in. The uniform number is a hash of (seed, doc_id, text): reruns and retried tasks agree.

    Null text or no word: size 0, no copy. Null source: a source of its own, last. Repeated rows: each counts;
    equal rows have equal ranks and are told apart by their number. Empty table: no rows. A source with no
    words: target 0. Extra columns of any name are left alone. Prefix sums run in range partitions, so a source
    that holds most rows is spread over many tasks; per source only its different sizes meet in one.
    """
    rows = drop_extra(docs, "doc_id", "source", "text").select("doc_id", *_keys(seed), F.monotonically_increasing_id().alias("n"))
    sized = materialize(rows)
    d = _decided(sized, _plan(sized, weights, share, cap, tilt), cap, tilt)
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, tilt: float = 0.5, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` in as many copies as ``mix`` gives it, all columns as they were.

    Every row decides by itself against its source's cut: no text is shuffled, equal rows count one by one.
    Rows without a word are in no copy; null sources, ties and an empty table as in ``mix``. Extra columns may
    have any names.
    """
    rows = numbered(docs, *_keys(seed))
    sized = rows.select("source", "size", "u", "n")
    d = _decided(rows, _plan(sized, weights, share, cap, tilt), cap, tilt).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_each")).select("row.*")
