"""Mixing sources to target weights by hash-threshold histograms (native: DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Plain, Scratch, running_total

#: Bits of the hash that each level of histogram resolves.
LEVEL_BITS = 12
LEVELS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """(_src, _source_size, _target): target words per source.

    ``sizes`` has one row per source: ``_src``, ``_source_size``. Sources by code point, null last, get ``weights`` in
    turn; ``budget`` times all words is shared by weight, no source above ``cap`` times its size, the excess reshared
    by weight until none is above. That fixed point is a water level: the capped sources are those of the smallest
    capacity per weight, so running totals in that order find it. Sources may be many: both orders are dealt by range.
    """
    src = F.col("_src").asc_nulls_last()
    s = running_total(scratch, sizes.withColumn("_one", F.lit(1).cast("long")), [src], {"_one": "_turn"}, "turns").drop("_one")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights)).cast("int") + 1)
    s = s.withColumn("_w", turn).drop("_turn").withColumn("_cap", cap * F.col("_source_size"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = running_total(scratch, s, [F.col("_ratio"), src], {"_cap": "_caps", "_w": "_ws"}, "levels")
    total, weight = s.agg(F.sum("_source_size"), F.sum("_w")).first()
    level = F.try_divide(F.lit(budget * (total or 0)) - F.col("_caps"), F.lit(float(weight or 0)) - F.col("_ws"))
    at = F.struct("_ratio", F.col("_src").isNull(), "_src", level.alias("_level"))
    water = s.agg(F.min(F.when(level <= F.col("_ratio"), at))["_level"]).first()[0]
    target = F.col("_cap") if water is None else F.when(F.col("_ratio") < F.lit(water), F.col("_cap")).otherwise(F.col("_w") * F.lit(water))
    return s.select("_src", "_source_size", target.alias("_target"))


def doc_hash(seed: int, of=F.col) -> Column:
    return F.xxhash64(F.lit(seed), of("doc_id"), of("source"), of("text"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to (doc_id, source) of every row of ``docs``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; more columns are ignored. Each source takes every document
    floor(target / size) times, and once more those whose hash lies under the source's threshold. The threshold comes
    from histograms: words are summed by source and hash bucket (4,096 of them), the bucket in which the budget runs out
    is found, only that bucket is summed again by the next 12 bits of the hash, and of the last bucket, a 16 millionth
    of the source, the documents are taken by full hash while they fit. What is left of the target then goes to the one
    document of the nearest size. No documents are sorted. The hash covers doc_id, source and text, so reruns agree whatever the partitioning.

    Null texts and texts without words have size 0, take 0 copies' words and disturb nothing. A null source is a
    source of its own, last in order. A source without words has target 0. Repeated rows have equal hashes and count as
    one unit of the threshold only inside the last bucket, where they are taken one by one. Empty input: empty result.
    """
    return decide(docs, weights, budget, cap, seed)[0].drop("_rule")


def decide(docs: DataFrame, weights: tuple[int, ...], budget: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``mix`` with ``_rule``, the copies that the threshold alone gives, and the thresholds of each source: _src, _whole and the cuts."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    sized = scratch.table(
        docs.select(
            F.col("doc_id"),
            F.col("source").alias("_src"),
            word_count(F.col("text")).alias("size"),
            doc_hash(seed).alias("_hash"),
        ),
        "sized",
    )
    sized = sized.withColumns({f"_b{i}": bucket(i) for i in range(LEVELS)})

    targets = source_targets(scratch, sized.groupBy("_src").agg(F.sum("size").alias("_source_size")), weights, budget, cap)
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    plan = scratch.table(
        targets.withColumn("_whole", whole.cast("long")).withColumn(
            "_left", F.col("_target") - F.col("_whole") * F.col("_source_size")
        ),
        "targets",
    )
    plan = plan.withColumn("_taken0", F.lit(0).cast("long"))
    for i in range(LEVELS):
        plan = scratch.table(refine(sized, plan, i), f"level{i}")
    edge = same(sized, plan, LEVELS)
    order = Window.partitionBy("_src").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "size")
    edge = edge.withColumn("_sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = F.col(f"_taken{LEVELS}") + F.col("_sum") <= F.col("_left")
    order_in = Window.partitionBy("_src", "_hash").orderBy(F.col("doc_id").asc_nulls_last(), "size")
    edge = edge.withColumn("_n", F.row_number().over(order_in)).select("_src", "_hash", "doc_id", "size", "_n", fits.alias("_fits"))
    edge = scratch.table(edge, "edge")

    inside, open_ = under()
    cols = ["_source_size", "_target", "_whole", *[f"_cut{i}" for i in range(LEVELS)]]
    out = sized.join(plan.select(F.col("_src").alias("_s"), *cols), F.col("_src").eqNullSafe(F.col("_s"))).drop("_s")
    out = out.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_edge", F.coalesce(open_, F.lit(False)))
    sure = out.where(~F.col("_edge")).withColumn("_extra", F.col("_in").cast("long"))
    last = out.where("_edge").withColumn("_n", F.row_number().over(order_in))
    e = edge.select(
        F.col("_src").alias("_s"), F.col("_hash").alias("_h"), F.col("_n").alias("_m"), F.col("_fits").cast("long").alias("_extra")
    )
    last = last.join(
        e, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h")) & (F.col("_n") == F.col("_m"))
    ).drop("_s", "_h", "_m", "_n")
    chosen = scratch.table(sure.unionByName(last).drop("_in", "_edge"), "chosen")
    out = fill(scratch, chosen)
    copies = F.least(F.col("_whole") + F.col("_extra"), F.lit(int(cap)))
    out = out.select(
        rule(cap).alias("_rule"),
        "doc_id",
        F.col("_src").alias("source"),
        F.col("_hash"),
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
    out = scratch.table(out, "mix")
    scratch.free("sized", "turns", "levels", "targets", "edge", "chosen", "fill", *[f"level{i}" for i in range(LEVELS - 1)])
    return out, plan.select("_src", "_whole", *[f"_cut{i}" for i in range(LEVELS)])


def fill(scratch: Scratch, chosen: DataFrame) -> DataFrame:
    """Takes one more document a source, that whose size is nearest to what the threshold left of the target, if any helps."""
    taken = F.sum(F.col("size") * (F.col("_whole") + F.col("_extra")))
    gap = chosen.groupBy("_src").agg((F.max("_target") - taken).alias("_gap"), F.max("_target").alias("_t"))
    gap = gap.where(F.col("_gap") > 0).select(F.col("_src").alias("_s"), "_gap")
    rest = chosen.where((F.col("_extra") == 0) & (F.col("size") > 0)).join(gap, F.col("_src").eqNullSafe(F.col("_s"))).drop("_s")
    off = F.abs(F.col("size") - F.col("_gap"))
    best = rest.where(off < F.col("_gap")).groupBy("_src").agg(F.min(F.struct(off, "_hash"))["_hash"].alias("_h"))
    best = scratch.table(best.select(F.col("_src").alias("_s"), "_h"), "fill")
    hit = F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h"))
    both = chosen.join(best, hit, "left").drop("_s")
    one = F.row_number().over(Window.partitionBy("_src", "_hash").orderBy("_extra", F.col("doc_id").asc_nulls_last()))
    same = both.where(F.col("_h").isNotNull()).withColumn("_n", one)
    same = same.withColumn("_extra", F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.col("_extra")).cast("long")).drop("_n")
    return both.where(F.col("_h").isNull()).unionByName(same)


def bucket(level: int) -> Column:
    """The ``level``-th group of LEVEL_BITS bits of the hash, from the top."""
    return F.shiftrightunsigned("_hash", 64 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def under() -> tuple[Column, Column]:
    """Whether a row beside its source's cuts lies under the threshold, and whether it lies in the last bucket, which is decided row by row."""
    inside, open_ = F.lit(False), F.lit(True)
    for i in range(LEVELS):
        inside = inside | (open_ & (F.col(f"_b{i}") < F.col(f"_cut{i}")))
        open_ = open_ & (F.col(f"_b{i}") == F.col(f"_cut{i}"))
    return inside, open_


def rule(cap: float) -> Column:
    """The copies of a row that the threshold alone gives."""
    return F.least(F.col("_whole") + F.coalesce(under()[0], F.lit(False)).cast("long"), F.lit(int(cap)))


def same(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The documents in the boundary buckets of the levels before ``level``, beside their source's plan."""
    on = F.col("_src").eqNullSafe(F.col("_s"))
    for i in range(level):
        on = on & (F.col(f"_b{i}") == F.col(f"_cut{i}"))
    return sized.join(plan.withColumnRenamed("_src", "_s"), on).drop("_s")


def refine(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """Adds to ``plan`` ``_cut{level}``, the bucket in which the budget runs out, and the words taken before it."""
    b, taken = f"_b{level}", f"_taken{level}"
    histogram = same(sized, plan, level) if level else sized
    histogram = histogram.groupBy("_src", b).agg(F.sum("size").alias("_sum"))
    histogram = histogram.withColumnRenamed("_src", "_s").join(plan, F.col("_s").eqNullSafe(F.col("_src"))).drop("_s")
    up = Window.partitionBy("_src").orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = histogram.withColumn("_upto", F.col(taken) + F.sum("_sum").over(up))
    over = F.col("_upto") > F.col("_left")
    cuts = histogram.groupBy("_src").agg(
        F.coalesce(F.min(F.when(over, F.col(b))), F.lit(1 << LEVEL_BITS)).alias(f"_cut{level}"),
        F.coalesce(F.max(F.when(~over, F.col("_upto"))), F.max(taken)).cast("long").alias(f"_taken{level + 1}"),
    )
    cuts = cuts.withColumnRenamed("_src", "_s")
    kept = plan.join(cuts, F.col("_src").eqNullSafe(F.col("_s")), "left").drop("_s")
    return kept.withColumn(f"_cut{level}", F.coalesce(f"_cut{level}", F.lit(-1))).withColumn(
        f"_taken{level + 1}", F.coalesce(f"_taken{level + 1}", F.col(taken))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with all their columns, as ``mix`` takes them: each as often as its copies, none if it has none.

    Texts without words (null, empty) are taken as often as their hash says. Rows that are equal share their copies. Empty input: empty result.
    """
    taken, plan = decide(docs, weights, budget, cap, seed)
    scratch = Scratch(docs.sparkSession, "mixed")
    # the rule gives the copies beside the row; few hashes, of the last buckets and of ``fill``, have others
    odd = scratch.table(taken.where("copies != _rule").select("_hash").distinct(), "odd")
    odd = taken.join(odd, "_hash", "left_semi").groupBy(F.col("_hash").alias("_h")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    odd = scratch.table(odd, "copies")
    plain = Plain(docs)
    rows = plain.df.withColumn("_hash", doc_hash(seed, plain.__getitem__))
    usual = rows.withColumns({f"_b{i}": bucket(i) for i in range(LEVELS)}).join(odd, F.col("_hash") == F.col("_h"), "left_anti")
    usual = usual.join(plan, plain["source"].eqNullSafe(F.col("_src"))).withColumn("_n", rule(cap))
    # rows that are equal share their copies: the first ones get what is over
    shared = rows.join(odd, F.col("_hash") == F.col("_h"))
    turn = F.row_number().over(Window.partitionBy("_hash").orderBy("_h"))
    over = (turn <= F.col("_copies") % F.col("_rows")).cast("long")
    shared = shared.withColumn("_n", F.floor(F.col("_copies") / F.col("_rows")) + over)
    both = usual.select(*plain.columns, "_n").unionByName(shared.select(*plain.columns, "_n"))
    return plain.back(both.withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int")))))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
