"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import free_prefix, small_side, stage

SEED = 42
TARGET_ENTROPY, MAX_REPEATS, BUDGET = 0.95, 4.0, 1.0
#: Exponents tried in one pass over the sources: four halvings of the interval at once.
POINTS, PASSES = 15, 7
#: Documents of a source that one bucket of the prefix sums holds on average.
BUCKET_ROWS = 1000


def tokens(text_col: str):
    """Words of a text and one end mark: no document is free."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def _curve(sources: DataFrame, exponents: list[float], budget: float) -> list:
    """(exponent, entropy, highest repetition) of the weights share^exponent, normalised."""
    tried = sources.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    raised = tried.select("a", "share", F.pow("share", "a").alias("w"))
    found = raised.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("a") * F.log("share")).alias("wl"),
                                    F.max(F.col("w") / F.col("share")).alias("most"))
    return sorted(found.select("a", F.log("z") - F.col("wl") / F.col("z"), F.lit(budget) * F.col("most") / F.col("z")).collect())


def _bisect(sources: DataFrame, budget: float, good) -> float:
    """The end of [0, 1] or the point inside where ``good(entropy, repetition)`` turns from true to false."""
    low, high = 0.0, 1.0
    ends = _curve(sources, [low, high], budget)
    if good(*ends[1][1:]):
        return high
    if not good(*ends[0][1:]):
        return low
    for _ in range(PASSES):
        step = (high - low) / (POINTS + 1)
        for a, entropy, most in _curve(sources, [low + step * (i + 1) for i in range(POINTS)], budget):
            if not good(entropy, most):
                high = a
                break
            low = a
    return low


def source_weights(docs: DataFrame, source_col: str = "source", target_entropy: float | None = TARGET_ENTROPY,
                   max_repeats: float | None = MAX_REPEATS, budget: float = BUDGET) -> DataFrame:
    """One row per source: its documents, tokens, share, weight, and how often its tokens are to be seen.

    weight = share^a / sum; ``docs`` has columns source_col and n_tokens. The
    exponent a in [0, 1] is the largest whose entropy reaches
    ``target_entropy`` of the most that so many sources can have; if a source
    would then be repeated over ``max_repeats`` times, it is raised until none
    is. With a = 1 sources keep their shares; that is taken when even it
    repeats too often (a budget above max_repeats corpora). Repeats are rounded
    to a millionth, the exponent's precision. A null source is a source of its
    own.
    """
    totals = stage(docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).coalesce(4), "sources")
    n, every = totals.agg(F.count("*"), F.sum("n_tokens")).first()
    sources = totals.withColumn("share", F.col("n_tokens") / F.lit(float(every or 1)))
    exponent = 1.0
    if n and target_entropy is not None:
        most = totals.sparkSession.range(1).select(F.log(F.lit(float(n)))).first()[0] * target_entropy
        exponent = _bisect(sources, budget, lambda entropy, _: entropy >= most)
    if n and max_repeats is not None and _curve(sources, [exponent], budget)[0][2] > max_repeats:
        exponent = _raise(sources, budget, exponent, max_repeats)
    raised = sources.withColumn("w", F.pow("share", F.lit(exponent)))
    z = raised.agg(F.sum("w")).first()[0] or 1.0
    weight = F.col("w") / F.lit(z)
    return raised.select("source", "n_docs", "n_tokens", "share", F.lit(exponent).alias("exponent"), weight.alias("weight"),
                         F.round(F.lit(budget) * weight / F.col("share"), 6).alias("repeats"))


def _raise(sources: DataFrame, budget: float, low: float, limit: float) -> float:
    """The least exponent, within the last pass's step, at which no source is repeated over ``limit`` times."""
    high = 1.0
    for _ in range(PASSES):
        step = (high - low) / (POINTS + 1)
        for a, _entropy, most in _curve(sources, [low + step * (i + 1) for i in range(POINTS)], budget):
            if most <= limit:
                high = a
                break
            low = a
    return high


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
        target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: float = BUDGET) -> DataFrame:
    """``df``'s rows as often as their source's weight asks, with columns block, block_order and weight.

    A source with r repeats gets floor(r) whole blocks, each a permutation of
    all its documents, and a last block cut where its tokens would exceed the
    rest of its budget. A block's order is a hash of (seed, block, id, text);
    rows equal in both stand at one place and are taken or left together.

    The cut needs prefix sums in hash order of sources of any size: tokens are
    summed by ranges of the hash, about BUCKET_ROWS documents each, these few
    sums are run up per source, and only the one range that holds the cut is
    ordered row by row. Texts are never shuffled.

    Null and empty texts cost one token, a null source is a source, and an
    empty table gives no row. ``budget`` is in corpora: 1 gives as many tokens
    as came in, at most. Columns of ``df`` named like the three are replaced.
    """
    costs = stage(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(source_col).alias("source"),
                            tokens(text_col).alias("n_tokens")), "tokens")
    weights = source_weights(costs, "source", target_entropy, max_repeats, budget)
    plan = stage(weights.select(F.col("source").alias("s"), "weight", F.floor("repeats").cast("int").alias("whole"),
                                (F.col("repeats") - F.floor("repeats")).alias("part"), F.col("n_tokens").alias("all"),
                                F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long").alias("buckets")).coalesce(4), "weights")

    def place(block, own_id: str = "id", own_text: str = "t"):
        h = F.xxhash64(F.lit(seed), block, F.col(own_id), F.col(own_text))
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))

    last = costs.join(small_side(plan), F.col("source").eqNullSafe(F.col("s"))).withColumn("u", place(F.col("whole"))).withColumn(
        "bucket", F.floor(F.col("u") * F.col("buckets"))).withColumn("allowed", F.col("part") * F.col("all"))
    sums = last.groupBy("s", "bucket").agg(F.sum("n_tokens").alias("n"), F.first("allowed").alias("allowed"))
    run_up = sums.withColumn("up", F.sum("n").over(Window.partitionBy("s").orderBy("bucket")))
    cut = stage(run_up.filter("up > allowed").groupBy("s").agg(F.min("bucket").alias("cut"), F.min(F.col("up") - F.col("n")).alias("before")).coalesce(4), "cuts")
    side = cut.withColumnRenamed("s", "c")
    inside = last.join(small_side(side), F.col("s").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("cut")))
    within = inside.withColumn("up", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("s").orderBy("u")))
    reach = within.groupBy("s").agg(F.max(F.when(F.col("up") <= F.col("allowed"), F.col("u"))).alias("u_in"),
                                    F.first(F.col("cut") / F.col("buckets")).alias("u_from"))
    # Sources without a cut fit whole into their last block.
    ends = stage(plan.join(reach.withColumnRenamed("s", "r"), F.col("s").eqNullSafe(F.col("r")), "left").select(
        "s", "weight", "whole", F.when(F.col("u_from").isNull(), 2.0).otherwise(F.coalesce("u_in", F.col("u_from"))).alias("until"),
        F.col("u_from").isNull().alias("no_cut"), F.col("u_in").isNull().alias("none_in")).coalesce(4), "ends")
    m = free_prefix(df, "_m_")
    side = small_side(ends.select(*[F.col(c).alias(f"{m}{c}") for c in ends.columns]))
    rows = df.withColumns({f"{m}id": F.col(id_col), f"{m}text": F.xxhash64(text_col)}).join(
        side, F.col(source_col).eqNullSafe(F.col(f"{m}s")))
    spot = place(F.col(f"{m}whole"), f"{m}id", f"{m}text")
    in_last = (F.when(F.col(f"{m}no_cut"), F.lit(True)).when(F.col(f"{m}none_in"), spot < F.col(f"{m}until"))
               .otherwise(spot <= F.col(f"{m}until")))
    chosen = rows.withColumn(f"{m}n", F.col(f"{m}whole") + F.when(in_last, 1).otherwise(0)).filter(f"{m}n > 0").withColumn(
        f"{m}block", F.explode(F.sequence(F.lit(0), F.col(f"{m}n") - 1)))
    added = {"block": F.col(f"{m}block"), "block_order": place(F.col(f"{m}block"), f"{m}id", f"{m}text"), "weight": F.col(f"{m}weight")}
    return chosen.select(*[F.col(c) for c in df.columns if c not in added], *[v.alias(k) for k, v in added.items()])
