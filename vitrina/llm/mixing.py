"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.common import WORD, discard, group_key, keep, unit_hash
from vitrina.operators.ordering import numbered

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20_011
# Newton stops when every source is this close to its target, as a share of it.
SOLVED = 1e-9
MAX_STEPS = 60
# Rounding stops when every source is this close, or no document can improve it.
ROUNDED = 0.002
CUTS = 64
MAX_CUT_PASSES = 4
MAX_SWAPS = 12


def text_size(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to rows of _key, source, source_size.

    Sources in code point order, null last, take the weights in turn. A target stops
    at ``max_repeats`` times its source's size; what is over goes to the others by
    weight until none is above. Each pass brings two sums to the driver.
    """
    ranked = keep(
        numbered(
            sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_nth"
        ).withColumn(
            "_weight",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int"),
            ),
        ),
        "ranked",
    )
    most = F.col("source_size") * F.lit(float(max_repeats))
    level = 0.0
    while True:
        free = F.col("_weight") * F.lit(level) < most
        sums = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(~free, most).otherwise(F.lit(0.0))).alias("full"),
            F.sum(F.when(free, F.col("_weight")).otherwise(F.lit(0.0))).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        raised = (sums["total"] - sums["full"]) / sums["weight"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_weight") * F.lit(level), most)
    return ranked.select("_key", "source", "source_size", "_n", target.alias("target"))


def _rate(max_repeats: int) -> Column:
    """Rate of a size under its source's tilt; 1 where the tilt is 0.

    A document's rate lies between 0 and ``max_repeats``; the prior is rate 1. The
    entropy of a bounded rate has the logistic form of the exponential tilt.
    """
    odds = F.col("tilt") * F.col("size") / F.col("scale")
    free = max_repeats / (1.0 + (max_repeats - 1.0) * F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))
    return F.when(F.col("full"), F.lit(float(max_repeats))).otherwise(free)


def solve_tilts(sizes: DataFrame, targets: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: _key, target, scale, tilt, full.

    ``sizes`` has _key, size, n: how often each size occurs. The dual has one unknown
    per source; a Newton step needs the source's expected words and their slope, both
    sums over ``sizes``, so an iteration is one aggregation. Steps that leave the known
    bracket are replaced by its middle. The state never leaves Spark; the driver sees
    one number per step, the worst distance to a target.
    """
    state = keep(
        targets.where("source_size > 0").select(
            "_key", "target",
            (F.col("source_size") / F.col("_n")).alias("scale"),
            (F.col("target") >= F.col("source_size") * float(max_repeats) * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"),
        ),
        "tilts",
    )
    rate = _rate(max_repeats)
    for _ in range(MAX_STEPS):
        expected = sizes.join(state, "_key").groupBy("_key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            F.sum(
                F.col("n") * F.col("size") * F.col("size") / F.col("scale")
                * rate * (1 - rate / max_repeats)
            ).alias("slope"),
        )
        moved = state.join(expected, "_key").select(
            "_key", "target", "scale", "full", "tilt", "words",
            F.when(F.col("words") <= F.col("target"), F.col("tilt")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("words") > F.col("target"), F.col("tilt")).otherwise(F.col("high")).alias("high"),
            (
                F.col("tilt")
                + F.when(F.col("slope") > 0, (F.col("target") - F.col("words")) / F.col("slope"))
            ).alias("step"),
        )
        middle = (F.col("low") + F.col("high")) / 2
        near = F.when(F.col("low") <= -1e9, 2 * F.col("high") - 1).when(
            F.col("high") >= 1e9, 2 * F.col("low") + 1
        ).otherwise(middle)
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        away = F.abs(F.col("words") - F.col("target")) / F.col("target")
        stepped = keep(
            moved.select(
                "_key", "target", "scale", "full",
                F.when(F.col("full") | (away <= SOLVED), F.col("tilt"))
                .when(inside, F.col("step")).otherwise(near).alias("tilt"),
                "low", "high",
                F.when(F.col("full"), F.lit(0.0)).otherwise(away).alias("away"),
            ),
            "tilts",
        )
        discard(state)
        state = stepped
        worst = state.agg(F.max("away")).first()[0]
        if worst is None or worst <= SOLVED:
            break
    # Rounded, so that sums taken in another order give the same tilt.
    return state.select("_key", "target", "scale", "full", F.round("tilt", 7).alias("tilt"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    carry: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies, taken.

    A value of the row to ``carry`` becomes a last column _carry.

    Rates maximise entropy relative to taking every document once, subject to each
    source's words meeting its target and no rate above ``max_repeats``. Copies are
    whole: the rate is rounded at a threshold that each document's keyed hash shifts and
    that each source sets so that its words meet the target; then single copies are
    added or taken away while that brings a source nearer. Copies of equal rows are
    interchangeable. A null source is a source of its own; documents without words get
    no copies' worth of words and copies by their rate 1; a source without words has
    target 0. Extra columns are ignored; an empty table gives an empty one. Joins are of
    kept tables by source: Spark broadcasts the sources' table when it is small and
    splits a source with very many rows when it is not.
    """
    compact = keep(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source).cast("string").alias("_source"),
            group_key(F.col(source)).alias("_key"),
            text_size(F.col(text)).alias("size"),
            *([] if carry is None else [carry.alias("_carry")]),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "sizes",
    )
    carried = [] if carry is None else ["_carry"]
    sources = compact.groupBy("_key").agg(
        F.first("_source", ignorenulls=True).alias("source"),
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("_n"),
    )
    targets = keep(source_targets(keep(sources, "sources"), weights, max_repeats), "targets")
    sizes = keep(compact.where("size > 0").groupBy("_key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    tilts = solve_tilts(sizes, targets, max_repeats)

    lookup = targets.select("_key", "source_size", F.col("target").alias("_target")).join(tilts, "_key", "left")
    rated = keep(
        compact.join(keep(lookup.drop("target"), "lookup"), "_key", "left")
        .withColumn(
            "rate",
            F.when(F.col("tilt").isNull() | (F.col("size") == 0), F.lit(1.0))
            .otherwise(F.round(_rate(max_repeats), 9)),
        )
        .withColumn("_shift", unit_hash(F.col("_id"), F.col("size"), seed=seed))
        .select("_row", "_id", "_source", "_key", "size", "source_size",
                F.col("_target").alias("target"), "rate", "_shift", *carried),
        "rated",
    )
    cuts = _find_cuts(rated, max_repeats)
    rounded = keep(
        rated.join(cuts, "_key", "left").withColumn(
            "copies", F.when(F.col("size") == 0, F.lit(1).cast("long"))
            .otherwise(_copies(F.col("cut"), max_repeats))
        ).drop("cut", "_shift"),
        "rounded",
    )
    done = _swap_copies(rounded, max_repeats)
    discard(rated)
    return done.select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), "size", "source_size",
        "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried,
    )


def _copies(cut: Column, max_repeats: int) -> Column:
    raised = F.floor(F.col("rate") + F.col("_shift") + cut)
    return F.least(F.greatest(raised, F.lit(0)), F.lit(max_repeats)).cast("long")


def _find_cuts(rated: DataFrame, max_repeats: int) -> DataFrame:
    """Per source the cut at which its copies' words come nearest to the target.

    The words grow with the cut. Each pass sums the words at evenly spaced cuts of
    every source's bracket, for all sources at once, and goes on inside the gap that
    holds the target.
    """
    rated = rated.where("size > 0")
    state = keep(
        rated.groupBy("_key").agg(F.first("target").alias("target")).select(
            "_key", "target", F.lit(-float(max_repeats) - 1).alias("low"), F.lit(float(max_repeats) + 1).alias("high")
        ),
        "cuts",
    )
    for _ in range(MAX_CUT_PASSES):
        width = (F.col("high") - F.col("low")) / CUTS
        joined = rated.drop("target").join(state, "_key")
        sums = joined.groupBy("_key").agg(
            F.array(*[
                F.sum(F.col("size") * _copies(F.col("low") + width * i, max_repeats))
                for i in range(CUTS + 1)
            ]).alias("words")
        )
        # The last cut whose words do not exceed the target, and the one after it.
        below = F.greatest(F.size(F.filter("words", lambda w: w <= F.col("target"))), F.lit(1))
        chosen = state.join(sums, "_key").withColumn("_at", F.least(below, F.lit(CUTS)))
        narrowed = keep(
            chosen.select(
                "_key", "target",
                (F.col("low") + width * (F.col("_at") - 1)).alias("low"),
                (F.col("low") + width * F.col("_at")).alias("high"),
                F.abs(F.element_at("words", F.col("_at")) - F.col("target")).alias("under"),
                F.abs(F.element_at("words", F.col("_at") + 1) - F.col("target")).alias("over"),
            ),
            "cuts",
        )
        discard(state)
        state = narrowed.select("_key", "target", "low", "high")
        state.kept_at = narrowed.kept_at
        worst = narrowed.agg(
            F.max(F.least("under", "over") / F.greatest(F.col("target"), F.lit(1.0)))
        ).first()[0]
        if worst is None or worst <= ROUNDED:
            break
    return narrowed.select(
        "_key", F.when(F.col("under") <= F.col("over"), F.col("low")).otherwise(F.col("high")).alias("cut")
    )


def _swap_copies(rounded: DataFrame, max_repeats: int) -> DataFrame:
    """Add or drop single copies, the largest that brings a source nearer, one per source and round."""
    spark = rounded.sparkSession
    totals = keep(
        rounded.groupBy("_key").agg(
            F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("words")
        ),
        "totals",
    )
    moves = spark.createDataFrame([], "_row long, _by long")
    for _ in range(MAX_SWAPS):
        open_sources = totals.where(
            F.abs(F.col("words") - F.col("target")) > F.lit(ROUNDED) * F.col("target")
        ).select("_key", (F.col("target") - F.col("words")).alias("_gap"))
        if open_sources.isEmpty():
            break
        now = rounded.join(moves, "_row", "left_anti")  # a document is changed once at most
        joined = now.join(open_sources, "_key")
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("_gap"))
        room = F.when(F.col("_gap") > 0, F.col("copies") < max_repeats).otherwise(F.col("copies") > 0)
        better = F.struct(
            -F.abs(F.abs(F.col("_gap")) - F.col("size")), F.col("size"), F.xxhash64("_id"), F.col("_row")
        )
        best = keep(
            joined.where(fits & room).groupBy("_key").agg(
                F.max_by(
                    F.struct("_row", F.signum("_gap").cast("long").alias("_by"), "size"), better
                ).alias("_best")
            ).select("_key", "_best.*"),
            "swaps",
        )
        if best.isEmpty():
            break
        moves = moves.unionByName(best.select("_row", "_by"))
        changed = keep(
            totals.join(best, "_key", "left").select(
                "_key", "target",
                (F.col("words") + F.coalesce(F.col("_by") * F.col("size"), F.lit(0))).alias("words"),
            ),
            "totals",
        )
        discard(totals)
        totals = changed
    return rounded.join(moves, "_row", "left").withColumn(
        "copies", F.col("copies") + F.coalesce("_by", F.lit(0).cast("long"))
    ).drop("_by")
