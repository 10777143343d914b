"""Run history, run logs and quality counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.functions.text import slug, strip, text
from vitrina.operators.lookups import attach
from vitrina.operators.ordering import running
from vitrina.operators.usage import estimate_cost

# The counter lines of the logs. Each counter group is numbered
# in the order of its names.
LOG_PATTERNS = {
    "stats": (
        r"\bSTATS discovered=(\d+)\s+processed=(\d+)\s+valid=(\d+)\s+errors=(\d+)",
        ["discovered", "processed", "valid", "errors"],
    ),
    "summary": (
        r"discover=(\d+)\s+processed=(\d+)\s+valid=(\d+).*errors=(\d+)",
        ["discovered", "processed", "valid", "errors"],
    ),
    "analysis": (
        r"ASTATS filtered=(\d+)\s+analyzed=(\d+)\s+stores=(\d+)\s+errors=(\d+)",
        ["filtered", "analyzed", "stores", "errors"],
    ),
    "api": (
        r"APISTATS run_requests=(\d+)\s+month_requests=(\d+)\s+free_cap=(\d+)\s+"
        r"remaining=(\d+)\s+within_free=(\w+)\s+est_cost_usd=([\d.]+)",
        ["run_requests", "month_requests", "free_cap", "remaining", "within_free", "est_cost_usd"],
    ),
    "budget": (
        r"IGBUDGET spent=([\d.]+) cap=([\d.]+) pending=(\d+) est=([\d.]+)",
        ["spent", "cap", "pending", "est"],
    ),
}


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Counter lines as rows (run, line_no, kind, counters map); others are dropped."""
    line = F.col("line")
    kind = counters = None
    for name, (pattern, fields) in LOG_PATTERNS.items():
        values = F.map_from_arrays(
            F.array(*[F.lit(f) for f in fields]),
            F.array(*[F.regexp_extract(line, pattern, i + 1) for i in range(len(fields))]),
        )
        kind = (F if kind is None else kind).when(line.rlike(pattern), name)
        counters = (F if counters is None else counters).when(F.col("kind") == name, values)
    # Most lines have no counters; a plain search tells before the patterns do.
    likely = line.contains("valid=") | line.contains("STATS ") | line.contains("IGBUDGET ")
    known = lines.where(likely).withColumn("kind", kind).where(F.col("kind").isNotNull())
    return known.withColumn("counters", counters).drop("line")


def latest_counters(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """The last counters of each run and kind; also valid on a stream.

    The final summary continues the running counters, so both count as one kind.
    """
    kind = F.when(F.col("kind") == "summary", "stats").otherwise(F.col("kind"))
    return parsed.groupBy("run", kind.alias("kind")).agg(
        F.max_by("counters", order).alias("counters"), F.max(order).alias(order)
    )


def latest_valid(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """The last ``valid=N`` of each run's log."""
    found = lines.where(F.col("line").rlike(r"valid=\d+")).withColumn(
        "valid", F.regexp_extract("line", r"valid=(\d+)", 1).cast("long")
    )
    return found.groupBy("run").agg(F.max_by("valid", order).alias("valid"))


def row_counts(outputs: DataFrame, run: str) -> DataFrame:
    return outputs.groupBy(run).agg(F.count(F.lit(1)).alias("real_count"))


def reconcile_runs(history: DataFrame, counts: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """Stored counts replaced by real ones, and lost runs marked as stopped.

    ``counts`` has job_id and real_count; ``alive`` the pids still running.
    """
    if alive is None:
        lost = F.col("status") == "running"
        seen = history
    else:
        live = alive.select("pid").distinct().withColumn("_live", F.lit(True))
        seen = attach(history, live, "pid")
        lost = (F.col("status") == "running") & F.col("_live").isNull()
    joined = seen.join(counts, "job_id", "left").withColumn("_lost", lost)
    settled = joined.withColumns(
        {
            "status": F.when(F.col("_lost"), "stopped").otherwise(F.col("status")),
            "pid": F.when(F.col("_lost"), F.lit(None)).otherwise(F.col("pid")),
        }
    )
    real = (F.col("status") != "running") & (F.col("real_count") > 0)
    return settled.withColumn(
        "valid_count",
        F.when(real, F.col("real_count")).otherwise(F.coalesce("valid_count", F.lit(0))),
    ).drop("_live", "_lost", "real_count")


def run_outcome(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Final status and count of ended runs (job_id, status, exit_code)."""
    joined = runs.join(counts, "job_id", "left").withColumn(
        "valid_count", F.coalesce("real_count", F.lit(0).cast("long"))
    )
    return joined.withColumn(
        "status",
        F.when(F.col("status") == "stopped", "stopped")
        .when(F.col("exit_code") == 0, "done")
        .when(F.col("valid_count") > 0, "partial")
        .otherwise("error"),
    ).drop("real_count")


def started_runs(history: DataFrame) -> DataFrame:
    return history.where(F.coalesce("started_at", F.lit("")) != "")


def newest_first(history: DataFrame, order: str) -> DataFrame:
    return started_runs(history).orderBy(F.col(order).desc())


def infer_region(history: DataFrame, regions: DataFrame) -> DataFrame:
    """Runs without parameters whose city is a region become region runs."""
    known = regions.select(F.lower("region").alias("_city")).distinct().withColumn(
        "_known", F.lit(True)
    )
    city = F.lower(strip(text(F.col("city"))))
    joined = attach(history.withColumn("_city", city), known, "_city")
    bare = F.col("params").isNull() | (F.size("params") == 0)
    region_run = F.create_map(
        F.lit("comunidad"), strip(F.col("city")),
        F.lit("category"), F.coalesce("category", F.lit("")),
    )
    return joined.withColumn(
        "params", F.when(bare & F.col("_known"), region_run).otherwise(F.col("params"))
    ).drop("_city", "_known")


def output_path(city: Column, category: Column, started: Column) -> Column:
    """out/<city>_<category>_<stamp>.csv"""
    return F.format_string(
        "out/%s_%s_%s.csv", slug(city), slug(category), F.date_format(started, "yyyyMMdd_HHmmss")
    )


def collection_summary(records: DataFrame, kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: rows discovered, processed (with a name), errors, valid, duplicates.

    ``by`` names at least one column of both tables; rows without a value are a group too.
    """
    by = list(by)
    counted = _collected(records, kept, by).groupBy(*by).agg(*_collection_counts())
    return counted.drop("heuristic_stops").withColumn("duplicates", F.col("processed") - F.col("valid"))


def collection_report(
    records: DataFrame, kept: DataFrame, by: Sequence[str], stops: DataFrame | None = None
) -> DataFrame:
    """The summary per group with totals: of the last column of ``by``, the last two, …, and of all.

    ``level`` tells how many columns of ``by`` a row is for: as many as there are for a group, 0
    for the whole. The columns summed over are null, as may be a group's own value; ``level``
    tells them apart. ``stops`` has a row with the columns of ``by`` for each grid cell that stopped
    before its results were known to be complete (``heuristic_stops``). One aggregation
    gives all rows; a group that only ``stops`` names is listed too. Where nothing was
    collected there are no rows.
    """
    by = list(by)
    counted = _collected(records, kept, by, stops).rollup(*by).agg(
        *_collection_counts(), F.grouping_id().alias("_summed")
    )
    # One bit for each column summed over, the last column's lowest.
    level = len(by) - F.bit_count("_summed")
    return counted.withColumns(
        {"duplicates": F.col("processed") - F.col("valid"), "level": level.cast("int")}
    ).drop("_summed")


def _collected(
    records: DataFrame, kept: DataFrame, by: list[str], stops: DataFrame | None = None
) -> DataFrame:
    """What is counted, one row each: records, kept rows and stops."""
    named = F.coalesce("nombre", F.lit("")) != ""

    def marked(df: DataFrame, kind: str, name: Column) -> DataFrame:
        return df.select(*by, F.lit(kind).alias("_kind"), name.alias("_named"))

    rows = marked(records, "record", named).unionByName(marked(kept, "kept", F.lit(True)))
    return rows if stops is None else rows.unionByName(marked(stops, "stop", F.lit(True)))


def _collection_counts() -> list[Column]:
    record = F.col("_kind") == "record"
    return [
        F.count_if(record).alias("discovered"),
        F.count_if(record & F.col("_named")).alias("processed"),
        F.count_if(record & ~F.col("_named")).alias("errors"),
        F.count_if(F.col("_kind") == "kept").alias("valid"),
        F.count_if(F.col("_kind") == "stop").alias("heuristic_stops"),
    ]


def require_name(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce("nombre", F.lit("")) != "")


def analysis_summary(rows: DataFrame) -> DataFrame:
    """Counts of an analysis: rows need excluded, es_tienda, page_error, instagram_fuente."""
    done = ~F.col("excluded")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("excluded")).alias("filtered"),
        F.count_if(done).alias("analyzed"),
        F.count_if(done & (F.col("es_tienda") == "Sí")).alias("stores"),
        F.count_if(done & F.col("page_error")).alias("errors"),
        F.count_if(done & (F.col("instagram_fuente") == "web")).alias("ig_web"),
        F.count_if(done & (F.col("instagram_fuente") == "dataforseo")).alias("ig_dataforseo"),
        F.count_if(done & (F.col("instagram_fuente") == "-")).alias("ig_none"),
    )


def valid_per_town(kept: DataFrame, town_order: DataFrame) -> DataFrame:
    """New valid rows per town and their running total in processing order.

    ``town_order`` has municipio_origen and pos.
    """
    counts = kept.groupBy("municipio_origen").agg(F.count(F.lit(1)).alias("written"))
    placed = town_order.join(counts, "municipio_origen", "left").withColumn(
        "written", F.coalesce("written", F.lit(0).cast("long"))
    )
    return running(placed, [], ["pos"], {"total": "written"})


def raw_vs_deduped(raw: DataFrame, deduped: DataFrame) -> DataFrame:
    """Row counts before and after de-duplication, in one row."""
    before = raw.agg(F.count(F.lit(1)).alias("results_raw"))
    return deduped.agg(F.count(F.lit(1)).alias("results_deduped")).withColumn(
        "results_raw", before.scalar()
    )


def run_metrics(
    requests: DataFrame, raw: DataFrame, deduped: DataFrame, by: str, tier: str = "enterprise"
) -> DataFrame:
    """One row per run: queries, requests, pages, rows before and after, cost.

    ``requests`` has one row per page asked for (run, source_query).
    """
    asked = requests.groupBy(by).agg(
        F.count_distinct("source_query").alias("queries"),
        F.count(F.lit(1)).alias("requests"),
    )
    before = raw.groupBy(by).agg(F.count(F.lit(1)).alias("results_raw"))
    after = deduped.groupBy(by).agg(F.count(F.lit(1)).alias("results_deduped"))
    joined = asked.join(before, by, "left").join(after, by, "left")
    counted = joined.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("results_raw", "results_deduped")}
    )
    return counted.withColumns(
        {
            "pages": F.col("requests"),
            "tier": F.lit(tier),
            "run_est_cost_usd": estimate_cost(F.col("requests"), tier),
        }
    )
