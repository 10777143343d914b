"""Usage, budget, logs and run history."""

from pyspark.sql import functions as F

from table_queries.registry import query
from table_queries.shops import letters, table
from vitrina.operators import runs, usage
from vitrina.operators.contact import cache_entries


# Usage and budget -----------------------------------------------------------

def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("run_ts"), F.floor(F.col("value") / 2).alias("requests")
    )


def _quota_sql(used: str, cap: int, rate: float) -> str:
    return f"""{cap}::BIGINT AS free_cap, greatest(0, {cap} - {used})::BIGINT AS remaining, {used} <= {cap} AS within_free,
  round(greatest(0, {used} - {cap}) / 1000.0::DOUBLE * {rate}::DOUBLE, 4) AS est_cost_usd"""


@query(f"""
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS month, sum(floor(value / 2))::BIGINT AS month_requests FROM events GROUP BY 1)
SELECT month, month_requests, {_quota_sql('month_requests', 1000, 35.0)} FROM d""")
def usage_by_day(spark, sf_dir):
    return usage.monthly_usage(ledger(spark, sf_dir), period="yyyy-MM-dd")


@query(f"""
WITH d AS (SELECT strftime(ts, '%Y-%m') AS month, sum(floor(value / 2))::BIGINT AS month_requests FROM events GROUP BY 1)
SELECT month, month_requests, {_quota_sql('month_requests', 5000, 32.0)} FROM d""")
def usage_by_month(spark, sf_dir):
    return usage.monthly_usage(ledger(spark, sf_dir), tier="pro")


@query(f"""
WITH d AS (SELECT event_id, strftime(ts, '%Y-%m') AS month, floor(value / 2)::BIGINT AS requests,
  sum(floor(value / 2)::BIGINT) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS month_requests FROM events)
SELECT event_id, month, requests, month_requests, {_quota_sql('month_requests', 1000, 35.0)} FROM d""")
def quota_after_each_run(spark, sf_dir):
    rows = usage.running_quota(ledger(spark, sf_dir), ["run_ts", "event_id"])
    return rows.drop("run_ts")


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE greatest(0, o_orderkey - 700) / 1000.0::DOUBLE * 32.0::DOUBLE END AS est_cost_usd
FROM orders""")
def request_costs(spark, sf_dir):
    k = F.col("o_orderkey")
    free = usage.estimate_cost(F.lit(0).cast("long") + k, "essentials", free_remaining=10**9)
    paid = usage.estimate_cost(k, "pro", free_remaining=700)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, free).otherwise(paid).alias("est_cost_usd")
    )


_COST = "CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE 0.002 * (1 + event_id % 4)::DOUBLE END"


def searches(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts",
        F.when(e % 5 == 0, 0.0).otherwise(0.002 * (1 + e % 4).cast("double")).alias("cost"),
    )


_BUDGET_SQL = f"""e AS (SELECT event_id, user_id % 3 AS run, ts, {_COST} AS cost FROM events),
s AS (SELECT *, coalesce(sum(cost) OVER w, 0) AS spent, coalesce(last_value(nullif(cost, 0) IGNORE NULLS) OVER w, 0.002) AS last
  FROM e WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(spent + last <= 6.0 + 1e-9) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM s)"""


@query(f"""
WITH {_BUDGET_SQL} SELECT event_id, run, cost, CASE WHEN ok THEN 'paid' ELSE 'refused' END AS search_state FROM f""")
def budget_states(spark, sf_dir):
    rows = searches(spark, sf_dir).withColumn("run", F.col("user_id") % 3).drop("user_id")
    return usage.with_budget(rows, ["run"], ["ts", "event_id"], 6.0).drop("ts")


@query(f"""
WITH {_BUDGET_SQL} SELECT run, round(sum(cost) FILTER (WHERE ok), 6) AS spent, count(*) FILTER (WHERE NOT ok) AS pending, 6.0::DOUBLE AS cap,
  round(count(*) FILTER (WHERE NOT ok) * arg_max(cost, (ts, event_id)) FILTER (WHERE ok AND cost > 0) + 0.004, 2) AS est FROM f GROUP BY run""")
def budget_reports(spark, sf_dir):
    rows = searches(spark, sf_dir).withColumn("run", F.col("user_id") % 3)
    order = ["ts", "event_id"]
    state = usage.with_budget(rows, ["run"], order, 6.0)
    report = usage.budget_report(state, ["run"], order, 6.0)
    return report.withColumn("spent", F.round("spent", 6))


_KEYED_SQL = f"""e AS (SELECT event_id, 'k' || (user_id * 7 + event_id % 11)::VARCHAR AS key, {_COST} AS cost FROM events),
p AS (SELECT key, min(event_id) FILTER (WHERE cost > 0) AS paid_at FROM e GROUP BY key),
c AS (SELECT e.*, paid_at, coalesce(event_id > paid_at, false) AS again FROM e JOIN p USING (key)),
s AS (SELECT *, coalesce(sum(cost) OVER w, 0) AS spent, coalesce(last_value(nullif(cost, 0) IGNORE NULLS) OVER w, 0.002) AS last
  FROM (SELECT * REPLACE (CASE WHEN again THEN 0 ELSE cost END AS cost) FROM c)
  WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT min(event_id) AS stop FROM s WHERE NOT again AND spent + last > 2.0 + 1e-9)"""


@query(f"""
WITH {_KEYED_SQL} SELECT event_id, key, CASE WHEN again AND (stop IS NULL OR paid_at < stop) THEN 'repeat'
  WHEN stop IS NULL OR event_id < stop THEN 'paid' ELSE 'refused' END AS search_state FROM s, x""")
def budget_with_repeats(spark, sf_dir):
    key = F.concat(F.lit("k"), (F.col("user_id") * 7 + F.col("event_id") % 11).cast("string"))
    rows = searches(spark, sf_dir).select("event_id", key.alias("key"), "cost")
    return usage.with_budget(rows, [], ["event_id"], 2.0, key="key").drop("cost")


# Logs -----------------------------------------------------------------------

def log_lines(spark, sf_dir):
    """A log line per event; some lines carry no counters."""
    e = F.col("event_id")

    def line(form, *numbers):
        return F.format_string(form, *numbers)

    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).cast("string").alias("run"),
        e.alias("line_no"),
        F.when(e % 7 == 0, line("x STATS discovered=%d processed=%d  valid=%d errors=1", e, e + 1, e % 90))
        .when(e % 7 == 1, line("ASTATS filtered=1 analyzed=%d stores=%d errors=0", e, e % 5))
        .when(e % 7 == 2, line(
            "APISTATS run_requests=%d month_requests=%d free_cap=1000 remaining=%d within_free=true est_cost_usd=0.50",
            e, e + 5, e % 3))
        .when(e % 7 == 3, line("IGBUDGET spent=%.2f cap=1.00 pending=%d est=0.10", e / 100, e))
        .when(e % 7 == 4, line("discover=%d processed=%d valid=%d duplicates=2 errors=3 elapsed_s=1.00", e, e, e % 80))
        .when(e % 7 == 5, line("plain text %d", e))
        .otherwise(line("retry valid=%d", e))
        .alias("line"),
    )


_LOG_SQL = """l AS (SELECT (user_id % 50)::VARCHAR AS run, event_id AS e, CASE WHEN event_id % 7 IN (0, 4) THEN 'stats'
    WHEN event_id % 7 = 1 THEN 'analysis' WHEN event_id % 7 = 2 THEN 'api' WHEN event_id % 7 = 3 THEN 'budget' END AS kind,
  CASE event_id % 7 WHEN 0 THEN concat_ws(',', event_id, event_id + 1, event_id % 90, 1)
    WHEN 1 THEN concat_ws(',', 1, event_id, event_id % 5, 0)
    WHEN 2 THEN concat_ws(',', event_id, event_id + 5, 1000, event_id % 3, 'true', '0.50')
    WHEN 3 THEN concat_ws(',', printf('%.2f', event_id / 100), '1.00', event_id, '0.10')
    WHEN 4 THEN concat_ws(',', event_id, event_id, event_id % 80, 3) END AS counters FROM events)"""


@query(f"""
WITH {_LOG_SQL} SELECT run, kind, arg_max(counters, e) AS counters, max(e) AS line_no FROM l WHERE kind IS NOT NULL GROUP BY run, kind""")
def log_counters(spark, sf_dir):
    last = runs.latest_counters(runs.parse_log_lines(log_lines(spark, sf_dir)))
    return last.withColumn("counters", F.array_join(F.map_values("counters"), ","))


@query("""
WITH l AS (SELECT (user_id % 50)::VARCHAR AS run, event_id,
    CASE event_id % 7 WHEN 0 THEN event_id % 90 WHEN 4 THEN event_id % 80 WHEN 6 THEN event_id END AS valid FROM events)
SELECT run, arg_max(valid, event_id) FILTER (WHERE valid IS NOT NULL) AS valid FROM l GROUP BY 1""")
def log_valid(spark, sf_dir):
    return runs.latest_valid(log_lines(spark, sf_dir))


# History --------------------------------------------------------------------

def history(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done")
        .otherwise("partial").alias("status"),
        F.when(k % 4 > 0, k % 9).alias("valid_count"),
        F.col("o_custkey").alias("pid"),
        F.when(k % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("started_at"),
    )


def outputs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return runs.row_counts(lines.select(F.col("l_orderkey").alias("job_id")), "job_id")


_RUNS_SQL = """h AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'partial' END AS status,
    CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 END AS valid_count, o_custkey AS pid,
    CASE WHEN o_orderkey % 6 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS started_at FROM orders),
n AS (SELECT l_orderkey AS job_id, count(*) AS real_count FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)"""


@query(f"""
WITH {_RUNS_SQL}, s AS (SELECT *, status = 'running' AND pid NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS lost
  FROM h LEFT JOIN n USING (job_id)),
t AS (SELECT * REPLACE (CASE WHEN lost THEN 'stopped' ELSE status END AS status, CASE WHEN lost THEN NULL ELSE pid END AS pid) FROM s)
SELECT job_id, status, pid, started_at, CASE WHEN status <> 'running' AND real_count > 0 THEN real_count ELSE coalesce(valid_count, 0) END AS valid_count
FROM t WHERE started_at IS NOT NULL""")
def reconciled_runs(spark, sf_dir):
    alive = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("pid")
    )
    done = runs.reconcile_runs(history(spark, sf_dir), outputs(spark, sf_dir), alive)
    return runs.newest_first(done, "job_id")


@query(f"""
WITH {_RUNS_SQL} SELECT job_id, coalesce(real_count, 0) AS valid_count, CASE WHEN status = 'partial' THEN 'stopped'
  WHEN job_id % 3 = 0 THEN 'done' WHEN real_count > 0 THEN 'partial' ELSE 'error' END AS status FROM h LEFT JOIN n USING (job_id)""")
def run_outcomes(spark, sf_dir):
    ended = history(spark, sf_dir).select(
        "job_id",
        F.when(F.col("status") == "partial", "stopped").otherwise("running").alias("status"),
        (F.col("job_id") % 3).alias("exit_code"),
    )
    return runs.run_outcome(ended, outputs(spark, sf_dir)).select("job_id", "valid_count", "status")


@query("""
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 4 = 1 THEN 'kept' WHEN c_custkey % 2 = 0 THEN r_name END AS comunidad,
  CASE WHEN c_custkey % 4 <> 1 AND c_custkey % 2 = 0 THEN c_mktsegment END AS category
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def inferred_regions(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    rows = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("job_id"),
            F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("r_name"))).otherwise(F.col("n_name")).alias("city"),
            F.col("c_mktsegment").alias("category"),
            F.when(k % 4 == 1, F.create_map(F.lit("comunidad"), F.lit("kept"))).alias("params"),
        )
    )
    known = region.select(F.lower("r_name").alias("region"))
    done = runs.infer_region(rows, known)
    return done.select(
        "job_id",
        F.try_element_at("params", F.lit("comunidad")).alias("comunidad"),
        F.try_element_at("params", F.lit("category")).alias("category"),
    )


@query("""
SELECT o_orderkey, 'out/a_coruna_' || translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') || '_' ||
  replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.csv' AS path FROM orders""")
def output_paths(spark, sf_dir):
    city = F.concat(F.lit("A Coruña, "), letters(F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        runs.output_path(city, F.col("o_orderpriority"), F.col("o_orderdate")).alias("path"),
    )


@query("""
WITH n AS (SELECT o_custkey, count(*) AS written FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey AS pos, c_name AS municipio_origen, coalesce(written, 0) AS written,
  sum(coalesce(written, 0)) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)::BIGINT AS total
FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def valid_rows_per_town(spark, sf_dir):
    towns = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("municipio_origen"), F.col("c_custkey").alias("pos")
    )
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(
        towns, F.col("o_custkey") == F.col("pos")
    )
    return runs.valid_per_town(kept.select("municipio_origen"), towns)


@query(f"""
WITH {_KEYED_SQL}
SELECT key, CASE WHEN event_type = 'click' THEN '' ELSE 'https://instagram.com/u' || event_id::VARCHAR END AS url, 99::BIGINT AS ts
FROM s JOIN x ON true JOIN events USING (event_id) WHERE NOT again AND s.cost > 0 AND (stop IS NULL OR event_id < stop)""")
def new_cache_entries(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "click", F.concat(F.lit("u"), F.col("event_id").cast("string")))
        .alias("handle"),
    )
    key = F.concat(F.lit("k"), (F.col("user_id") * 7 + F.col("event_id") % 11).cast("string"))
    rows = searches(spark, sf_dir).select("event_id", key.alias("key"), "cost").join(events, "event_id")
    return cache_entries(usage.with_budget(rows, [], ["event_id"], 2.0, key="key"), 99)


@query("""
SELECT r.run, queries, requests, coalesce(results_raw, 0) AS results_raw, coalesce(results_deduped, 0) AS results_deduped,
  requests AS pages, 'pro' AS tier, round(greatest(0, requests - 5000) / 1000.0::DOUBLE * 32.0::DOUBLE, 4) AS run_est_cost_usd
FROM (SELECT user_id % 9 AS run, count(DISTINCT event_type) AS queries, count(*) AS requests FROM events GROUP BY 1) r
LEFT JOIN (SELECT o_custkey % 9 AS run, count(*) AS results_raw, count(DISTINCT o_custkey) AS results_deduped FROM orders GROUP BY 1) USING (run)""")
def metrics_of_runs(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 9).alias("run"), F.col("event_type").alias("source_query")
    )
    raw = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).alias("run"), "o_custkey")
    return runs.run_metrics(asked, raw, raw.distinct(), "run", "pro")
