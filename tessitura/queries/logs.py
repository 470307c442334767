"""Run logs over ``events`` (samples and steps by user) and costs over ``orders``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import utc_micros
from ..operators import oplogs as G
from ..operators import packing as P
from ..sources.tables import read_table
from . import sql as Q
from .registry import query
from .scores import rounded


def steps(spark: SparkSession, sf: str) -> DataFrame:
    t = utc_micros(F.col("ts")) / 1e6
    return read_table(spark, sf, "events").filter("event_type IN ('view', 'click')").select(
        (F.col("user_id") % 20).alias("run"), F.col("event_id").alias("step"), t.alias("t_end"), (t - F.col("value") / 100).alias("t_begin"),
        (F.col("event_id") % 32).alias("batch_size"), F.col("value").alias("audio_seconds"), (F.col("value") / 1013).alias("data_wait"),
        F.when(F.col("event_id") % 40 == 0, float("nan")).otherwise(F.col("value") / 10).alias("loss"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").filter("event_type IN ('error', 'purchase')").select(
        (F.col("user_id") % 20).alias("run"), "event_id", (utc_micros(F.col("ts")) / 1e6).alias("t"), F.col("value").alias("util"), (F.col("event_id") % 4000).alias("mem"), (F.col("value") * 2).alias("power"))


def machine(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").filter("event_type = 'signup'").select(
        (F.col("user_id") % 20).alias("run"), (utc_micros(F.col("ts")) / 1e6).alias("t"), (F.col("value") / 7).alias("cores"), (F.col("event_id") % 100).alias("mem_gb"))


LOGS = """st AS (SELECT user_id % 20 AS run, event_id AS step, epoch_us(ts) / 1e6 AS t_end, epoch_us(ts) / 1e6 - value / 100 AS t_begin, event_id % 32 AS batch_size, value AS audio_seconds,
      value / 1013 AS data_wait, CASE WHEN event_id % 40 = 0 THEN NULL ELSE value / 10 END AS loss FROM events WHERE event_type IN ('view', 'click')),
    gp AS (SELECT user_id % 20 AS run, event_id, epoch_us(ts) / 1e6 AS t, value AS util, event_id % 4000 AS mem, value * 2 AS power FROM events WHERE event_type IN ('error', 'purchase')),
    ma AS (SELECT user_id % 20 AS run, epoch_us(ts) / 1e6 AS t, value / 7 AS cores, event_id % 100 AS mem_gb FROM events WHERE event_type = 'signup'),
    w AS (SELECT run, min(t_end) AS a, max(t_end) AS b FROM (SELECT *, min(t_end) OVER (PARTITION BY run) + 90 AS f FROM st) WHERE t_end >= f GROUP BY run)"""


@query("j13_samples_in_window", f"WITH {LOGS} SELECT run, event_id, round(util, 6) AS util FROM gp JOIN w USING (run) WHERE t BETWEEN a AND b")
def j13_samples_in_window(spark, sf):
    return G.in_window(samples(spark, sf), G.steady_window(steps(spark, sf))).select("run", "event_id", F.round("util", 6).alias("util"))


NEAREST = "list_sort(list({0}))[round_even({1} * (count({0}) - 1), 0)::INT + 1]"


@query("a21_run_summary", f"""WITH {LOGS}, c AS (SELECT st.*, b - a AS d FROM st JOIN w USING (run) WHERE t_end > a AND t_end <= b),
    s AS (SELECT run, max(d) AS d, count(*) AS n, sum(batch_size) AS u, sum(audio_seconds) AS au, sum(data_wait) AS wt, avg(data_wait) AS mw, avg(t_end - t_begin) AS cp, {NEAREST.format('data_wait', 0.9)} AS p90 FROM c GROUP BY 1),
    g AS (SELECT run, avg(util) AS um, avg(power) AS pm, {NEAREST.format('util', 0.1)} AS u1, {NEAREST.format('util', 0.5)} AS u5, {NEAREST.format('util', 0.9)} AS u9 FROM gp JOIN w USING (run) WHERE t BETWEEN a AND b GROUP BY 1),
    m AS (SELECT run, max(mem) AS mm FROM gp GROUP BY 1), h AS (SELECT run, avg(cores) AS cm, max(mem_gb) AS sm FROM ma JOIN w USING (run) WHERE t BETWEEN a AND b GROUP BY 1),
    l AS (SELECT run, count(*) FILTER (loss IS NULL) AS bad FROM st GROUP BY 1), t AS (SELECT run, avg(loss) AS tl FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 100) GROUP BY 1)
    SELECT run, n AS steady_steps, round(n / d, 6) AS steps_per_s, round(u / d, 5) AS utts_per_s, round(mw, 5) AS mean_data_wait_s, round(cp, 4) AS mean_step_compute_s, round(wt / d, 6) AS data_wait_frac,
      round(p90, 4) AS p90_data_wait_s, round(um, 4) AS gpu_util_mean, u1 AS gpu_util_p10, u5 AS gpu_util_p50, u9 AS gpu_util_p90, mm::BIGINT AS gpu_mem_used_max_mib, sm::BIGINT AS sys_mem_used_gb_max, bad AS nonfinite_loss_steps, round(tl, 3) AS loss_last_mean
    FROM s LEFT JOIN g USING (run) LEFT JOIN m USING (run) LEFT JOIN h USING (run) LEFT JOIN l USING (run) LEFT JOIN t USING (run)""".replace(
        "round(n / d, 6) AS steps_per_s, round(u / d, 5) AS utts_per_s, round(mw, 5)", "round_even(n / d, 3) AS steps_per_s, round_even(u / d, 1) AS utts_per_s, round_even(mw, 4)").replace(
        "round(cp, 4)", "round_even(cp, 4)").replace("round(wt / d, 6)", "round_even(wt / d, 4)").replace("round(p90, 4)", "round_even(p90, 4)").replace("round(um, 4)", "round_even(um, 1)").replace("round(tl, 3)", "round_even(tl, 3)"))
def a21_run_summary(spark, sf):
    out = G.summarize_runs(steps(spark, sf), samples(spark, sf), machine(spark, sf))
    return out.select("run", "steady_steps", "steps_per_s", "utts_per_s", "mean_data_wait_s", "mean_step_compute_s", "data_wait_frac", "p90_data_wait_s", "gpu_util_mean",
                      "gpu_util_p10", "gpu_util_p50", "gpu_util_p90", "gpu_mem_used_max_mib", "sys_mem_used_gb_max", "nonfinite_loss_steps", "loss_last_mean")


TRUNC = "list_sort(list({0}))[least(count({0}) - 1, floor(count({0}) * {1})::INT) + 1]"


@query("a22_tail_statistics", f"""WITH {LOGS}, l AS (SELECT * FROM gp QUALIFY row_number() OVER (PARTITION BY run ORDER BY t DESC, event_id DESC) <= 60),
    x AS (SELECT run, unnest([{{metric: 'util', v: util}}, {{metric: 'mem', v: mem::DOUBLE}}], recursive := true) FROM l)
    SELECT run, metric, count(v) AS n, round(avg(v), 6) AS mean, {TRUNC.format('v', 0.1)} AS p10, {TRUNC.format('v', 0.5)} AS p50, {TRUNC.format('v', 0.9)} AS p90 FROM x GROUP BY ALL""")
def a22_tail_statistics(spark, sf):
    out = G.tail_statistics(samples(spark, sf), ["run"], "t", "event_id", ["util", "mem"], 60)
    return out.withColumn("mean", F.round("mean", 6))


@query("s18_gpu_lines", """WITH l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE (value)::VARCHAR END AS u, event_id % 13 = 0 AS short, ts, value FROM events)
    SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS t, value AS util, (event_id % 500)::DOUBLE AS mem, 1.5::DOUBLE AS power FROM l WHERE u <> 'N/A' AND NOT short""")
def s18_gpu_lines(spark, sf):
    use = F.when(F.col("event_id") % 11 == 0, "N/A").otherwise(F.col("value").cast("string"))
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")
    line = F.when(F.col("event_id") % 13 == 0, F.concat_ws(", ", stamp, use)).otherwise(
        F.concat_ws(", ", stamp, use, (F.col("event_id") % 500).cast("string"), F.lit("1.5")))
    parsed = G.parse_gpu_lines(read_table(spark, sf, "events").select("event_id", line.alias("value")))
    return parsed.select("event_id", F.round("t", 3).alias("t"), "util", "mem", "power")


@query("s19_run_header", """SELECT event_id, event_type AS kind, user_id::VARCHAR AS "user", props AS extra FROM events""")
def s19_run_header(spark, sf):
    text = F.concat(F.lit("run kind="), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" plain extra="), F.replace("props", F.lit(" "), F.lit("~")))
    m = read_table(spark, sf, "events").select("event_id", G.parse_header(text).alias("m"))
    return m.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["user"].alias("user"), F.replace(F.col("m")["extra"], F.lit("~"), F.lit(" ")).alias("extra"))


@query("s20_metric_rows", """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.02 THEN l_quantity END AS sps, l_tax AS a, CASE WHEN l_tax > 0.03 THEN l_discount END AS b FROM lineitem),
    x AS (SELECT l_orderkey, l_linenumber, sps, unnest([{name: 'a', "value": a}, {name: 'b', "value": b}], recursive := true) FROM r WHERE sps IS NOT NULL)
    SELECT name, count(*) AS n, round(sum("value"), 4) AS total, round(sum(sps), 4) AS sps FROM x WHERE "value" IS NOT NULL GROUP BY 1""")
def s20_metric_rows(spark, sf):
    r = read_table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("sps"), F.col("l_tax").alias("train_a"),
                                                 F.when(F.col("l_tax") > 0.03, F.col("l_discount")).alias("train_b"), F.lit(1.0).alias("train_skip"))
    return G.metric_rows(r, "sps", "train_", ["l_orderkey"], ["train_skip"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("sps"), 4).alias("sps"))


@query("a23_merged_timings", """WITH a AS (SELECT event_type AS section, 'cmd' || (user_id % 3) AS command, value AS seconds, event_id % 4 AS rc, user_id FROM events),
    u AS (SELECT section, command, seconds, 'laptop' AS w FROM a WHERE user_id % 3 = 0 UNION ALL
      SELECT section, CASE WHEN rc = 0 THEN command ELSE command || ' (exit ' || rc || ')' END, seconds, CASE WHEN user_id % 3 = 1 THEN 'box1' ELSE 'box2' END FROM a WHERE user_id % 3 > 0)
    SELECT section, command, w AS "where", count(*) AS n, round(sum(seconds) / 60, 6) AS minutes FROM u GROUP BY ALL""")
def a23_merged_timings(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("section"), F.concat(F.lit("cmd"), (F.col("user_id") % 3).cast("string")).alias("command"),
                                               F.col("value").alias("seconds"), (F.col("event_id") % 4).alias("rc"), "user_id")
    merged = G.merge_timings(e.filter("user_id % 3 = 0"), {"box1": e.filter("user_id % 3 = 1"), "box2": e.filter("user_id % 3 = 2")})
    return merged.groupBy("section", "command", "where").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds") / 60, 6).alias("minutes"))


@query("a24_cost_extrapolation", """WITH r AS (SELECT o_custkey % 5 AS host, o_orderkey AS run, o_totalprice / 100000 AS sps FROM orders WHERE o_totalprice > 0), h AS (SELECT n_nationkey AS host, 0.25 * (n_nationkey + 1) AS d FROM nation),
    x AS (SELECT r.*, d, unnest([100000, 300000]) AS target FROM r JOIN h USING (host))
    SELECT host, target AS target_iterations, count(*) AS runs, round(sum(target / sps / 3600), 3) AS hours, round(sum(target / sps / 3600 * d), 3)::DOUBLE AS dollars FROM x GROUP BY ALL""")
def a24_cost_extrapolation(spark, sf):
    runs = read_table(spark, sf, "orders").filter("o_totalprice > 0").select((F.col("o_custkey") % 5).alias("host"), F.col("o_orderkey").alias("run"), (F.col("o_totalprice") / 100000).alias("steps_per_s"))
    hosts = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("host"), (0.25 * (F.col("n_nationkey") + 1)).alias("dollars_per_hour"))
    each = G.extrapolate_cost(runs, hosts, (100_000, 300_000)).join(hosts, "host")
    hours = F.col("target_iterations") / F.col("steps_per_s") / 3600
    return each.groupBy("host", "target_iterations").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum(hours), 3).alias("hours"),
                                                        F.round(F.sum(hours * F.col("dollars_per_hour")), 3).alias("dollars"))


@query("a25_host_costs", """SELECT o_orderkey AS host, round_even((o_custkey * 3.0001::DOUBLE) / 60, 1) AS create_to_running_min, round_even(o_totalprice * 1.000007::DOUBLE / 3600, 2) AS billed_hours,
    round_even(o_totalprice * 1.000007::DOUBLE / 3600 * 0.5::DOUBLE, 2) AS cost_dollars FROM orders""")
def a25_host_costs(spark, sf):
    h = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("host"), F.lit(0.5).alias("dollars_per_hour"), F.lit(0).alias("created"), (F.col("o_custkey") * 3.0001).alias("running"), (F.col("o_totalprice") * 1.000007).alias("destroyed"))
    return G.host_costs(h).drop("dollars_per_hour")


@query("a29_generation_summary", """SELECT event_type AS speaker, count(*) AS utterances, round_even(sum(value), 1) AS audio_seconds, round_even(sum(value) / 3600, 3) AS audio_hours,
    round_even(sum(value) / 60, 2) AS audio_sec_per_wall_sec, round_even(avg(value), 2) AS mean_utt_seconds FROM events GROUP BY 1""")
def a29_generation_summary(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("speaker"), F.col("value").alias("audio_seconds"))
    return P.generation_summary(e, ["speaker"], F.lit(60.0))


@query("r3_throughput_windows", """SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS window_start, count(*) AS steps, round(count(*) / (21600 - sum(value) / 1000), 9) AS steps_per_s,
    round(sum(event_id % 32) / (21600 - sum(value) / 1000), 9) AS samples_per_s, round(sum(value) / 100 / (21600 - sum(value) / 1000), 9) AS data_wait_share FROM events GROUP BY 1""")
def r3_throughput_windows(spark, sf):
    e = read_table(spark, sf, "events").select("ts", (F.col("event_id") % 32).alias("samples"), (F.col("value") / 100).alias("wait"), (F.col("value") / 1000).alias("excluded"))
    return rounded(G.throughput_windows(e, "6 hours"), 9)
