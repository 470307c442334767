"""Run logs: GPU samples, steps and machine samples to one summary row per run; timings, hosts and costs."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_exact
from ..session import written
from .ordering import exact_quantiles, top_rows

WARMUP_SECONDS = 90.0


def parse_gpu_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``time, use, memory, power`` lines: malformed and N/A ones dropped, time as epoch seconds (UTC)."""
    parts = F.transform(F.split(line, ","), lambda p: F.trim(p))
    cells = lines.withColumn("_p", parts).filter((F.size("_p") == 4) & ~F.array_contains("_p", "N/A"))
    number = lambda i: F.col("_p")[i].cast("double")
    stamp = F.to_timestamp(F.concat(F.col("_p")[0], F.lit(" Z")), "yyyy/MM/dd HH:mm:ss.[SSSSSS][SSS] XXX")
    return cells.select(*[c for c in lines.columns if c != line], (F.unix_micros(stamp) / 1e6).alias("t"),
                        number(1).alias("util"), number(2).alias("mem"), number(3).alias("power"))


def parse_header(text: Column) -> Column:
    """``name key=value key=value`` as a map; words without ``=`` are left out."""
    words = F.filter(F.split(text, r"\s+"), lambda w, i: (i > 0) & w.contains("="))
    return F.map_from_entries(F.transform(words, lambda w: F.struct(F.element_at(F.split(w, "=", 2), 1), F.element_at(F.split(w, "=", 2), 2))))


def metric_rows(rows: DataFrame, required: str, prefix: str, keep: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Rows that carry the required value, their ``prefix`` columns unpivoted to (name, value) where present."""
    columns = [c for c in rows.columns if c.startswith(prefix) and c not in skip]
    pairs = F.array(*[F.struct(F.lit(c[len(prefix):]).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return rows.filter(F.col(required).isNotNull()).select(*keep, required, F.inline(pairs)).filter(F.col("value").isNotNull())


def steady_window(steps: DataFrame, warmup: float = WARMUP_SECONDS) -> DataFrame:
    """(run, t_start, t_end): from the first step end at least ``warmup`` after the run's first one to the last."""
    first = steps.groupBy("run").agg((F.min("t_end") + warmup).alias("_from"))
    return steps.select("run", "t_end").join(first, "run").filter(F.col("t_end") >= F.col("_from")).groupBy("run").agg(
        F.min("t_end").alias("t_start"), F.max("t_end").alias("t_stop"))


def in_window(samples: DataFrame, window: DataFrame, time: str = "t") -> DataFrame:
    """Samples inside their run's steady window: an equality on the run, the range is checked per row."""
    return samples.join(window, "run").filter(F.col(time).between(F.col("t_start"), F.col("t_stop"))).drop("t_start", "t_stop")


def summarize_runs(steps: DataFrame, gpu: DataFrame, machine: DataFrame, last: int = 100) -> DataFrame:
    """One row per run over its steady window: throughput, waits, GPU use, memory, first and last losses.

    The windows (a row a run) are written once; each log is then read once for all its sums and twice for its quantiles.
    """
    window = written(steady_window(steps), "steady-windows")
    span, finite = F.col("t_stop") - F.col("t_start"), ~F.isnan("loss") & (F.abs("loss") != float("inf"))
    inside = (F.col("t_end") > F.col("t_start")) & (F.col("t_end") <= F.col("t_stop"))
    steady = lambda c: F.when(inside, F.col(c) if isinstance(c, str) else c)
    sums = steps.join(window, "run", "left").groupBy("run").agg(
        F.max(steady(span)).alias("_d"), F.count_if(inside).alias("steady_steps"), F.sum(steady("batch_size")).alias("_utts"),
        F.sum(steady("audio_seconds")).alias("_audio"), F.sum(steady("data_wait")).alias("_wait"), F.avg(steady("data_wait")).alias("_mean_wait"),
        F.avg(steady(F.col("t_end") - F.col("t_begin"))).alias("_compute"), F.count_if(~finite).alias("nonfinite_loss_steps"),
        F.min_by("loss", F.col("step")).alias("loss_first")).filter("steady_steps > 0")
    d = F.col("_d")
    out = sums.select(
        "run", round_exact(d, 1).alias("steady_seconds"), "steady_steps", round_exact(F.col("steady_steps") / d, 3).alias("steps_per_s"),
        round_exact(F.col("_utts") / d, 1).alias("utts_per_s"), round_exact(F.col("_audio") / d, 1).alias("audio_sec_per_s"),
        round_exact("_compute", 4).alias("mean_step_compute_s"), round_exact("_mean_wait", 4).alias("mean_data_wait_s"),
        round_exact(F.col("_wait") / d, 4).alias("data_wait_frac"), "nonfinite_loss_steps", "loss_first")
    waits = exact_quantiles(steps.join(window, "run").filter(inside), ["run"], "data_wait", {"p90_data_wait_s": 0.9}, rule="nearest").select(
        "run", round_exact("p90_data_wait_s", 4).alias("p90_data_wait_s"))
    within = F.col("t").between(F.col("t_start"), F.col("t_stop"))
    use = gpu.join(window, "run", "left").groupBy("run").agg(
        round_exact(F.avg(F.when(within, F.col("util"))), 1).alias("gpu_util_mean"), round_exact(F.avg(F.when(within, F.col("power"))), 1).alias("gpu_power_mean_w"),
        F.max("mem").alias("gpu_mem_used_max_mib"))
    use_q = exact_quantiles(in_window(gpu, window), ["run"], "util", {"gpu_util_p10": 0.1, "gpu_util_p50": 0.5, "gpu_util_p90": 0.9}, rule="nearest")
    host = in_window(machine, window).groupBy("run").agg(
        round_exact(F.avg("cores"), 2).alias("container_cores_used_mean"), F.max("mem_gb").alias("sys_mem_used_gb_max"))
    tail = top_rows(steps, ["run"], [F.desc("step")], last, F.col("step")).groupBy("run").agg(
        round_exact(F.avg(F.when(finite, F.col("loss"))), 3).alias("loss_last_mean"))
    for part in (waits, use, use_q, host, tail):
        out = out.join(part, "run", "left")
    return out


def tail_statistics(samples: DataFrame, keys: Sequence[str], time: str, tie: str, values: Sequence[str], rows: int) -> DataFrame:
    """Mean and truncated-index p10, p50, p90 of each value over the last rows of a log."""
    last = top_rows(samples, list(keys), [F.desc(time), F.desc(tie)], rows, F.col(tie))
    long = last.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])))
    means = long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return means.join(exact_quantiles(long, [*keys, "metric"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, rule="truncated"), [*keys, "metric"])


def merge_timings(local: DataFrame, hosts: dict[str, DataFrame], local_name: str = "laptop") -> DataFrame:
    """(section, command, seconds, where): a step that failed keeps its exit code in the command name."""
    named = F.when(F.col("rc") == 0, F.col("command")).otherwise(F.concat("command", F.lit(" (exit "), F.col("rc").cast("string"), F.lit(")")))
    first = local.select("section", "command", "seconds", F.lit(local_name).alias("where"))
    rest = [df.select("section", named.alias("command"), "seconds", F.lit(name).alias("where")) for name, df in hosts.items()]
    return reduce(lambda a, b: a.unionByName(b), rest, first)


def section_minutes(timings: DataFrame) -> DataFrame:
    return timings.groupBy("section").agg((F.sum("seconds") / 60).alias("minutes"))


def extrapolate_cost(runs: DataFrame, hosts: DataFrame, targets: Sequence[int]) -> DataFrame:
    """Hours and money to reach each step target, for one and two attempts."""
    each = runs.join(hosts.select("host", "dollars_per_hour"), "host").withColumn(
        "target_iterations", F.explode(F.array(*[F.lit(int(t)) for t in targets])))
    hours = F.col("target_iterations") / F.col("steps_per_s") / 3600
    money = hours * F.col("dollars_per_hour")
    return each.select("host", "run", "steps_per_s", "target_iterations", round_exact(hours, 1).alias("hours"), round_exact(money, 2).alias("dollars"),
                       round_exact(2 * hours, 1).alias("hours_2_attempts"), round_exact(2 * money, 2).alias("dollars_2_attempts"))


def host_costs(hosts: DataFrame) -> DataFrame:
    """Start-up minutes, billed hours and cost from creation, running and removal times (epoch seconds)."""
    hours = (F.col("destroyed") - F.col("created")) / 3600
    return hosts.select("host", "dollars_per_hour", round_exact((F.col("running") - F.col("created")) / 60, 1).alias("create_to_running_min"),
                        round_exact(hours, 2).alias("billed_hours"), round_exact(hours * F.col("dollars_per_hour"), 2).alias("cost_dollars"))


def throughput_windows(steps: DataFrame, every: str, watermark: str | None = None) -> DataFrame:
    """Steps per second, samples per second and wait share per time window (excluded seconds removed).

    The same aggregation runs on a table and, with a watermark, on a stream.
    """
    timed = steps.withWatermark("ts", watermark) if watermark else steps
    sums = timed.groupBy(F.window("ts", every).alias("w")).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("samples").alias("samples"), F.sum("wait").alias("wait"), F.sum("excluded").alias("excluded"))
    seconds = F.expr("CAST(CAST(w.`end` - w.`start` AS INTERVAL SECOND) AS BIGINT)") - F.col("excluded")
    return sums.select(F.col("w.start").alias("window_start"), "steps", (F.col("steps") / seconds).alias("steps_per_s"),
                       (F.col("samples") / seconds).alias("samples_per_s"), (F.col("wait") / seconds).alias("data_wait_share"))
