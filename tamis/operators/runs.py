"""Runs: status, recent events, rate windows, pairing of artifacts, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_status(events: DataFrame, now: str, done: str, failed: str, stale_minutes: int = 10) -> DataFrame:
    """events (run, ts, state, tokens, event_id): one row per run with counts, last heartbeat and health at
    ``now``. done and failed: the states that mean so. A run without any time is unknown."""
    out = events.groupBy("run").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("state") == failed).alias("n_failed"), F.count_if(F.col("state") == done).alias("n_done"),
        F.max("ts").alias("last_ts"), F.max_by("state", F.struct("ts", "event_id")).alias("last_state"),
    )
    age = F.timestamp_diff("SECOND", F.col("last_ts"), F.lit(now).cast("timestamp_ntz")).cast("long")
    out = out.withColumn("age_seconds", age)
    status = F.when(F.col("last_state") == done, "completed").when(F.col("age_seconds").isNull(), "unknown").when(F.col("age_seconds") > 60 * stale_minutes, "stale").otherwise("running_or_recent")
    return out.withColumn("status", status).withColumn("can_resume", (F.col("status") == "stale") & (F.col("n_failed") > 0))


HEALTH = {"completed": "completed", "unknown": "no_runtime_signal", "stale": "possibly_interrupted", "running_or_recent": "recent_heartbeat"}


def call_status(runs: DataFrame, stale_minutes: int = 10) -> DataFrame:
    """Adds status, health and percent to runs (total_calls, completed_calls, age_seconds: null without a heartbeat)."""
    total, done, age = F.col("total_calls"), F.col("completed_calls"), F.col("age_seconds")
    status = F.when((total > 0) & (done >= total), "completed").when(age.isNull(), "unknown").when(age > 60 * stale_minutes, "stale").otherwise("running_or_recent")
    health = F.create_map(*[F.lit(x) for kv in HEALTH.items() for x in kv])
    percent = F.when(total > 0, F.bround(done / total * 100, 1)).otherwise(0.0)
    return runs.withColumn("status", status).withColumn("health", F.element_at(health, F.col("status"))).withColumn("percent", percent)


def should_resume(runs: DataFrame, stale_seconds: int = 600, cooldown_seconds: int = 180) -> DataFrame:
    """Adds resume to runs: only where all holds: auto_resume is on, the status is stale, can_resume, the
    heartbeat is known and old enough, no child and no other resume runs, the last launch is long
    enough ago, and not all is known to be done."""
    left = F.col("completed_calls").isNull() | F.col("total_calls").isNull() | (F.col("completed_calls") < F.col("total_calls"))
    ok = F.col("auto_resume") & (F.col("status") == "stale") & F.col("can_resume") & F.col("age_seconds").isNotNull() & (F.col("age_seconds") >= stale_seconds) & ~F.col("child_running") & ~F.col("resume_running") & (F.col("since_launch") >= cooldown_seconds) & left
    return runs.withColumn("resume", F.coalesce(ok, F.lit(False)))


def newest_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (run, pairing, at): of checkpoints and logs (run, at) the newest run that has both, else the
    newest that has one, else MISSING."""
    both = pairing(left, right)
    best = both.agg(F.max_by(F.struct("run", "pairing", F.col("newest").alias("at")), F.struct(F.col("pairing") == "PAIRED", "newest", "run")).alias("b"))
    return best.select("b.run", F.coalesce("b.pairing", F.lit("MISSING")).alias("pairing"), "b.at")


def recent(events: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` events of each run, with their place from the end."""
    w = Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def rate_window(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Requests and tokens of the run in the window that ends at each event, both ends included."""
    # A range of whole seconds would lose fractions; the frame is in microseconds.
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("run").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("requests", F.count("*").over(w)).withColumn("tokens_sum", F.sum("tokens").over(w))


def sessions(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Heartbeat sessions of each run: they end where the next event is more than the gap away."""
    w = Window.partitionBy("run").orderBy("ts", "event_id")
    new = F.coalesce(F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) > gap_seconds, F.lit(True))
    return (
        events.withColumn("session", F.sum(F.when(new, 1).otherwise(0)).over(Window.partitionBy("run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
        .groupBy("run", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    )


def pairing(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (run, at), right (run, at): PAIRED or UNPAIRED with the newer time, by run."""
    both = left.select("run", F.col("at").alias("a")).join(right.select("run", F.col("at").alias("b")), "run", "full")
    return both.select("run", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "PAIRED").otherwise("UNPAIRED").alias("pairing"), F.greatest("a", "b").alias("newest"))


def stratified_sample(df: DataFrame, stratum: str, key: str, rate: float | dict[str, float], least: int, seed: str, rounding=F.ceil) -> DataFrame:
    """Per stratum min(N, max(least, rounding(N * rate))) rows: those of least md5(seed|key). The same rows
    at every run. rate: one for all, or by stratum (others then have none but ``least``).

    Strata are counted; rows whose md5, as a number, is beyond a limit that leaves some more than are
    wanted are dropped before the ranking, and a stratum in which too few are left (never by more than
    chance) is ranked whole. So what is sorted is about the sample."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))
    share = F.lit(float(rate)) if not isinstance(rate, dict) else F.coalesce(*[F.when(F.col(stratum) == k, F.lit(float(v))) for k, v in rate.items()], F.lit(0.0))
    n = df.groupBy(stratum).agg(F.count("*").alias("_all"))
    take = F.least(F.col("_all"), F.greatest(F.lit(least).cast("long"), rounding(F.col("_all") * share).cast("long")))
    want = n.withColumn("_n", take).withColumn("_cut", F.least(F.lit(1.0), (F.col("_n") + 10 * F.sqrt("_n") + 20) / F.col("_all")))
    place = F.conv(F.left(order, F.lit(12)), 16, 10).cast("double") / float(1 << 48)
    here = F.col(stratum).eqNullSafe(F.col("_s"))
    rows = df.withColumn("_o", order).withColumn("_p", place)
    low = rows.join(want.withColumnRenamed(stratum, "_s"), here).filter("_p < _cut")
    few = low.groupBy("_s", "_n").agg(F.count("*").alias("_k")).filter("_k < _n").select("_s", "_n")
    again = rows.join(few, here)
    columns = [*df.columns, "_o", "_n"]
    kept = low.join(few.select(F.col("_s").alias("_f")), F.col("_s").eqNullSafe(F.col("_f")), "left_anti").select(*columns).unionByName(again.select(*columns))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_o", key))).filter("_r <= _n").drop("_o", "_n", "_r")


def review_sample(df: DataFrame, key: str, seed: str) -> DataFrame:
    """For a second look: a tenth of the inclusions, a twentieth of the exclusions, one of each at least."""
    return stratified_sample(df.filter(F.col("decision").isin("INCLUDE", "EXCLUDE")), "decision", key, {"INCLUDE": 0.1, "EXCLUDE": 0.05}, 1, seed, F.floor)
