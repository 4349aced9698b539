import datetime
import random

import pytest
from pyspark.sql import functions as F

from tamis.streaming import supervisor

START = datetime.datetime(2024, 1, 1)
KINDS = "run long, ts timestamp, finished boolean"


def made(seed, n=60, runs=4):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        out.append((pick.randint(1, runs), pick.choice([0, 3, 50, 200, 201, 900, 2000]) + pick.randint(0, 6000), pick.random() < 0.2))
    return out + out[:3]  # repeated rows


def by_seconds(rows, end, stale, cooldown):
    """Second by second, as a loop that looks at each run would."""
    out = []
    for run in {r for r, _, _ in rows}:
        beats = {}
        for _, t, f in sorted(x for x in rows if x[0] == run):
            beats[t] = beats.get(t, False) or f
        last, launched, n = None, None, 0
        for now in range(end + 1):
            if now in beats:
                last, n = now, 0
            elif last is not None and not beats[last] and now - last >= stale and (launched is None or now - launched >= cooldown):
                launched, n = now, n + 1
                out.append((run, now, last, n))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(r, START + datetime.timedelta(seconds=t), f) for r, t, f in rows], KINDS)


def seconds(df):
    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    return sorted((r.run, (r.at_ms - base) // 1000, (r.last_ms - base) // 1000, r.nth) for r in df.collect())


@pytest.mark.parametrize("stale, cooldown", [(600, 180), (100, 700), (50, 50)])
def test_table_equals_a_loop_over_seconds(spark, stale, cooldown):
    rows = made(stale)
    until = str(START + datetime.timedelta(seconds=7000))
    nulls = frame(spark, [(1, 5, None)]).select("run", F.lit(None).cast("timestamp").alias("ts"), "finished")
    got = supervisor.launches(frame(spark, rows).unionByName(nulls), until, stale, cooldown)
    assert seconds(got) == by_seconds(rows, 7000, stale, cooldown)
    assert supervisor.launches(frame(spark, rows).limit(0), until, stale, cooldown).count() == 0


def test_stream_equals_table(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(made(5, 40), key=lambda x: x[1])
        parts = [rows[i : i + 15] for i in range(0, len(rows), 15)]
        parts[0], late = parts[0][:-1], parts[0][-1]
        parts[1].append(late)  # a heartbeat that comes a file late, within the watermark's delay
        parts += [[(99, 12000, True)], [(99, 12001, True)]]
        for i, part in enumerate(parts):
            frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = supervisor.launch_stream(stream, 300, 500, late="4000 seconds")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = seconds(spark.read.parquet(str(tmp_path / "out")))
        want = by_seconds(rows, 8001, 300, 500)  # the watermark ends at 12001 - 4000
        assert got == want and len(want) > 5
    finally:
        spark.conf.unset(key)
