import random
from datetime import datetime, timedelta, timezone

import pytest

from catalogspark.streaming import usage

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)


def brute(rows, limit, seconds):
    out, accepted = [], {}
    for key, at in sorted(rows):
        times = [a for a in accepted.get(key, []) if a >= at - timedelta(seconds=seconds)]
        ok = len(times) < limit
        accepted[key] = times + [at] * ok
        out.append((key, at, ok))
    return sorted(out)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, usage.STATE_STORE)
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(3))
def test_any_dealing_gives_the_same_answers(spark, rocks, tmp_path, seed):
    """The rows in any order over files and triggers, ties included; the late ones within the bound."""
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), BASE + timedelta(seconds=rng.randrange(200), milliseconds=rng.choice([0, 0, 250]), microseconds=rng.choice([0, 7]))) for _ in range(120)]
    rows += [("c", BASE + timedelta(seconds=s)) for s in (20, 70, 0, 10)]
    files = [[] for _ in range(1 + 2 * seed)]
    for r in rng.sample(rows, len(rows)):
        rng.choice(files).append(r)
    files = [f for f in files if f] + [[("end", BASE + timedelta(hours=2))]]
    for n, f in enumerate(files):
        spark.createDataFrame(f, "anon string, ts timestamp").repartition(1 + n % 3).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("anon string, ts timestamp").option("maxFilesPerTrigger", 1 + seed).parquet(f"{tmp_path}/in")
    name = f"limited_{seed}"
    q = usage.rate_limited(stream, 2, 60, "1 hour").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.anon, r.ts.astimezone(timezone.utc), r.allowed) for r in spark.table(name).collect())
    assert got == brute(rows, 2, 60)


def test_another_state_store_is_an_error(spark):
    with pytest.raises(ValueError):
        usage.rate_limited(spark.createDataFrame([], "anon string, ts timestamp"))
