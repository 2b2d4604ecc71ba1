import random
import time
from datetime import datetime, timedelta

import pytest

from tessella.operators import tasks
from tessella.streaming import live

START = datetime(2024, 1, 1, 10, 0)


def limiter(events, most, window, lock):
    """The windows that locked a key, one failure after the other."""
    out = []
    for key in sorted({k for k, _ in events}):
        entry = None
        for t in sorted(t for k, t in events if k == key):
            if entry and (entry[2] is None or t >= entry[2]) and t - entry[0] >= window:
                if entry[2]:
                    out.append((key, *entry))
                entry = None
            entry = entry or [t, 0, None]
            entry[1] += 1
            if entry[1] >= most:
                entry[2] = t + lock
        if entry and entry[2]:
            out.append((key, *entry))
    return sorted(out)


def got(df):
    return sorted((r.key, r.window_start, r.failures, r.locked_until) for r in df.collect())


@pytest.fixture(scope="module")
def failures():
    rng = random.Random(5)
    out = [("edge", START + timedelta(minutes=14, seconds=20 * k)) for k in range(5)]  # five failures around a quarter hour
    out += [("slow", START + timedelta(minutes=4 * k)) for k in range(5)]  # never five within fifteen minutes
    for k in range(12):
        t = START
        for _ in range(rng.randint(1, 40)):
            t += timedelta(seconds=rng.choice([0, 5, 60, 200, 700, 1000, 4000]))
            out.append((f"k{k}", t))
    return out


def test_lockouts_fold(spark, failures):
    df = spark.createDataFrame([*failures, (None, START), ("edge", None)], "key string, ts timestamp")
    minute = timedelta(minutes=1)
    want = limiter(failures, 5, 15 * minute, 15 * minute)
    assert got(tasks.lockouts(df)) == want
    assert [w[0] for w in want if w[0] in ("edge", "slow")] == ["edge"]
    assert got(tasks.lockouts(df, 3, 10, 2)) == limiter(failures, 3, 10 * minute, 2 * minute)
    assert got(tasks.lockouts(df.limit(0))) == []


def test_stream_with_timers_gives_the_rows_of_the_fold(spark, failures, tmp_path):
    schema = "key string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    except Exception:  # the folder has to be there
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ordered = sorted(failures, key=lambda r: r[1])
    parts = [ordered[: len(ordered) // 2], ordered[len(ordered) // 2 :], [("end", START + timedelta(days=30))], [("end", START + timedelta(days=31))]]
    for k, p in enumerate(parts):
        random.Random(k).shuffle(p)
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    q = live.lockouts(stream).writeStream.format("memory").queryName("locked").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    minute = timedelta(minutes=1)
    assert got(spark.table("locked")) == limiter(failures, 5, 15 * minute, 15 * minute)


def below(parents, roots):
    out = set()
    for task in parents:
        seen, at = set(), parents[task]
        while at is not None and at not in seen:
            if at in roots and at != task:
                out.add((at, task))
            seen.add(at)
            at = parents.get(at)
    return out


def test_descendants_at_any_depth_and_on_cycles(spark):
    rng = random.Random(2)
    parents = {k: k - 1 if k else None for k in range(1000)}  # a chain of 1000
    parents |= {2000 + k: 2000 + (k + 1) % 7 for k in range(7)}  # a cycle, and a tail that hangs on it
    parents |= {3000: 2003, 3001: 3000, 4000: 99999, 5000: 5000}
    parents |= {6000 + k: 6000 + rng.randrange(k) if k else None for k in range(300)}
    roots = {0, 500, 2001, 6000, 6007, 5000, 99999, 777777}
    t = spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    found = tasks.descendants(t, spark.createDataFrame([(r,) for r in [*roots, 0]], "root long")).collect()
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == below(parents, roots)
