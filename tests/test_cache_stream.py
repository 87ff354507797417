"""The cache as a stream against the batch queries, over any arrival order, and going on from its checkpoint."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from landcube.streaming import cache

START = datetime(2024, 1, 1)


def put(spark, folder, rows):
    made = [(k, i, START + timedelta(hours=h), kind) for k, i, h, kind in rows]
    spark.createDataFrame(made, cache.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def plain(rows, days, end):
    """Answers by trying every entry for every request; ``end``: the hour that event time has come to."""
    us = lambda h: (datetime(2024, 1, 1) - datetime(1970, 1, 1)) // timedelta(microseconds=1) + round(h * 3_600_000_000)
    entries = [(h, i, k) for k, i, h, kind in rows if kind == cache.ENTRY]
    out = []
    for k, i, h, kind in rows:
        if kind == cache.REQUEST:
            live = max(((t, e) for t, e, key in entries if key == k and t <= h < t + 24 * days), default=None)
            out.append((cache.HIT if live else cache.MISS, k, i, us(h), live[1] if live else None))
    out += [(cache.EXPIRED, k, i, us(h + 24 * days), i) for h, i, k in entries if h + 24 * days <= end]
    return sorted(out, key=str)


def events(seed, n=120):
    rng = random.Random(seed)
    return [(rng.randrange(5), i, rng.randrange(0, 20 * 24 * 4) / 4, rng.choice([cache.ENTRY, cache.REQUEST, cache.REQUEST])) for i in range(n)]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


CLOSE = [(-1, -1, 1000.0, cache.TICK), (-1, -2, 1001.0, cache.TICK)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rows = events(seed)
    folder = str(tmp_path / "in")
    shuffled = random.Random(seed).sample(rows, len(rows))
    for k in range(0, len(rows), 30):
        put(spark, folder, shuffled[k : k + 30])
    put(spark, folder, CLOSE[:1])
    got = found(cache.stream_cache(spark, folder, 3, late="60 days"))
    assert got == []  # nothing is due before the watermark has passed it
    put(spark, folder, [(-1, -3, 4000.0, cache.TICK)])
    assert found(cache.stream_cache(spark, folder, 3, late="60 days")) == plain(rows, 3, 4000 - 60 * 24)


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = sorted(events(3), key=lambda r: r[2])
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    put(spark, folder, rows[:60])
    first = found(cache.stream_cache(spark, folder, 3, state, out))
    assert 0 < len(first)
    put(spark, folder, rows[60:])
    cache.stream_cache(spark, folder, 3, state, out)
    put(spark, folder, CLOSE)
    whole = found(cache.stream_cache(spark, folder, 3, state, out))
    assert whole == plain(rows, 3, 1000) and set(first) <= set(whole)
    assert found(cache.stream_cache(spark, folder, 3, state, out)) == whole  # nothing new


def test_equals_the_batch_queries(spark, tmp_path):
    """Requests asked at one time: hits and evictions are those of the batch operators at that time."""
    from pyspark.sql import functions as F

    from landcube.operators import store

    rows = [r for r in events(4, 200) if r[3] == cache.ENTRY]
    asked = [(k, 1000 + k, 480.0, cache.REQUEST) for k in range(5)]
    folder = str(tmp_path / "in")
    put(spark, folder, rows + asked + CLOSE)
    got = cache.stream_cache(spark, folder, 3)
    entries = spark.createDataFrame([(k, i, START + timedelta(hours=h)) for k, i, h, _ in rows], "key long, id long, created timestamp")
    requests = spark.createDataFrame([(k, i) for k, i, *_ in asked], "key long, event_id long")
    now = F.lit(START + timedelta(hours=480))
    hits = store.hits(requests, store.live(entries, now, 3)).select("key", "event_id", "entry")
    assert found(got.where("kind = 'hit'").select("key", "id", "entry")) == found(hits)
    due = (START + timedelta(hours=480)).timestamp() * 1e6
    assert found(got.where((F.col("kind") == "expired") & (F.col("us") <= due)).select("id", "key")) == found(store.expired(entries, now, 3).select("id", "key"))


def test_arrival_of_many_files(spark, tmp_path):
    """Files of one arrival that fall into several batches, in no order of time, lose no event."""
    from pathlib import Path

    from comparing import duck

    from landcube.plans.queries import cache_stream
    from landcube.plans.sql import SQL

    source = "/root/testdata/sf0.001"
    for p in Path(source).iterdir():
        if p.stem != "events":
            (tmp_path / p.name).symlink_to(p)
    spark.read.parquet(f"{source}/events.parquet").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    rows = duck(source).sql(SQL["cache_stream"]).fetchall()
    assert found(cache_stream(spark, str(tmp_path)).select("kind", "key", "id", "at", "entry")) == sorted(rows, key=str)


def test_a_file_a_batch(spark, tmp_path):
    """As many batches as files, in no order of time: the state's blocks are put together over all of them."""
    rows = events(5)
    folder = str(tmp_path / "in")
    for k in range(0, len(rows), 40):
        put(spark, folder, rows[k : k + 40])
    put(spark, folder, [(-1, -1, 480.0 + 20 * 24, cache.TICK)])
    put(spark, folder, [(-1, -2, 1000.0 + 20 * 24, cache.TICK)])
    assert found(cache.stream_cache(spark, folder, 3, late="20 days", most=1)) == plain(rows, 3, 1000)
