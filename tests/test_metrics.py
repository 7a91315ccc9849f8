"""Counters and sketches against plain loops."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jalur.operators.metrics import added, increase, quantiles, sketch

START = datetime(2024, 1, 1)


def test_increase(spark):
    rng = random.Random(1)
    rows, at = [], START
    for k in range(400):
        at += timedelta(minutes=rng.choice([0, 1, 7, 200]))
        rows.append((k, rng.choice(["a", "b", None]), at if k % 37 else None, rng.choice([None, 0.0, float(rng.randrange(50))]) if k % 5 else float(k)))
    df = spark.createDataFrame(rows, "id int, s string, at timestamp, v double")
    want, last = {}, {}
    for k, s, t, v in sorted((r for r in rows if r[2] and r[3] is not None), key=lambda r: (r[2], r[0])):
        key = s, t.replace(minute=0, second=0)
        want.setdefault(key, 0.0)
        if s in last:
            want[key] += v - last[s] if v >= last[s] else v
        last[s] = v
    got = {(r.s, r.window_start): r.increase for r in increase(df.repartition(5), ["s"], "at", "v", "id").collect()}
    assert got == want
    assert increase(df.limit(0), ["s"], "at", "v", "id").collect() == []


def test_sketches_add_up(spark):
    rng = random.Random(2)
    values = [None, 0.0, 0.0, -3.5, float("nan"), 1e-9, 1e12, *(math.exp(rng.gauss(0, 3)) * rng.choice([1, 1, -1]) for _ in range(900))]
    rows = [(k % 7, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "w int, v double")
    whole, parts = sketch(df, "v"), sketch(df, "v", ["w"])
    assert sorted(added(parts).collect()) == sorted(whole.collect())
    kept = sorted(v for v in values if v is not None and v == v)
    qs = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    for r in quantiles(added(parts), qs).collect():
        exact = kept[max(math.ceil(r.q * len(kept)), 1) - 1]
        assert abs(r.value - exact) <= 0.0100001 * abs(exact)
    assert quantiles(parts, [0.5], ["w"]).count() == 7 and quantiles(whole.limit(0), qs).count() == 0
    assert sketch(df.where(F.lit(False)), "v").count() == 0
