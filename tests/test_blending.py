import hashlib

import pytest
from pyspark.sql import functions as F

from tunedata.operators import blending as bl


def unit(seed, slot):
    return int(hashlib.md5(f"{seed}:{slot}".encode()).hexdigest()[:8], 16) / 2**32


def brute(sizes, probs, seed, stop):
    """Slot by slot, as a sequential reader would do it."""
    live = [i for i, n in enumerate(sizes) if n > 0]
    weight = sum(probs[i] for i in live)
    bounds, total = [], 0.0
    for i in live:
        total += probs[i] / weight
        bounds.append(total)
    read, done, out, slot = {i: 0 for i in live}, set(), [], 0
    while True:
        u = unit(seed, slot)
        pick = next((i for i, b in zip(live[:-1], bounds) if u < b), live[-1])
        out.append((slot, pick, read[pick] % sizes[pick]))
        read[pick] += 1
        if read[pick] >= sizes[pick]:
            done.add(pick)
        slot += 1
        if (stop == "first_exhausted" and done) or len(done) == len(live):
            return out


def sources(spark, sizes):
    return [spark.range(n).select((F.col("id") * 3 + 1).alias("k"), F.lit(i).alias("origin")) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
@pytest.mark.parametrize("sizes,probs", [([40, 25, 9], [0.5, 0.3, 0.2]), ([0, 1, 100], [0.2, 0.1, 0.7]), ([100, 100], [0.9, 0.1])])
def test_blend_equals_sequential_reading(spark, sizes, probs, stop):
    got = bl.blend(sources(spark, sizes), probs, order_col="k", seed=3, stop=stop).collect()
    assert sorted((r.slot, r.origin, (r.k - 1) // 3) for r in got) == brute(sizes, probs, 3, stop)
    assert {r.source for r in got} <= {"ft", "harmful", "system"}


def test_blend_slices_and_cap(spark):
    got = bl.blend(sources(spark, [50, 50]), [0.5, 0.5], order_col="k", start=[10, 0], max_count=20, cap=15).collect()
    assert sorted(r.slot for r in got) == list(range(15))
    assert min(r.k for r in got if r.origin == 0) == 31


def test_blend_of_nothing(spark):
    assert bl.blend(sources(spark, [0, 0]), [0.5, 0.5], order_col="k").count() == 0


def test_one_probability_per_source(spark):
    with pytest.raises(ValueError):
        bl.blend(sources(spark, [1, 1]), [1.0], order_col="k")


def test_spec():
    assert bl.parse_spec("a,b", "0.9,0.1", "5000,0").starts == [5000, 0]
    assert bl.parse_spec("a,b", "0.9,0.1", 7).starts == [7, 7]
    assert bl.parse_spec("a", "1", None).starts == [0]
    with pytest.raises(ValueError):
        bl.parse_spec("a,b", "0.9")


def test_eval_split_order(spark):
    train, test = spark.range(300), spark.range(3)
    assert bl.eval_split({"train": train, "test": test}, "x", "id", 100).count() == 3
    assert bl.eval_split({"train": train}, "my_eval_set", "id", 100).count() == 100
    assert bl.eval_split({"train": train}, "my_eval_set", "id", 1000).count() == 300
    assert [r.id for r in bl.eval_split({"train": train, "validation": test}, "x", "id", 2).orderBy("id").collect()] == [r.id for r in test.orderBy("id").limit(2).collect()]
    assert bl.train_split({"a": train, "b": test}).count() == 303
    assert sorted(r.id for r in bl.eval_split({"train": train}, "x", "id", 100).collect()) == [297, 298, 299]
