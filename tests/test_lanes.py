import random

from helixframe.operators.annotation import lanes


def plain(rows):
    """The first lane whose last interval ends at or before the start, interval by interval."""
    out = []
    for by in {r[0] for r in rows}:
        ends = []
        for _, name, start, end in sorted((r for r in rows if r[0] == by), key=lambda r: (r[2], r[1])):
            lane = next((k for k, e in enumerate(ends) if e <= start), len(ends))
            ends[lane:] = [end, *ends[lane + 1 :]]
            out.append((by, name, start, end, lane))
    return sorted(out, key=str)


def test_lanes_against_plain_loops_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, s := rng.randint(0, 300), s + rng.randint(0, 60)) for k in range(900)]
    rows += [(9, 1, 0, 5), (9, 2, 5, 9), (9, 3, 5, 7), (9, 4, 5, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    got = lanes(spark.createDataFrame(rows, "seq long, name long, start long, end long"), "seq", "name").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    odd = spark.createDataFrame([(1, 1, None, 5), (1, 2, 3, None), (1, 3, 2, 4)], "seq long, name long, start long, end long")
    assert sorted((r["name"], r["lane"]) for r in lanes(odd, "seq", "name").collect() if r["lane"] is not None) == [(3, 0)]
    assert lanes(odd.limit(0), "seq", "name").count() == 0
