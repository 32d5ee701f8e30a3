import random

from helixframe.operators.sketches import kmer_cardinality, kmer_sketches, merge_sketches


def exact(rows, k, keep):
    return len({s[i : i + k] for a, b, s in rows if s and keep(a, b) for i in range(len(s) - k + 1)})


def test_estimates_stay_within_four_standard_errors(spark):
    rng, k = random.Random(5), 9
    rows = [(rng.choice(["x", "y", None]), rng.choice("pqr"), "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 9, 3000])))) for _ in range(60)] + [("x", "p", None), ("z", "q", "ACGT")]
    df = spark.createDataFrame(rows, "a string, b string, seq string").repartition(7)
    parts = [kmer_sketches(df.where("b <> 'q'"), ["a", "b"], k), kmer_sketches(df.where("b = 'q'"), ["a", "b"], k), kmer_sketches(df.where("a = 'x'"), ["a", "b"], k)]
    sketches = merge_sketches(parts, ["a", "b"]).cache()
    got = {(r["a"], r["b"], r["level"]): r["kmers"] for r in kmer_cardinality(sketches, ["a", "b"], cube=True).collect()}
    groups = {(a, b) for a, b, _ in rows}
    want = {(a, b, 0): exact(rows, k, lambda x, y, a=a, b=b: (x, y) == (a, b)) for a, b in groups} | {(a, None, 1): exact(rows, k, lambda x, y, a=a: x == a) for a, _ in groups}
    want |= {(None, b, 2): exact(rows, k, lambda x, y, b=b: y == b) for _, b in groups} | {(None, None, 3): exact(rows, k, lambda x, y: True)}
    assert got.keys() == want.keys() and got["z", "q", 0] == 0
    assert all(abs(got[g] - n) <= 0.033 * n for g, n in want.items()) and want[None, None, 3] > 20_000
    rolled = {(r["a"], r["b"], r["level"]): r["kmers"] for r in kmer_cardinality(sketches, ["a", "b"]).collect()}
    assert rolled.keys() == {g for g in got if g[2] != 2}
    assert kmer_cardinality(kmer_sketches(df.where("false"), ["a"], k), ["a"]).count() <= 1
