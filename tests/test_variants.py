import random
from itertools import groupby

from helixframe.operators import variants as va
from helixframe.operators.variants import blocks_of, mutation_blocks


def plain(ref, query):
    kind = lambda c: "equal" if c[0] == c[1] else "insertion" if c[0] == "-" else "deletion" if c[1] == "-" else "substitution"
    at, out = 0, []
    for k, run in groupby(zip(ref, query, strict=False), key=kind):
        run = list(run)
        r, q = ("".join(x).replace("-", "") for x in zip(*run, strict=True))
        if k != "equal":
            out.append((at, r, q, k))
        at += len(r)
    return out


def test_blocks_are_the_plain_runs():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 40)
        ref, query = ("".join(rng.choice("ACGT-é") for _ in range(n)) for _ in range(2))
        assert blocks_of(ref, query) == plain(ref, query)


def test_tables_without_a_shuffle(spark):
    rows = spark.createDataFrame([("x", "AC-GT", "ATTG-"), (None, "A", "C"), ("y", None, "A"), ("z", "", "")], "id string, ref_aligned string, query_aligned string")
    blocks = mutation_blocks(rows)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    got = sorted((tuple(r) for r in blocks.collect()), key=str)
    assert got == sorted([("x", 1, 2, "C", "T", "substitution", "2C>T"), ("x", 2, 2, "", "T", "insertion", "2_3insT"), ("x", 3, 4, "T", "", "deletion", "4delT"), (None, 0, 1, "A", "C", "substitution", "1A>C")], key=str)
    assert blocks.schema["id"].dataType.simpleString() == "string" and mutation_blocks(rows.limit(0)).count() == 0


def test_impacts_row_by_row_are_the_joined_ones(spark):
    rows = [(1, "ACGTAC-GTTTGA", "ACCTACAGT--GA"), (2, "TTTAAA", "TATAAA"), (3, None, "A"), (4, "--ACG", "GGA-G"), (5, "TGGAAACC", "TGAAAACG"), (6, "", "")]
    pairs = spark.createDataFrame(rows, "id long, ref_aligned string, query_aligned string")
    for frame in (0, 1, 3):
        made = va.mutation_impacts(pairs, frame)
        want = va.codon_impact(va.mutation_blocks(pairs), pairs.selectExpr("id", "replace(ref_aligned, '-', '') AS ref"), frame)
        assert made.columns == want.columns and sorted(made.collect(), key=str) == sorted(want.collect(), key=str)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
