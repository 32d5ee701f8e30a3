import random

from helixframe.operators.assembly import assemble_reads, best_overlap, contig_coverage
from helixframe.operators.families import assemble

TURN = str.maketrans("ACGT", "TGCA")


def reads_of(rng, length, n, size, errors=0.0):
    genome = "".join(rng.choice("ACGT") for _ in range(length))
    step = (length - size) // (n - 1)
    out = [genome[i * step : i * step + size] for i in range(n)]
    return genome, ["".join(rng.choice("ACGT") if rng.random() < errors else c for c in r) for r in out]


def test_best_overlap():
    assert best_overlap("AAACCCTTTGGG", "TTTGGGAAACCC", 5, 90) == 6 and best_overlap("AAAA", "CCCC", 1, 90) == 0
    assert best_overlap("AAACCCTTTGGGA", "TTTGGCAAA", 5, 80) == 7 and best_overlap("AAACCCTTTGGGA", "TTTGGCAAA", 5, 90) == 0 and best_overlap("", "A", 1, 0) == 0


def test_equal_to_the_greedy_rule_on_small_families(spark):
    rng, families = random.Random(5), {}
    for f in range(6):
        _, own = reads_of(rng, 400, 6, 110, 0.0 if f % 3 else 0.01)
        own = [r[::-1].translate(TURN) if f % 2 and i in (2, 5) else r for i, r in enumerate(own)]
        families[f] = [*own, "".join(rng.choice("ACGT") for _ in range(70))]
    families[20] = ["A" * 60, "C" * 60, "ACGT" * 10]
    families[21] = ["ACGTTGCAAGGTC" * 3]
    rows = [(f, i, s, "x") for f, own in families.items() for i, s in enumerate(own)] + [(20, 7, None, "x"), (20, 8, " ", "x"), (None, 1, "ACGTACGTACGTTTT", "x")]
    got = {}
    result = assemble_reads(spark.createDataFrame(rows, "family_id long, idx long, seq string, placed string"), 20, 90.0)
    for r in result.collect():
        got.setdefault(r["family_id"], []).append((r["contig_id"], r["contig"], sorted((p["idx"], p["start"], p["reversed"]) for p in r["placements"])))
    for f, own in families.items():
        want = [(k, c, sorted(placed)) for k, (c, placed) in enumerate(assemble(own, 20, 90.0))]
        assert sorted(got[f]) == want, f
    assert got[None] == [(0, "ACGTACGTACGTTTT", [(1, 0, False)])]
    depth = contig_coverage(result).where("family_id = 21").collect()
    assert [tuple(r)[2:] for r in depth] == [(0, 39, 1)]


def test_a_long_chain_of_reads(spark):
    """120 reads of one sample, some turned, in any order: the genome, and every read in its place."""
    rng = random.Random(6)
    genome, own = reads_of(rng, 4_800, 120, 120)
    rows = [(1, i, r) for i, r in enumerate(own)]
    rng.shuffle(rows)
    contig = assemble_reads(spark.createDataFrame(rows, "family_id long, idx long, seq string"), 30, 95.0).collect()
    assert len(contig) == 1 and contig[0]["n_reads"] == 120
    end = contig[0]["placements"][-1]["end"]
    assert contig[0]["contig"] == genome[:end] and all(genome[p["start"] : p["end"]] == own[p["idx"]] for p in contig[0]["placements"])
