import math
import random
from collections import Counter

import pytest

from helixframe.operators.workflow import findings, run_tasks
from helixframe.plans.reports import TASKS, species_task
from pyspark.sql import functions as F

SEQS = [(0, "ATGAAATAG" + "ACGTTGCA" * 30), (1, ""), (2, None), (50, "ATGAAATAG" + "ACGTTGCA" * 30 + "A"), (None, "GGGGGG"), (3, "ATG" + "AAA" * 30 + "TAG")]


def test_all_tasks_over_odd_sequences(spark):
    found, log = run_tasks(spark.createDataFrame(SEQS, "doc_id long, seq string"), TASKS, list(TASKS))
    rows = found.collect()
    assert [(r["task"], r["state"], r["error"]) for r in log.collect()] == [(t, "done", None) for t in TASKS]
    assert {r["task"]: r["findings"] for r in log.collect()} == {**dict.fromkeys(TASKS, 0), **Counter(r["task"] for r in rows)}
    assert {r["task"]: r["numbers"] for r in log.collect()} == {**dict.fromkeys(TASKS, 0), **Counter(r["task"] for r in rows if r["number"] is not None)}
    value = {(r["doc_id"], r["task"], r["finding"]): r["number"] if r["text"] is None else r["text"] for r in rows}
    assert value[0, "quality", "length"] == 249 and value[None, "quality", "homopolymer"] == 6 and value[50, "species", "reference"] == 0 and value[0, "species", "reference"] == 50
    share = Counter(SEQS[0][1])
    assert value[0, "statistics", "shannon"] == pytest.approx(-sum(n / 249 * math.log2(n / 249) for n in share.values()), abs=1e-6)
    assert value[0, "statistics", "simpson"] == pytest.approx(1 - sum((n / 249) ** 2 for n in share.values()), abs=1e-6)
    assert value[1, "proteomics", "residues"] == 0 and value[1, "rna", "pairs"] == 0 and (0, "annotation", "orfs") not in value
    assert value[3, "annotation", "orfs"] == 1 and value[3, "annotation", "longest_orf"] == 96


def test_a_failing_task_leaves_the_others(spark):
    def breaks_when_run(df):
        return findings(df, {"x": F.raise_error(F.lit("broken\nmore")).cast("double")})

    @F.pandas_udf("double")
    def bad(s):
        raise KeyError("in a worker")

    tasks = {"run": breaks_when_run, "plan": lambda df: df.select("no such column"), "worker": lambda df: findings(df, {"x": bad("seq")}), "code": lambda df: 1 / 0, "good": lambda df: findings(df, {"n": F.length("seq")})}
    found, log = run_tasks(spark.createDataFrame(SEQS, "doc_id long, seq string"), tasks, list(tasks))
    assert [(r["task"], r["state"]) for r in log.collect()] == [("run", "failed"), ("plan", "failed"), ("worker", "failed"), ("code", "failed"), ("good", "done")]
    assert all(r["error"] and "\n" not in r["error"] for r in log.where("state = 'failed'").collect()) and log.where("error LIKE '%broken%'").count() == 1 and log.where("error LIKE '%in a worker%'").count() == 1
    assert found.count() == 6 and {r["task"] for r in found.collect()} == {"good"}
    with pytest.raises(ValueError):
        run_tasks(spark.createDataFrame(SEQS, "doc_id long, seq string"), tasks, ["no such"])
    found, log = run_tasks(spark.createDataFrame([], "doc_id long, seq string"), tasks, ["good"])
    assert found.count() == 0 and [tuple(r) for r in log.collect()] == [("good", "done", 0, 0, None)]


def test_the_species_task_takes_every_document(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ACGT", k=200)) for _ in range(3)]
    rows = [(7, texts[0]), (8, texts[0][:150] + texts[1][:50]), (9, texts[1]), (50, texts[0][50:]), (51, texts[2]), (52, "ACGT"), (53, None)]
    sets = {i: {s[n : n + 11] for n in range(len(s) - 10)} for i, s in rows if s}
    wanted = {}
    for i, own in sets.items():
        near = [(-100 * len(own & other) / len(own | other), j) for j, other in sets.items() if j != i and own & other]
        if near:
            wanted[i] = (min(near)[1], pytest.approx(-min(near)[0], abs=1e-6))
    found = species_task(spark.createDataFrame(rows, "doc_id long, seq string")).collect()
    got = {i: tuple(next(r["number"] for r in found if r["doc_id"] == i and r["finding"] == n) for n in ("reference", "similarity")) for i in {r["doc_id"] for r in found}}
    assert got == wanted and set(got) == {7, 8, 9, 50}
