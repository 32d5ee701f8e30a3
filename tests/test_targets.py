from helixframe.functions.protein import residue_structure, structure, structure_letters
from helixframe.operators import targets as tg


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_profiles_are_rows_without_arrays_of_a_whole_batch(spark):
    df = spark.createDataFrame([(1, "KKKKKKKKKKKKKKKK"), (2, None), (3, ""), (4, "LLLLLLLLLLLLLLLLLLLLLLLL"), (5, "ACDE" * 10)], "doc_id long, seq string")
    for rows in (tg.epitopes(df), tg.hydrophilicity(df)):
        assert "MapInArrow" in plan(rows) and "Generate" not in plan(rows) and "ArrowEvalPython" not in plan(rows)
    windows = tg.epitopes(df).collect()
    assert {(r.doc_id, r.start) for r in windows} >= {(1, s) for s in range(8)} and not {r.doc_id for r in windows} & {2, 3, 4}
    assert [r.start for r in windows if r.doc_id == 1 and r.kept] == [0]
    assert [(r.doc_id, r.pos) for r in tg.hydrophilicity(df).where("doc_id < 4").collect()] == [(1, k) for k in range(16)]
    counted = {r[0]: r[1] for r in df.where("seq is not null").select("doc_id", tg.target_count("seq")).collect()}
    assert counted == {d: sum(r.doc_id == d and r.kept and r.exposed for r in windows) for d in (1, 3, 4, 5)}


def test_structure_is_worked_in_arrays(spark):
    df = spark.createDataFrame([("",), (None,), ("AAAVVVVVVGGGGG",), ("A?é",)], "s string")
    out = df.select(structure_letters("s").alias("t"), residue_structure(df.s).alias("k"))
    assert [(r.t, r.k and "".join(k[0] for k in r.k)) for r in out.collect()] == [("", []), (None, None), (structure("AAAVVVVVVGGGGG"),) * 2, ("HHH", "HHH")]
    assert "lambda" not in plan(df.select(structure_letters("s")))
