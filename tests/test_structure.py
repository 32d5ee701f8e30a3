import math

from pyspark.sql import Row

from helixframe.functions.protein import structure
from helixframe.operators.structure import backbone
from helixframe.plans import reports


def plain(seq):
    kinds, rows, turn, z = structure(seq), [], 0, 0.0
    for i, (residue, kind) in enumerate(zip(seq, kinds, strict=True)):
        turn = turn + 1 if i and kinds[i - 1] == kind else 0
        z += {"H": 1.5, "S": 3.2, "C": 2.2}[kind]
        angle = math.radians(100.0 * turn)
        x, y = {"H": (2.3 * math.cos(angle), 2.3 * math.sin(angle)), "S": (1.6 if i % 2 == 0 else -1.6, 0.0), "C": (2.5 * math.sin(0.5 * i), 2.0 * math.cos(0.7 * i))}[kind]
        rows.append((i, residue, {"H": "helix", "S": "sheet", "C": "coil"}[kind], x, y, z))
    return rows


def test_backbone_is_made_row_by_row(spark):
    seqs = ["MKTAYIAKQRQISFVKSHFSRQ" * 8, None, "", "G", "AAAALLLLVVVVGGGGPPPP", "VVVVIIIIYYYYEEEEMMMM"]
    proteins = spark.createDataFrame([Row(doc_id=i, seq=s) for i, s in enumerate(seqs)], "doc_id long, seq string")
    for most in (150, None, 3):
        made = backbone(proteins, most)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
        got = sorted(made.collect())
        wanted = [(i, *r) for i, s in enumerate(seqs) for r in plain((s or "")[:most])]
        assert [r[:4] for r in got] == [w[:4] for w in wanted]
        assert all(abs(a - b) < 2e-6 for r, w in zip(got, wanted, strict=True) for a, b in zip(r[4:], w[4:], strict=True))


def test_backbone_query_draws_every_residue(spark, tmp_path):
    text = "Mktayiakqrqisfvkshfsrq, " * 40
    spark.createDataFrame([Row(doc_id=1, text=text, lang="en")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(reports.protein_backbone(spark, str(tmp_path)).collect())
    wanted = plain("MKTAYIAKQRQISFVKSHFSRQ" * 40)
    assert [r[1:4] for r in got] == [(i, residue, {"H": "helix", "S": "sheet", "C": "coil"}.get(kind, kind)) for i, residue, kind, *_ in wanted]
    assert "substr(seq, 1, 150)" not in reports.SQL["protein_backbone"]
