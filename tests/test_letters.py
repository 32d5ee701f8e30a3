"""Arrow functions of letters, against plain Python; and that they, not expressions that look at each letter, do the work."""

import math
from collections import Counter
from itertools import groupby

import pytest

from helixframe.functions import letters as lt
from helixframe.functions import protein as prot
from helixframe.functions import sequence as sq
from helixframe.functions.tables import CODON_AMINO, CODON_BASES, HYDROPATHY, RESIDUES
from helixframe.operators import annotation as an
from helixframe.plans import reports, views
from pyspark.sql import functions as F

TEXTS = [None, "", "A", "AC", "atgUAg", "ATGNNNTAGCC", "ATGé\U0001F600AATG", "é" * 7, "AAAC" * 9 + "CC", "aAaA", "GGGG", "ATGACGTTTTAA" * 40, "x\ny\n\ny"]


@pytest.fixture(params=[1 << 20, 10], ids=["together", "in parts"])
def table(spark, request, monkeypatch):
    monkeypatch.setattr(lt, "PART", request.param)
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").coalesce(1)


def _codons(s):
    s = "".join(c.upper() if c.isascii() else c for c in s).replace("U", "T")
    place = lambda c: sum(CODON_BASES.index(x) * 4 ** (2 - k) for k, x in enumerate(c))
    return "".join(CODON_AMINO[place(c)] if set(c) <= set(CODON_BASES) else "X" for c in (s[i : i + 3] for i in range(0, len(s) - 2, 3)))


def test_letters_of_odd_texts(table):
    own = lambda c: [r[0] for r in table.select(c).collect()]
    text = F.col("text")
    some = lambda f, none=None: [none if t is None else f(t) for t in TEXTS]
    assert own(sq.translate_codons(text)) == some(_codons)
    assert own(sq.longest_homopolymer(text)) == some(lambda t: max((len(list(g)) for _, g in groupby(t)), default=0), 0)
    assert own(lt.letter_numbers(text)) == some(lambda t: list(Counter(t).values()))
    assert own(prot.residue_counts(text)) == some(lambda t: [t.count(r) for r in RESIDUES])
    assert own(views.bases()) == some(lambda t: "".join(views.FOLD[ord(c.upper()) - 65] for c in t if c.isascii() and c.isalpha()), "")
    assert own(sq.gc_content(text)) == some(lambda t: 100.0 * (t.count("G") + t.count("C")) / len(t) if t else 0.0)


def test_numbers_of_a_protein_by_its_counts(table):
    clean = prot.clean_protein(F.coalesce("text", F.lit("")))
    numbers = {"residues": F.length(clean), "mw": prot.molecular_weight(clean), "gravy": prot.gravy(clean), "aliphatic": prot.aliphatic_index(clean), "pi": prot.isoelectric_point(clean)}
    counted = table.select(prot.residue_counts(clean).alias("c")).select(*(c.alias(n) for n, c in prot.counted_numbers(F.col("c")).items()))
    assert [tuple(r) for r in counted.collect()] == [tuple(r) for r in table.select(*(c.alias(n) for n, c in numbers.items())).collect()]
    assert math.isclose(counted.collect()[10]["gravy"], HYDROPATHY["G"])


def test_frames_of_many_sequences_are_those_of_each(table):
    seqs = [t or "" for t in TEXTS]
    for least, top in ((6, None), (12, 3), (6, 0)):
        rows = an.orf_rows(seqs, least, top)
        for k, s in enumerate(seqs):
            assert rows[1:6, rows[0] == k].tolist() == [x.tolist() for x in an.orf_columns(s, least, top)] == list(map(list, zip(*_frames(s, least, top), strict=True))) or not _frames(s, least, top)
            assert rows[6, rows[0] == k].tolist() == list(range(1, len(_frames(s, least, top)) + 1))


def _frames(s, least, top):
    s, found = "".join(c if c in "ACGTU" else "N" for c in s), []
    for minus, own in enumerate((s, s.translate(str.maketrans("ACGTU", "TGCAA"))[::-1])):
        for frame in range(3):
            amino = _codons(own[frame:])
            at = 0
            for segment in amino.split("*")[:-1]:
                if (m := segment.find("M")) >= 0 and 3 * (len(segment) - m + 1) >= least:
                    found.append((minus, frame, frame + 3 * (at + m), frame + 3 * (at + len(segment) + 1), len(segment) - m))
                at += len(segment) + 1
    return sorted(found, key=lambda f: (f[2] - f[3], f[0], f[1], f[2]))[:top]


def test_no_task_looks_at_each_letter_in_an_expression(spark):
    own = spark.createDataFrame([(0, "ACGT")], "doc_id long, seq string")
    for name in reports.IN_SQL:
        plan = reports.TASKS[name](own)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f in plan for f in ("regexp_extract_all", "regexp_replace", "split(", "array_distinct")), name


def test_a_filter_does_not_fold_texts_twice(spark, tmp_path):
    spark.createDataFrame([(1, "en", "acgt" * 20, "s", 80)], "doc_id long, lang string, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = views.text_dna(spark, str(tmp_path)).where("length(seq) >= 40")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_no_stage_has_two_python_workers_a_task(spark, tmp_path):
    """Features: what is worked in Python after folding is dealt first. Reads: one worker makes bases and qualities."""
    spark.createDataFrame([(1, "en", "acgt" * 20, "s", 80)], "doc_id long, lang string, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    lines = reports.genome_features(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    own = [line for line in lines if any(w in line for w in ("MapInArrow", "ArrowEvalPython", "Exchange"))]
    for above, below in zip(own, own[1:], strict=False):
        assert not ("MapInArrow" in above and "ArrowEvalPython" in below)
    assert sum("MapInArrow" in line for line in own) == 2
    assert views.reads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
