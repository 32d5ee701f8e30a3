import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.llm.line_dedup import SHARD_KEYS, CuckooFilter, _rows, build_filters, count_keys, dedup_lines, document_keys, probe, shards_for, update_counts, update_filters


def digests(n, tag):
    return _rows([hashlib.blake2b(f"{tag}{i}".encode(), digest_size=16).digest() for i in range(n)])


def test_cuckoo_filter_inserts_and_deletes():
    a, b = digests(900, "a"), digests(4000, "b")
    f = CuckooFilter.of(a)
    assert f.contains(a).all() and f.contains(b).mean() < 0.01
    assert all(f.delete(x) for x in a[:450])
    assert f.contains(a[450:]).all() and f.contains(a[:450]).mean() < 0.05
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(a[450:]).all()
    small = CuckooFilter(4)
    held = [x for x in a[:40] if small.insert(x)]
    assert len(held) < 40 and small.contains(np.array(held)).all()


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([Row(doc_id=first + i, text=t, dropped="x", digest=1) for i, t in enumerate(texts)])


def brute(texts, threshold):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < threshold]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


TEXTS = ["Menu\nHello\nmenu ", "\tMENU\n", None, "", "a\n\nmenu\nÉ", "é\nmenu", "menu\nmenu", "x" * 5000 + "\nb", "b"] * 2 + ["u \nu"]


def test_lines_agree_with_brute_force(spark):
    rows = dedup_lines(docs_of(spark, TEXTS), threshold=4, with_text=True).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows} == brute(TEXTS, 4)
    assert {r["doc_id"]: r["text"] for r in rows}[2] is None


def test_deleting_documents_reverses_their_insertion(spark):
    first, second = document_keys(docs_of(spark, TEXTS)), document_keys(docs_of(spark, ["menu", "new\nHello"] * 5, 100))
    base = count_keys(first)
    more = update_counts(base, added=second)
    back = update_counts(more, removed=second)
    as_set = lambda df: {(bytes(r[0]), r[1]) for r in df.collect()}
    assert as_set(back) == as_set(base) != as_set(more)
    filters = build_filters(base, 4, 8)
    grown = update_filters(filters, base, more, 4, 8)
    shrunk = update_filters(grown, more, back, 4, 8)
    for counts, held in ((more, grown), (back, shrunk)):
        wanted = counts.where(F.col("n_docs") >= 4).select(F.lit(1).cast("long").alias("doc_id"), "digest")
        assert probe(wanted, held, 8).count() == wanted.count() > 0
    assert probe(second, filters, 8).count() < second.count()


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_with_null_and_repeated_ids_count_each(spark):
    docs = spark.createDataFrame([(None, "menu\na"), (None, "menu\nb"), (7, "menu\nc"), (7, "menu\nc"), (8, "d")], "doc_id long, text string")
    got = sorted((r["text"], r["n_dropped"]) for r in dedup_lines(docs, threshold=4, with_text=True).collect())
    assert got == [("a", 1), ("b", 1), ("c", 1), ("c", 1), ("d", 0)]


def test_shards_follow_the_number_of_keys():
    assert [shards_for(n) for n in (0, SHARD_KEYS, SHARD_KEYS + 1, 9 * SHARD_KEYS)] == [1, 1, 2, 16]


def test_shards_give_equal_results(spark, monkeypatch):
    monkeypatch.setattr("helixframe.llm.line_dedup.SHARD_KEYS", 1)
    rows = dedup_lines(docs_of(spark, TEXTS), threshold=2).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows} == brute(TEXTS, 2)
