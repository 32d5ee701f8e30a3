import re
import struct
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import queries as llm
from helixframe.llm.quality_classifier import Settings, document_features, train
from helixframe.llm.simhash import fingerprint


def tables():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    bad = lambda n: " ".join(w + "%%%" for w in rng.choice(vocabulary[:40], n))
    labelled = [(i, bad(60) if i % 3 == 0 else words(60)) for i in range(90)]
    item = words(30)
    leak = lambda: f"{words(40)} {item} {words(40)}"
    copied, other = words(80), words(80)
    docs = [
        *labelled,
        *((None, words(60)) for _ in range(4)),  # null ids: good, bad, contaminated, with a frequent line
        *((None, bad(60)) for _ in range(3)),
        *((None, leak()) for _ in range(2)),
        *((i, f"Menu\n{words(60)}") for i in (None, None, 200, 201, 202, 203, 204, 205, 206, 207, 207)),
        (300, copied), (300, copied), (301, copied), (None, copied),  # repeated rows and copies
        (None, other), (None, other),  # copies without any id
        (310, words(70)), (310, words(70)), (310, bad(60)),  # one id, three texts
        (320, leak()), (320, words(70)),
        (330, None), (None, None), (331, ""),
    ]
    return docs, [(i, int(i % 3 != 0)) for i, _ in labelled], [(1, item)]


def brute(docs, labels, benchmark):
    """(doc_id, start, length, crc) of each piece, stage by stage with plain loops."""
    s, texts = Settings(), dict(docs)
    known = [(i, y) for i, y in sorted(labels) if zlib.crc32(str(i).encode()) % 5]
    model = train([document_features(texts[i], s) for i, _ in known], [y for _, y in known], s)

    def good(text):
        buckets, shares = document_features(text, s)
        z = (shares @ model.vectors[buckets] if len(buckets) else np.zeros(s.width)) @ model.weights + model.bias
        return 1 / (1 + np.exp(z[0] - z[1])) >= s.threshold

    rows = [r for r in docs if good(r[1])]
    key = lambda x: x.strip().lower()
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    rows = [(i, t and "\n".join(x for x in t.split("\n") if not key(x) or n[key(x)] < 10)) for i, t in rows]
    prints, group = [fingerprint((t or "").encode()) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    rows = [min((r for r, h in zip(rows, group, strict=True) if h == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in sorted(set(group))]
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def leaks(text):
        own = split(text)
        return any(sum(x == y for x, y in zip(own[i : i + 13], item[j : j + 13], strict=True)) >= 11 for _, t in benchmark for item in [split(t)] for i in range(len(own) - 12) for j in range(len(item) - 12))

    tokenizer = Tokenizer.from_file(llm.WORD_BPE)
    out = Counter()
    for i, t in rows:
        if not leaks(t):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            out[i, 0, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    return out


def test_pipeline_agrees_with_brute_force_on_null_and_repeated_ids(spark, tmp_path):
    docs, labels, benchmark = tables()
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, labels, benchmark)
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert sum(k[0] is None for k in want.elements()) >= 6 and want.total() < len(docs)


def test_stages_on_tables_with_their_own_names(spark, tmp_path):
    """Every filtering stage returns all columns as they were, whatever they are called."""
    names = ["_row", "_key", "_dropped", "_row_", "key", "fp", "first", "root", "item", "seed", "at", "start", "words", "salt", "digest", "shard", "dropped", "score", "predicted", "quality", "node", "n", "rank", "kept"]
    docs, labels, benchmark = tables()
    rows = [(i, t, *(f"{c}{k}" for c in names)) for k, (i, t) in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    there = {tuple(r)[2:] for r in table.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        kept = [tuple(r[c] for c in names) for r in out.select(names).collect()]
        assert set(out.columns) - {"n_chars"} == set(table.columns) and set(kept) <= there and len(kept) == len(set(kept)) >= 60, name
