import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

from helixframe.llm.packing import fullest, pack, plan_bins
from helixframe.llm.token_counts import count_tokens
from helixframe.llm.tokenizer_memo import ByteCounts, WordIds

TEXTS = [None, "", "one", "a few words", "word " * 300, "x y z " * 40, "the end.", "a few words"] * 3


def docs_of(spark):
    return spark.createDataFrame([Row(doc_id=i, text=t, piece="x", length=3) for i, t in enumerate(TEXTS)])


def test_packing_is_an_exact_round_trip(spark):
    path, capacity = public_tokenizers.path("word_bpe_49k.json"), 128
    tokenizer = Tokenizer.from_file(path)
    rows = pack(docs_of(spark), path, end_id=1, capacity=capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, k * capacity, min(capacity, len(ids) - k * capacity)) for k in range(-(-len(ids) // capacity))]
        for r in pieces:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs_of(spark), path, limit=100).collect()}
    want = {i: (len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in enumerate(TEXTS)}
    assert got == want


def test_stored_counts_are_found_again_and_count_once(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/cache"
    first = sorted(count_tokens(docs_of(spark), path, cache=cache).collect())
    stored = spark.read.parquet(cache)
    stored.selectExpr("tokenizer", "digest", "n_bytes", "n_tokens + 1000 AS n_tokens").write.parquet(f"{tmp_path}/other")
    stored.write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(cache)  # as by a retry
    again = sorted(count_tokens(docs_of(spark), path, cache=cache).collect())
    assert first == again and spark.read.parquet(cache).count() == 2 * len({t or "" for t in TEXTS})
    hit = sorted(count_tokens(docs_of(spark), path, cache=f"{tmp_path}/other").collect())
    assert [(a["doc_id"], a["n_tokens"] + 1000) for a in first] == [(b["doc_id"], b["n_tokens"]) for b in hit]


def test_empty_tables_and_null_ids(spark):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, word).collect() == [] and count_tokens(empty, byte).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in pack(docs, word).collect()) == [(0, 3), (0, 3), (1, 1)]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in count_tokens(docs, byte).collect()) == [(0, 2), (0, 2), (1, 0)]


LETTERS = [*"aAZzé ßİıKẞçñ日語🙂\0\x0b\x1c\x85\xa0\u2028\u0301 \n\t\r  '\"!#$%&()*+,-./:;=?@[]^_`{}~019<|>", "<|endoftext|>", "<|END|>", "<|startoftext|>", "'s", "'LL", "  ", " ; ", "</s>", "the", "Word", "\0;", "end;"]


def test_memo_agrees_with_the_library_in_any_order():
    rng = random.Random(5)
    texts = ["\0; x", "end; y", "q \0; x", "q end; y"] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    ids = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in Tokenizer.from_file(word).encode_batch(texts, add_special_tokens=False)]
    counts = [len(e.ids) for e in Tokenizer.from_file(byte).encode_batch(texts, add_special_tokens=False)]
    for order in (1, -1):
        assert WordIds(word)(texts[::order])[::order] == ids
        assert ByteCounts(byte)(texts[::order])[::order] == counts


def test_fullest_and_plan_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        histogram = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in histogram.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = fullest(histogram, sorted(histogram, reverse=True), room)
        assert sum(chosen) == max(s for s in sums if s <= room) and all(chosen.count(x) <= histogram[x] for x in chosen)
        placed = defaultdict(int)
        for _, times, lengths in plan_bins(histogram, 40):
            assert sum(lengths) <= 40
            for x in lengths:
                placed[x] += times
        assert placed == histogram
