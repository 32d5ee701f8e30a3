import numpy as np
import xxhash
from pyspark.sql import Row

from helixframe.llm.simhash import connected_components, fingerprint, fingerprint_links, near_duplicates, trie_labels


def plain(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_is_the_defined_one():
    for text in ["", None, "A", "a B", "One two  three\tFOUR one two three", "É é x y z " * 9]:
        assert fingerprint(None if text is None else text.encode()) == plain(text)


def test_trie_agrees_with_all_pairs():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    values = {b ^ sum({1 << int(k) for k in rng.integers(0, 64, int(rng.integers(0, 5)))}) for b in base for _ in range(20)}
    values = np.array(sorted(values), np.uint64)
    halves = values.copy(), np.sort((values << np.uint64(32)) | (values >> np.uint64(32)))
    links = []
    for turned, v in enumerate(halves):
        label = trie_labels(v, [(0, len(v), 0, len(v), 0)], 0)
        back = [int(x) if not turned else int((x << np.uint64(32)) | (x >> np.uint64(32))) for x in v]
        links += [(back[i], back[l]) for i, l in enumerate(label)]
    group = {int(v): int(v) for v in values}
    for _ in range(len(values)):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    want = brute([int(v) for v in values])
    assert [group[int(v)] for v in values] == [int(values[l]) for l in want]


def test_components_of_documents(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(6):
        body = list(rng.choice(words, 300))
        for k in range(6):
            texts.append(" ".join(body[: 300 - k] + ["X"] * (k % 3)))
    texts += ["", None, "  ", "\t", "one", "ONE", "one two"]
    rows = [Row(doc_id=100 - i, text=t, lang="en", fp=1, root="x") for i, t in enumerate(texts)] * 2
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows)).collect()}
    ids = sorted(got)
    by_id = {100 - i: plain(t) for i, t in enumerate(texts)}
    label = brute([by_id[i] for i in ids])
    assert got == {i: (f"{by_id[i]:016x}", ids[l]) for i, l in zip(ids, label, strict=True)}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_subtries_dealt_again_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 63, 8)] + [(1 << 63) + 5]
    values = sorted({b ^ sum({1 << int(k) for k in rng.integers(0, 64, int(rng.integers(0, 6)))}) for b in base for _ in range(40)})
    want = brute(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for hot in (1 << 16, 3, 0):
        monkeypatch.setattr("helixframe.llm.simhash.HOT", hot)
        roots = {r["node"]: r["root"] for r in connected_components(fingerprint_links(frame, len(values))).collect()}
        own = [roots.get(v - (1 << 64) if v >> 63 else v, v - (1 << 64) if v >> 63 else v) for v in values]
        assert len(set(want)) > 9
        assert [(a == b) for a in own for b in own] == [(a == b) for a in want for b in want], hot
