import random
import re
import time
from itertools import combinations

from pyspark.sql import Row

from helixframe.llm.decontamination import MASKS, NEEDED, WINDOW, contaminated


def test_masks_cover_every_pair_of_substitutions():
    for lost in combinations(range(WINDOW), WINDOW - NEEDED):
        assert any(all(o + at not in lost for o in m) for m in MASKS for at in range(WINDOW - m[-1]))


def test_planted_passages(spark):
    item = [f"q{i}" for i in range(20)]
    near = [w if i not in (4, 9, 15) else "x" for i, w in enumerate(item)]
    far = [w if i % 4 else "x" for i, w in enumerate(item)]
    fill = [f"f{i}" for i in range(30)]
    texts = {1: fill + item + fill, 2: fill + near, 3: fill + far + fill, 4: item[7:] + fill, 5: item[8:] + fill, 6: fill, 7: ["so", "short", "an", "item"] + fill, 8: ["so", "short", "x", "item"]}
    docs = [Row(doc_id=i, text=", ".join(w).upper(), item=1, words="x", seed=3) for i, w in texts.items()] + [Row(doc_id=9, text=None, item=1, words="", seed=3), Row(doc_id=10, text="", item=1, words="", seed=3)]
    bench = [Row(item_id=1, text=" ".join(item), start=1), Row(item_id=2, text="So short: an item", start=1), Row(item_id=3, text=None, start=0), Row(item_id=4, text="", start=0)]
    for most in (1_000_000, 0):  # broadcast, and shuffled as for a large benchmark
        got = sorted(map(tuple, contaminated(spark.createDataFrame(docs + docs[:2]), spark.createDataFrame(bench + bench[:1]), broadcast_seeds=most).collect()))
        assert got == [(1, 1, 20, 20, 30), (2, 1, 20, 17, 30), (4, 1, 20, 13, -7), (7, 2, 4, 4, 0)]


def test_empty_tables(spark):
    empty_docs, empty_bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contaminated(empty_docs, spark.createDataFrame([Row(item_id=1, text="a b")])).collect() == []
    assert contaminated(spark.createDataFrame([Row(doc_id=1, text="a b")]), empty_bench).collect() == []


def plain(docs, bench):
    """All diagonals of all pairs."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, text in docs:
        for i, item in bench:
            dw, iw, best = words(text), words(item), None
            for start in range(-len(iw) + 1, len(dw)) if iw else ():
                equal = [start + j in range(len(dw)) and dw[start + j] == w for j, w in enumerate(iw)]
                inside = [e for j, e in enumerate(equal) if 0 <= start + j < len(dw)]
                good = all(equal) if len(iw) < WINDOW else any(sum(inside[k : k + WINDOW]) >= NEEDED for k in range(len(inside) - WINDOW + 1))
                if good and (best is None or (sum(equal), -start) > best):
                    best = (sum(equal), -start)
            if best:
                out.add((d, i, len(iw), best[0], -best[1]))
    return sorted(out)


def test_all_diagonals(spark):
    """Texts of few words, which meet items at many places, against all diagonals; cut in rows of any number of starts."""
    rng = random.Random(4)
    word = lambda: rng.choice("abcde")
    bench = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for k in range(14)]
    docs = [(k, " ".join(word() for _ in range(rng.choice([0, 3, 13, 40, 90])))) for k in range(25)]
    docs += [(100, bench[5][1] + " x " + bench[6][1]), (101, " ".join(["a"] * 60)), (102, "a b c d e f g " * 9)]
    bench += [(50, "a b c d e f g " * 3), (51, " ".join(["a"] * 20))]
    for most, starts in ((1_000_000, 1024), (0, 3)):
        got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), most, starts).collect()
        assert sorted(map(tuple, got)) == plain(docs, bench)


def test_repetitive_texts_in_time(spark):
    """20,000 words in a cycle of 14 against 200 items of 43 such words: 4 million places to judge."""
    cycle = [f"w{k}" for k in range(14)]
    docs = [(1, " ".join(cycle[k % 14] for k in range(20_000))), (2, "other text")]
    bench = [(k, " ".join(cycle[(k + j) % 14] for j in range(43))) for k in range(200)]
    began = time.perf_counter()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, k, 43, 43, k % 14) for k in range(200)]
    assert time.perf_counter() - began < 90  # 4 slow cores; an unbounded reading runs out of memory
