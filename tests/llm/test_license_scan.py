import random
import re

from pyspark.sql import Row

from helixframe.llm.license_scan import CONTAINMENT, TEMPLATES, WORDS, scan, size_class, templates_table, window_shape


def test_planted_notices(spark):
    fill = " ".join(f"f{i}" for i in range(40))
    long = TEMPLATES["MIT grant"]
    changed = long.replace("hereby", "now")
    broken = " ".join(w if i % 4 else "x" for i, w in enumerate(long.split()))
    texts = {1: TEMPLATES["MIT short"], 2: fill + " released UNDER the mit license! " + fill, 3: fill + "\n" + long + "\n" + fill + " " + long, 4: changed + " " + fill, 5: broken, 6: None, 7: "", 8: "the MIT License", 9: fill * 50}
    docs = spark.createDataFrame([Row(doc_id=i, text=t, m=1, window="x", start=None) for i, t in texts.items()] * 2, "doc_id long, text string, m int, window string, start int")
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["first_word"]) for r in scan(docs, templates_table(spark)).collect()}
    n = len(re.findall(r"\w+", long)) - 4
    assert got == {(1, "MIT short"): (1.0, 0), (2, "MIT short"): (1.0, 40), (3, "MIT grant"): (1.0, 40), (4, "MIT grant"): ((n - 3) / n, 3)}
    blocks = scan(docs, templates_table(spark), block=40)
    assert got == {(r["doc_id"], r["license_id"]): (r["containment"], r["first_word"]) for r in blocks.collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan(docs, templates_table(spark)).collect() == []
    assert scan(spark.createDataFrame([Row(doc_id=1, text="a b c d e f")]), spark.createDataFrame([Row(license_id="x", text="a b")])).collect() == []


def test_bands_find_what_a_brute_force_over_all_windows_finds(spark):
    rng = random.Random(4)
    fill = lambda n: [f"f{rng.randint(0, 300)}" for _ in range(n)]
    texts = {}
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        for k in range(12):  # at any place, whole or with a word put in, left out or changed
            own = re.findall(r"[^\W_]+", text.lower())
            at = rng.randrange(len(own))
            own[at : at + (k % 4 > 1)] = [["new"], [], ["other"], own[at : at + 1]][k % 4]
            texts[100 * i + k] = fill(rng.randint(0, 90)) + own + fill(rng.randint(0, 90))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]) for r in scan(docs, templates_table(spark)).collect()}
    shingles = lambda w: [tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)]
    want = set()
    for name, text in TEMPLATES.items():
        all_own = shingles(re.findall(r"[^\W_]+", text.lower()))
        own, (step, width) = set(all_own), window_shape(size_class(len(all_own)))
        for i, w in texts.items():
            s = shingles(w)
            if any(len(own & set(s[k : k + width])) >= CONTAINMENT * len(own) for k in range(0, max(1, len(s)), step)):
                want.add((i, name))
    assert got == want and len(want) > 150
