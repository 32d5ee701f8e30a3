import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Row

from helixframe.llm import common, quality_classifier
from helixframe.llm.packing import WordIds, encoder
from helixframe.llm.quality_classifier import Model, Settings, WordTable, classify, document_features, many_features, score, train, word_features

SMALL = Settings(buckets=1 << 12, epochs=6)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    good = [f"{a}{b}" for a in ("an", "tion", "the", "ing") for b in ("ed", "er", "ly", "sh")]
    out = []
    for i in range(n):
        words = list(rng.choice(good, 60))
        if i % 4 == 0:
            words = [w + "%%%" for w in words] if i % 8 else [words[k // 20 * 20] for k in range(60)]
        out.append((" ".join(words), int(i % 4 != 0)))
    return out


def test_learns_symbols_and_repetition():
    rows = texts(400, 1)
    model = train([document_features(t, SMALL) for t, _ in rows], [y for _, y in rows], SMALL)
    held = texts(120, 2)
    assert np.mean((score([t for t, _ in held], model) >= 0.3) == np.array([y for _, y in held])) > 0.97


def test_score_is_the_softmax_of_the_mean_vector():
    rows = texts(40, 3)
    model = train([document_features(t, SMALL) for t, _ in rows], [y for _, y in rows], SMALL)
    for text, _ in [*rows[:9], ("", 1), ("one", 1)]:
        buckets, shares = document_features(text, SMALL)
        z = (shares @ model.vectors[buckets] if len(buckets) else np.zeros(SMALL.width)) @ model.weights + model.bias
        assert abs(score([text], model)[0] - np.exp(z[1]) / np.exp(z).sum()) < 1e-4


def test_table(spark):
    rows = texts(600, 4)
    docs = [Row(doc_id=i, text=t, score="x", held_out=0) for i, (t, _) in enumerate(rows)] + [Row(doc_id=9000, text=None, score="x", held_out=0), Row(doc_id=9001, text="", score="", held_out=0)] * 2
    labels = [Row(doc_id=i, quality=y) for i, (_, y) in enumerate(rows)] + [Row(doc_id=None, quality=1), Row(doc_id=3, quality=None)]
    got = classify(spark.createDataFrame(docs), spark.createDataFrame(labels), SMALL).collect()
    assert len(got) == 604
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert np.mean([r["predicted"] == rows[r["doc_id"]][1] for r in got if r["held_out"] and r["doc_id"] < 9000]) > 0.9
    assert len({r["score"] for r in got if r["doc_id"] >= 9000}) == 1


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert classify(docs, labels, SMALL).collect() == []
    one = spark.createDataFrame([Row(doc_id=1, text="a b")])
    assert classify(one, labels, SMALL).first()["score"] == 0.5


def test_a_worker_keeps_what_one_operator_learned():
    """An encoder goes when the classifier begins, a model's words when another model or an encoder begins."""
    rows = texts(40, 5)
    one, two = (train([document_features(t, SMALL) for t, _ in rows[:n]], [y for _, y in rows[:n]], SMALL) for n in (20, 40))
    words = encoder(WordIds, public_tokenizers.path("word_bpe_49k.json"))
    assert encoder(WordIds, public_tokenizers.path("word_bpe_49k.json")) is words
    first = score([rows[0][0]], one)
    assert [type(x) for x in common._KEPT.values()] == [WordTable] and next(iter(common._KEPT.values())).model is one
    table = next(iter(common._KEPT.values()))
    score([rows[1][0]], one)
    assert next(iter(common._KEPT.values())) is table
    score([rows[0][0]], two)
    assert [x.model for x in common._KEPT.values()] == [two]
    assert score([rows[0][0]], one) == first
    encoder(WordIds, public_tokenizers.path("word_bpe_49k.json"))
    assert [type(x) for x in common._KEPT.values()] == [WordIds]


def test_features_of_many_words_are_those_of_each():
    words = ["a", "ab", "word", "é", "\u4e2d\u6587\u5b57", "na\u00efve", "a\U0001f600b", "<>", "x" * 300, "\u00df\u20ac" * 9, "word"]
    for s in (SMALL, Settings(shortest=1, longest=7), Settings(shortest=5, longest=5)):
        flat, sizes = many_features(words, s)
        assert flat.tolist() == [f for w in words for f in word_features(w, s)] and sizes.tolist() == [len(word_features(w, s)) for w in words]


def test_a_table_learns_words_together(monkeypatch):
    """The words of a text are hashed at once, and their sums are those of their own features."""
    model = Model(SMALL, np.random.default_rng(1).normal(size=(SMALL.buckets, SMALL.width)).astype(np.float32), np.zeros((SMALL.width, 2), np.float32), np.zeros(2, np.float32))
    calls, words = [], [f"w\u00f6rd{k}" for k in range(50)]
    monkeypatch.setattr(quality_classifier, "many_features", lambda own, s: calls.append(len(own)) or many_features(own, s))
    table = WordTable(model)
    rows = table.find([*words, *words])
    assert rows[:50].tolist() == rows[50:].tolist() and calls == [50]
    for w, row in zip(words, rows, strict=False):
        own = word_features(w, SMALL)
        assert (table.sums[row] == model.vectors[own].sum(axis=0)).all() and table.sizes[row] == len(own) and table.hashes[row] == zlib.crc32(w.encode())


def test_scores_do_not_depend_on_what_is_looked_up_together(monkeypatch):
    rows = [None, "", *(t for t, _ in texts(30, 8)), "one", "long " * 90 + "text"]
    model = train([document_features(t, SMALL) for t in rows], [k % 2 for k in range(len(rows))], SMALL)
    want, calls = score(rows, model), []
    find = WordTable.find
    monkeypatch.setattr(WordTable, "find", lambda self, words: calls.append(len(words)) or find(self, words))
    assert (score(rows, model) == want).all() and len(calls) == 1
    for group, most in ((1, 500_000), (100, 500_000), (30_000, 130), (30_000, 190)):
        monkeypatch.setattr(WordTable, "GROUP", group)
        monkeypatch.setattr(WordTable, "ROWS", most)
        common._KEPT.clear()
        assert np.allclose(score(rows, model), want, atol=1e-6)
