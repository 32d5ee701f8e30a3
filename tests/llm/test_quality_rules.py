import math
import random
import re
from collections import Counter

from pyspark.sql import Row

from helixframe.llm.quality_rules import KINDS, RULES, Settings, apply_rules, estimate, first_guess


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts_and_verdicts(spark):
    plain = [" ".join(f"w{(i * 7 + k * k) % 97}x{k % 5}" for k in range(120)) + f"\nend {i}\nend" for i in range(40)]
    junk = [" ".join(w + "%%%" for w in t.split()) for t in plain[:8]]
    loud = [t.translate({48 + d: 97 + d for d in range(10)}).upper() for t in plain[8:12]]
    again = ["the same four words " * 40, "a a a a", "é\tü\x0bx\ny\n \ny\ny " * 30, None, "", " \n ", "one", "|", "long " + "x" * 9000]
    texts = plain + junk + loud + again
    rows = [Row(doc_id=i, text=t, words=1, symbols="x", kept=None, n_words=3) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, words int, symbols string, kept boolean, n_words int"
    got = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows + rows[:1], schema)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), repr(t)[:80]
    assert all(got[i]["kept"] for i in range(40))
    assert not any(got[i]["kept"] for i in range(40, len(texts)))


def test_empty_table(spark):
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_estimate(patterns, s):
    """Expectation-maximisation with plain loops: (shares, rates) of kinds."""
    guess = first_guess(s)
    shares, rates = [v[0] for v in guess.values()], [list(v[1].values()) for v in guess.values()]
    n_all = sum(n for _, n in patterns)
    prior = lambda k, r: s.good_votes if k == 0 and list(RULES)[r] in KINDS else s.votes
    for _ in range(s.rounds):
        mass = []
        for votes, n in patterns:
            p = [a * math.prod(h if v == 0 else 1 - h if v == 1 else 1.0 for v, h in zip(votes, hs, strict=True)) for a, hs in zip(shares, rates, strict=True)]
            mass.append([n * x / sum(p) for x in p])
        new_shares = [(sum(m[k] for m in mass) + 1) / (n_all + len(KINDS)) for k in range(len(KINDS))]
        new_rates = [[(sum(m[k] for (v, _), m in zip(patterns, mass, strict=True) if v[r] == 0) + prior(k, r)[0]) / (sum(m[k] for (v, _), m in zip(patterns, mass, strict=True) if v[r] is not None) + sum(prior(k, r))) for r in range(len(RULES))] for k in range(len(KINDS))]
        moved = max(abs(x - y) for x, y in zip([*new_shares, *sum(new_rates, [])], [*shares, *sum(rates, [])], strict=True))
        shares, rates = new_shares, new_rates
        if moved < s.still:
            break
    return shares, rates


def test_estimate_equals_plain_loops_until_nothing_moves(spark):
    rng = random.Random(2)
    votes = [[rng.choice([1, 1, 1, 1, None, 0 if rng.random() < 0.3 else 1]) for _ in RULES] for _ in range(300)] + [[0, *[rng.choice([0, 1, None]) for _ in list(RULES)[1:]]] for _ in range(40)]
    patterns = Counter(map(tuple, votes))
    for s in (Settings(), Settings(rounds=7, votes=(2.0, 5.0))):
        model = estimate(spark.createDataFrame([(v,) for v in votes], "votes array<int>"), s)
        shares, rates = plain_estimate(list(patterns.items()), s)
        assert all(abs(a - b) < 1e-6 for a, b in zip([m[0] for m in model.values()], shares, strict=True))
        assert all(abs(model[k][1][r] - rates[i][j]) < 1e-5 for i, k in enumerate(KINDS) for j, r in enumerate(RULES))


def test_good_votes_outweigh_one_bad_vote(spark):
    """A text that fails one rule and has all else to speak for it stays; with nothing else it goes."""
    plain = [" ".join(f"{'of a to in'.split()[k % 4] if k % 3 == 0 else f'word{chr(97 + (i * 7 + k * k) % 26)}{chr(97 + k % 23)}'}{'.' if k % 12 == 11 else ''}" for k in range(240)) + ".\nEnd it here.\nOr here." for i in range(60)]
    junk = [" ".join("%%" + w[::-1] + "#" for w in t.split() if len(w) > 4) for t in plain[:12]]
    odd = plain[0].replace("word", "WORD", 10) + "\n" + "\n".join(["One line of it."] * 3)  # repeated lines, but a text
    got = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(list(enumerate([*plain, *junk, odd])), "doc_id long, text string")).collect()}
    assert got[72]["n_dup_lines"] == 2 and got[72]["kept"] and all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 72))
