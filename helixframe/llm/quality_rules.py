"""Quality rules by weak supervision, in DataFrame functions only (operator 3).

Each rule votes good (1) or bad (0) or abstains (null); five look for what spoils a text, five for what speaks for it.
Documents are a mixture of one good kind and one bad kind for each of the first five, as texts go wrong in different
ways. Expectation-maximisation over the counts of vote patterns (at most 3^rules, in one row) estimates the kinds' shares
and how often each rule says "bad" on each, which is the rule's accuracy, until nothing moves any more; the posterior
probability of the good kind decides instead of a demand that all rules pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import SPACE, let, materialise, words_column

#: Rule -> vote: integer arithmetic on the counts of a document.
RULES = {
    "symbols": "CASE WHEN n_words = 0 THEN NULL WHEN 10 * n_symbols > n_words THEN 0 WHEN 50 * n_symbols <= n_words THEN 1 END",
    "repeats": "CASE WHEN n_words < 3 THEN NULL WHEN 100 * n_repeat_words > 30 * n_words THEN 0 WHEN 100 * n_repeat_words <= 10 * n_words THEN 1 END",
    "word_length": "CASE WHEN n_words = 0 THEN NULL WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 0 WHEN word_chars BETWEEN 3 * n_words AND 10 * n_words THEN 1 END",
    "lines": "CASE WHEN n_lines < 2 THEN NULL WHEN 10 * n_dup_lines > 3 * n_lines THEN 0 WHEN n_dup_lines = 0 THEN 1 END",
    "capitals": "CASE WHEN n_words = 0 THEN NULL WHEN 2 * n_upper > word_chars THEN 0 WHEN 5 * n_upper <= word_chars THEN 1 END",
    "letters_digits": "CASE WHEN n_words = 0 THEN NULL WHEN 10 * n_alnum < 7 * word_chars THEN 0 WHEN 10 * n_alnum >= 9 * word_chars THEN 1 END",
    "sentences": "CASE WHEN n_words < 20 THEN NULL WHEN 2 * n_ends > n_words THEN 0 WHEN 40 * n_ends >= n_words AND 5 * n_ends <= n_words THEN 1 END",
    "line_ends": "CASE WHEN n_lines < 2 THEN NULL WHEN 10 * n_end_lines < 3 * n_lines THEN 0 WHEN 10 * n_end_lines >= 8 * n_lines THEN 1 END",
    "distinct_words": "CASE WHEN n_words < 20 THEN NULL WHEN n_distinct * n_distinct < 4 * n_words THEN 0 WHEN n_distinct * n_distinct >= 25 * n_words THEN 1 END",
    "short_words": "CASE WHEN n_words < 20 THEN NULL WHEN 100 * n_short < 3 * n_words THEN 0 WHEN 100 * n_short BETWEEN 10 * n_words AND 60 * n_words THEN 1 END",
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alnum", "n_ends", "n_end_lines", "n_distinct", "n_short")


#: The kinds of documents: the good one, and a bad one for each rule that looks for what spoils a text.
KINDS = ("good", "symbols", "repeats", "word_length", "lines", "capitals")


@dataclass(frozen=True)
class Settings:
    #: Rounds at most, and the move of a parameter below which they end.
    rounds: int = 1000
    still: float = 1e-6
    #: First guesses: the good kind's share, and how often a rule says "bad" on its own kind, on other bad kinds, on good.
    good: float = 0.9
    own: float = 0.5
    other: float = 0.1
    false_alarm: float = 0.002
    #: The same for rules that look for what speaks for a text: on the good kind, and on bad kinds.
    lacking: float = 0.2
    missing: float = 0.3
    #: Pseudo-counts: (bad, not bad) votes that a rule is taken to have cast on each kind before any is seen, and those of
    #: a rule that looks for what spoils a text, on the good kind: they decide in tables of some hundred rows only.
    votes: tuple[float, float] = (1.0, 1.0)
    good_votes: tuple[float, float] = (1.0, 400.0)
    threshold: float = 0.5


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules read, each from one pass over the row's text.

    Repeated 3-word windows are found by sorting the windows' 64-bit hashes within the row: n log n, no shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words_column(F.col("text").cast("string")).alias("words"))
    has_word = f"[^{SPACE}]"
    rows = rows.select(
        "doc_id", "text", "words",
        F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)).alias("lines"),
        F.when(F.size("words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.struct(F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)).alias("h"), i.alias("at"))))).alias("windows"),
    )
    again = F.filter("windows", lambda w, k: (w["h"] == F.get("windows", k - 1)["h"]) | (w["h"] == F.get("windows", k + 1)["h"]))
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda w: w["at"])))
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)

    def without(chars: str) -> Column:
        return F.length("text") - F.length(F.translate("text", chars, ""))

    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_alnum"),
        without(".!?").cast("long").alias("n_ends"),
        F.size(F.filter("lines", lambda x: x.rlike(f"[.!?:;\"')][{SPACE}]*$"))).cast("long").alias("n_end_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
    )


Model = dict[str, tuple[float, dict[str, float]]]


def first_guess(s: Settings) -> Model:
    """Kind -> (share, rule -> rate of "bad")."""

    def rate(kind: str, rule: str) -> float:
        if rule not in KINDS:
            return s.lacking if kind == "good" else s.missing
        return s.false_alarm if kind == "good" else s.own if kind == rule else s.other

    return {k: (s.good if k == "good" else (1 - s.good) / (len(KINDS) - 1), {r: rate(k, r) for r in RULES}) for k in KINDS}


def joint(model: Column, votes: Column) -> Column:
    """An array with the joint probability of each kind of ``model`` and the array ``votes``; an abstaining rule says nothing."""
    says = lambda rate, vote: F.when(vote == 0, rate).when(vote == 1, 1 - rate).otherwise(F.lit(1.0))
    return F.zip_with(model["shares"], model["rates"], lambda share, rates: F.aggregate(F.zip_with(rates, votes, says), share, lambda a, x: a * x))


def posteriors(model: Column, votes: Column) -> Column:
    """An array with P(kind | votes) of each kind."""
    return let(joint(model, votes), lambda p: let(total(p, lambda x: x), lambda t: F.transform(p, lambda x: x / t)))


def total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def model_column(model: Model) -> Column:
    return F.struct(F.array(*(F.lit(share) for share, _ in model.values())).alias("shares"), F.array(*(F.array(*(F.lit(rates[r]) for r in RULES)) for _, rates in model.values())).alias("rates"))


def one_round(model: Column, patterns: Column, s: Settings) -> Column:
    """The model after a round: what each pattern's documents are, then shares and rates by these."""
    prior = [[s.good_votes if kind == "good" and rule in KINDS else s.votes for rule in RULES] for kind in KINDS]
    bad, cast = (F.array(*(F.array(*(F.lit(f(cell)) for cell in row)) for row in prior)) for f in (lambda c: c[0], sum))
    members = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), F.transform(posteriors(model, p["votes"]), lambda x: x * p["n"]).alias("m")))
    kinds, rules = (F.sequence(F.lit(0), F.lit(k - 1)) for k in (len(KINDS), len(RULES)))

    def made(known: Column) -> Column:
        shares = F.transform(kinds, lambda k: (total(known, lambda p: F.get(p["m"], k)) + 1) / (total(patterns, lambda p: p["n"]) + len(KINDS)))

        def rate(k: Column, r: Column) -> Column:
            vote = lambda p: F.get(p["votes"], r)
            said = total(known, lambda p: F.when(vote(p) == 0, F.get(p["m"], k)).otherwise(0.0))
            return (said + F.get(F.get(bad, k), r)) / (total(known, lambda p: F.when(vote(p).isNotNull(), F.get(p["m"], k)).otherwise(0.0)) + F.get(F.get(cast, k), r))

        return F.struct(shares.alias("shares"), F.transform(kinds, lambda k: F.transform(rules, lambda r: rate(k, r))).alias("rates"))

    return let(members, made)


def estimate(votes: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """Shares and rates by expectation-maximisation over the patterns' counts, all rounds within one row."""
    counts = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    patterns = materialise(counts.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns")), "vote-patterns")  # 3^rules patterns at most
    first = F.struct(model_column(first_guess(s)).alias("model"), F.lit(1.0).alias("moved"))

    def step(state: Column, _: Column) -> Column:
        flat = lambda m: F.concat(m["shares"], F.flatten(m["rates"]))
        moved = lambda m: F.array_max(F.zip_with(flat(m), flat(state["model"]), lambda x, y: F.abs(x - y)))
        after = let(one_round(state["model"], F.col("patterns"), s), lambda m: F.struct(m.alias("model"), moved(m).alias("moved")))
        return F.when((state["moved"] < s.still) | (F.size("patterns") == 0), state).otherwise(after)

    found = patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(s.rounds)), first, step)["model"].alias("m")).first()["m"]  # one row
    return {kind: (found["shares"][k], dict(zip(RULES, found["rates"][k], strict=True))) for k, kind in enumerate(KINDS)}


def apply_rules(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    ``quality`` is the posterior of the good kind; ``kept`` needs it to reach the threshold. A null text has no words and
    fails the base; a null doc_id is a row like any other. Repeated rows each return a row and count each; extra columns
    are ignored; an empty table gives an empty result.
    """
    counts = materialise(document_counts(docs), "rule-counts")
    votes = counts.withColumn("votes", F.array(*(F.expr(sql) for sql in RULES.values())))
    votes = votes.withColumn("good", F.element_at(posteriors(model_column(estimate(votes, s)), F.col("votes")), 1))
    good = F.col("good")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return votes.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (good >= s.threshold)).alias("kept"), F.round(good, 6).alias("quality"))


def rules_sql(s: Settings = Settings()) -> str:  # noqa: B008
    """The same in DuckDB's SQL."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    votes = ", ".join(f"{sql} AS {rule}" for rule, sql in RULES.items())

    model = first_guess(s)
    cells = [(k, r) for k in KINDS for r in RULES]
    names = [*(f"s_{k}" for k in KINDS), *(f"h_{k}_{r}" for k, r in cells)]
    first = ", ".join(f"{x!r}::DOUBLE" for x in [*(model[k][0] for k in KINDS), *(model[k][1][r] for k, r in cells)])
    joint = ", ".join(" * ".join([f"s_{k}", *(f"CASE {r} WHEN 0 THEN h_{k}_{r} WHEN 1 THEN 1 - h_{k}_{r} ELSE 1 END" for r in RULES)]) + f" AS p_{k}" for k in KINDS)
    total = " + ".join(f"p_{k}" for k in KINDS)
    means = [f"(sum(n * p_{k} / ({total})) + 1) / (sum(n) + {len(KINDS)})" for k in KINDS]
    for k, r in cells:
        bad, not_bad = s.good_votes if k == "good" and r in KINDS else s.votes
        share = f"n * p_{k} / ({total})"
        means.append(f"(coalesce(sum({share}) FILTER ({r} = 0), 0) + {bad!r}) / (coalesce(sum({share}) FILTER ({r} IS NOT NULL), 0) + {bad + not_bad!r})")
    made = ", ".join(f"{mean} AS new_{name}, any_value({name}) AS old_{name}" for mean, name in zip(means, names, strict=True))
    moved = ", ".join(f"abs(new_{name} - old_{name})" for name in names)
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: trim(x, {space}) <> '') AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS wc,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
        (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_upper,
        length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))::BIGINT AS n_alnum, (length(text) - length(translate(text, '.!?', '')))::BIGINT AS n_ends,
        len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"'')][ \\t\\n\\x0B\\f\\r]*$')))::BIGINT AS n_end_lines,
        len(list_distinct(words))::BIGINT AS n_distinct, len(list_filter(words, lambda x: length(x) <= 3))::BIGINT AS n_short FROM w),
counts AS (SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines, n_upper, n_alnum, n_ends, n_end_lines, n_distinct, n_short
        FROM c LEFT JOIN r USING (doc_id)),
votes AS MATERIALIZED (SELECT *, {votes} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(RULES)}, count(*)::DOUBLE AS n FROM votes GROUP BY ALL),
em(round, moved, {", ".join(names)}) AS (
  SELECT 0, 1.0::DOUBLE, {first}
  UNION ALL
  SELECT round + 1, greatest({moved}), {", ".join(f"new_{name}" for name in names)}
  FROM (SELECT any_value(round) AS round, {made}
    FROM (SELECT p.*, em.*, {joint} FROM em, patterns p WHERE round < {s.rounds} AND moved >= {s.still!r}) HAVING count(*) > 0)
),
fitted AS (SELECT * FROM em ORDER BY round DESC LIMIT 1),
judged AS (SELECT *, p_good / ({total}) AS q FROM (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {joint} FROM votes v, fitted))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= {s.threshold!r} AS kept, round(q, 6) AS quality FROM judged
"""
