"""Benchmark decontamination by spaced seeds, in DataFrame functions only (operator 6).

A seed hashes six words of a short window and ignores the others, so a substituted word at an ignored place does not
hide the match. The two masks together hit every run of WINDOW words with at most two substitutions. Documents' seeds
are looked up in the benchmark's; the diagonals they meet on are gathered without the words, each once, and only
documents with hits fetch their words for these. The passage counts where some WINDOW aligned words agree in at least
NEEDED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import BROADCAST_KEYS, ROW, computed, let, materialise, numbered

WINDOW, NEEDED = 13, 11  # an agreement of 0.8 or more
#: Offsets of the words that a seed reads; the two leave no pair of substitutions in WINDOW words uncovered.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Seeds of a benchmark up to this many are broadcast (32 bytes each), with the items' words; of a larger benchmark the
#: documents' seeds are shuffled (24 bytes each), and only documents with hits fetch their words again. Equal results.
BROADCAST_SEEDS = 1_000_000
#: Tasks that share a seed beyond that.
SALTS = 16
#: Places of an item in a document that a row holds; rows of a document for each copy of its words, and most copies.
STARTS, ROWS_A_PART, MOST_PARTS = 1024, 64, 64


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (null: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: DataFrame, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """A row for each place and mask of each row's ``words``: ``keep``, at, seed."""
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    hashes = [F.when(F.col("at") + mask[-1] < F.size("words"), F.xxhash64(F.lit(k), *(F.get("words", F.col("at") + o) for o in mask))) for k, mask in enumerate(masks)]
    placed = words.select(*keep, "words", F.explode_outer(places).alias("at"))
    return placed.select(*keep, "at", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def _agreement(start: Column) -> Column:
    """(matched, -start) of the item's words laid on the document's from ``start`` on; null where that is no match.

    The places of unequal words tell both: how many agree, and whether some WINDOW words lie between one of them and the
    third after it, so that they hold two at most.
    """
    low, high = F.greatest(F.lit(0), -start), F.least(F.size("item_words"), F.size("words") - start)
    unequal = F.filter(F.sequence(low, high - 1), lambda j: F.get("item_words", j) != F.get("words", start + j))
    miss = WINDOW - NEEDED
    wide = lambda ends: F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ends) - miss - 2)), lambda k: F.coalesce(F.get(ends, k + miss + 1), high) - F.get(ends, k) > WINDOW)
    found = lambda u: F.when(F.size("item_words") < WINDOW, (high - low == F.size("item_words")) & (F.size(u) == 0)).otherwise(wide(F.concat(F.array(low - 1), u, F.array(high))))
    return F.when(high > low, let(unequal, lambda u: F.when(found(u), F.struct((high - low - F.size(u)).alias("matched"), (-start).alias("back")))))


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, starts_a_row: int = STARTS) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, item_words, matched_words, doc_start.

    ``matched_words`` counts the equal words on the best diagonal, ``doc_start`` is the word of the document where the
    item's first word falls on it (negative where the document begins within the item). An item of fewer than WINDOW
    words must stand in the document word for word. Null or empty texts match nothing, items without words neither, and
    rows with a null doc_id or item_id are left out; of equal matches the first place counts; repeated rows give one row;
    extra columns are ignored; empty tables give an empty result. A text that repeats itself meets an item at each place
    once, however often its seeds do, and its places are judged in rows of ``starts_a_row``, dealt to all tasks.
    """
    items = materialise(benchmark.where("item_id is not null").select("item_id", plain_words(F.col("text")).alias("words")).where(F.size("words") > 0).dropDuplicates(), "benchmark-words")
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # below WINDOW: a dozen at most
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    lookup = items.select(F.col("item_id").alias("item"), F.col("words").alias("item_words"))
    seeds = _seeds(items.withColumnRenamed("item_id", "item"), masks, "item", "words").select("seed", "item", F.col("at").alias("item_at"), F.col("words").alias("item_words"))
    whole = [F.when(F.size("item_words") == n, F.xxhash64(F.lit(len(MASKS) + k), *(F.get("item_words", F.lit(o)) for o in range(n)))) for k, n in enumerate(short)]
    long_or_whole = (F.size("item_words") >= WINDOW) | (F.col("seed") == F.coalesce(*whole, F.lit(None).cast("long")))
    seeds = materialise(seeds.where(long_or_whole).select("seed", "item", "item_at").distinct(), "benchmark-seeds")
    few = seeds.count() <= broadcast_seeds  # then few words too: a seed or two a word
    words = numbered(computed(docs.where("doc_id is not null").select("doc_id", "text"), "words", plain_words(F.col("text"))).select("doc_id", "words"), "document-words")
    asked = _seeds(words.select(ROW, "words"), masks, ROW)
    if few:
        met = asked.join(F.broadcast(seeds), "seed")
    else:  # a seed that a third of the documents hold is dealt by SALTS, with its places in the benchmark at each
        asked = asked.withColumn("salt", F.pmod(F.xxhash64(ROW), F.lit(SALTS)).cast("int"))
        met = asked.join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["seed", "salt"])
    starts = met.select(ROW, "item", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    part = F.floor((F.col("start") + (1 << 30)) / starts_a_row).cast("int")
    hits = materialise(starts.groupBy(ROW, "item", part.alias("part")).agg(F.collect_list("start").alias("starts")), "seed-hits")  # starts_a_row starts at most
    hit_rows = materialise(hits.groupBy(ROW).agg(F.least(F.lit(MOST_PARTS), F.ceil(F.count("*") / ROWS_A_PART)).cast("int").alias("parts")), "hit-rows")
    found = words.join(F.broadcast(hit_rows) if hit_rows.count() <= BROADCAST_KEYS else hit_rows, ROW)  # documents without a hit stay where they are
    found = found.select(ROW, "doc_id", "words", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal"))
    hits = hits.join(F.broadcast(hit_rows) if hit_rows.count() <= BROADCAST_KEYS else hit_rows, ROW).withColumn("deal", F.pmod(F.xxhash64("item", "part"), F.col("parts")).cast("int")).drop("parts")
    pairs = hits.join(F.broadcast(lookup) if few else lookup, "item").join(found.select(ROW, "doc_id", "words", "deal"), [ROW, "deal"])
    best = F.array_max(F.transform("starts", _agreement))
    found = computed(pairs.select("doc_id", "item", F.size("item_words").alias("n"), best.alias("m")), "best", F.col("m")).where("best is not null")
    found = found.groupBy("doc_id", F.col("item").alias("item_id")).agg(F.max(F.struct("best.matched", "best.back", "n")).alias("m"))
    return found.select("doc_id", "item_id", F.col("m.n").cast("long").alias("item_words"), F.col("m.matched").cast("long").alias("matched_words"), (-F.col("m.back")).cast("long").alias("doc_start"))


#: The same in DuckDB's SQL; runs of four equal words stand in for the seeds (a window with two substitutions holds one),
#: and the first word for items below WINDOW words.
DECONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS iw FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS dw FROM documents),
bw AS (SELECT item_id, unnest(iw) AS w, unnest(range(1, len(iw) + 1)) AS j FROM b WHERE len(iw) >= {WINDOW}),
dx AS (SELECT doc_id, unnest(dw) AS w, unnest(range(1, len(dw) + 1)) AS i FROM d),
bs AS (SELECT item_id, j, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS s FROM bw WINDOW o AS (PARTITION BY item_id ORDER BY j)),
ds AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS s FROM dx WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT DISTINCT doc_id, item_id, i - j AS start FROM ds JOIN bs USING (s)),
e AS (SELECT doc_id, item_id, start, len(iw) AS n, iw, dw, unnest(range(1, len(iw) + 1)) AS j FROM c JOIN b USING (item_id) JOIN d USING (doc_id)),
f AS (SELECT doc_id, item_id, start, n, j, (iw[j] = dw[start + j])::INT AS eq FROM e WHERE start + j BETWEEN 1 AND len(dw)),
g AS (SELECT *, sum(eq) OVER w AS agree, count(*) OVER w AS width FROM f WINDOW w AS (PARTITION BY doc_id, item_id, start ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)),
v AS (SELECT doc_id, item_id, start, any_value(n) AS n, sum(eq) AS matched FROM g GROUP BY ALL HAVING bool_or(width = {WINDOW} AND agree >= {NEEDED})),
s AS (SELECT doc_id, item_id, i - 1 AS start, len(iw) AS n FROM b JOIN dx ON iw[1] = w JOIN d USING (doc_id) WHERE len(iw) BETWEEN 1 AND {WINDOW - 1} AND dw[i:i + len(iw) - 1] = iw)
SELECT doc_id, item_id, n::BIGINT AS item_words, matched::BIGINT AS matched_words, start::BIGINT AS doc_start
FROM (SELECT doc_id, item_id, start, n, matched FROM v UNION ALL SELECT doc_id, item_id, start, n, n FROM s) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""
