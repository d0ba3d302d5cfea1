"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them; built-in column functions only.

Each rule says good, bad or nothing about a text. How often it says each about good and about bad texts, that is, how accurate it is, is estimated from
the votes alone: texts with equal votes are one row of a table of at most 3^rules rows, over which a handful of
aggregations run for each round. A text is kept by its posterior probability of being good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.inline import bound
from draftlake.session import cut

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
ROUNDS = 12
PRIOR = 0.85          # of good texts, before the first round
STRENGTH = 10.0       # texts that the starting values count as, in every round
START = {"good": 0.99, "bad": 0.5}    # how often a rule that speaks is right about good and about bad texts, before the first round
BOUNDS = {"good": (0.99, 0.9999), "bad": (0.2, 0.99)}  # in every round: bad votes are meant for plain faults, so they are seldom wrong


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the text): everything the rules need, in one pass over whole texts without a shuffle.

    A null or empty text has zeros. Words are maximal runs other than space and \\\\t to \\\\r.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn(
        "words", F.filter(F.split(F.col("text"), GAP, -1), lambda w: w != ""))
    n = F.size("words")
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select("doc_id", "text", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), lines.alias("lines"))
    # A window is hashed from its words' hashes by place; slice() would copy the whole array for each window.
    window = lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(WINDOW)))
    runs = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return two.select("*", runs.alias("runs")).select(
        "doc_id", n.cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size(F.array_distinct("runs")) == F.size("runs"), F.lit(0)).otherwise(covered(F.col("runs"))).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"[.?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"))


def covered(runs: Column) -> Column:
    """Words inside windows that occur at least twice: sorted by hash, equal windows stand side by side; back in text order,
    each adds what the one before does not cover. No list grows step by step, so the work is that of the sorts."""
    def noted(ordered: Column) -> Column:
        like = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"]))

    places = bound(F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), noted)
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, begin, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def _vote(good: Column | None, bad: Column | None) -> Column:
    vote = F.lit(0)
    vote = vote if good is None else F.when(good, F.lit(1)).otherwise(vote)
    return vote if bad is None else F.when(bad, F.lit(-1)).otherwise(vote)


def rules() -> dict[str, Column]:
    """Rule -> vote: 1 good, -1 bad, 0 abstains. Rules for one fault say nothing where it is absent: a text without symbols may be
    poor all the same. Ratios are compared as products, so short texts divide by nothing."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": _vote(n >= 30, None),
        "word_length": _vote((chars >= 3 * n) & (chars <= 10 * n) & (n > 0), (chars > 15 * n) | (chars < 2 * n)),
        "variety": _vote((F.col("n_distinct") * 4 > n) & (n >= 16), (F.col("n_distinct") * 6 < n) & (n >= 16) & (n < 2000)),
        "stops": _vote((F.col("n_stops") * 40 >= n) & (n > 0), (F.col("n_stops") * 200 < n) & (n >= 30)),
        "symbols": _vote(None, F.col("n_symbols") * 5 > n),
        "repeats": _vote(None, F.col("n_repeat_words") * 10 > 3 * n),
        "capitals": _vote(None, F.col("n_capitals") * 2 > chars),
        "shouts": _vote(None, F.col("n_shouts") * 5 > n),
        "lines": _vote(None, (F.col("n_dup_lines") * 2 > F.col("n_lines")) & (F.col("n_lines") >= 4)),
    }


def posterior(model: dict[str, float], names: list[str]) -> Column:
    """Probability of a good text, given the votes: log-odds of the prior and of every vote; abstentions say nothing."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name in names:
        good, bad = model[f"good {name}"], model[f"bad {name}"]
        odds = odds + F.when(F.col(name) == 1, math.log(good / (1 - bad))).when(F.col(name) == -1, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Prior and accuracies (``good name``: of the rule's votes on good texts, ``bad name``: on bad ones) by expectation-maximisation.

    ``patterns`` (a column per rule, n) counts equal votes. A round is one aggregation that gives one row of sums; the
    starting values count as ``STRENGTH`` texts in each, so rules that never speak keep them.
    """
    model = {"prior": PRIOR} | {f"{side} {name}": START[side] for side in START for name in names}
    right = {"good": 1, "bad": -1}
    for _ in range(rounds):
        weighed = patterns.withColumn("good", posterior(model, names) * F.col("n")).withColumn("bad", F.col("n") - F.col("good"))
        total = lambda side, when: F.coalesce(F.sum(F.when(when, F.col(side))), F.lit(0.0))
        sums = weighed.agg(
            *(total(side, F.col(name) == vote).alias(f"{side} {name} right") for side, vote in right.items() for name in names),
            *(total(side, F.col(name) != 0).alias(f"{side} {name}") for side in right for name in names),
            *(total(side, F.lit(True)).alias(side) for side in right)).first()
        model = {"prior": (sums["good"] + STRENGTH * PRIOR) / (sums["good"] + sums["bad"] + STRENGTH)}
        for side in right:
            low, high = BOUNDS[side]
            for name in names:
                key = f"{side} {name}"
                model[key] = min(high, max(low, (sums[f"{key} right"] + STRENGTH * START[side]) / (sums[key] + STRENGTH)))
    return model


def judge_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) for every row of ``docs``.

    kept is false where base_failed, else whether the posterior reaches ``threshold``. Rows may repeat, doc_id may be null;
    other columns are not read; an empty table gives no rows.
    """
    measured = cut(measures(docs))
    voted = measured.select("*", *(vote.alias(name) for name, vote in rules().items()))
    names = list(rules())
    patterns = cut(voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1))
    model = estimate(patterns, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.withColumn("probability", posterior(model, names)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("probability") >= threshold)).alias("kept"), "probability")
