"""Quality of documents by weak supervision, in DataFrame expressions only.

Measures of a text are array expressions over its words and lines, so texts are neither exploded nor shuffled.  Rules turn measures into
votes (1 good, -1 poor, 0 abstains).  How often each rule votes how on good and on poor documents is estimated without labels, by
expectation-maximisation over the counts of vote patterns (a table of at most 3 to the number of rules rows, whatever the corpus
size).  A document is kept where the posterior probability of good quality is at least one half.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture.session import store

#: White space between words, as a character class and as characters.
GAP = r"[\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"\p{Lu}"
MARKS = r"[.,;:!?]"


def measures(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measures of every text; null counts as empty.

    word_chars: code points in words; n_symbols: characters of ``SYMBOLS``; n_capitals: upper-case letters; n_marks: characters of ``MARKS``; n_lines: lines with a word; n_dup_lines: of these, those equal
    to an earlier one; n_distinct: different words; n_repeat_words: words inside 3-word windows that occur twice or more in the text.  Windows
    are compared by 64-bit hashes within one text.
    """
    empty = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(*keep, text.alias("_text"))
    rows = rows.withColumn("_body", F.btrim("_text", F.lit(GAPS)))
    rows = rows.withColumn("_words", F.when(F.col("_body") == "", empty).otherwise(F.split("_body", GAP)))
    rows = rows.withColumn("n_words", F.size("_words").cast("bigint"))
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(3)])
    last = F.size("_words") - 3
    rows = rows.withColumn("_windows", F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), window)))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(GAPS)) != "")
    rows = rows.withColumn("_lines", lines)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sort = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(repeats, sort))
    met = lambda x, k: ((k > 0) & (F.get("_sorted", k - 1)["h"] == x["h"])) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_sorted", met), lambda x: x["i"]))
    rows = rows.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    found = {"n_symbols": SYMBOLS, "n_capitals": CAPITALS, "n_marks": MARKS}
    return rows.select(
        *keep,
        "n_words",
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        *[(F.size(F.split("_text", kind, -1)) - 1).cast("bigint").alias(name) for name, kind in found.items()],
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The rules that no vote overrides: too short, or mostly repetition."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Vote of each rule: -1 poor, 1 good, 0 abstains.  Bounds are in whole numbers, so that votes don't depend on rounding.

    A rule that looks for one defect votes poor or abstains, as the absence of one defect says little; what votes good looks at several sides.
    """
    n, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    poor = lambda condition: F.when(condition, -1).otherwise(0)
    good = lambda condition: F.when(condition, 1).otherwise(0)
    clean = (50 * symbols <= n) & (10 * F.col("n_capitals") <= 4 * n) & (10 * F.col("n_marks") <= 4 * n)
    return {
        "symbols": poor(10 * symbols > n),
        "repeats": poor(100 * F.col("n_repeat_words") > 30 * n),
        "lines": poor(10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        "word_length": poor((chars < 3 * n) | (chars > 12 * n)),
        "capitals": poor(10 * F.col("n_capitals") > 6 * n),
        "marks": poor(10 * F.col("n_marks") > 6 * n),
        "variety": poor(10 * F.col("n_distinct") < 2 * n),
        "prose": good(clean & (2 * chars >= 7 * n) & (chars <= 9 * n)),
        "variation": good(clean & (10 * F.col("n_distinct") >= 3 * n) & (2 * F.col("n_dup_lines") <= F.col("n_lines"))),
    }


def estimate(patterns: Mapping[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Prior of good quality, and for each rule P(vote | poor), P(vote | good), by expectation-maximisation from the majority vote.

    Counts are smoothed by one, so no vote is impossible.  Without documents all is even.
    """
    order = sorted(patterns)
    n_rules = len(order[0]) if order else 0
    good = [1 / (1 + math.exp(-sum(p))) for p in order]
    prior, table = 0.5, [dict.fromkeys((-1, 0, 1), (1 / 3, 1 / 3)) for _ in range(n_rules)]
    for _ in range(rounds):
        total = sum(patterns[p] for p in order)
        positive = sum(patterns[p] * g for p, g in zip(order, good))
        prior = (positive + 1) / (total + 2)
        for j in range(n_rules):
            for v in (-1, 0, 1):
                a = sum(patterns[p] * (1 - g) for p, g in zip(order, good) if p[j] == v)
                b = sum(patterns[p] * g for p, g in zip(order, good) if p[j] == v)
                table[j][v] = ((a + 1) / (total - positive + 3), (b + 1) / (positive + 3))
        good = [1 / (1 + math.exp(-log_odds(p, prior, table))) for p in order]
    return prior, table


def log_odds(pattern: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    value = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][1] / table[j][v][0]) for j, v in enumerate(pattern))
    return max(-500.0, min(500.0, value))


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, measures, votes, base_failed, posterior, kept) for every row.

    Accuracies are estimated over all rows that pass the base rules.  Empty tables give no rows; null, empty and blank texts fail the base rules.
    """
    votes = rules()
    names = [f"vote_{k}" for k in votes]
    measured = measures(df, text_col, (id_col,)).withColumn("base_failed", base_failed())
    voted = store(measured.withColumns(dict(zip(names, votes.values()))))
    counts = voted.filter(~F.col("base_failed")).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    prior, table = estimate({tuple(r[k] for k in names): r["n"] for r in counts})
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, row in zip(names, table):
        weight = {v: math.log(g / p) for v, (p, g) in row.items()}
        odds = odds + F.when(F.col(name) == -1, weight[-1]).when(F.col(name) == 1, weight[1]).otherwise(weight[0])
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))
    scored = voted.withColumn("posterior", posterior)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
