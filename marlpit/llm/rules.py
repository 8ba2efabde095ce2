"""Quality rules as weak supervision. DataFrame operations only.

Heuristic rules on a text's statistics vote good or bad, or abstain. Expectation-maximisation over the counts of
vote patterns (at most 3 ** rules of them, whatever the table's size) estimates each rule's accuracy in either
class and the share of good texts; the posterior probability of good, from all votes of a text, replaces the
demand that every rule pass. Hard failures (too few words, mostly repeated words) are never kept, and the
estimates are made without them.

A null text counts as an empty one: no words, a hard failure. Ties and repeated rows get equal results; an empty
table gives an empty one; other columns of docs are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.text import materialize

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_letters, n_ended): all long.

    n_repeat_words sorts one long per 3-word window, made of a 64-bit hash's upper bits and the window's place
    (as many bits as the text's length needs), so windows found twice are neighbours. Hash bits only propose: the
    proposed windows' words are sorted and compared, so the count is exact at every length.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bare = F.btrim(F.col("t"), F.lit(SPACE))
    t = t.select("id", "t", F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    t = t.withColumn("n", F.size("w"))
    t = t.withColumn("bits", F.length(F.bin("n")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long")))
    t = t.withColumn("mask", mask).withColumn("s", F.when(F.col("n") >= 3, F.sort_array(grams)).otherwise(F.array().cast("array<bigint>")))

    def twice(x: Column, i: Column) -> Column:
        same = lambda y: F.call_function("shiftright", x.bitwiseXOR(y), F.col("bits")) == 0
        return F.coalesce(same(F.get("s", i + 1)), F.lit(False)) | F.coalesce(same(F.get("s", i - 1)), F.lit(False))

    def words(x: Column) -> Column:
        at = x.bitwiseAND(F.col("mask"))
        three = (F.get("w", (at + i).cast("int")) for i in range(3))  # words have no white space
        return F.struct(F.concat_ws(" ", *three).alias("words"), at.alias("at"))

    t = t.withColumn("g", F.sort_array(F.transform(F.filter("s", twice), words)))
    neighbour = lambda x, i: F.coalesce(F.get("g", i)["words"] == x["words"], F.lit(False))
    t = t.withColumn("places", F.sort_array(F.transform(F.filter("g", lambda x, i: neighbour(x, i + 1) | neighbour(x, i - 1)), lambda x: x["at"])))
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("places", i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("t", pattern, "")).cast("long")

    ended = F.filter("lines", lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*".!?\"'”»…:;"))
    return t.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        left(r"[\x20\x09-\x0D]+").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        left(r"[^\p{Lu}]+").alias("n_capitals"),
        left(r"[^\p{L}]+").alias("n_letters"),
        F.size(ended).cast("long").alias("n_ended"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of statistics(): 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    symbols, repeats, length = F.col("n_symbols") / words, F.col("n_repeat_words") / words, F.col("word_chars") / words
    return {
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "repeats": _vote(repeats < 0.1, repeats > 0.3),
        "lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * lines),
        "length": _vote(length.between(3.5, 9), (length < 2.5) | (length > 14)),
        "capitals": _vote(F.col("n_capitals") < 0.1 * F.col("n_letters"), F.col("n_capitals") > 0.3 * F.col("n_letters")),
        "letters": _vote(F.col("n_letters") > 0.88 * chars, F.col("n_letters") < 0.8 * chars),
        "ends": _vote(F.col("n_ended") > 0.5 * lines, F.col("n_ended") < 0.1 * lines),
    }


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of good, for each rule the probability of each vote given good and given bad) from counted vote patterns.

    Starts from doubt about every text with a vote for bad; one count of each vote is added to each class, so no
    probability is 0.
    """
    if not patterns:
        return 0.5, []
    rules = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    good = [0.1 if -1 in p else 0.9 for p, _ in patterns]
    share, tables = 0.5, []
    for _ in range(rounds):
        mass = sum(g * n for g, (_, n) in zip(good, patterns))
        share = min(max((mass + 1) / (total + 2), 1e-6), 1 - 1e-6)
        tables = []
        for j in range(rules):
            table = {}
            for v in (-1, 0, 1):
                g = sum(q * n for q, (p, n) in zip(good, patterns) if p[j] == v)
                b = sum((1 - q) * n for q, (p, n) in zip(good, patterns) if p[j] == v)
                table[v] = ((g + 1) / (mass + 3), (b + 1) / (total - mass + 3))
            tables.append(table)
        new = []
        for p, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(p))
            new.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        moved = max(abs(a - b) for a, b in zip(good, new))
        good = new
        if moved < 1e-9:
            break
    return share, tables


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """statistics() with base_failed, posterior (probability of good) and kept."""
    found = materialize(statistics(docs, id_col, text_col), "statistics")
    rules = votes()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = found.where(~failed).select(*(v.alias(k) for k, v in rules.items())).groupBy(*rules).count().collect()  # at most 3 ** 7 rows
    share, tables = em(sorted((tuple(r)[:-1], r["count"]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for vote, table in zip(rules.values(), tables):
        weight = {v: math.log(g / b) for v, (g, b) in table.items()}
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    posterior = 1 / (1 + F.exp(-odds))
    return found.withColumnRenamed("id", id_col).select("*", failed.alias("base_failed"), posterior.alias("posterior"), (~failed & (posterior >= threshold)).alias("kept"))
