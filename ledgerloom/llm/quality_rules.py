"""Weak supervision for document quality, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation
over the vote patterns of *all* documents estimates how accurate every rule is
on either class, without labels, and the posterior probability of "good"
replaces an all-must-pass filter.

The number of vote patterns is at most 3 ** len(RULES) at any input size, so
the pattern counts are one small aggregated table; documents never leave the
executors.

Defined cases: a null or empty text has no words, every rule abstains and the
posterior is the estimated share of good documents; an empty table returns an
empty table; repeated rows are scored alike, row by row; other columns are
kept whatever their names, but for those that ``score_quality`` sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, text_or_empty, words_of

#: Name, statistic, vote bad at or above, vote good at or below (None: no such vote).
RULES = (
    ("symbols", "symbol_ratio", 0.05, 0.01),
    ("duplicate_lines", "dup_line_ratio", 0.50, 0.05),
    ("repeated_words", "repeat_ratio", 0.50, 0.20),
    ("shouting", "upper_ratio", 0.50, 0.20),
    ("exclamation", "exclaim_ratio", 0.25, 0.05),
    ("tables", "pipe_ratio", 0.20, 0.01),
    ("long_words", "word_length", 14.0, 11.0),
    ("digits", "digit_ratio", 0.30, 0.05),
)
EM_ROUNDS = 40
# Pseudo-counts, as shares by vote (1 good, -1 bad): good documents; a
# component's own rule; the other rules there.  Abstaining tells nothing.
GOOD = {1: 0.99, -1: 0.01}
OWN = {1: 0.05, -1: 0.95}
OTHER = {1: 0.75, -1: 0.25}


def _size_diff(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` a text holds."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    The windows are sorted by a 64-bit hash within the row, so equal windows
    stand side by side: n log n in the words of one text, no shuffle.
    """

    def covered(windows: Column) -> Column:
        starts = F.filter(
            F.transform(
                windows,
                lambda x, i: F.when(
                    (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]), x["p"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return let(
            F.sort_array(starts),
            lambda s: F.aggregate(
                F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered)).cast("long")


#: Columns that scoring sets.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_pipes", "n_digits")
RESULT = (*STATISTICS, "votes", "quality_probability", "good")


def rule_statistics(rows: DataFrame) -> DataFrame:
    """The counts that the rules look at beside (row, text), in one pass over each text."""
    t = F.col("text")
    out = rows.withColumns({"words": words_of(t), "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _size_diff(t, "#*$%&|<>"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": let(F.col("words"), _repeat_words),
        "n_upper": _size_diff(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaim": _size_diff(t, "!"),
        "n_pipes": _size_diff(t, "|"),
        "n_digits": _size_diff(t, "0123456789"),
    }
    return out.select("row", *(counts[c].alias(c) for c in STATISTICS))


def _ratios() -> dict[str, Column]:
    c = F.col

    def over(a: str, b: str) -> Column:
        return F.try_divide(c(a), c(b))

    return {
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "upper_ratio": over("n_upper", "word_chars"),
        "exclaim_ratio": over("n_exclaim", "n_words"),
        "pipe_ratio": over("n_pipes", "n_words"),
        "word_length": over("word_chars", "n_words"),
        "digit_ratio": over("n_digits", "word_chars"),
    }


def votes() -> Column:
    """The rules' votes as one array of tinyint: 1 good, -1 bad, 0 abstain."""
    ratio = _ratios()
    return F.array(
        *(
            F.when(ratio[stat] >= bad, -1).when(ratio[stat] <= good, 1).otherwise(0).cast("tinyint")
            for _, stat, bad, good in RULES
        )
    )


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> list[tuple[float, list[dict]]]:
    """EM over (votes, count): a share and vote probabilities for each component.

    Component 0 is the good documents.  Bad documents fail in different ways,
    so each rule has a component of its own for the documents that it is first
    to reject; within a component votes are independent.  The start takes a
    document as probably bad once any rule says so, and small pseudo-counts
    keep the components from changing places; from there the counts of all
    documents decide how far each rule can be believed.
    """
    size, total = len(RULES), sum(n for _, n in patterns)
    resp = []
    for v, _ in patterns:
        against = [j for j, x in enumerate(v) if x < 0]
        good = 0.02 if against else 0.98
        each = against or range(size)
        resp.append([good] + [(1 - good) / len(each) if j in each else 0.0 for j in range(size)])
    model: list[tuple[float, list[dict]]] = []
    for _ in range(rounds):
        model = []
        for k in range(size + 1):
            weight = [n * r[k] for (_, n), r in zip(patterns, resp, strict=True)]
            prior = (0.01 if k == 0 else 0.002) * max(total, 1)
            rules = []
            for j in range(size):
                a = {x: prior * p for x, p in (GOOD if k == 0 else OWN if j == k - 1 else OTHER).items()}
                for (v, _), w in zip(patterns, weight, strict=True):
                    if v[j]:
                        a[v[j]] += w
                rules.append({x: y / sum(a.values()) for x, y in a.items()})
            model.append(((sum(weight) + prior) / (max(total, 1) * (1.01 + 0.002 * size)), rules))
        resp = []
        for v, _ in patterns:
            logs = [math.log(share) + sum(math.log(t[x]) for t, x in zip(rules, v, strict=True) if x) for share, rules in model]
            top = max(logs)
            e = [math.exp(x - top) for x in logs]
            resp.append([x / sum(e) for x in e])
    return model


def accuracies(model: list[tuple[float, list[dict]]]) -> dict[str, float]:
    """P(a rule's vote is right | it votes), as the fitted model has it."""
    out = {}
    for j, (name, *_) in enumerate(RULES):
        right = model[0][0] * model[0][1][j][1] + sum(s * t[j][-1] for s, t in model[1:])
        out[name] = right / sum(s * (t[j][1] + t[j][-1]) for s, t in model)
    return out


def posterior(votes_col: Column, model: list[tuple[float, list[dict]]]) -> Column:
    """P(good | votes) as an expression over the fitted constants."""

    def weight(share: float, rules: list[dict]) -> Column:
        z = F.lit(math.log(share))
        for j, t in enumerate(rules):
            v = votes_col[j]
            z = z + F.when(v == 1, math.log(t[1])).when(v == -1, math.log(t[-1])).otherwise(0.0)
        return F.exp(z)

    parts = [weight(*m) for m in model]
    bad = parts[1]
    for p in parts[2:]:
        bad = bad + p
    return parts[0] / (parts[0] + bad)


def score_rows(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (the table's own row, or its columns ``keep``), the statistics, ``votes``, ``quality_probability`` and ``good``.

    One pass over the texts writes the statistics and votes beside the rows to
    the shared folder; the pattern counts and the scores read those.  Nothing
    is shuffled but the pattern counts.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    voted = rule_statistics(docs.select(row.alias("row"), text_or_empty(text).alias("text"))).withColumn("votes", votes())
    voted = materialize(voted, "rule-votes")
    rows = voted.groupBy("votes").count().collect()  # at most 3 ** len(RULES) rows at any size
    model = fit(sorted((tuple(r["votes"]), r["count"]) for r in rows))
    return voted.withColumn("quality_probability", posterior(F.col("votes"), model)).withColumn(
        "good", F.col("quality_probability") >= F.lit(threshold)
    )


def score_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The table (or its columns ``keep``) with the columns of RESULT; its own columns of those names give way."""
    given = docs.columns if keep is None else keep
    scored = score_rows(docs, text, threshold, tuple(c for c in given if c.lower() not in RESULT) or (docs.columns[0],))
    return scored.select("row.*", *RESULT)


def base_failed() -> Column:
    """Too few words, or most words inside repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
