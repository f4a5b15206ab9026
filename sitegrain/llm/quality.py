"""Quality rules as weak supervision (native: no Python on the executors).

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains
(0).  Rows are aggregated by vote pattern, of which there are at most
``3 ** len(RULES)``; expectation-maximisation over that bounded table estimates
the share of good documents and how often each rule, where it votes, is right on
good and on bad ones.  Every kind of fault is in sight of two rules, whose
agreement is what the estimates rest on.  The posterior probability of "good"
replaces "passes every rule": a rule that often objects alone is outvoted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, name, staged, unused, whole_row, word_array

SYMBOLS = "#*$%&|<>"
#: Characters that running text has few of: symbols, brackets, and marks of shouting.
MARKS = "!?|$%&*#@^~=+<>\\/{}[]_"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _repeated_words(hashes: Column) -> Column:
    """Words covered by a window whose hash stands twice or more in the array."""

    def covered(windows):
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, other: F.coalesce(s["x"] == other["x"], F.lit(False))
        starts = let(
            ordered,
            lambda o: F.sort_array(
                F.transform(
                    F.filter(o, lambda s, j: same(s, F.get(o, j - 1)) | same(s, F.get(o, j + 1))), lambda s: s["i"]
                )
            ),
        )
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(
                (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WINDOW))),
    )
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
    )


def features(text: Column) -> Column:
    """Struct of the counts that the rules read; a null text counts as empty.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_lines`` (``\\n``-split lines with a word), ``n_dup_lines`` (of those,
    equal to an earlier one), ``n_repeat_words`` (words in 5-word windows found
    twice or more), ``n_distinct`` (different words), ``n_marks`` (characters of
    ``MARKS``) and ``n_capitals`` (words of two characters or more with a letter,
    all in upper case).  Windows and words are told apart by a 64-bit hash within
    one text.
    """
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    counts = let(
        F.struct(word_array(text).alias("w"), lines.alias("l"), body.alias("t")),
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(v["w"], "")).cast("long").alias("word_chars"),
            (F.length(v["t"]) - F.length(F.translate(v["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            let(
                F.transform(v["w"], lambda x: F.xxhash64(x)),
                lambda h: F.struct(_repeated_words(h).alias("repeated"), F.size(F.array_distinct(h)).cast("long").alias("distinct")),
            ).alias("words"),
            (F.length(v["t"]) - F.length(F.translate(v["t"], MARKS, ""))).cast("long").alias("n_marks"),
            F.size(F.filter(v["w"], lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x)))).cast("long").alias("n_capitals"),
        ),
    )
    plain = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_marks", "n_capitals")
    return let(
        counts,
        lambda c: F.struct(*(c[k].alias(k) for k in plain), c["words"]["repeated"].alias("n_repeat_words"), c["words"]["distinct"].alias("n_distinct")),
    )


def base_failed(f: Column) -> Column:
    """The hard rule: too few words, or too many of them in repeated windows."""
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: name -> vote.  A rule made to detect one fault abstains where it sees none.
RULES = {
    "length": lambda f: _vote(f["n_words"] < 10, f["n_words"] >= 50),
    "word_length": lambda f: _vote(
        (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"]),
        (f["word_chars"] >= 3 * f["n_words"]) & (f["word_chars"] <= 8 * f["n_words"]),
    ),
    "symbols": lambda f: _vote(10 * f["n_symbols"] > f["n_words"], 50 * f["n_symbols"] <= f["n_words"]),
    "marks": lambda f: _vote(5 * f["n_marks"] > f["n_words"], 20 * f["n_marks"] <= f["n_words"]),
    "capitals": lambda f: _vote(10 * f["n_capitals"] > 3 * f["n_words"], 20 * f["n_capitals"] <= f["n_words"]),
    "lines": lambda f: _vote(2 * f["n_dup_lines"] > f["n_lines"], (f["n_dup_lines"] == 0) & (f["n_lines"] > 1)),
    "repetition": lambda f: _vote(
        100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"], 50 * f["n_repeat_words"] <= f["n_words"]
    ),
    # Different words grow with about the root of all words.
    "distinct": lambda f: _vote(f["n_distinct"] * f["n_distinct"] < 9 * f["n_words"], f["n_distinct"] * f["n_distinct"] >= 36 * f["n_words"]),
}

#: Rows of either vote that each rule is taken to have seen in each class beforehand.
SMOOTHING = 2.0


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; per rule, P(objects | it votes) on good and on bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def _logs(self, j: int) -> list[float]:
        """What the votes -1, 0 and 1 of a rule say for "good"; an abstention says nothing."""
        g, b = self.good[j], self.bad[j]
        return [math.log(g / b), 0.0, math.log((1 - g) / (1 - b))]

    def posterior(self, votes: Sequence[int]) -> float:
        z = math.log(self.prior / (1 - self.prior)) + sum(self._logs(j)[v + 1] for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def posterior_column(self, votes: Sequence[Column]) -> Column:
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, v in enumerate(votes):
            low, none, high = self._logs(j)
            z = z + F.when(v == -1, low).when(v == 1, high).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], rules: int, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over (votes, count) rows.

    It starts from the share of votes that say good as the belief in a document.
    The share of good documents and what each rule does are estimated from the
    rows alone, smoothed by ``SMOOTHING`` rows of either kind.  A rule is held to be
    no worse than chance: one that objects to good documents more often than to bad
    ones says nothing.  That, and "good" being the larger class to begin with, keeps
    the classes from swapping.  Without rows nothing is known, and no vote counts.
    """
    belief = [(1 + votes.count(1)) / (2 + votes.count(1) + votes.count(-1)) for votes, _ in patterns]
    model = LabelModel(0.5, (0.5,) * rules, (0.5,) * rules)
    for _ in range(rounds if patterns else 0):
        sides = [[n * q for (_, n), q in zip(patterns, belief, strict=True)], [n * (1 - q) for (_, n), q in zip(patterns, belief, strict=True)]]
        tables = [
            [
                tuple(SMOOTHING + sum(w for (votes, _), w in zip(patterns, rows, strict=True) if votes[j] == v) for v in (-1, 1))
                for j in range(rules)
            ]
            for rows in sides
        ]
        good, bad = ([objects / (objects + agrees) for objects, agrees in table] for table in tables)
        for j in range(rules):
            if good[j] > bad[j]:
                both = [sum(x) for x in zip(tables[0][j], tables[1][j], strict=True)]
                good[j] = bad[j] = both[0] / sum(both)
        total = [sum(rows) + SMOOTHING for rows in sides]
        model = LabelModel(total[0] / sum(total), tuple(good), tuple(bad))
        belief = [model.posterior(votes) for votes, _ in patterns]
    return model


#: Counts that :func:`features` makes.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_marks", "n_capitals")


def judge(df: DataFrame, text: str = "text", out: str = "quality", threshold: float = 0.5, with_text: bool = True) -> DataFrame:
    """Add the struct ``out``: the counts, ``base_failed``, ``posterior``, ``kept``.

    The input is scanned once: rows and their counts are staged in the shared
    folder, the vote patterns are counted there, and the fitted model is applied
    to the staged rows.  ``with_text=False`` leaves the text out of them and of the
    result.  Nothing but the pattern counts (``3 ** len(RULES)`` rows at most)
    reaches the driver.

    Null or empty texts have no words and fail the base rule; a text is judged
    whole, however long; equal counts are judged alike, repeated rows one by one;
    an empty table gives an empty result.  Other columns pass through, whatever
    they are called; one that is already called ``out`` is replaced.
    """
    rows = df.select(whole_row(df, out, *([] if with_text else [text])).alias("row"), features(name(text)).alias("f"))
    rows = staged(rows, "quality")
    f = F.col("f")
    votes = {f"v{k}": rule(f).cast("int") for k, rule in enumerate(RULES.values())}
    counted = rows.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).count().collect()
    patterns = sorted((tuple(r[k] for k in votes), r["count"]) for r in counted)
    posterior = fit(patterns, len(RULES)).posterior_column(list(votes.values()))
    # A bounded CASE over constants: cheap to repeat in both fields.
    verdict = F.struct(
        *(f[k].alias(k) for k in COUNTS),
        base_failed(f).alias("base_failed"),
        posterior.alias("posterior"),
        (~base_failed(f) & (posterior >= threshold)).alias("kept"),
    )
    return rows.select("row.*", verdict.alias(out))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that :func:`judge` keeps, with the columns of ``df``.

    Rows without words go, as do all that fail the base rule; repeated rows all
    stay or all go.
    """
    mark = unused("quality", df)
    judged = judge(df, text, mark)
    return judged.filter(F.col(mark)["kept"]).select(*(name(c) for c in df.columns))


def digest(df: DataFrame) -> DataFrame:
    """One row per document: its counts and the verdict."""
    q = F.col("quality")
    return judge(df.select("doc_id", "text"), "text", with_text=False).select(
        "doc_id", *(q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"))
    )
