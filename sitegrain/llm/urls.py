"""URL filter: host and path rules first, then a small linear model (native).

The model is a logistic regression on hashed character n-grams of host and
path, trained on a small labelled table.  Features are made by the same
DataFrame expressions for training and for scoring; the weights, ``BUCKETS``
numbers, are a constant of the scoring expression.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, name, whole_row

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: Labelled rows that training takes at most; more raise ``ValueError``.
MAX_LABELLED = 10_000

#: (verdict, host, path): the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words of general knowledge that names of unwanted sites are made of, by kind.
_UNWANTED = (
    "casino poker roulette jackpot slots lottery betting bookmaker gambling baccarat "
    "viagra cialis pharmacy pills steroids slimming "
    "porn xxx escorts webcams adult hentai erotic nudes "
    "payday loans forex doubler giveaway sweepstakes "
    "warez keygen cracked torrents serials "
    "adserver adclick tracker popunder clickbank spam linkfarm"
).split()
#: Words that names of ordinary sites are made of.
_WANTED = (
    "news library university weather museum garden recipes science history parliament railway astronomy books "
    "languages mathematics ocean theatre orchestra hospital geology travel cooking school football cinema music "
    "software physics painting bakery cycling hiking farming justice poetry chess photography architecture"
).split()
#: Words that stand in names of either kind and so tell nothing.
_EITHER = "best my new online top world club hub 24 free cheap win the go".split()
_PATHS = ("/en/12.html", "/fr/987?page=2", "/de/45/", "/", "/es/300#top", "", "/index.php", "/a/b/c")


def labelled_names(seed: int = 4) -> list[tuple[str, int]]:
    """(name, label) of the small labelled table: 1 for those to be blocked.

    Names join a word of either list, or for ordinary sites a made-up word, with
    words that stand in both.  No name is taken from any data.
    """
    rng = random.Random(seed)
    made_up = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice(("a", "e", "i", "o", "u", "an", "er", "on")) for _ in range(rng.randint(2, 4))) for _ in range(120)]
    out = []
    for words, label in ((_UNWANTED, 1), (_WANTED + made_up, 0)):
        for word in words:
            shapes = [word, word + "-" + rng.choice(_EITHER), rng.choice(_EITHER) + "-" + word, rng.choice(_EITHER) + word]
            out += [(x, label) for x in shapes]
    return out


def labelled_urls(names: Sequence[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
    """URLs of labelled names: every front, ending and path on both sides."""
    out = []
    for k, (word, label) in enumerate(labelled_names() if names is None else names):
        front, ending = ("www.", "", "blog.", "m.")[k % 4], ("org", "net", "com", "example.org", "example.com")[k % 5]
        out.append((f"https://{front}{word}.{ending}{_PATHS[k % len(_PATHS)]}", label))
    return out


def held_out(spark: SparkSession, parts: int = 4, by_word: bool = False) -> tuple[int, int, int, int]:
    """(unwanted right, unwanted, ordinary right, ordinary) of hosts that were not trained on.

    Names are dealt to ``parts``, which take turns to be judged by a model of the
    others.  ``by_word`` deals all names of a word to one part, so that nothing but
    the word's likeness to other words can tell.
    """
    table = list(enumerate(labelled_names()))
    right, total = {0: 0, 1: 0}, {0: 0, 1: 0}
    for part in range(parts):
        mine = lambda k: (k // 4 if by_word else k // 4 + k) % parts == part  # noqa: B023, E731
        train = spark.createDataFrame(labelled_urls([x for k, x in table if not mine(k)]), "url string, label int")
        asked = spark.createDataFrame(labelled_urls([x for k, x in table if mine(k)]), "url string, label int")
        for r in judge(asked, "url", train).select("label", F.col("url_filter.probability").alias("p")).collect():
            total[r["label"]] += 1
            right[r["label"]] += (r["p"] >= 0.5) == bool(r["label"])
    return right[1], total[1], right[0], total[0]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``.

    The host ends at the first ``/``, ``?`` or ``#``; the path at ``?`` or ``#``.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    before = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(before, "/", 1)
    return F.translate(host, upper, lower), F.substring(before, F.length(host) + 1, F.length(before))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's
    path.  Rules are equal in length only if they are different names, of which
    one host fits no more than one.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, under in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(under))
        name = F.when(fits, at + under).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def buckets(host: Column, path: Column) -> Column:
    """Hashed character n-grams of ``^host$`` and of the path, as bucket numbers.

    Digits count as one character: page numbers say nothing about a site.
    """
    def of_length(t: Column, n: int, salt: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: i <= F.length(t) - (n - 1))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substring(t, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    def grams(text: Column, salt: int) -> Column:
        return let(text, lambda t: F.flatten(F.array(*(of_length(t, n, salt) for n in GRAMS))))

    zeros = lambda c: F.translate(c, "123456789", "0" * 9)
    return F.concat(grams(F.concat(F.lit("^"), zeros(host), F.lit("$")), 1), grams(zeros(path), 2))


def train(rows: Sequence[tuple[Sequence[int], int]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression, by full-batch adaptive gradient steps.

    A row is its bucket numbers and its label; a bucket counts as often as it
    stands there, over the root of the row's length.  Both labels weigh the same,
    however many rows have them.  Steps are scaled per bucket, so a rare n-gram is
    learned as fast as one that every URL has.
    """
    weights, bias = [0.0] * BUCKETS, 0.0
    seen, seen_bias = [1e-9] * BUCKETS, 1e-9
    each = [sum(y == label for _, y in rows) for label in (0, 1)]
    scaled = [(b, 1 / math.sqrt(len(b)) if b else 0.0, y, 1 / (2 * each[y])) for b, y in rows]
    for _ in range(rounds if rows else 0):
        slope: dict[int, float] = {}
        shift = 0.0
        for b, s, y, worth in scaled:
            z = bias + s * sum(weights[k] for k in b)
            off = worth * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            shift += off
            for k in b:
                slope[k] = slope.get(k, 0.0) + off * s
        for k, g in slope.items():
            g += decay * weights[k]
            seen[k] += g * g
            weights[k] -= rate * g / math.sqrt(seen[k])
        seen_bias += shift * shift
        bias -= rate * shift / math.sqrt(seen_bias)
    return weights, bias


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> tuple[list[float], float]:
    """Train on ``labelled`` (url, label), by default on :func:`labelled_urls`."""
    table = labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int")
    host, path = host_and_path(F.col("url"))
    rows = table.filter(F.col("label").isNotNull()).select(buckets(host, path).alias("b"), F.col("label").cast("int").alias("y")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    return train([(r["b"], r["y"]) for r in rows])


def probability(host: Column, path: Column, weights: Sequence[float], bias: float) -> Column:
    """Probability that a URL is to be blocked."""
    table = F.from_json(F.lit("[" + ",".join(repr(round(w, 9)) for w in weights) + "]"), "array<double>")
    found = buckets(host, path)
    score = let(
        F.struct(found.alias("b"), table.alias("w")),
        lambda v: F.aggregate(v["b"], F.lit(0.0), lambda a, k: a + F.get(v["w"], k)) / F.sqrt(F.greatest(F.size(v["b"]), F.lit(1))),
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(score + F.lit(bias))))


def judge(df: DataFrame, url: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Add the struct ``url_filter``: host, path, rule, probability, verdict.

    The verdict is the longest fitting rule's, else ``block`` where the model's
    probability reaches ``threshold``.  A null URL, or one without ``://``, has an
    empty host and path, fits no rule and is judged by the model's bias.  Rows are
    judged one by one: repeated rows alike, none dropped.  A column of that name
    is replaced.
    """
    weights, bias = fit(df.sparkSession, labelled)
    host, path = host_and_path(name(url))
    rule, says = rule_of(F.col("_h"), F.col("_p"))
    out = df.drop("url_filter")
    given = out.select(whole_row(out).alias("row"), host.alias("_h"), path.alias("_p"))
    p = probability(F.col("_h"), F.col("_p"), weights, bias)
    judged = given.select("row", "_h", "_p", rule.alias("_rule"), says.alias("_says"), p.alias("_prob"))
    return judged.select(
        "row.*",
        F.struct(
            F.col("_h").alias("host"),
            F.col("_p").alias("path"),
            F.col("_rule").alias("rule"),
            F.col("_prob").alias("probability"),
            F.coalesce(F.col("_says"), F.when(F.col("_prob") >= threshold, "block").otherwise("allow")).alias("verdict"),
        ).alias("url_filter"),
    )


def digest(df: DataFrame) -> DataFrame:
    """One row per page: host, path, rule and verdict."""
    return judge(df.select("page_id", "url")).select("page_id", "url_filter.*")
