"""URL filters: rules by host and path, and a model for the other URLs.

Method: logistic regression on hashed character n-grams of host and path,
trained by full-batch gradient steps from a small labelled URL table.  Scores
and gradients are DataFrame expressions; only the weights, of a fixed number,
pass through the driver.
"""

from __future__ import annotations

import json
import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, let

#: Weights, lengths of n-grams, labelled URLs of each class that are learned from at most, and gradient steps.
WEIGHTS, GRAMS, LABELLED, STEPS = 4096, (3, 4, 5), 1000, 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(_jl_url, locate('://', _jl_url) + 3)")).otherwise(F.lit(""))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), ascii_uppercase, ascii_lowercase), part(2)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    rows = df.withColumn("_jl_url", F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col("_jl_url"))
    return rows.withColumns({"host": host, "path": path}).drop("_jl_url")


def matched_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and what it says; else null.

    rules: (allow or block, host and path as one string), some hundreds at most.
    Of rules of the same length the first wins.
    """
    rule = said = None
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    return (rule, said) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def features(host: Column, path: Column, weights: int = WEIGHTS) -> Column:
    """Distinct weight numbers of the character n-grams, ends marked; in time that grows with the text's length."""
    none = F.array().cast("array<int>")

    def grams(kind: str, letters: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1)))
        return F.when(F.size(letters) >= n, F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.array_join(F.slice(letters, i, n), "")), F.lit(weights)).cast("int"))).otherwise(none)

    def all_of(kind: str, text: Column) -> Column:
        letters = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
        return let(letters, lambda x: F.concat(*[grams(kind, x, n) for n in GRAMS]))

    return F.array_distinct(F.concat(all_of("h", host), all_of("p", path)))


def _literal(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def score(found: Column, weights: list[float]) -> Column:
    """Chance that the label is 1; weights: the bias last."""
    table = _literal(weights)
    # the found numbers are worked out once, though two parts of the formula name them
    total = lambda known: F.aggregate(F.transform(known, lambda f: table[f]), F.lit(0.0), lambda a, x: a + x)
    return let(found, lambda known: 1 / (1 + F.exp(-(total(known) / F.sqrt(F.greatest(F.size(known), F.lit(1)).cast("double")) + weights[-1]))))


def train(labelled: DataFrame, steps: int = STEPS, rate: float = 4.0, shrink: float = 1e-3) -> list[float]:
    """Weights from columns host, path and label (0 or 1); the bias comes last.

    Both labels weigh the same in total.  With labels of one kind or none there is nothing to tell apart: all weights
    are 0 and the bias says that kind, or allow.  Each step is one aggregation whose result has a row for each weight
    at most.
    """
    rows = Table(labelled.select(F.col("label").cast("double").alias("y"), features(F.col("host"), F.col("path")).alias("f")).coalesce(4))  # a small table
    blocked, n = rows.df.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    if not 0 < blocked < n:
        rows.drop()
        return [0.0] * WEIGHTS + [2.0 if blocked else -2.0]
    even = F.when(F.col("y") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked)))
    weights, speed = [0.0] * (WEIGHTS + 1), [0.0] * (WEIGHTS + 1)
    for _ in range(steps):
        ahead = [w + 0.8 * v for w, v in zip(weights, speed, strict=True)]
        missed = rows.df.select((even * (F.col("y") - score(F.col("f"), ahead))).alias("e"), "f").select((F.col("e") / F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))).alias("part"), F.explode(F.concat(F.col("f"), F.array(F.lit(WEIGHTS)))).alias("w"), (F.col("e")).alias("e"))
        slope = {r["w"]: r["g"] for r in missed.groupBy("w").agg(F.sum(F.when(F.col("w") == WEIGHTS, F.col("e")).otherwise(F.col("part"))).alias("g")).collect()}
        for k in range(WEIGHTS + 1):
            speed[k] = 0.8 * speed[k] + rate * (slope.get(k, 0.0) / n - shrink * ahead[k])
            weights[k] += speed[k]
    rows.drop()
    return [w if math.isfinite(w) else 0.0 for w in weights]


def labelled_by_rules(pages: DataFrame, at_most: int = LABELLED) -> DataFrame:
    """A small labelled URL table: distinct host, path and label (1: block) of pages with a rule.

    Of each label at most at_most, those of the least hash, are taken.
    """
    known = pages.where(F.col("_jl_said").isNotNull()).select("host", "path", (F.col("_jl_said") == "block").cast("int").alias("label")).distinct()
    pick = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("host", "path"), "host", "path").limit(at_most)
    return pick(0).unionAll(pick(1))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and block_score.

    A URL that a rule fits gets the rule's verdict, any other the model's: block
    if its score is threshold or more.  labelled: host, path, label; if None, the
    URLs with a rule are the labelled table.  A null URL or one without `://` has
    an empty host and path, which no rule with a path fits; the model judges it.
    """
    rule, said = matched_rule(rules)
    made = ("host", "path", "rule", "verdict", "block_score")
    rows = split_url(pages.drop(*(c for c in made if c != url)), url).withColumns({"rule": rule, "_jl_said": said})
    weights = train(labelled_by_rules(rows) if labelled is None else labelled)
    rows = rows.withColumn("block_score", score(features(F.col("host"), F.col("path")), weights))
    return rows.withColumn("verdict", F.coalesce("_jl_said", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))).drop("_jl_said")
