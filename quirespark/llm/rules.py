"""Quality rules: text statistics in DataFrame functions and a learned decision list over them.

learn() covers the low-quality examples one rule at a time: a rule grows by the threshold test of
the largest information gain, is pruned on held-back examples, and is kept while it is precise there;
what it covers is set aside. The ordered rules become one conditional expression (first that holds says no).

Defined results: null or empty text has no word and fails the base rules; without labels, or with
labels of one kind, no rule is learned; every row gets its own result, equal doc_ids too; a document
with several labels counts as low only if all say so; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the rules are learned from: those of the smallest hashes of doc_id.
EXAMPLES = 4000
#: A rule must be right for this share of the held-back examples that it covers.
PRECISION = 0.98
WORD = r"[^\x20\x09-\x0D]+"
FEATURES = ["mean_word", "symbol_share", "bang_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "words"]


class Test(NamedTuple):
    feature: str
    above: bool
    value: float


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and FEATURES of each row of docs(doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    counted = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.when(F.size("h") >= 5, F.transform(F.sequence(F.lit(1), F.size("h") - 4), lambda i: F.xxhash64(*[F.element_at("h", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    grams = counted.withColumn("g", windows).drop("h")
    # Only where a window repeats are windows sorted, to find the places of those that have an equal neighbour.
    by_hash = F.array_sort(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    sorted_ = grams.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), by_hash)).drop("g")
    equal = lambda x, k: F.coalesce(x["g"] == F.get("s", k)["g"], F.lit(False))
    places = F.array_sort(F.filter(F.transform("s", lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), x["i"])), lambda i: i.isNotNull()))
    placed = sorted_.withColumn("p", places).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")))["n"]
    out = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return out.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_bangs") / words).alias("bang_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        F.col("n_words").cast("double").alias("words"),
    )


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best(x: np.ndarray, low: np.ndarray, names: list[str]) -> tuple[float, Test | None]:
    best: tuple[float, Test | None] = (1e-9, None)
    p0, n0 = low.sum(), (~low).sum()
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, y = x[order, j], low[order]
        p, n = np.cumsum(y), np.cumsum(~y)
        ends = np.flatnonzero(v[1:] > v[:-1])  # the thresholds between different values
        if not len(ends):
            continue
        middle = (v[ends] + v[ends + 1]) / 2
        for above, gain in ((False, _gain(p0, n0, p[ends], n[ends])), (True, _gain(p0, n0, p0 - p[ends], n0 - n[ends]))):
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), Test(name, above, float(middle[k])))
    return best


def holds(rule: list[Test], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        v = x[:, names.index(t.feature)]
        out &= v > t.value if t.above else v <= t.value
    return out


def learn(x: np.ndarray, low: np.ndarray, names: list[str] = FEATURES, precision: float = PRECISION, most: int = 20) -> list[list[Test]]:
    """Rules for the low examples: rows of x (features by names) where low is true."""
    rules: list[list[Test]] = []
    held = np.arange(len(x)) % 3 == 2
    grow_x, grow_y, prune_x, prune_y = x[~held], low[~held], x[held], low[held]
    while grow_y.any() and len(rules) < most:
        rule: list[Test] = []
        inside = np.ones(len(grow_x), bool)
        while (~grow_y[inside]).any() and len(rule) < 5:
            _, test = _best(grow_x[inside], grow_y[inside], names)
            if test is None:
                break
            rule.append(test)
            inside = holds(rule, grow_x, names)
        if not rule:
            break

        def worth(r: list[Test]) -> tuple[float, int]:
            on = holds(r, prune_x, names)
            p, n = prune_y[on].sum(), (~prune_y[on]).sum()
            return (float(p - n) / max(1.0, float(p + n)), -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        on = holds(rule, prune_x, names)
        if prune_y[on].sum() < 2 or prune_y[on].mean() < precision:
            break
        rules.append(rule)
        keep = ~holds(rule, grow_x, names)
        grow_x, grow_y = grow_x[keep], grow_y[keep]
        prune_x, prune_y = prune_x[~on], prune_y[~on]
    return rules


def expression(rules: list[list[Test]]) -> Column:
    """0 where no rule holds, else the number of the first that does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for t in rule:
            test = test & (F.col(t.feature) > t.value if t.above else F.col(t.feature) <= t.value)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def learn_from(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> list[list[Test]]:
    """Rules from at most `examples` rows of labelled documents: labels(doc_id, quality), 0 is low."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 0).alias("low"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # at most `examples` ids
    numbers = statistics(own.select("doc_id", "text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "low", *FEATURES)
    rows = numbers.orderBy(F.xxhash64("doc_id"), *numbers.columns).limit(examples).collect()  # one document may have several rows
    if not rows:
        return []
    return learn(np.array([[r[f] for f in FEATURES] for r in rows], float), np.array([r.low for r in rows], bool))


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """statistics() with base_failed, rule (number of the first that holds, else 0) and kept."""
    base = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
    return statistics(docs).withColumn("base_failed", F.expr(base)).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
