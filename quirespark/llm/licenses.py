"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a paragraph (text between blank lines), a template the words of a license notice. They match when some
REACH * size consecutive words of the block, size being the number of the template's different words, contain at least
THRESHOLD of these and each of the template's phrases that a notice of its kind can't lack.

Words are ordered by their document frequency over all blocks, rarest first. A template of size s
that needs o common words can only match a block that holds one of its s - o + 1 rarest (prefix
filter), has o template words at all (length filter), and has enough words left after the place
where both meet (positional filter). Candidates come from an equi-join on prefix words and are
counted in full, window by window around the phrases. DataFrame functions only.

Besides, the base phrases are found at all their word positions.

Defined results: null or empty text has no word, no place and no label; every row gets its own
result, equal doc_ids too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Words of a window for each of the template's.
REACH = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Phrase and label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
class Template(NamedTuple):
    label: str
    text: str
    must: tuple[str, ...]  # phrases, all of which must be there

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    def need(self, threshold: float) -> int:
        return ceil(threshold * len(self.words) - 1e-9)


#: Label, notice as the licenses' owners publish it, and what it can't lack.
TEMPLATES = [
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by", "licensed under cc by 4 0", ("licensed", "cc by")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("licensed", "cc by sa")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("licensed", "cc by nc")),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("licensed", "cc by nd")),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("licensed", "cc by nc sa")),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column) -> Column:
    """(start, label) of every base phrase."""
    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        at = F.filter(F.transform(words, lambda x, i: F.when(x == parts[0], i)), lambda i: i.isNotNull())
        at = F.filter(at, lambda i: F.coalesce(_follows(words, i, parts), F.lit(False)))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[of(*item) for item in BASE.items()])


def _follows(words: Column, i: Column, parts: list[str]) -> Column:
    out = F.lit(True)
    for k, part in enumerate(parts[1:], 1):
        out = out & (F.get(words, i + k) == part)
    return out


def _best_window() -> Column:
    """(shared, at, words) of the best window of seq for a candidate: the most shared words, the earliest of these; null if none will do."""
    phrase = F.split(F.get("must", F.lit(0)), " ")
    places = F.filter(F.transform("seq", lambda w, i: F.when(w == F.get(phrase, F.lit(0)), i)), lambda i: i.isNotNull())
    places = F.filter(places, lambda i: F.slice("seq", i + 1, F.size(phrase)) == phrase)
    starts = F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(F.lit(0), i + F.size(phrase) - F.col("reach")), i)))

    def window(at: Column) -> Column:
        own = F.slice("seq", at + 1, F.col("reach"))
        said = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        fits = F.forall("must", lambda p: F.contains(said, F.concat(F.lit(" "), p, F.lit(" "))))
        words = F.array_sort(F.array_intersect(own, F.col("words")))
        return F.struct(F.size(words).alias("shared"), (-at).alias("before"), words.alias("words"), fits.alias("fits"))

    best = F.array_max(F.filter(F.transform(F.array_distinct(starts), window), lambda x: x["fits"] & (x["shared"] >= F.col("need"))))
    return F.struct(best["shared"].alias("shared"), (-best["before"]).alias("at"), best["words"].alias("words"))


def license_matches(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): rows(row, doc_id, n_words, places) for each row of docs(doc_id, text), matches(row, block, template, label, shared, at, reach, size).

    shared are the template's words in the best window, which starts at word `at` of the block and has `reach` words.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(ascii_lower(F.col("text").cast("string")), F.lit("")).alias("low"))
    named = reduce(lambda p, q: p | q, [reduce(lambda p, q: p & q, [F.contains("low", F.lit(w)) for w in sorted({w for m in t.must for w in m.split()})]) for t in templates], F.lit(False))
    cut_up = low.select("doc_id", named.alias("named"), F.contains("low", F.lit("license")).alias("based"), F.transform(F.split("low", r"\n[\x20\x09\x0B-\x0D]*\n"), lambda b: F.regexp_extract_all(b, F.lit(WORD), F.lit(0))).alias("blocks"))
    cut_up = cut_up.select("doc_id", "named", "based", F.flatten("blocks").alias("w"), "blocks")
    rows = cut_up.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.col("based"), F.array_sort(_places(F.col("w")))).alias("places"),
        F.transform("blocks", lambda b: F.array_distinct(F.array_intersect(b, _strings(vocabulary)))).alias("sets"),
        F.when(F.col("named"), F.col("blocks")).alias("blocks"),  # words in order only where a phrase can be
    )
    rows = cut(rows, "license-blocks")  # from here on a row's number is fixed
    counts = {r.word: r.n for r in rows.select(F.explode(F.flatten("sets")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each word of the vocabulary at most
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    prefix, first = [], set()
    array = lambda x: f"array({', '.join(x)})"
    for k, t in enumerate(templates):
        ranks, need = sorted(rank[w] for w in t.words), t.need(threshold)
        said = f"{k}, '{t.label}', {len(ranks)}, {need}, {REACH * len(ranks)}, {array(map(str, ranks))}, {array(repr(w) for w in t.words)}, {array(repr(m) for m in t.must)}"
        prefix += [f"({r}, {i}, {said})" for i, r in enumerate(ranks[: len(ranks) - need + 1])]
        first.update(ranks[: len(ranks) - need + 1])
    heads = docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(prefix)} AS t(rank, i, template, label, size, need, reach, ranks, words, must)")
    blocks = rows.where("blocks is not null").select("row", F.posexplode(F.arrays_zip("sets", "blocks")).alias("block", "b")).select("row", "block", F.col("b.sets").alias("held"), F.col("b.blocks").alias("seq"))
    ranked = blocks.where(F.arrays_overlap("held", _strings([order[r - 1] for r in sorted(first)]))).select("row", "block", "seq", F.array_sort(F.transform("held", lambda w: F.array_position(_strings(order), w).cast("int"))).alias("own"))
    met = ranked.select("row", "block", "seq", "own", F.posexplode("own").alias("j", "rank")).join(F.broadcast(heads), "rank")  # the templates' prefixes: a fixed, small table
    met = met.where("size(own) >= need and least(i, j) + 1 + least(size - i - 1, size(own) - j - 1) >= need").where("size(array_intersect(own, ranks)) >= need")
    met = met.where("rank = array_min(array_intersect(own, ranks))")  # a pair that meets at several words is counted once: its first common word is in both prefixes
    found = met.select("row", "block", "template", "label", "size", "reach", _best_window().alias("best")).where("best.shared is not null")
    return rows.drop("sets", "blocks"), found.select("row", "block", "template", "label", F.col("best.words").alias("shared"), "best.at", "reach", "size")


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs(doc_id, text).

    A match gives no label if a better one (of a higher score, or as high with more words) shares all its words and meets its window.
    """
    rows, matches = license_matches(docs, templates, threshold)
    score = (F.size("shared") / F.col("size")).alias("score")
    block = matches.groupBy("row", "block").agg(F.collect_set(F.struct("label", "shared", "at", "reach", score)).alias("found"))  # one for each template at most
    over = lambda x, y: (y["at"] < x["at"] + x["reach"]) & (x["at"] < y["at"] + y["reach"])
    better = lambda x, y: over(x, y) & (F.size(F.array_except(x["shared"], y["shared"])) == 0) & ((y["score"] > x["score"]) | ((y["score"] == x["score"]) & (F.size(y["shared"]) > F.size(x["shared"]))))
    kept = block.select("row", F.explode(F.filter("found", lambda x: ~F.exists("found", lambda y: better(x, y)))).alias("x"))
    found = kept.groupBy("row").agg(F.collect_set("x.label").alias("more"), F.max("x.score").alias("best"))
    base = F.coalesce(F.transform("places", lambda p: p["label"]), F.array().cast("array<string>"))
    starts = F.transform("places", lambda p: p["start"])
    out = rows.join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
