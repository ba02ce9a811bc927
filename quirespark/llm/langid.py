"""Language identification: averaged hashed subword embeddings with a linear softmax.

The subwords of a text are the byte n-grams (2 to 4) of its words, lower-cased, letters only, with
their borders, hashed into BUCKETS. A text is the mean of their embeddings, a linear layer and a
softmax give the languages. Embeddings and layer are trained together by stochastic gradient
descent in numpy; beside the examples they learn texts in no language, made from examples by dealing their letters
anew over their places, with all languages alike as their goal. Then a temperature is fitted on texts held back. Because the layer is linear in the
mean, a bucket's embedding and the layer fold into one row of scores, and a text costs a histogram.

Rejection is calibrated on the same texts of both kinds. A text is rejected when it has no letter or its score is below the threshold: half-way between what
all but REJECTED of the rightly labelled ones reach and what all but REJECTED of the texts in no language stay
below, or the former alone if that is the smaller. Since the former are fewer than 1 / REJECTED, it is their lowest score, or
where a normal distribution of their logits has that quantile, if that is lower.

Examples are at most PER_LANGUAGE documents of every language, and an equal part of EXAMPLES where there are more languages than that allows: those of the smallest
hashes of doc_id among texts of at most EXAMPLE_BYTES, or the beginnings of longer texts where a language has no others; only text and language are used. Defined results:
null text, or text without a letter, is `und` with score 0; without a labelled example every text is `und`; a single language
is learned as a constant; every row gets its own result, equal doc_ids too; bytes that aren't UTF-8 count as U+FFFD;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import map_arrow

UNKNOWN = "und"
#: Most examples of a language, of all together (but one of each language at least) and most bytes of an example; they bound what the driver gets. No language is left out.
PER_LANGUAGE, EXAMPLES, EXAMPLE_BYTES = 600, 120_000, 1 << 15
BUCKETS, WIDTH, ORDERS = 1 << 14, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 8, 32, 2.0
#: Share of rightly labelled examples held back that calibration lets go, at most; and what one score may differ by rounding.
REJECTED, ROUNDING = 0.0005, 1e-6
_SALT = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # a row for each bucket: embedding times layer, over temperature
    bias: np.ndarray
    threshold: float
    #: Share of the texts in no language that the threshold rejects.
    caught: float = 0.0


def subwords(text: str) -> np.ndarray:
    """The buckets of a text's subwords."""
    low = text.lower()
    data = np.frombuffer(low.encode("utf-8", "replace"), np.uint8)
    letters = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first of each run of others stands for the border
    clean = np.where(letters, data, 0x20)[keep]
    clean = np.concatenate([[0x20], clean, [0x20]]).astype(np.uint64)
    rolled, out = np.zeros(len(clean), np.uint64), []
    for n in range(1, max(ORDERS) + 1):
        rolled = (rolled[: len(clean) - n + 1]) * np.uint64(0x100) + clean[n - 1 :]
        if n in ORDERS:
            out.append(((rolled + np.uint64(n)) * _SALT[n] >> np.uint64(50)).astype(np.int64))
    return np.concatenate(out)


def garbled(text: str, rng: np.random.Generator) -> str:
    """text with its letters dealt anew over their places: no language, but the same letters and lengths of words."""
    letters = np.array([c.isalpha() for c in text], bool)
    out = np.array(list(text))
    out[letters] = rng.permutation(out[letters])
    return "".join(out.tolist())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def histogram(text: str) -> np.ndarray:
    counts = np.bincount(subwords(text), minlength=BUCKETS).astype(np.float32)
    return counts / counts.sum()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(examples: list[tuple[str, str]], seed: int = 0) -> Model:
    """A model of (text, language) examples; the order doesn't matter."""
    examples = sorted(x for x in set(examples) if has_letter(x[0]))
    languages = sorted({lang for _, lang in examples})
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 0.0)
    rng = np.random.default_rng(seed)
    examples = [examples[i] for i in rng.permutation(len(examples))]
    held = max(1, len(examples) // 5)
    strange = [garbled(text, rng) for i, (text, _) in enumerate(examples) if i < held or i % 3 == 0]
    parts = [subwords(text).astype(np.int32) for text in (*(x[0] for x in examples), *strange)]
    y = np.array([languages.index(lang) for _, lang in examples])
    goal = np.full((len(parts), len(languages)), 1 / len(languages), np.float32)
    goal[: len(y)] = np.eye(len(languages), dtype=np.float32)[y]
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    fit = np.concatenate([np.arange(held, len(y)), np.arange(len(y) + held, len(parts))])

    def grid(rows: np.ndarray) -> np.ndarray:
        return np.stack([(h := np.bincount(parts[r], minlength=BUCKETS).astype(np.float32)) / max(1, h.sum()) for r in rows])

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            rows = fit[i : i + BATCH]
            x = grid(rows)
            mean = x @ embed
            wrong = (_softmax(mean @ layer + bias) - goal[rows]) / len(rows)
            back = wrong @ layer.T
            layer -= rate * (mean.T @ wrong)
            bias -= rate * wrong.sum(0)
            embed -= rate * BUCKETS**0.5 * (x.T @ back)
    scores = embed @ layer
    kept_back = np.concatenate([np.arange(held), np.arange(len(y), len(y) + held)])
    logits = np.concatenate([grid(kept_back[i : i + 256]) @ scores + bias for i in range(0, 2 * held, 256)])
    heats = np.geomspace(0.05, 20, 60)
    loss = [-(goal[kept_back] * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum(1).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(logits / heat)
    right, none = np.sort(p[:held].max(1)[p[:held].argmax(1) == y[:held]]), np.sort(p[held:].max(1))
    threshold = _lower_end(right) if len(right) else 0.0
    most = float(none[len(none) - 1 - int(REJECTED * len(none))])
    if most < threshold:
        threshold = (threshold + most) / 2
    threshold = max(threshold, 1 / len(languages) + 1e-6)
    return Model(languages, (scores / heat).astype(np.float32), bias / heat, threshold, float((none < threshold).mean()))


def _lower_end(scores: np.ndarray) -> float:
    """What all but REJECTED of sorted scores reach, by themselves or, if that is less, by the normal distribution of their logits."""
    held = np.clip(scores.astype(np.float64), 1e-9, 1 - 1e-9)
    logits = np.log(held / (1 - held))
    tail = logits.mean() - NormalDist().inv_cdf(1 - REJECTED) * logits.std()
    return min(float(scores[int(REJECTED * len(scores))]), float(1 / (1 + np.exp(-tail)))) - ROUNDING


def _predict(shared: Broadcast):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                if not model.languages or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                p = _softmax(histogram(text) @ model.scores + model.bias)
                k = int(p.argmax())
                langs.append(model.languages[k])
                scores.append(float(p[k]))
                rejected.append(bool(p[k] < model.threshold))
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *found], [batch.schema.names[0], *batch.schema.names[2:], "lang_pred", "score", "rejected"])

    return predict


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of docs(doc_id, text, lang): rows whose remainder is not 2, at most per_language of each language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    open_ = known.where("lang is not null and text is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 2).withColumn("long", F.octet_length("text") > EXAMPLE_BYTES)
    counts = open_.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count("*").alias("n")).collect()
    if not counts:
        return train([])
    per_language = max(1, min(per_language, EXAMPLES // len(counts)))
    # Of each language so many small hashes that the smallest per_language of them are among these: three times as many, and all where there are few.
    share = docs.sparkSession.createDataFrame([(r.lang, r.short == 0, min(1.0, 3 * (per_language + 100) / (r.short or r.n))) for r in counts], "lang string, only_long boolean, share double")
    open_ = open_.withColumn("text", F.when(F.col("long"), F.substring("text", 1, EXAMPLE_BYTES // 4)).otherwise(F.col("text")))  # four bytes a character at most
    draw = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("draw")
    near = open_.join(F.broadcast(share), "lang").where("long = only_long").withColumn("draw", draw).where("draw <= share")  # a row for each language
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    rows = near.select("lang", "doc_id", "draw", "text").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).select("text", "lang").collect()
    return train([(r.text, r.lang) for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    return map_arrow(texts, _predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, as they are, that identify() doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = docs.select(F.lit(0).alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"), row)
    kept = map_arrow(tagged, _predict(shared), T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("row", tagged.schema["row"].dataType), *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields]))
    return kept.where("not rejected").select("row.*")
