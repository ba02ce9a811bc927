"""Words that weak hashes confuse, crowded anchors and buckets, clashing names, texts over a megabyte, models recomputed plainly."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from quirespark.llm import automatondedup, bpe, langid, licenses, minhash, pieces, registry, rules, secrets, suffixdedup, wumanber

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def alike(n):
    """Two words of n letters with equal polynomial hashes modulo 2^64, whatever the odd base."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


CONFUSED = [word for n in (1024, 2048, 4096) for word in alike(n)]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_confused_pieces(docs):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate([*CONFUSED, " ".join(CONFUSED)]))
    got = {r.doc_id: r for r in bpe.encode(docs(rows).coalesce(1), MULTI).collect()}
    assert all(got[i].ids == enc.encode_ordinary(t) and got[i].decoded_sha256 == sha(t) for i, t in rows)
    own = pieces.automaton(PIECES)
    counts = {r.doc_id: r.n_tokens for r in pieces.token_counts(docs(rows).coalesce(1), PIECES).collect()}
    assert all(counts[i] == sum(own.count(w.encode()) for w in t.split()) for i, t in rows)


def test_confused_words_and_bytes(docs):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(i, " ".join([*words[:12], w, *words[12:24]])) for i, w in enumerate(CONFUSED)] + [(10, " ".join(["x", *words[:24]]))]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs([(i, w) for i, w in enumerate(CONFUSED)])).collect()} == {i: i for i in range(6)}
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        cover = set()
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (i, k)) < (i, k):
                cover.update(range(k, k + 20))
        want[i] = (len(cover), sha(" ".join(x for k, x in enumerate(w) if k not in cover)))
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in automatondedup.dedup(docs(rows)).collect()} == want
    count = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = {}
    for i, t in rows:
        cover = {p for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for p in range(k, k + 200)}
        want[i] = (len(cover), sha("".join(c for p, c in enumerate(t) if p not in cover)))
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixdedup.dedup(docs(rows)).collect()} == want


def test_crowded_anchor(docs):
    """A passage in 4,000 texts, around it words of a few: groups of hundreds of contexts are refined down to windows."""
    rng = random.Random(2)
    phrase = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(i, f"{' '.join(rng.choices('abcdefg', k=6))} {phrase} {' '.join(rng.choices('uvwxyz', k=6))}") for i in range(4_000)]
    first, want = {}, {}
    for i, t in rows:
        w, cover = t.split(), set()
        for k in range(len(w) - 9):
            if first.setdefault(tuple(w[k : k + 10]), (i, k)) < (i, k):
                cover.update(range(k, k + 10))
        want[i] = (len(cover), sha(" ".join(x for k, x in enumerate(w) if k not in cover)))
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in automatondedup.dedup(docs(rows), 10, shard=1000).collect()} == want


@pytest.mark.parametrize("crowd", [0])
def test_crowded_buckets(docs, monkeypatch, crowd):
    """Texts that share much, but not enough, beside near copies: all links, with buckets that are dealt anew."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rng = random.Random(3)
    core = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(core + [f"u{i}x{k}" for k in range(20 + i % 9)])) for i in range(60)]
    rows += [(100 + i, " ".join(core + [f"u{i}x{k}" for k in range(20 + i % 9)][: 18 + i % 3])) for i in range(60)]
    rng.shuffle(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()} == {i: find(i) for i in sets}


@pytest.mark.parametrize("crowd", [0, 2048])
def test_links_of_one_bucket(spark, docs, monkeypatch, crowd):
    """Members that share one bucket and no other band: every link across components is found, however full the bucket counts as."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rng = random.Random(5)
    base = [[f"b{k}x{i}" for i in range(60)] for k in range(6)]
    rows = [(i, " ".join(w if j < 30 + i % 28 else f"u{i}x{j}" for j, w in enumerate(rng.choice(base)))) for i in range(90)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    component = {i: 0 if i < 20 else i for i in sets}
    want = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(want) > 20
    texts = docs(rows)
    signed = minhash.map_arrow(texts, minhash._sign, "doc_id long, n_shingles long, digest binary, keys array<bigint>, bits array<bigint>")
    found = spark.createDataFrame([(i, c) for i, c in component.items() if i < 20], "node long, component long")
    pairs = minhash._residual(texts.select(F.lit(7).cast("long").alias("key"), "doc_id"), found, signed.select("doc_id", F.col("n_shingles").alias("n"), "bits"), texts)
    assert {tuple(r) for r in minhash._confirmed(pairs, texts).collect()} == want


def test_comparisons_stay_in_proportion(spark, docs, monkeypatch):
    """A bucket whose members share a long passage, but not enough, is not met each with each: no more comparisons than shingles, and all links."""
    met, across = [], minhash._across

    def counted(*rows):
        met.append(across(*rows).count())
        return across(*rows)

    monkeypatch.setattr(minhash, "_across", counted)
    rows = [(i, " ".join([f"c{k}" for k in range(30)] + [f"u{i}x{k}" for k in range(30)])) for i in range(120)]
    rows += [(200 + i, text.rsplit(" ", 2)[0]) for i, text in rows[:20]]
    texts = docs(rows)
    signed = minhash.map_arrow(texts, minhash._sign, "doc_id long, n_shingles long, digest binary, keys array<bigint>, bits array<bigint>")
    none = spark.createDataFrame([], "node long, component long")
    pairs = minhash._residual(texts.select(F.lit(7).cast("long").alias("key"), "doc_id"), none, signed.select("doc_id", F.col("n_shingles").alias("n"), "bits"), texts)
    assert {tuple(r) for r in minhash._confirmed(pairs, texts).collect()} == {(i, 200 + i) for i in range(20)}
    assert sum(met) + pairs.count() <= sum(len(text.split()) - 4 for _, text in rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(texts).collect()} == {i: i % 200 for i, _ in rows}


def test_every_language_is_learned(docs, spark):
    """More languages than examples are usually shared out to, and one whose texts are all long."""
    langs = [f"l{k:03d}" for k in range(205)]
    rows = [(k * 10 + i, f"w{k}a{i} w{k}b w{k}c", lang) for k, lang in enumerate(langs) for i in range(10)] + [(9000 + i, "zyx " * 9000 + str(i), "zz") for i in range(10)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [*langs, "zz"]


def test_clashing_names(spark, docs):
    """Extra columns named as the operators' own change nothing."""
    rows = [(1, "password = abcdefgh1 licensed under the apache license version 2 0 and more words here"), (2, "password = abcdefgh1 licensed under the apache license version 2 0 and more words here"), (3, None), (None, "some text"), (4, "")]
    names = "blob holder rank digest keys h id fp c1 c2 own kept spans items row lang_pred rejected words blocks ranks entries node component u v m draw share place shard low b text2 n_shingles".split()
    plain = docs(rows)
    busy = plain
    for name in names:
        busy = busy.withColumn(name, F.lit("clash"))
    bench = spark.createDataFrame([(1, "the apache license")], "item_id long, text string")
    model = langid.train([("some text here", "aa"), ("andere worte dort", "bb")] * 3)
    operators = {
        "licenses": licenses.scan, "language": lambda d: langid.identify(d, model), "minhash": minhash.near_duplicates, "contamination": lambda d: wumanber.contamination(d, bench).drop("kept"), "pieces": lambda d: pieces.token_counts(d, PIECES),
        "secrets": lambda d: secrets.scan(d)[0], "bytes": suffixdedup.dedup, "words": automatondedup.dedup, "rules": lambda d: rules.judge(d, []), "bpe": lambda d: bpe.encode(d, MULTI),
    }
    for name, operator in operators.items():
        assert sorted(map(repr, operator(busy).collect())) == sorted(map(repr, operator(plain).collect())), name
    kept = langid.identified(busy, model)
    assert kept.columns == busy.columns


def test_scores_recomputed(docs):
    """Predictions against plain sums over n-grams."""
    rng = random.Random(4)
    kinds = {"aa": "abcdef", "bb": "stuvwx", "cc": "éñopqr"}
    text = lambda lang, n=9: " ".join("".join(rng.choices(kinds[lang], k=4)) for _ in range(n))
    model = langid.train([(text(lang), lang) for _ in range(60) for lang in kinds])
    rows = [(i, text(lang)) for i, lang in enumerate(list(kinds) * 5)] + [(50, "Zug 12, zug!"), (51, "a"), (52, "123")]
    got = {r.doc_id: r for r in langid.identify(docs(rows), model).collect()}
    for i, t in rows:
        if not langid.has_letter(t):
            assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
            continue
        words = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode()).split()
        clean = b" " + b"".join(w + b" " for w in words) + b" "
        if not t.endswith(("!", ",")) and clean.endswith(b"  "):
            clean = clean[:-1]
        grams = Counter()
        for n in langid.ORDERS:
            for k in range(len(clean) - n + 1):
                value = (int.from_bytes(clean[k : k + n]) + n) * int(langid._SALT[n]) % 2**64
                grams[value >> 50] += 1
        total = sum(grams.values())
        logits = [sum(c * float(model.scores[g, j]) for g, c in grams.items()) / total + float(model.bias[j]) for j in range(len(model.languages))]
        top = max(logits)
        p = [math.exp(x - top) for x in logits]
        best = max(range(len(p)), key=p.__getitem__)
        assert got[i].lang_pred == model.languages[best] and abs(got[i].score - p[best] / sum(p)) < 1e-4
        assert got[i].rejected == (got[i].score < model.threshold)


def test_long_texts(spark, tmp_path):
    """Every query over texts of over two megabytes, nulls and repeated rows, and over empty tables."""
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    rows = [(1, long, "en", "s", len(long)), (2, long[:1_200_000], "en", "s", 1), (3, None, None, "s", 0), (4, "", "de", "s", 0), (4, "", "de", "s", 0), (5, "x" * 1_100_000, "de", "s", 1), (None, "kurzer Text", "de", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, held in (("full", rows), ("none", [])):
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, " ".join(long.split()[100:130]))] if held else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 0, 0)] if held else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    for name, run in registry.QUERIES.items():
        got = run(spark, f"{tmp_path}/full").collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows), name
        assert run(spark, f"{tmp_path}/none").count() == 0, name
        own = {r.doc_id: r.asDict() for r in got}
        if "n_words" in own[1]:
            assert own[1]["n_words"] == 400_000 and own[3]["n_words"] == 0, name
        if name == "op4_decontaminate":
            assert own[1]["n_hit"] >= 30 and own[1]["n_items"] == 1


def test_labels_of_documents_with_several_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (1, "### ### ### $$$ $$$ a b c d e f"), (2, "x")], "doc_id long, text string")
    assert rules.learn_from(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert rules.judge(docs, rules.learn_from(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, quality int"))).count() == 3
    np.testing.assert_equal(rules.learn(np.zeros((0, len(rules.FEATURES))), np.zeros(0, bool)), [])
