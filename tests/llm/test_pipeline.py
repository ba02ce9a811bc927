"""The pipeline against plain Python, and every registered query on small tables."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from quirespark.llm import langid, registry, secrets

RNG = random.Random(8)
KINDS = {"aa": "abcde", "bb": "vwxyz"}


def prose(lang, n):
    return " ".join("".join(RNG.choices(KINDS[lang], k=5)) for _ in range(n))


def words(text, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, benchmark):
    kept = [d for d in docs if langid.has_letter(d[1])]
    sets = {}
    for i, t, *_ in kept:
        w = words(t, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [d for d in kept if find(d[0]) == d[0]]
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in benchmark:
        w = words(t, alnum)
        windows |= {tuple(w[i : i + min(13, len(w))]) for i in range(len(w) - min(13, len(w)) + 1)}
    out = []
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t, *_ in kept:
        w = words(t, alnum)
        hit = {p for m in {len(x) for x in windows} for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows for p in range(k, k + m)}
        if hit and 20 * len(hit) >= len(w):
            continue
        spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, t, re.ASCII) if len(m[r.group]) >= r.least)
        masked, at = "", 0
        for a, b in spans:
            if a >= at:
                masked += t[at:a] + "[SECRET]"
            at = max(at, b)
        masked += t[at:]
        ids = enc.encode_ordinary(masked)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(masked.encode()).hexdigest()))
    return sorted(out)


def test_pipeline(spark, tmp_path):
    bench = [prose("aa", 30), prose("bb", 8)]
    docs = [(i, prose(lang, RNG.randrange(20, 80)), lang) for i in range(120) for lang in [RNG.choice(list(KINDS))]]
    base = docs[3][1]
    docs += [(200, base, "aa"), (201, base.upper(), "aa"), (202, base + " extra", "aa"), (203, "123 456 !", None), (204, None, "aa"), (205, "", None), (206, prose("aa", 40) + " " + bench[0], "aa"), (207, prose("bb", 20) + " password=abcdef99 tail", "bb"), (208, bench[1].title(), "bb"), (209, prose("aa", 900) + " " + bench[0][:80], "aa")]
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long, __blob string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == brute(docs, bench)
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, str(tmp_path))
        assert after.dtypes == seen.dtypes, name
        assert stage(spark, seen.where("false"), str(tmp_path)).count() == 0, name


def test_pipeline_rows_without_ids(spark, tmp_path):
    rows = [(None, "some letters", "aa", "s", 1), (None, "some letters", "aa", "s", 1), (7, "other words here", None, "s", 1), (7, "other words here", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "zzz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == ["7", "None", "None"]
    assert corpus_pipeline.mask_secrets(spark, docs, str(tmp_path)).count() == corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 4


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
