"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from quirespark.llm import automatondedup, langid, licenses, minhash, rules, secrets, suffixdedup, wumanber

RNG = random.Random(11)
WORDS = ["mit", "license", "apache", "general", "public", "the", "of", "Éa", "ciónes", "über", "x1", "don't", "a", "secret", "zz"] + [f"w{i}" for i in range(60)]
PASSAGE = " ".join(RNG.choices(WORDS, k=60))


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def near(text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[RNG.randrange(len(words))] = f"edit{RNG.randrange(10**6)}"
    return " ".join(words)


BASE = prose(150)
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a b c d"), (7, "A B C D"), (8, BASE), (9, BASE), (10, near(BASE, 2)), (11, near(BASE, 5)), (12, near(BASE, 40)),
    (13, prose(30) + " " + PASSAGE + " " + prose(20)), (14, PASSAGE + "\n" + prose(10)), (15, prose(5) + "\n\n" + PASSAGE), (15, prose(5) + "\n\n" + PASSAGE), (16, "Orre " * 300), (17, "x" * 5000),
    (18, 'token = "abc123def456" and password: short1 AKIA' + "Z9" * 10 + " " + "0a" * 15), (19, "secret: token: abcdefgh 😀 api_key=QWERTYUIOP PASSWD = 12345"), (20, "Released under the MIT License.\n\n" + prose(30)),
    (21, "Licensed under CC BY-NC 4.0.\nGNU General Public License, version 3 mit license mit license"), (22, "### $$$ | a\nsame\nsame\n same \n\nsame"), (None, prose(40)), (23, prose(20_000)),
    (24, "漢字 " * 60), (25, "1 2 3 4 5 1 2 3 4 5 1 2 3 4 5"), (26, "-----BEGIN RSA PRIVATE KEY-----\nabcd==\n-----END RSA PRIVATE KEY----- ghp_" + "a" * 40),
]
ROWS += [(100 + i, near(BASE, i)) for i in range(20)]
ORDER = {id_: i for i, (id_, _) in enumerate(ROWS)}


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture
def df(docs):
    return docs(ROWS)


def compare(rows, want):
    """rows and want as multisets of tuples."""
    assert Counter(tuple(r) for r in rows) == Counter(want)


def test_licenses(df, docs):
    want = []
    for id_, text in ROWS:
        w = alnum(text)
        places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        want.append((id_, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))))
    got = licenses.scan(df).collect()
    compare([r[:6] for r in got], want)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[20] == ("mit", 1.0) and labels[21][0].split(",")[0] == "cc-by-nc" and labels[1] == ("", 0.0)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(docs([])).count() == 0


def test_license_join_is_whole(docs):
    """Every block with a window that holds enough of a template is found, and no other."""
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(14)]
    templates = []
    for k in range(25):
        words = rng.sample(vocabulary, rng.randrange(1, 9))
        templates.append(licenses.Template(f"l{k}", " ".join(words), (words[0], " ".join(words[-2:])) if k % 2 else (words[0],)))
    texts = [(i, " ".join(rng.choices([*vocabulary, "other", "more"], k=rng.randrange(0, 24)))) for i in range(300)]
    rows, matches = licenses.license_matches(docs(texts), templates, 0.7)
    got = {(r.doc_id, r.template, tuple(r.shared), r["at"]) for r in matches.join(rows, "row").collect()}
    want = set()
    for i, text in texts:
        words = text.split()
        for k, t in enumerate(templates):
            reach, best = licenses.REACH * len(t.words), None
            for s in range(len(words)):
                own = words[s : s + reach]
                shared = sorted(set(own) & set(t.words))
                if len(shared) >= 0.7 * len(t.words) - 1e-9 and all(f" {m} " in f" {' '.join(own)} " for m in t.must) and (best is None or len(shared) > len(best[0])):
                    best = (shared, s)
            if best:
                want.add((i, k, tuple(best[0]), best[1]))
    assert got == want and len(got) > 50


def test_license_words_far_apart_give_no_label(docs):
    texts = [(1, "Licensed under the Apache License. Fahren wir mit " + "dem Zug " * 9 + "released"), (2, "Licensed under CC BY 4.0 " + "x " * 9 + "nd sa nc"), (3, "MIT: released under the MIT license"), (4, "Released under the Licence mit Zug license")]
    assert {r.doc_id: r.labels for r in licenses.scan(docs(texts)).collect()} == {1: "apache", 2: "cc-by", 3: "mit", 4: ""}


def test_language(spark, docs):
    rng = random.Random(3)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=4)) for _ in range(12)), lang) for i in range(400) for lang in [rng.choice(list(kinds))]]
    frame = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !", "bb"), (502, "", None), (None, "abc", "aa")], "doc_id long, text string, lang string")
    model = langid.learn(frame)
    got = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert not any(got[i].rejected for i, _, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (500, 501, 502))
    flipped = frame.selectExpr("doc_id", "text", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 'cc' else lang end as lang")
    assert {r.doc_id: r.score for r in langid.identify(flipped, langid.learn(flipped)).collect()} == {i: r.score for i, r in got.items()}
    none = docs([(1, "abc"), (2, None)])
    assert {r.lang_pred for r in langid.identify(none, langid.learn(none)).collect()} == {"und"}


def test_unlearned_languages_are_rejected_by_score(docs):
    rng = random.Random(5)
    kinds = {"aa": "abcdefgh", "bb": "stuvwxyz", "cc": "ijklmnop"}
    text = lambda *of: " ".join("".join(rng.choices(kinds[of[i % len(of)]], k=4)) for i in range(12))
    model = langid.train([(text(lang), lang) for _ in range(150) for lang in kinds])
    rows = [(i, text(lang)) for i, lang in enumerate(list(kinds) * 20)] + [(100 + i, text("aa", "bb")) for i in range(20)] + [(200 + i, " ".join("".join(rng.choices("éñüßøåçœ", k=4)) for _ in range(12))) for i in range(20)]
    got = {r.doc_id: r for r in langid.identify(docs(rows), model).collect()}
    assert not any(got[i].rejected for i in range(60))
    assert all(got[i].rejected and got[i].score > 0 for i in got if i >= 100)
    assert {r.doc_id for r in langid.identified(docs(rows), model).collect()} == set(range(60))


def test_minhash(df, docs):
    sets = {}
    for id_, text in ROWS:
        w = spaced(low(text))
        sets.setdefault(id_, []).append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [(id_, len(s), None if id_ is None else find(id_), id_ is None or find(id_) == id_) for id_, own in sets.items() for s in own]
    compare(minhash.near_duplicates(df).collect(), want)
    assert minhash.near_duplicates(docs([])).count() == 0


def test_wumanber(df, spark, monkeypatch):
    items = [(1, " ".join(PASSAGE.split()[:30])), (2, "a b c"), (3, None), (4, ""), (5, "token"), (11, "A, B; c"), (12, " ".join(BASE.split()[40:53])), (None, "one"), (13, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for id_, text in ROWS:
        w, hit, found = alnum(text), set(), set()
        for item, t in items:
            b = alnum(t)
            m = min(13, len(b))
            windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m and item is not None else set()
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found.add(item)
        want.append((id_, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    got = wumanber.contamination(df, benchmark)
    compare([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()], want)
    assert wumanber.contamination(df, benchmark.where("false")).where("contaminated or n_hit > 0").count() == 0
    monkeypatch.setattr(wumanber, "SHARD_BYTES", 60)  # several shards
    compare([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in wumanber.contamination(df, benchmark).collect()], want)


def spans_of(text):
    out = []
    for rank, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, r.kind, m.end()))
    return sorted(out)


def test_key_without_end_leaves_prose(docs):
    key = "-----BEGIN PRIVATE KEY-----"
    lines = "\n" + "Ab1+" * 16 + "\n" + "Zz9/" * 9
    texts = {1: key + "\nabc\n\nHere follows ordinary prose of some length.", 2: key + lines + "\n\nand prose", 3: key + lines + "=\n-----END PRIVATE KEY----- tail"}
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "pem"] for r in secrets.scan(docs(list(texts.items())))[0].collect()}
    assert got == {1: [(0, len(key))], 2: [(0, len(key + lines))], 3: [(0, len(texts[3]) - 5)]}


def test_secrets(df, docs, spark):
    findings, ledger = secrets.scan(df)
    compare([(r.doc_id, tuple(tuple(s) for s in r.spans)) for r in findings.collect()], [(i, tuple(spans_of(t))) for i, t in ROWS])
    kinds = {s[2] for _, t in ROWS for s in spans_of(t)}
    assert {"assign", "access", "hex", "pem", "github"} <= kinds
    # a second run scans new texts and new versions only, and finds the same
    more = docs([*ROWS, (900, "new password=abcdef123")])
    bumped = [r._replace(version=2) if r.kind == "hex" else r for r in secrets.RULES]
    found, whole = secrets.scan(more, ledger, bumped)
    compare([(r.doc_id, tuple(tuple(s) for s in r.spans)) for r in found.collect()], [(i, tuple(spans_of(t))) for i, t in [*ROWS, (900, "new password=abcdef123")]])
    blobs, listed = len({t or "" for _, t in ROWS}), lambda x: x.selectExpr("sum(size(entries))").first()[0]
    assert ledger.count() == blobs and listed(ledger) == blobs * len(secrets.RULES)
    assert whole.count() == blobs + 1 and listed(whole) == listed(ledger) + blobs + len(secrets.RULES)
    assert secrets.unseen(ledger.select("blob"), ledger, secrets.RULES).count() == 0
    assert {tuple(r.ranks) for r in secrets.unseen(ledger.select("blob"), ledger, bumped).collect()} == {(2,)}
    text = "a password=abcdef12 b"
    assert spark.createDataFrame([(text,)], "text string").select(secrets.masked(__import__("pyspark").sql.functions.col("text"), __import__("pyspark").sql.functions.expr("array(named_struct('start', 2L, 'rank', 0, 'kind', 'assign', 'end', 19L))"))).first()[0] == "a [SECRET] b"
    assert secrets.scan(docs([]))[0].count() == 0


@pytest.mark.parametrize("sizes", [{}, {"shard": 500}])
def test_suffix_array(df, docs, sizes):
    length = 60
    count = Counter(b[i : i + length] for _, t in ROWS for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    want = []
    for id_, t in ROWS:
        b = (t or "").encode()
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = [True] * length
        n = sum(c and not p for c, p in zip(cover, [False, *cover]))
        want.append((id_, len(b), sum(cover), n, sha(bytes(x for x, c in zip(b, cover) if not c))))
    compare([r[:5] for r in suffixdedup.dedup(df, length, **sizes).collect()], want)
    assert suffixdedup.dedup(docs([]), length).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"shard": 200}])
def test_automaton(df, docs, sizes):
    length, first = 8, {}
    key = lambda id_: -(2**63) if id_ is None else id_
    for id_, t in ROWS:
        w = spaced(t)
        for i in range(len(w) - length + 1):
            at = (key(id_), i)
            first[tuple(w[i : i + length])] = min(at, first.get(tuple(w[i : i + length]), at))
    want = []
    for id_, t in ROWS:
        w = spaced(t)
        cover = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (key(id_), i):
                cover[i : i + length] = [True] * length
        want.append((id_, len(w), sum(cover), sha(" ".join(x for x, c in zip(w, cover) if not c))))
    compare([r[:4] for r in automatondedup.dedup(df, length, **sizes).collect()], want)
    assert automatondedup.dedup(docs([]), length).count() == 0


def test_statistics(df, docs, spark):
    want = []
    for id_, t in ROWS:
        t = t or ""
        w = spaced(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if spaced(x)]
        want.append((id_, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    labels = spark.createDataFrame([(8, 1), (9, None), (None, 0)], "doc_id long, quality int")
    learned = rules.learn_from(df, labels)
    assert learned == []
    got = rules.judge(df, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    compare([r[:7] for r in got], want)
    assert all(r.kept != r.base_failed for r in got)
    assert rules.judge(docs([]), learned).count() == 0


def test_learned_rules(spark):
    rng = random.Random(5)
    good = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(40)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(999)}" + rng.choice(["", "###", "$$$"]) for _ in range(40)), 0) for i in range(120)]
    loud = [(2000 + i, " ".join(f"W{rng.choice('ABCD')}ORD!!" for _ in range(25)) + " " + " ".join(f"X{rng.randrange(999)}Y" for _ in range(60)), 0) for i in range(120)]
    frame = spark.createDataFrame(good + bad + loud, "doc_id long, text string, quality int")
    learned = rules.learn_from(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    assert 1 <= len(learned) <= 6
    got = rules.judge(frame.select("doc_id", "text"), learned).join(frame.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in got if r.quality == 0) <= 5
