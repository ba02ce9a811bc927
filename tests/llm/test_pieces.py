"""Automaton counts against greedy longest match."""

import random

import numpy as np
import public_tokenizers
from quirespark.llm import bpe, pieces

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    word, n = b" " + word, 0
    while word:
        k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary)
        word, n = word[k:], n + 1
    return n


def check(vocabulary: set[bytes], words: list[bytes]):
    own = pieces.Automaton(sorted(vocabulary))
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    want = [greedy(w, vocabulary, max(map(len, vocabulary))) for w in words]
    assert own.counts(data, start, end).tolist() == want
    assert [own.count(w) for w in words] == want


def test_random_vocabularies():
    rng = random.Random(3)
    for _ in range(30):
        some = {bytes(rng.choices(b" ab", k=1)) + bytes(rng.choices(b"ab", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        check(some | {bytes([i]) for i in range(256)}, [bytes(rng.choices(b"abc", k=rng.randrange(1, 30))) for _ in range(60)])


def test_real_vocabulary():
    rng = random.Random(4)
    with open(PATH, "rb") as f:
        vocabulary = set(bpe.read_ranks(f))
    words = ["tokenization", "ciónñrr", "über", "a", "x" * 1000, "unbelievably", "漢字かな", "http://example.com/a?b=c"]
    check(vocabulary, [w.encode() for w in words] + [bytes(rng.choices(b"etaoinshrdlu", k=rng.randrange(1, 40))) for _ in range(500)])


def test_query(spark, docs):
    df = docs([(1, "hello  world"), (2, None), (3, ""), (3, "x " * 50_000), (None, "a"), (4, " \n ")])
    rows = {(r.doc_id, r.n_words): r for r in pieces.token_counts(df, PATH).collect()}
    assert len(rows) == 6 and rows[1, 2].n_tokens == rows[1, 2].n_words == 2
    assert rows[3, 50_000].n_tokens == 50_000 and rows[2, 0].n_tokens == rows[4, 0].n_tokens == rows[3, 0].n_tokens == 0
    assert pieces.token_counts(docs([]), PATH).count() == 0
