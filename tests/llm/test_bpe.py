"""Byte-level BPE against tiktoken, on texts that stress the pre-tokeniser."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from quirespark.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    if not data:
        return [[] for _ in texts]
    _, which, distinct, of = bpe.encoder(PATH).pieces(data, np.frombuffer(data, np.uint8), at)
    said = [b"".join(distinct[i][1] for i in which[a:b])[:-1] for a, b in zip(of[:-1], of[1:])]
    back = b"".join(distinct[i][2] for i in which)
    assert back == data
    return [[int(x) for x in s.split(b",")] if s else [] for s in said]


EDGES = ["", " ", "  ", "a", " a", "  a", "a ", "a  ", "\n\n a", "\na", " \n", "a\n\n\nb", "'s", "''s", " 's", "x's", "x'sabc", "x're", "x'rx", "x'r", "x'", "x'll'd", "\n's", "1's", "!'s", "it's 12x's\t't", "é's ñ", " a", "  b", "\x1c\x1da", "áb", "漢字かな 漢", "😀😀 😀", "x" * 3000, "ab" * 400 + " " * 300, "'" * 40 + "s", "a'lle", "don't'", "'ve'v'e", " '", " 'll"]


def test_edges(reference):
    assert ids_of(EDGES) == [reference.encode_ordinary(t) for t in EDGES]


def test_random(reference):
    rng = random.Random(5)
    alphabet = list("aabcdestrvl mLl'' \n\t\r12!?.,é") + [" ", "ß", "字", "😀", "  ", "'s", "'re", " ", "\x85", "\x1f", "²", "Ⅷ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 120))) for _ in range(3000)]
    assert ids_of(texts) == [reference.encode_ordinary(t) for t in texts]


def test_query(spark, docs, reference):
    df = docs([(1, "Hello world's  end"), (2, None), (3, ""), (3, "x" * 200_000), (None, "a b"), (3, "")])
    rows = bpe.encode(df, PATH).collect()
    assert len(rows) == 6
    for r in rows:
        text = {1: "Hello world's  end", 2: "", None: "a b"}.get(r.doc_id, "x" * 200_000 if r.n_tokens else "")
        ids = reference.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH), PATH).where("doc_id = 1").first()
    assert bytes(back.bytes) == b"Hello world's  end" and back.ends[-1] == len(back.bytes)
    assert bpe.encode(docs([]), PATH).count() == 0


def test_memory_goes_back(monkeypatch):
    """What a task has merged doesn't stay in its worker, whose memory counts beside the next stages."""
    monkeypatch.setattr(bpe.SparkFiles, "get", lambda name: PATH)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["Hello world's  end"]})
    assert [b.num_rows for b in bpe._encode("ranks", False)(iter([batch]))] == [1]
    assert not bpe.encoder(PATH).cache

    def held(batches):
        for b in batches:
            yield b

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.returning(held)(iter([batch]))) == [batch] and given == [1]
    next(run := common.returning(held)(iter([batch, batch])))
    run.close()
    assert given == [1, 1]
