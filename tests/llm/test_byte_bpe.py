"""Backtracking byte-level BPE against the tiktoken library."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tallymart.llm import byte_bpe  # noqa: E402

NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
ODD = ["", " ", "   \n\n  ", "<|endoftext|> don't ½ ２ é ▁ 日本 😀", "a" * 20000, "\x00\x01 �", "I'll've we'RE 123456789 ...!!!"]


def library(name):
    ranks = byte_bpe.load_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_equals_library(name):
    mine = byte_bpe.Backtracker(public_tokenizers.path(name), public_tokenizers.PATTERN)
    theirs = library(name)
    pick = random.Random(7)
    alphabet = ["a", "b", "ab", " ", "  ", "\n", "é", "日本", "😀", "1", "12345", "'s", "$$", "the", "ing", "\t", "ﬁ", "Ω", "\x00"]
    texts = ODD + ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode("utf-8")


def test_digests(spark):
    name = NAMES[0]
    rows = [(1, "hello world"), (1, "hello world"), (None, "x"), (2, None), (3, ""), (4, ODD[3]), (5, "a" * 5000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(byte_bpe.digest(docs, public_tokenizers.path(name), public_tokenizers.PATTERN).collect(), key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))
    theirs = library(name)
    want = []
    for i, text in rows:
        ids = theirs.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] or -1, r[1]))
    assert byte_bpe.digest(docs.filter("false"), public_tokenizers.path(name), public_tokenizers.PATTERN).count() == 0
    encoded = byte_bpe.encode(docs, public_tokenizers.path(name), public_tokenizers.PATTERN).collect()
    assert all(bytes(r["decoded"]) == theirs.decode_bytes(r["ids"]) for r in encoded)


def test_query_equals_library_on_documents(spark):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    theirs = library(NAMES[0])
    for row in byte_bpe.op13_byte_bpe(spark, folder).collect():
        ids = theirs.encode_ordinary(texts[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
