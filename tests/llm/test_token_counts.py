import random

import public_tokenizers
import pytest

from fleetlens.llm import token_counts, tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = " \n\tab'sZé1²½.,-́ 日🙂ÀßLlrevemtd\x1c\x85"


@pytest.fixture(scope="module")
def library():
    return tokenizing.load(PATH)


def texts(n):
    draw = random.Random(4)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(n)] + [
        "<|endoftext|>", " <|endoftext|>  x<|endoftext|>", "I'll we've 'S", "   a", "a   ", "<|startoftext|> <|endoftext|>",
    ]


def test_counts_are_the_librarys(library):
    own = tokenizing.SpacedEncoder(PATH)
    for t in texts(3000):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_ids_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = tokenizing.WordEncoder(path), tokenizing.load(path)
    for t in texts(3000):
        ids = whole.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == b"".join(i.to_bytes(4, "little") for i in ids), repr(t)


def test_a_full_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(tokenizing, "CACHED", 5)
    own = tokenizing.SpacedEncoder(PATH)
    for t in texts(50):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk, overlap", [(50_000, 1_000), (64, 16), (200, 8)])
def test_tricky_documents(spark, tricky_docs, tricky, library, chunk, overlap):
    """Small chunks cut words, special strings and characters; the word of 100,000 letters needs wider overlaps."""
    docs = tricky_docs if chunk > 1000 else tricky_docs.where("doc_id not in (5, 6, 11)")
    rows = token_counts.token_counts(docs, PATH, chunk_chars=chunk, overlap_chars=overlap).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows)
    want = sorted(
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t, _ in tricky if chunk > 1000 or i not in (5, 6, 11)
    )
    assert got == want


def test_chunks_of_odd_texts(spark, library):
    draw = random.Random(9)
    many = ["".join(draw.choice(ODD + "<|endoftext|>") for _ in range(300)) for _ in range(60)]
    many += ["ab<|endoftext|>" * 40, " " * 300 + "x", "x" * 500, "a " * 200, "\n \n" * 120]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    rows = token_counts.token_counts(docs, PATH, chunk_chars=40, overlap_chars=12).collect()
    for r in rows:
        assert r["n_tokens"] == len(library.encode(many[r["doc_id"]], add_special_tokens=False).ids), r
    assert len(rows) == len(many)


def test_no_documents(no_docs):
    assert token_counts.token_counts(no_docs, PATH).collect() == []
