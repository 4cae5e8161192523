"""BPE: ids and texts equal to the tokenizers library's, whatever the text."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import bpe, queries

BITS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "Σ", "ΑΣ", "İ", "é", "é", "ﬁ", "123", "½",
        "漢字", "ÄÖ", "\x1c", "!!..", "😀", "x" * 70, "qwertyuiop" * 9, "́", "Ⅷ", "Ᲊ", "Ɤ", "\U00010d50", "𝔸", "ǅ", "​", "\xa0",
        "안녕", "한", "_", "٣", "the", "Running", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


@pytest.fixture(scope="module")
def vocab(spark):
    return bpe.vocabulary(spark, queries.vocabulary_path())


def run(spark, vocab, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).withColumn("ids", bpe.encode(F.col("text"), vocab))
    return df.select("doc_id", "text", "ids", bpe.id_array(F.col("ids")).alias("n"), bpe.decode(F.col("ids"), vocab).alias("back")).collect()


def same(library, text, ids, back):
    want = library.encode(text or "", add_special_tokens=False).ids
    assert list(np.frombuffer(ids, "<u4")) == want, text
    assert back == library.decode(want, skip_special_tokens=False), text


def test_random_texts_equal_the_library(spark, library, vocab):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    for r in run(spark, vocab, rows):
        same(library, r["text"], r["ids"], r["back"])
        assert r["n"] == list(np.frombuffer(r["ids"], "<u4"))


def test_nulls_empty_and_long_texts(spark, library, vocab):
    rng = random.Random(6)
    letters = "".join(rng.choice("abcdeé") for _ in range(30_000))  # one word
    many = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(120_000))
    rows = [(None, None), (1, ""), (1, ""), (2, " \n "), (3, letters), (4, many), (5, "a" * 2_000), (6, "<|endoftext|>" * 50)]
    got = run(spark, vocab, rows)
    assert len(got) == len(rows)
    for r in got:
        same(library, r["text"], r["ids"], r["back"])
    assert run(spark, vocab, []) == []


def test_pieces_and_a_full_table_change_nothing(library, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    monkeypatch.setattr(bpe, "PIECE", 16)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (16,))
    enc = bpe._Encoder(bpe.read_vocabulary(queries.vocabulary_path()))
    for text, ids in zip(texts, enc(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids


def test_short_and_long_words_merge_alike(monkeypatch):
    v = bpe.read_vocabulary(queries.vocabulary_path())
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 64))) for _ in range(400)]
    short = bpe.merge_words(words, v)
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe._merge_long(np.append(v["inner"][list(w.encode()[:-1])], v["last"][w.encode()[-1]]).astype(np.int32), v).astype("<u4").tobytes()
            for w in words] == short


def test_other_columns_stay(spark, library, vocab):
    df = spark.createDataFrame([(1, "hi there", "x", 5)], "doc_id long, text string, ids_ string, rank int")
    r = df.withColumn("ids", bpe.encode(F.col("text"), vocab)).first()
    assert (r["ids_"], r["rank"]) == ("x", 5)
    same(library, "hi there", r["ids"], library.decode(library.encode("hi there", add_special_tokens=False).ids, skip_special_tokens=False))


def test_unknown_kind_of_file(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_on_a_table(spark, library, tmp_path):
    texts = [(1, "Hello World's 12"), (2, None), (3, "Grüße <|endoftext|> ok")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op13(spark, str(tmp_path)).collect()}
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
