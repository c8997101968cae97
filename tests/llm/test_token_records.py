"""Token records: exact round trips against plain encoding."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobtables.llm.token_records import (Encoder, read_records, token_records, write_records)

SF001 = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    tok = Tokenizer.from_file(VOCAB)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]


def expected(rows):
    encode, out, start = plain(), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_chunks_equal_whole_texts():
    random.seed(5)
    alphabet = ["a", "Word", "é", "ß", "Ñandú", "ªº", "ɏ", "ʼn", "x́", "日本", "word.", "(a)", "n't", "**", "'s", "'ll", "12", ".", "!!", "|", " ", " ", "  ",
                "\n", "\n\n", "\t", " ", "　", "\x00", "<|endoftext|>", "😀"]
    encode, small = plain(), Encoder(VOCAB, 2, capacity=3)
    for _ in range(3000):
        t = "".join(random.choices(alphabet, k=random.randint(0, 14)))
        assert np.frombuffer(small(t), small.dtype).tolist() == encode(t), repr(t)


def test_words_of_the_documents_equal_whole_texts():
    import pandas as pd
    fast, encode = Encoder(VOCAB, 2, capacity=1000), plain()
    for t in pd.read_parquet(f"{SF001}/documents.parquet").text:
        assert np.frombuffer(fast(t), fast.dtype).tolist() == encode(t)


def test_documents_round_trip(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_records(docs, VOCAB).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_edges_files_and_shuffled_reads(spark, tmp_path):
    rows = [(None, "no id"), (3, None), (1, ""), (2, " \n "), (5, "x" * 50), (4, "many words " * 9000),
            ((1 << 62) + 1, "large id")]
    df = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumns({c: F.lit(0) for c in ("tie", "n", "start", "part")})
    manifest = write_records(df, str(tmp_path / "a"), VOCAB, file_bytes=100, partitions=2)
    assert manifest.count() > 2
    want = expected(rows)
    plain_read = read_records(spark, manifest, with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in plain_read] == want
    encode = plain()
    texts = dict(rows)
    assert all(r.ids == encode(texts[r.doc_id]) for r in plain_read)
    mixed = read_records(spark, manifest, shuffle_seed=3).collect()
    assert sorted(map(tuple, mixed), key=lambda r: r[1]) == want


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 50 + [(1, "other")], "doc_id long, text string")
    got = token_records(df, VOCAB).orderBy("start").collect()
    assert len(got) == 51
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_records(df, VOCAB).count() == 0


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string")
    manifest = write_records(df, str(tmp_path / "b"), VOCAB, partitions=1)
    path = glob.glob(str(tmp_path / "b" / "records" / "*.rec"))[0]
    data = bytearray(open(path, "rb").read())
    data[25] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        read_records(spark, manifest).collect()


def library(text):
    """The library's encoding with no flag but ``add_special_tokens``."""
    return Tokenizer.from_file(VOCAB).encode(text, add_special_tokens=False).ids + [2]


def test_added_tokens_in_texts_have_their_ids(spark, tmp_path):
    assert library("x <|endoftext|> y") == [87, 220, 50256, 331, 2]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b\nc", "no token", "<|endoftext |>",
             "end<|endoftext|><|endoftext|> \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = write_records(df, str(tmp_path / "c"), VOCAB)
    got = read_records(spark, manifest, with_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [library(t) for t in texts]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_chunks_with_added_tokens_equal_whole_texts():
    random.seed(6)
    alphabet = ["a", "Word", "é", "word.", "'s", "12", "|", "<", " ", " ", "  ", "\n", "<|endoftext|>", "<|endoftext"]
    tok = Tokenizer.from_file(VOCAB)
    small = Encoder(VOCAB, 2, capacity=3, added_tokens=True)
    for _ in range(2000):
        t = "".join(random.choices(alphabet, k=random.randint(0, 14)))
        assert np.frombuffer(small(t), small.dtype).tolist() == \
            tok.encode(t, add_special_tokens=False).ids + [2], repr(t)
