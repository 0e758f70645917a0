"""Token files: exact round trips, and whole-text encoding as the oracle of the piecewise one."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        assert (tokens.unpack(*tokens.pack(v), n) == v).all()


def test_pieces_equal_whole_texts(whole):
    enc = tokens.Encoder(PATH)
    alphabet = st.sampled_from(list("ab'sZ9 .\n\t\r\x0b#  éß中\U0001f600 ") + ["  ", "'ll", " the", "<|endoftext|>", "\x1c", "\x85"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(alphabet, max_size=25).map("".join))
    def check(text):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == whole(text)

    check()


def test_files(spark, whole):
    rng = random.Random(3)
    rows = [(i * 2, " ".join(rng.choice(["alpha", "Beta.", "γάμμα", "x\ny", "", "7"]) for _ in range(rng.randrange(40))), 1) for i in range(150)]
    rows += [(7, None, 1), (9, "", 1), (11, "long text " * 3000, 1), (4, rows[2][1], 1), (4, rows[2][1], 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    files = tokens.write_tokens(docs, PATH, block_ids=500)
    got = files.digest().orderBy("start").collect()
    at = 0
    for r, (d, t, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = np.array([*whole(t), 0], dtype="<u4")
        assert tuple(r) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    back = {r["doc_id"]: r["ids"] for r in files.ids().collect()}
    assert all(back[d] == [*whole(t), 0] for d, t, _ in rows)


def test_special_tokens_as_the_library_reads_them(whole):
    enc = tokens.Encoder(PATH)
    assert enc.by_words
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x.\n<|endoftext|>y, z", "  <|endoftext|>  "):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == whole(t)
    assert np.frombuffer(enc.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_another_file_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, tok = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Words, here.", None, "", "two\nlines  of it"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    assert [r["doc_id"] for r in tokens.write_tokens(docs, PATH).digest().orderBy("start").collect()] == ["a", "b"]


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "b"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = tokens.write_tokens(docs, PATH).digest().collect()
    assert sorted((str(r["doc_id"]), r["start"]) for r in got) == [("1", 4), ("None", 0), ("None", 2)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.write_tokens(empty, PATH).digest().collect() == []
