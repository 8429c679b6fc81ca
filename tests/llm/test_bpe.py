"""Byte-level BPE against the library, and there and back."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from touchline.llm import bpe

from .conftest import TEXTS

#: Contractions, runs of white space of all kinds, signs, numerals and letters of many scripts, unassigned characters.
MORE = [
    "I'll don't we've 'S 's 'tis it's", "a  b   \n\n c \t d\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 x  y　z ", "1 22 333 ٣٤ Ⅷ ² ½", "!!! ?! ...a", "日本語テキスト 한국어 עברית ไทย",
    "😀😀 👩‍👩‍👧 é", "՘͸ a֋ b\U00016ea0c \U0003fffdx", " ", "\n", "<|endoftext|>", "z" * 5000, " " * 3000 + "end", "ab\x00cd\x7f", "�﻿",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("whole", pat_str=bpe.split_pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, sf, texts, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.op13_byte_bpe(spark, sf).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_words_are_the_librarys(library):
    split = bpe.splitter(bpe.split_pattern()).words
    merge = bpe.merger(bpe.vocabulary())
    for text in [*MORE, *(t for _, t, _, _ in TEXTS if t)]:
        assert "".join(split(text)) == text
        assert [x for w in split(text) for x in merge(w)] == library.encode_ordinary(text)


def test_units_have_the_words_of_the_whole():
    rnd = random.Random(2)
    split = bpe.splitter(bpe.split_pattern()).words
    signs = ["a", "B", "é", "1", "٣", ".", "'s", "'", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "日", "!"]
    known = defaultdict()
    known.default_factory = known.__len__
    units = bpe.Units(split, known)
    for text in [*MORE, *("".join(rnd.choices(signs, k=rnd.randint(0, 12))) for _ in range(20_000))]:
        assert [*units.numbers(text)] == [known[w] for w in split(text)], text


def test_packed_numbers():
    for a in ([], [0], [254, 255, 256, 0, 70_000, (1 << 32) - 1], range(1000)):
        assert bpe._unpack(bpe._pack(np.array(a, np.uint32))).tolist() == list(a)


def test_another_pattern(spark):
    """Patterns whose words hold spaces are not taken apart at spaces."""
    pattern = r"[a-z ]+|[^a-z ]+"
    texts = [(1, "one two 3four five"), (2, "a  b\n c")]
    whole = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
    got = bpe.encode(spark.createDataFrame(texts, "doc_id bigint, text string"), pattern=pattern).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {i: whole.encode_ordinary(t) for i, t in texts}


def test_odd_texts_small_blocks(spark, odd, none, library):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(MORE)], "doc_id bigint, text string")).withColumns({"ids": F.lit("x"), "block": F.lit(1), "n": F.lit(2)})
    want = sorted(map(repr, ((i, *expected(library, t)) for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()])))
    for block in (1, 50, bpe.BLOCK):
        coded = bpe.encode(docs, block=block).withColumn("sha", F.sha2("ids", 256))
        back = bpe.decode(coded, bpe.token_bytes(spark), block=block)
        assert back.columns == ["doc_id", "n_tokens", "sha", "bytes"]
        assert sorted(map(repr, ((r["doc_id"], r["n_tokens"], r["sha"], hashlib.sha256(r["bytes"]).hexdigest()) for r in back.collect()))) == want
    assert bpe.decode(bpe.encode(none), bpe.token_bytes(spark)).collect() == []


def test_large_token_table_is_joined_by_shuffle(spark, odd):
    coded = bpe.encode(odd)
    key = lambda df: sorted(map(repr, df.collect()))
    tokens = bpe.token_bytes(spark)
    assert key(bpe.decode(coded, tokens, most=10)) == key(bpe.decode(coded, tokens))


def test_unknown_id_raises(spark):
    df = spark.createDataFrame([(1, bytearray(np.array([5, 1 << 20], "<u4").tobytes()))], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="no token has the id 1048576"):
        bpe.decode(df, bpe.token_bytes(spark)).collect()


def test_each_distinct_word_is_encoded_in_one_place(spark, documents):
    cut = bpe.pieces(documents.repartition(6), "doc_id", "text", bpe.split_pattern(), 8, 2000)
    rows = cut.filter("words IS NOT NULL").select("bucket", "words").collect()
    place = {}
    for r in rows:
        for w in bpe._unpack_words(bytes(r["words"])):
            assert place.setdefault(w, r["bucket"]) == r["bucket"]
    assert len(rows) > 8 and len(place) > 1000
