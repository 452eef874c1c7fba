import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from yieldnorm.llm import bpe, token_count

from ..conftest import SF0001

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "a", "  a  b ", "a" * 300, "ab" * 3000, "x<|endoftext|>y <|endoftext|>", "\n\n a\n\tb\n", "don't I'll WE'RE 's",
         "你好 мир ñandú ＡＢＣ", " x y", "a\x1cb \x1c c", "² ½ Ⅷ", "ΣΑΣ İ ς", "🙂👨‍👩‍👧 ok", "0123456789" * 20, "<|startoftext|>A", "tab\tv\x0bf\x0cr\r"]


@pytest.fixture(scope="module")
def counter():
    return bpe.ByteCounter(BYTE, max_runs=50)  # so small that the table is emptied again and again


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordEncoder(WORD, max_runs=50)


ALPHABET = st.text(alphabet="aAbB'sSt T\n\n  .,!é ñ你́\x85\xa0019²<|endoftext|>", max_size=60)


@settings(max_examples=100, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_counts_and_ids_equal_the_library(counter, encoder, texts):
    texts = texts + TEXTS[:4]
    lib = Tokenizer.from_file(BYTE)
    assert counter.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    lib = Tokenizer.from_file(WORD)
    assert [x.tolist() for x in encoder.ids(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_fixed_texts_and_documents(counter, encoder, spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("text").collect()]
    lib = Tokenizer.from_file(BYTE)
    assert counter.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    lib = Tokenizer.from_file(WORD)
    assert [x.tolist() for x in encoder.ids(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_only_distinct_runs_are_looked_up():
    class Counted(dict):
        looked = 0

        def get(self, k, default=None):
            Counted.looked += 1
            return super().get(k, default)

        def __getitem__(self, k):
            Counted.looked += 1
            return super().__getitem__(k)

    enc = bpe.WordEncoder(WORD)
    first = enc.ids(["one two three\n<|endoftext|> İ 你"] * 50)
    enc.runs.at = Counted(enc.runs.at)
    again = enc.ids(pa.array(["one two three\n<|endoftext|> İ 你"] * 50))
    assert [x.tolist() for x in again] == [x.tolist() for x in first]
    assert 0 < Counted.looked <= 12  # of 300


def test_count_tokens(spark):
    lib = Tokenizer.from_file(BYTE)
    data = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (99, None, 2), (0, "", 5), (100, "word " * 5000, None)]
    got = token_count.count_tokens(spark.createDataFrame(data, "doc_id long, text string, n_tokens int"), BYTE).collect()
    want = []
    for d, t, _ in data:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d is None, d or 0, len((t or "").encode()), n, n > 1024))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0
