import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from yieldnorm.llm import packing

from ..conftest import SF0001

WORD = public_tokenizers.path("word_bpe_49k.json")


def rows(spark):
    docs = [(r.doc_id, r.text, 0) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    return docs + [(1000, None, 1), (1001, "", 1), (None, "no id here", 1), (1002, "long words " * 9000, 1)] + [(1003, "twice the same", 1)] * 2


def test_round_trip(spark):
    data = rows(spark)
    df = spark.createDataFrame(data, "doc_id long, text string, length int")
    got = packing.pack(df, WORD, with_ids=True).collect()
    lib = Tokenizer.from_file(WORD)
    want = {}
    for d, t, _ in data:
        want.setdefault(d, []).append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    have = {}
    for r in got:
        assert r.length == len(r.ids) <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        have.setdefault(r.doc_id, []).append(r)
    assert have.keys() == want.keys()
    for d, lists in want.items():
        pieces = sorted(have[d], key=lambda r: r.start)
        if len(lists) == 1:
            assert [x for r in pieces for x in r.ids] == lists[0] and all(r.doc_tokens == len(lists[0]) for r in pieces)
        else:  # repeated rows: each is packed
            assert [r.ids for r in pieces] == lists
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and sum(w[-1]) <= 4096
    total = sum(r.length for r in got)
    assert total / (4096 * len(windows)) > 0.97


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


def test_differencing_is_near_equal_and_counts_rise():
    rng = np.random.default_rng(0)
    size = rng.integers(100, 1025, 600)
    of = packing.difference(size, 75)
    sums = np.bincount(of, size, 75)
    assert sums.sum() == size.sum() and sums.max() - sums.min() <= 30
    place, offset = packing.pack_group(np.full(9, 3000))  # no two fit together
    assert sorted(place) == list(range(9)) and (offset == 0).all()
    place, _ = packing.pack_group(np.full(5000, 2))
    assert place.max() == 2 and np.bincount(place, np.full(5000, 2)).max() <= 4096
    assert len(packing.pack_group(np.zeros(0))[0]) == 0


def test_cuts_cover_each_id_once():
    for n in (1, 1024, 1025, 4095, 4096, 4097, 50_000):
        at = 0
        for a, k in packing.cuts(n):
            assert a == at and 0 < k <= 4096
            at += k
        assert at == n
