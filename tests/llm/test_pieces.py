import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from tidewright.llm import pieces


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_proto=pieces.model_bytes())


@pytest.fixture(scope="module")
def own():
    return pieces.MergeRounds(pieces.model_bytes())


def texts(n, longest, seed):
    rng = random.Random(seed)
    letters = "abthe AZ09 \n\t  ▁▁éßñ日本ゼ😀ﬃ\x00\x7f's.,aaannń"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_same_as_the_library_on_random_texts(library, own):
    some = texts(20_000, 40, 7)
    for k in range(0, len(some), 500):
        for ids, text in zip(own.encode_all(some[k : k + 500]), some[k : k + 500]):
            want = library.encode(text, add_bos=True, add_eos=True)
            assert ids.tolist() == want, repr(text)
            assert own.decode(want) == library.decode(want)


def test_decoding_any_ids(library, own):
    rng = random.Random(8)
    for _ in range(10_000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), rng.randrange(240, 259)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_blocks_end_at_cuts(library):
    small = pieces.MergeRounds(pieces.model_bytes(), block=64)
    some = [*texts(50, 400, 9), " " * 1000, "a" * 1000, "the" * 500, ""]
    assert [x.tolist() for x in small.encode_all(some)] == [library.encode(t, add_bos=True, add_eos=True) for t in some]


def test_repeats_overlaps_and_equal_scores(library, own):
    for text in ["aaaaaaa", "▁" * 37, " " * 15, "a" + " " * 21 + "b", "tthhththth", "anananana", "lllllll", "0" * 50, "=" * 77, "-" * 130]:
        assert own.encode(text) == library.encode(text, add_bos=True, add_eos=True), repr(text)


def test_words_of_equal_hash_are_told_apart(own):
    class Blunt(pieces.MergeRounds):
        def _different(self, letters, starts, sizes):
            self._up = self._down = np.zeros(len(letters) + 1, np.uint64)  # all hashes of words of a size are equal
            return super()._different(letters, starts, sizes)

    some = texts(100, 60, 10)
    assert [x.tolist() for x in Blunt(pieces.model_bytes()).encode_all(some)] == [x.tolist() for x in own.encode_all(some)]


def test_query_rows(spark, odd_docs, library):
    rows = pieces.digests(odd_docs).collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_encode_and_decode_columns(spark, library):
    df = spark.createDataFrame([(1, "hello  world"), (2, None), (3, "")], "i int, text string")
    rows = pieces.decode(pieces.encode(df)).orderBy("i").collect()
    assert [r.ids for r in rows] == [library.encode(r.text or "", add_bos=True, add_eos=True) for r in rows]
    assert [r.decoded for r in rows] == ["hello  world", "", ""]
    empty = spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>")
    assert [r.decoded for r in pieces.decode(empty).collect()] == ["", ""]


def test_empty_and_taken_names(odd_docs, no_docs):
    assert pieces.digests(no_docs).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(odd_docs)


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, RuntimeError, OSError)):
        pieces.MergeRounds(b"no model")
