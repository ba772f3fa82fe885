import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return bpe.ForcedBoundaryBPE(bpe.vocabulary_text(), memo_words=500)


def test_same_as_the_library_on_random_texts(library, own):
    rng = random.Random(7)
    letters = "abz AZ09'²½ ́\x1c\x1d\x85\xa0　 \n\n\t éßſñ日本😀​._-'s're \r\n\x0b\x00\x7f٠ªº"
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.1:
            text = f"<|endoftext|>{text}<|endoftext|>"
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_where_no_token_reaches(own):
    raw = "qzx'é thonbleon".encode()
    parts = own.fragments(raw)
    assert b"".join(parts) == raw
    assert all((a[-1], b[0]) not in own.joined for a, b in zip(parts, parts[1:]))
    assert all(pair in own.joined for p in parts for pair in zip(p, p[1:]))


def test_words_in_use_outlive_a_full_memo():
    made = []
    memo = bpe._Memo(lambda w: made.append(w) or w.encode(), 3)
    for word in ["a", "b", "c", "d", "a", "e", "a", "x" * 300, "x" * 300]:
        assert memo[word] == word.encode()
    assert made.count("a") == 1 and made.count("x" * 300) == 2 and len(memo) + len(memo.old) <= 6


def test_query_rows(spark, odd_docs, library):
    rows = bpe.digests(odd_docs).collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_empty_and_taken_names(odd_docs, no_docs):
    assert bpe.digests(no_docs).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd_docs)
    assert bpe.encode(odd_docs, ids="token_ids").columns == [*odd_docs.columns, "token_ids"]


def test_decoding_null_ids(spark):
    df = spark.createDataFrame([(1, [104]), (2, None), (3, [])], "i int, ids array<int>")
    assert [r.decoded is not None for r in bpe.decode(df).collect()] == [True] * 3


def test_one_word_pieces_are_encoded_once():
    """Letters between spaces, with a mark behind them or not, are one word that the model sees once; ids are the library's."""
    library, made = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)), []
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary_text())
    own._pack_word = lambda word, make=own._pack_word: made.append(word) or make(word)
    text = "So harbour harbour, harbour. and harbour! were harbour; of harbour? said it"
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert made.count(" harbour") == 1
    for odd in ("x é. ñandu, ß! ª. c º, Ⅻ. d", "a 's. b 't, c 's b", "x ʰ. y ٣. z", "a 日本. 本 c", "a .. b ., c", "q word.\nnext w", "a ſ. İ. b", "tab\tb. c d, \n e. f", "a " + "é" * 300 + ". b", " b, ", "a <|endoftext|>. b"):
        assert own.encode(odd) == library.encode(odd, add_special_tokens=False).ids, odd
