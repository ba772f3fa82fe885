import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import periodic


def brute(words, min_words=24, min_times=3):
    n, found = len(words), []
    for q in range(1, n // min_times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.append((i, j + q - i, q))
            i = j + 1
    long = [(s, size, q) for s, size, q in found if size >= max(min_words, min_times * q)]
    return sorted((s, size, q) for s, size, q in long if not any(all(words[k] == words[k + d] for k in range(s, s + size - d)) for d in range(1, q)))


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(rng, letters, n_pieces):
    words = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
    for _ in range(n_pieces):
        root = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
        at = rng.randint(0, len(words))
        words[at:at] = (root * 12)[: rng.randint(1, 90)]
    return words


def test_runs_of_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        words = repeating(rng, range(rng.randint(1, 4)), rng.randint(0, 2))
        for least in ((24, 3), (4, 2)):
            assert sorted(periodic.runs_of(np.array(words, int), *least)) == brute(words, *least), words


def test_common_extensions_and_both_orders():
    rng = random.Random(2)
    for _ in range(200):
        text = [rng.randint(1, 3) for _ in range(rng.randint(2, 120))]
        tree = periodic.SuffixTree(text)
        i, j = np.triu_indices(len(text), 1)
        want = [next((k for k in range(len(text) - b) if text[a + k] != text[b + k]), len(text) - b) for a, b in zip(i.tolist(), j.tolist())]
        assert tree.common(i, j).tolist() == want
        for inverse in (False, True):
            order = sorted(range(len(text) + 1), key=lambda a: [-x if inverse else x for x in text[a:]])
            ranks = tree.ranks(inverse)
            assert sorted(range(len(text) + 1), key=ranks.__getitem__) == order


def test_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 300):
        values = rng.integers(0, 50, n).astype(np.int32)
        first = rng.integers(0, n, 500)
        last = np.minimum(first + rng.integers(0, n, 500), n - 1)
        assert periodic._RangeMin(values).query(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]


def test_batches_of_texts():
    rng, texts = random.Random(4), [None, "", " \n", "x", "\x85 \xa0 a", "a" * 100_000]
    for _ in range(300):
        words = [w if w < 5 else rng.randrange(10**6) for w in repeating(rng, range(12), rng.randint(0, 3))]
        texts.append(rng.choice(["", " ", "\n "]) + "".join(f"wé{w}" + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    found = periodic.collapse_batch(pa.array(texts, pa.string()))
    for text, (runs, joined) in zip(texts, found):
        want = brute(words_of(text))
        assert sorted(runs) == want and joined == collapsed(words_of(text), want)
    assert periodic.collapse_batch(pa.array(texts, pa.string()).slice(7, 50)) == found[7:57]
    assert periodic.collapse_batch(pa.array([], pa.string())) == []


def test_a_text_that_repeats_one_word():
    (runs, joined), = periodic.collapse_batch(pa.array(["spam " * 30_000]))
    assert runs == [(0, 30_000, 1)] and joined == "spam"


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed(words, runs)))


def test_query_rows_against_brute_force(spark):
    rows = periodic.op12_periodic(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    # brute force takes the square of a text's words: short ones only, all of which must be there
    want = {expected(*d) for d in docs if len(words_of(d.text)) <= 600}
    assert len(rows) == len(docs) and len(want) > 100
    assert want <= set(map(tuple, rows))
    assert sum(r.n_runs > 0 for r in rows) > 5


def test_odd_rows(spark, odd_docs):
    rows = periodic.digests(odd_docs).collect()
    short = [expected(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 1000]
    assert len(rows) == odd_docs.count()
    for row in short:
        assert sum(tuple(r) == row for r in rows) == short.count(row)
    (spam,) = (r for r in rows if r.doc_id == 5 and r.n_runs)
    assert (spam.start, spam.period) == (0, 1) and spam.length == 40_000


def test_empty_and_taken_names(odd_docs, no_docs):
    assert periodic.digests(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(odd_docs, name="K")
