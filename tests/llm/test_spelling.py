import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewright.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def near_pairs(words):
    """All pairs one edit apart, by the texts left after one deletion, each checked."""
    groups = defaultdict(set)
    for w in words:
        groups[w].add(w)
        for d in deletions(w) if len(w) < 1000 else ():
            groups[d].add(w)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b and near(a, b)}


def counts_of(docs):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def expected(counts):
    near_of = defaultdict(list)
    for a, b in near_pairs(counts):
        near_of[a].append(b)
        near_of[b].append(a)
    forms = {}
    for w, n in counts.items():
        best = min(near_of[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 5 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, len(near_of[w]), counts[forms[w]] if forms[w] else None) for w, n in counts.items()}


def some_words(rng, letters, n):
    words = set()
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 16)))
        i, k = rng.randrange(len(w)), rng.randrange(3)
        words |= {x for x in (w, w[:i] + (rng.choice(letters) if k != 1 else "") + w[i + (k != 0) :]) if len(x) >= 6}
    return words


def test_index_finds_every_near_pair_with_any_dictionary():
    rng = random.Random(5)
    for trial in range(40):
        words = some_words(rng, rng.choice(["a", "ab", "abc", "abcdefghé"]), 60)
        counts = Counter(w[i : i + k] for w in words for k in range(2, 6) for i in range(len(w) - k + 1))
        least = rng.choice([0, 1, 3, 10, 50, 10**9])
        frequent = {g: c for g, c in counts.items() if c > least and len(g) < 5}
        lists, found = defaultdict(list), set()
        entries = [(w, r) for w in words for r in spelling.index_rows(w, frequent, {g[1:] for g in frequent}, counts)]
        for w, r in entries:
            assert r[6] >= 1
            if not r[3]:
                lists[r[:3]].append((w, r))
        for w, r in entries:
            for v, q in lists[r[:3]]:
                if (r[3] or v < w) and min(q[5] - q[4], r[5] - r[4]) >= max(q[6], r[6]) and near(v, w):
                    found.add((min(v, w), max(v, w)))
        assert found == near_pairs(words), trial


def test_grams_cover_and_do_not_contain_each_other():
    grams = spelling.decomposed("retrieval", 4, {"re", "ret", "et", "ie", "va", "al"})
    assert [("retrieval"[p:e]) for p, e in grams] == ["retr", "ri", "iev", "val"]
    assert spelling.decomposed("retrieval", 2, {"re"}) == [(i, i + 2) for i in range(8)]


def test_dictionary_is_bounded(spark):
    rng = random.Random(6)
    words = spark.createDataFrame([(w,) for w in some_words(rng, "abcdefghijklmnop", 800)], "word string")
    frequent, places = spelling.gram_dictionary(words, frequent=400)
    sizes = Counter(map(len, frequent))
    assert set(sizes) <= {2, 3, 4} and max(sizes.values()) <= 400
    assert all(len(g) == 2 or g[:-1] in frequent for g in places)
    text = [r.word for r in words.collect()]
    assert all(places[g] == sum(w[i : i + len(g)] == g for w in text for i in range(len(w))) for g in rng.sample(sorted(places), 50))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_brute_force(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = spelling.op11_spelling(spark, folder)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected(counts_of(docs))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)
    assert any(form for _, form, *_ in want)


def test_chains_hubs_and_ties(spark):
    # chains of forms, a hub with many near words, equal counts
    counts = {"colours": 1250, "colour": 250, "colou": 3, "coloor": 50, "colooor": 10, "coloooor": 2, "kolours": 5, "zebras": 60, "zebrax": 60, "zebraz": 5}
    counts |= {f"hub{c}letters": 5 for c in "abcdefghijklmnopqrstuvwxyz"} | {"hubletters": 900}
    counts = {w: n for w, n in counts.items() if len(w) >= 6}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert set(map(tuple, rows)) == expected(counts)
    by = {r.word: r for r in rows}
    assert by["coloooor"].root == "colours" and by["zebraz"].form == "zebras" and by["hubletters"].n_near == 26


def test_long_words(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abc") for _ in range(5000))
    edits = [base, base[1:], base[:-1], base[:2500] + base[2501:], base[:99] + "z" + base[99:], base[:99] + "z" + base[100:], base[:99] + "y" + base[100:], base + "z", "z" + base, base[:-1] + "z", base[2:], base[::-1]]
    edits += [w[:200] for w in edits]
    words = sorted(set(edits))
    rows = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect()
    assert {tuple(sorted((r.a, r.b))) for r in rows} == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    assert len(rows) > 15


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    many = odd_docs.unionAll(odd_docs).unionAll(odd_docs).unionAll(odd_docs).unionAll(odd_docs)
    assert set(map(tuple, spelling.variants(spelling.counted_words(many)).collect())) == expected(counts_of(docs * 5))
    assert spelling.variants(spelling.counted_words(no_docs)).count() == 0
