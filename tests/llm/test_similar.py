import numpy as np
import pytest

from tidewright.llm import decontaminate, similar, simhash

from .test_simhash import groups


def test_one_of_each_group(odd_docs, no_docs):
    kept = similar.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # both texts of id 5 stay; of the two null ids, one is a copy of 3 and one of 1
    assert ids == [1, 3, 5, 5, 6, 7, 9, 10, 11] and kept.count() == len(ids)
    assert similar.one_of_each_group(no_docs).count() == 0


def shingles(text, n=5):
    w = simhash._WORD.findall(text.translate(simhash._LOWER))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}


@pytest.mark.parametrize("seed", [2, 32])
def test_similar_texts_are_grouped(spark, seed):
    """Edited copies of a few texts: pairs of similarity 0.85 and more share a group, others below 0.6 do not."""
    rng = np.random.default_rng(seed)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(6):
        words = list(rng.choice(pool, 400))
        for copy in range(25):
            own = list(words)
            for at in rng.choice(400, copy // 4, replace=False):
                own[at] = "changed%d" % rng.integers(1000)
            rows.append((base * 1000 + copy, " ".join(own)))
    rows += [(9000 + i, " ".join(rng.choice(pool, 200))) for i in range(60)] + [(9999, None)]
    out = similar.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    group = {r.doc_id: r.component_id for r in out.collect()}
    sets = {i: shingles(t) for i, t in rows if t}
    close = far = lost = 0
    for a in sets:
        for b in sets:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                close += j >= 0.85
                lost += j >= 0.85 and group[a] != group[b]
                far += j < 0.3 and group[a] == group[b]
    assert close > 500 and lost == far == 0
    assert group[9999] == 9999 and len(group) == len(rows)


def exact_groups(rows, similarity=0.8):
    """The groups of exact Jaccard links of five-word shingle sets, and the number of links."""
    sets = {i: shingles(t or "") for i, t in rows}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= round(10 * similarity) * len(sets[a] | sets[b])]
    return groups(near, ids), len(near)


def found_groups(spark, rows, **options):
    out = similar.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), **options)
    return {r.doc_id: r.component_id for r in out.collect()}


def lost_members(got, want):
    return sum(got[i] != c for i, c in want.items())


def test_pairs_in_large_buckets(spark):
    """Pairs of similar texts that all share one long passage: buckets hold texts of many groups."""
    rng = np.random.default_rng(5)
    pool = [f"w{i}" for i in range(5000)]
    passage = list(rng.choice(pool, 310))
    rows = []
    for pair in range(120):
        own = list(rng.choice(pool, 90))
        rows.append((2 * pair, " ".join(passage + own)))
        own[40:42] = ["x", "y"]
        rows.append((2 * pair + 1, " ".join(passage + own)))
    want, near = exact_groups(rows)
    assert near == 120
    assert lost_members(found_groups(spark, rows), want) == 0


def test_one_large_group_of_near_copies(spark):
    """Copies of one text with edits of their own: alike to the text, less so to each other, some only through a chain."""
    rng = np.random.default_rng(6)
    base = list(rng.choice([f"w{i}" for i in range(5000)], 300))
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(300, rng.integers(0, 16), replace=False):
            own[at] = f"e{rng.integers(10_000)}"
        rows.append((i, " ".join(own)))
    want, near = exact_groups(rows)
    assert near > 200 and len(set(want.values())) > 10
    assert found_groups(spark, rows) == want


def templates(n):
    """Texts of one sentence with one word changed: mostly unlike one another, all in the same few buckets."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        own = [f"w{k}" for k in range(40)]
        own[rng.integers(40)] = f"x{i}"
        rows.append((i, " ".join(own)))
    return rows


def test_texts_of_one_template(spark, monkeypatch):
    """Exact groups, and compared pairs that grow with the texts, not with their square."""
    compared = []
    plain = similar.written

    def watched(df, what, **options):
        out = plain(df, what, **options)
        compared.extend([out.count()] * (what == "pairs"))
        return out

    monkeypatch.setattr(similar, "written", watched)
    rows = templates(400)
    want, near = exact_groups(rows)
    assert near > 400 and found_groups(spark, rows) == want
    compared.clear()
    found_groups(spark, templates(3000))
    assert sum(compared) < 2 * 3000


def test_rows_equal_in_every_column(spark):
    """Copies of a row beside near copies of it: all are one group, and each pair is compared once."""
    rows = [r for r in templates(30) for _ in range(20)] + [(100, " ".join(f"w{k}" for k in range(40)))]
    want, _ = exact_groups(rows)
    assert found_groups(spark, rows) == want
    kept = similar.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def block_edits(rng, kind, words, share):
    n = len(words)
    fresh = [f"n{rng.integers(1 << 40)}" for _ in range(n)]
    if kind == "appended":
        return words + fresh[: int(n * share)]
    if kind == "truncated":
        return words[: n - int(n * share)]
    return words[: n - int(n * share)] + fresh[: int(n * share)]


@pytest.mark.parametrize("kind,low,high", [("appended", 0.17, 0.25), ("truncated", 0.14, 0.2), ("replaced", 0.07, 0.11)])
def test_block_edits_between_80_and_85(spark, kind, low, high):
    rng = np.random.default_rng(7)
    pool = [f"w{i}" for i in range(5000)]
    rows = []
    for pair in range(100):
        words = list(rng.choice(pool, 400))
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(block_edits(rng, kind, words, rng.uniform(low, high))))]
    want, near = exact_groups(rows)
    assert near > 85
    assert lost_members(found_groups(spark, rows), want) == 0


def test_links_on_either_side_of_the_threshold(spark):
    """Similarities from 0.76 to 0.84: exactly those of 0.8 and more link; so do very short texts, and 0.8 itself."""
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(5000)]
    rows = []
    for pair in range(120):
        words = list(rng.choice(pool, 204))
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[: 155 + pair // 2]))]
    rows += [(1000, "a b c d e f g h i"), (1001, "a b c d e f g h"), (1002, "a b c d e f g"), (1003, "q r"), (1004, "Q r"), (1005, None), (1006, " \n")]
    want, near = exact_groups(rows)
    assert 40 < near < 110 and want[1001] == 1000 and want[1002] == 1002 and want[1006] == 1005
    assert found_groups(spark, rows) == want


def dealt_bytes(spark):
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_stay_where_they_are(spark):
    """Where keys are too many to be broadcast, only the texts of compared and of dropped documents are shuffled."""
    rng = np.random.default_rng(10)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"))
    long = lambda: " ".join("".join(w) for w in rng.choice(letters, (150, 80)))
    rows = [(i, long()) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)] + [(2000 + i, rows[i][1]) for i in range(10, 30)]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    docs = similar.written(spark.createDataFrame(rows, "doc_id bigint, text string"), "texts")
    spark.conf.set(threshold, "-1")
    try:
        start = dealt_bytes(spark)
        kept = [r.doc_id for r in similar.one_of_each_group(docs).collect()]
        dealt = dealt_bytes(spark) - start
    finally:
        spark.conf.set(threshold, before)
    assert sorted(kept) == list(range(600))
    assert 2 * dealt < sum(len(t) for _, t in rows)


@pytest.mark.parametrize("set_words", [1, 1 << 18])
def test_full_bitmaps_lose_nothing(spark, monkeypatch, set_words):
    """With a bitmap of one word nearly all rows pass it: the joins behind it decide."""
    monkeypatch.setattr(decontaminate, "SET_WORDS", set_words)
    rows = templates(150) + [(1000 + i, t) for i, t in templates(20)] + [r for r in templates(10) for _ in range(2)]
    want, _ = exact_groups(rows)
    assert found_groups(spark, rows) == want
    kept = similar.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
