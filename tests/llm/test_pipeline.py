"""Each stage of the pipeline against rules written out here, without the operators' own code."""

import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidewright.llm.common import table

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows_of(df):
    return [(r.doc_id, r.source, r.text) for r in df.collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fails_base_rules(text):
    words = words_of(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words) < 10 or 100 * len(again) > 20 * len(words)


def test_quality_rules(spark, docs):
    kept = {r.doc_id for r in STAGES["quality rules"](spark, docs, SF).collect()}
    rows = rows_of(docs)
    assert not kept & {i for i, _, t in rows if fails_base_rules(t)}
    # what was labelled: the model has seen some of them, so this is a check of sense, not of generalisation
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good, bad = ([i for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_line_dedup(spark, docs):
    pages = defaultdict(set)
    for _, source, text in rows_of(docs):
        if text is not None:
            pages[source].add(text)
    boilerplate = {}
    for source, texts in pages.items():
        counts = defaultdict(int)
        for text in texts:
            for line in {x.strip(" ") for x in text.split("\n")} - {""}:
                counts[line] += 1
        boilerplate[source] = {line for line, n in counts.items() if n >= 5 and n > 0.03 * len(texts)}
    assert any(boilerplate.values())
    want = sorted((i, s, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in boilerplate[s])) for i, s, t in rows_of(docs))
    assert sorted(rows_of(STAGES["line dedup"](spark, docs, SF))) == want


def shingles(text):
    words = [w.translate(LOWER) for w in words_of(text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups_of(rows, similarity=0.8):
    """The smallest id of each document's group, by comparing all pairs."""
    sets = sorted(((shingles(t), i) for i, _, t in rows), key=lambda x: (len(x[0]), x[1]))
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, i) in enumerate(sets):
        for b, j in sets[k + 1 :]:
            if similarity * len(b) > len(a):
                break
            same = len(a & b)
            if same >= similarity * (len(a) + len(b) - same) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_dedup(spark, docs):
    rows = rows_of(docs)
    kept = sorted(i for i, _, _ in rows_of(STAGES["simhash near-dedup"](spark, docs, SF)))
    roots = groups_of(rows)
    assert kept == sorted(set(roots.values()))
    assert len(kept) < len(rows)


def test_near_dedup_of_form_letters(spark):
    """One long sentence with another word in each text: a bucket of many groups."""
    base = [f"word{k}" for k in range(40)]
    texts = []
    for n in range(300):
        own = list(base)
        own[(7 * n) % 40] = f"name{n}"
        texts.append(" ".join(own + ([f"end{n % 5}"] * (n % 3))))
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in STAGES["simhash near-dedup"](spark, df, SF).collect())
    assert kept == sorted(set(groups_of([(i, "s", t) for i, t in enumerate(texts)]).values()))


def test_decontamination(spark, docs):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        own = words(r.text)
        windows |= {tuple(own[i : i + 10]) for i in range(len(own) - 9)} if len(own) >= 10 else {tuple(own)} - {()}
    sizes = {len(w) for w in windows}
    rows = rows_of(docs)
    hit = {i for i, _, t in rows for own in [words(t)] for n in sizes if any(tuple(own[k : k + n]) in windows for k in range(len(own) - n + 1))}
    kept = rows_of(STAGES["benchmark decontamination"](spark, docs, SF))
    assert hit and sorted(kept) == sorted(r for r in rows if r[0] not in hit)


def test_bpe_encoding(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, _, text in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, STAGES["bpe encoding"](spark, docs, SF).collect())) == sorted(want)


def test_run_applies_the_stages_in_turn(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
