import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import quality
from tidewright.llm.common import table
from tidewright.llm.crf import LinearChainCRF

import itertools


def slow_repeats(words, k=5):
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(k)}
    return len(inside)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeat_words(words):
    assert quality.repeat_words(words) == slow_repeats(words)


def test_repeat_words_with_a_large_vocabulary():
    words = [f"w{i}" for i in range(9000)] + [f"w{i}" for i in range(50, 60)]
    assert quality.repeat_words(words) == 20


def test_base_counts_by_hand():
    text = "a b c\n\na b c\n  \n#*é $x|\na b c"
    n, chars, symbols, dups, repeats, failed, kept, *_ = quality.judge_text(text, None)
    assert (n, chars, symbols, dups, repeats, failed, kept) == (11, 15, 4, 2, 0, False, True)
    assert quality.judge_text(None, None)[:7] == (0, 0, 0, 0, 0, True, False)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    crf = LinearChainCRF(np.zeros((1, 2)), rng.normal(size=(2, 2)), np.zeros(0), np.ones(0))
    for n in range(1, 8):
        s = rng.normal(size=(n, 2))
        total = {p: sum(s[i, k] for i, k in enumerate(p)) + sum(crf.transition[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=n)}
        assert tuple(crf.viterbi(s)) == max(total, key=total.get)


def test_fit_learns_a_chain():
    rng = np.random.default_rng(1)
    ys = [np.repeat(rng.integers(0, 2, 8), 5) for _ in range(40)]
    xs = [y[:, None] + rng.normal(scale=0.7, size=(40, 1)) for y in ys]
    crf = LinearChainCRF.fit(xs[:30], ys[:30])
    right = np.mean([np.mean(np.array(crf.viterbi(crf.scores(x))) == y) for x, y in zip(xs[30:], ys[30:])])
    alone = np.mean([np.mean((x[:, 0] > 0.5) == y) for x, y in zip(xs[30:], ys[30:])])
    assert right > alone + 0.05


def test_held_out_labels(spark):
    """Fitted on the labels of odd ids, judged on those of even ids."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 1"), limit=100)
    judged = quality.judge(docs, model, "v").join(labels.where("doc_id % 2 = 0"), "doc_id").selectExpr("v.base_failed", "v.kept", "quality").collect()
    judged = [r for r in judged if not r.base_failed]
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_lines_of_mixed_documents(spark):
    """Held-out documents of both kinds laid one into the other: lines are told apart within one document."""
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 1"))
    rows = docs.join(labels.where("doc_id % 2 = 0"), "doc_id").where("length(text) between 400 and 6000").orderBy("doc_id").select("text", "quality").collect()
    good, bad = ([[x for x in r.text.split("\n") if len(x.split()) > 3][:8] for r in rows if r.quality == q] for q in (1, 0))
    right = total = both = n = 0
    for one, two in zip([g for g in good if len(g) > 1] * 3, [b for b in bad if b] * 3):
        lines, truth = one[: len(one) // 2] + two + one[len(one) // 2 :], [1] * (len(one) // 2) + [0] * len(two) + [1] * (len(one) - len(one) // 2)
        marks = model.viterbi(model.scores(quality.line_features(lines, [x.split() for x in lines])))
        right += sum(a == b for a, b in zip(marks, truth))
        total += len(lines)
        both += len(set(marks)) == 2
        n += 1
    print(f"lines right {right / total:.3f}, documents with both labels {both / n:.3f} of {n}")
    assert n >= 20 and right / total > 0.9 and both / n > 0.8


def test_frequent_lines_are_boilerplate_in_good_documents():
    prose = ["Rain fell all morning and the boats stayed in.", "Nobody minded much; there was work on land."]
    rows = [quality._training_rows("\n".join([prose[0] + str(i), "All rights reserved.", prose[1] + str(i), ""])) for i in range(6)]
    rows += [quality._training_rows("\n".join(prose))] * 9
    frequent = quality.frequent_lines([d for _, d in rows])
    assert len(frequent) == 1 and quality.line_labels(1, rows[0][1], frequent).tolist() == [1, 0, 1, 1] and quality.line_labels(1, rows[-1][1], frequent).tolist() == [1, 1]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (10, 0, 0), (None, 1, None), (4, None, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(odd_docs, labels)
    out = quality.judge(odd_docs, model, "v2")
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "v2"]
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} >= {3, 4}
    assert quality.fit(odd_docs, labels.where("quality = 1")) is None and quality.fit(odd_docs, labels.limit(0)) is None
    assert quality.keep_good(no_docs, labels).count() == 0
