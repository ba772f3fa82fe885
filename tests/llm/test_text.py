"""Operators 4 and 5, and the pipeline."""

import random
import re

import pytest

import corpus_pipeline
from tidewright.llm import bpe, decontaminate, html_text, line_dedup, pii, quality
from tidewright.llm.common import table


def slow_pii(t):
    t = t or ""
    out = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), 4, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_by_the_patterns():
    rng = random.Random(9)
    for _ in range(6000):
        text = "".join(rng.choice(["a", "é", "@", "@b.c", ".", "1", "25", "4", "+1", "(", ") ", "-", " ", "%", "_x", "\n", "79927398713", "0000"]) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == slow_pii(text), repr(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000 + ".2.3.4") == slow_pii("") and len(pii.base_spans("x@y.z" * 5)) == len(slow_pii("x@y.z" * 5))


def test_discovery(spark):
    """Seeds in a context teach it; identifiers of no known kind in that context are found, others are not."""
    rows = [(i, f"please mail customer reference person{i}@mail.example now and then") for i in range(12)]
    rows += [(100 + i, f"please mail customer reference ZX-{i}98{i}77-Q now and then") for i in range(2)]
    rows += [(200 + i, f"an order of type AB-{i}4433 was made on day {i} of the year {1900 + i}") for i in range(5)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(len(out[i].base) == 1 and not out[i].discovered for i in range(12))
    for i in (100, 101):
        (s,) = out[i].discovered
        assert rows[i - 100 + 12][1][s.start : s.end] == f"ZX-{i - 100}98{i - 100}77-Q"
    assert not any(out[200 + i].discovered for i in range(5))


def slow_words(text, start, end):
    return text[:start].split()[-2:], text[end:].split()[:2]


def test_context_words_are_whole():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b" * 70, " ", " ", "\n", "id=", "4", "-", "x@y.zz"]) for _ in range(rng.randint(1, 14)))
        runs = [m.span() for m in re.finditer(r"\S+", text)]
        for start in range(len(text)):
            for end in range(start + 1, min(len(text), start + 4) + 1):
                if text[start].isspace() or text[end - 1].isspace():
                    continue
                before, after = ([pii._name(re.sub("[0-9]", "0", w.lower())) for w in side] for side in slow_words(text, start, end))
                want = [" ".join([*before, "_"])] if len(before) == 2 else []
                want += [f"{before[-1]} _ {after[0]}"] if before and after else []
                want += [" ".join(["_", *after])] if len(after) == 2 else []
                assert pii.patterns(text, start, end, runs) == want, (text, start, end)


def test_long_names_stay_apart():
    """Identifiers equal in their first 256 characters, and context words of the same beginning, are different nodes."""
    one, two = ("k" * 300 + f"{n}123" for n in (1, 2))
    (a,), (b,) = (pii.occurrences(f"before {x} after") for x in (one, two))
    assert a[3] != b[3] and len(a[3]) < 64 and a[4] == b[4]
    long = "w" * 200
    assert pii.occurrences(f"see {long}1 ab-12345 end")[-1][4] != pii.occurrences(f"see {long}x ab-12345 end")[-1][4]


def test_chains_of_patterns_are_followed_to_their_end(spark):
    """Ten contexts, each sharing identifiers with the next: the last is reached only by nine rounds and more."""
    say = lambda k, x: f"c{'abcdefghijk'[k] * 2} d{'abcdefghijk'[k] * 2} {x} e{'abcdefghijk'[k] * 2} f{'abcdefghijk'[k] * 2}"
    rows = [say(0, f"user{i}@mail.example") for i in range(30)] + [say(0, f"ref0-{i}{i}07") for i in range(3)]
    for k in range(1, 10):
        rows += [say(k, f"user{i}@mail.example") for i in range(12)] + [say(k, f"ref{k - 1}-{i}{i}{k - 1}7") for i in range(3)] + [say(k, f"ref{k}-{i}{i}{k}7") for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    last = {r.doc_id for r in pii.find(docs).where("size(discovered) > 0").collect()}
    assert {i for i, t in enumerate(rows) if "ref9-" in t} <= last


def test_pii_on_odd_rows(spark, odd_docs, no_docs):
    rows = pii.find(odd_docs).collect()
    want = [(r.doc_id, slow_pii(r.text) if len(r.text or "") < 1000 else None) for r in odd_docs.select("doc_id", "text").collect()]
    assert len(rows) == len(want) and {(r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in rows} >= {(i, tuple(s)) for i, s in want if s}
    assert pii.find(no_docs).count() == 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def model(spark, sf):
    return html_text.fit(table(spark, sf, "pages"))


PROSE = "The tide came in slowly. Nobody on the pier moved, and the gulls had gone."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p", ""), ("<!-- never closed", ""),
        (page(f"<nav><a>Home</a></nav><article><h1>Tides</h1><p>{PROSE}</p></article><footer>(c) x</footer>"), f"Tides {PROSE}"),
        (page(f"<article><p>One&nbsp;&amp; two &lt;b&gt; caf&eacute; &#8212; &amp  x<br>y</p><script>var a='</p>';</script><p>{PROSE}<b>bo</b>ld</p></article>"), f"One & two <b> café — & x y {PROSE}bold"),
        (page(f"<main><p>{PROSE}<p>{PROSE}<div class='ad'>Buy ropes now.</div></main><aside><p>{PROSE}</p></aside>"), f"{PROSE} {PROSE}"),
        (page(f"<article><p>{PROSE}</p><section class='comments'><p>I agree. {PROSE}</p></section></article><div id='cookie-banner'>We use cookies. OK?</div>"), PROSE),
        (page(f"<article><p>{PROSE}</p><form><p>Sign up here today.</p></form></article><div class='sidebar'><h3>Popular</h3><p>{PROSE}</p></div>"), PROSE),
        (f"<article><p>{PROSE}</p><p>Cut off in the <a hre", f"{PROSE} Cut off in the"),
    ],
)
def test_main_text(model, html, text):
    assert html_text.main_text(html, model) == text


def test_pages_without_semantic_tags(model):
    got = html_text.main_text(page(f"<div class='navbar'><a>Home</a> <a>News</a></div><div class='post-content'><h2>Tides</h2><p>{PROSE}</p><p>{PROSE}</p></div><div class='footer'>© 2020 All rights</div>"), model)
    assert got == f"Tides {PROSE} {PROSE}"


def test_held_out_pages(spark, model):
    """Pages of another scale against the text between their article tags."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    for p in pages:
        want = [t for above, t, _ in html_text.leaf_blocks(p.html) if above and any(tag == "article" for tag, _ in above.path())]
        assert html_text.main_text(p.html, model) == " ".join(want)


def test_pages_table(spark, model):
    rows = [(1, "u", None, "x"), (1, "u", page(f"<article><p>{PROSE}</p></article>"), None), (None, None, "plain", "y"), (2, "v", page("<p>" + "w " * 100_000 + "</p>"), None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, ids string")
    out = html_text.extract(df, model)
    assert out.count() == 4 and out.columns == [*df.columns, "text"]
    with pytest.raises(ValueError):
        html_text.extract(out, model)
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


def test_pipeline_stages_in_turn(spark, sf):
    """Every stage keeps the columns, and its decisions are those of its operator's brute-force rules."""
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "bpe encoding"]
    good = stages["quality rules"](spark, docs, sf)
    assert good.columns == docs.columns
    fitted = quality.fit(docs, table(spark, sf, "labels"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if quality.judge_text(r.text, fitted)[6]}
    lined = stages["line dedup"](spark, good, sf)
    assert lined.columns == docs.columns and lined.count() == good.count()
    assert {(r.doc_id, r.text) for r in lined.collect()} == {(r.doc_id, r.text) for r in line_dedup.drop_lines(good).collect()}
    single = stages["simhash near-dedup"](spark, lined, sf)
    assert single.columns == docs.columns
    left = single.collect()
    rows = lined.collect()
    # no two that stay are equal, and every text that went has an equal or near one that stayed
    assert len({r.text for r in left}) == len(left) and {r.text for r in rows if r.text} >= {r.text for r in left}
    clean = stages["benchmark decontamination"](spark, single, sf)
    assert clean.columns == docs.columns
    hit = {r.doc_id for r in decontaminate.judge(single, table(spark, sf, "benchmark")).where("n_hit > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in left} - hit
    last = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, bpe.digests(clean).collect()))


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, sf)
            assert docs_out.columns == docs.columns
            docs_out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()



@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>T</title><meta charset=x><body><p>seen</p><div>too</div></body></html>",
        "<html><head><title>T</title><p>seen</p><div>too</div>",
        "<html><head><title>T</title>seen<div>too</div>",
        "<body><div><svg/>seen<p>too</p></div></body>",
        "<body><div><math/>seen<svg><g><path d='x'/><title/>unseen</g></svg><p>too</p></div></body>",
    ],
)
def test_open_heads_and_self_closed_elements_hide_nothing(html):
    assert [t for _, t, _ in html_text.leaf_blocks(html)] == ["seen", "too"]


def test_very_deep_pages_and_formulas():
    """100,000 open elements take linear time and memory; text of formulas stays."""
    blocks = html_text.leaf_blocks("<div class='content'>x" * 100_000)
    assert len(blocks) == 100_000 and blocks[-1][0].depth == 100_000 and html_text.block_features(blocks).shape[0] == 100_000
    assert [t for _, t, _ in html_text.leaf_blocks("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>")] == ["so x=2 holds"]


def slow_state(path):
    """The label rule, element by element."""
    seen = inside = False
    for tag, named in path:
        seen = seen or tag in html_text._GOOD
        inside = (inside or tag in html_text._GOOD) and tag not in html_text._BAD and not any(i in html_text._BOILER_NAMES for i in named)
        if seen and not inside:
            return 0
    return int(inside)


def test_label_states(spark):
    for p in table(spark, "/root/testdata/sf0.001", "pages").collect():
        blocks = html_text.leaf_blocks(p.html)
        labels = html_text.own_labels(blocks)
        assert labels is None or labels == [slow_state(at.path()) if at else 0 for at, _, _ in blocks]
