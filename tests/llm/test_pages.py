"""Pages written by hand, with the texts that a reader would take from them: most have no telling tags or names."""

import pytest

from tidewright.llm import html_text

A = "The bridge was closed for most of the spring. Engineers found that two of the older cables had lost a third of their strength."
B = "Work went on at night, when few trains had to wait. By June the new cables were in place, and the first lorries crossed again."
C = "A report on the costs is expected in the autumn; the council has set money aside, but nobody can say yet whether it is enough."
NAV = "<nav><ul><li><a href='/'>Start</a></li><li><a href='/local'>Local</a></li></ul></nav>"
FOOT = "<footer><p>© 2023 The Evening Post</p></footer>"
NAMES = ["Olga Reed", "Per Dahl", "Rosa Kern", "Sam Vance", "Tess Wild", "Uri Katz", "Vera Long", "Will Penn", "Xenia Rao", "Yan Zhou"]
LISTED = "".join(f"<li><a href='/p/{i}'>{n}</a></li>" for i, n in enumerate(NAMES))

PAGES = {
    "one block": (f"<body>{NAV}<div>{A}<br><br>{B}<br><br>{C}</div>{FOOT}</body>", f"{A} {B} {C}"),
    "one block alone": (f"<div>{A}<br>{B}</div>", f"{A} {B}"),
    "linked names in an article": (f"<body>{NAV}<article><h1>Who built it</h1><p>{A}</p><ul>{LISTED}</ul><p>{B}</p></article>{FOOT}</body>", " ".join(["Who built it", A, *NAMES, B])),
    "linked names in a plain box": (f"<body>{NAV}<div><h1>Who built it</h1><p>{A}</p><ul>{LISTED}</ul><p>{B}</p></div>{FOOT}</body>", " ".join(["Who built it", A, *NAMES, B])),
    "headline in a header": (f"<body>{NAV}<article><header><h1>The bridge is open</h1></header><p>{A}</p><p>{B}</p></article>{FOOT}</body>", f"The bridge is open {A} {B}"),
    "image in a word": (f"<body><article><p>Auto<img src='a.png'>mobile traffic. {A}</p></article></body>", f"Automobile traffic. {A}"),
    "paragraphs in the body": (f"<body><h1>The bridge is open</h1><p>{A}</p><p>{B}</p><p>{C}</p></body>", f"The bridge is open {A} {B} {C}"),
    "plain boxes": (f"<body><div><a href='/'>Start</a> <a href='/l'>Local</a></div><div><h1>The bridge is open</h1><p>{A}</p><p>{B}</p></div><div><p>© 2023 The Evening Post</p></div></body>", f"The bridge is open {A} {B}"),
    "quotation and list": (f"<body>{NAV}<div><p>{A}</p><blockquote><p>It held for eighty years, and it would have held for ten more.</p></blockquote><ul><li>Two cables were changed.</li><li>Nine weeks were planned.</li></ul><p>{C}</p></div>{FOOT}</body>", f"{A} It held for eighty years, and it would have held for ten more. Two cables were changed. Nine weeks were planned. {C}"),
    "table": (f"<body>{NAV}<main><p>{A}</p><table><tr><th>Cable</th><th>Strength</th></tr><tr><td>North</td><td>64 %</td></tr></table><p>{B}</p></main></body>", f"{A} Cable Strength North 64 % {B}"),
    "sidebar": (f"<body><div class='sidebar'><h3>Most read</h3><ul><li><a>Rain again</a></li></ul></div><div><p>{A}</p><p>{B}</p><p>{C}</p></div></body>", f"{A} {B} {C}"),
    "notice and advert": (f"<body><div class='cookie-banner'><p>We use cookies. Is that all right with you?</p></div><div><p>{A}</p><div class='ad'><p>Cheap tickets to the coast!</p></div><p>{B}</p></div></body>", f"{A} {B}"),
    "named comments": (f"<body><article><h1>The bridge is open</h1><p>{A}</p><p>{B}</p></article><section class='comments'><h2>2 comments</h2><p>At last. I had to drive around for months, every single day.</p></section></body>", f"The bridge is open {A} {B}"),
    "references and white space": (f"<body><article><p>Cables &amp; bolts&#58;\n   {A}</p>\n\n<p>{B}&nbsp;</p></article></body>", f"Cables & bolts: {A} {B}"),
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return html_text.fit(spark.read.parquet(f"{sf}/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_main_text(model, name):
    html, want = PAGES[name]
    assert html_text.main_text(html, model) == want


def test_repeated_and_huge_pages(spark, model):
    huge = "<article>" + "".join(f"<p>{A}</p>" for _ in range(html_text.TRAIN_BLOCKS + 1)) + "</article>"
    df = spark.createDataFrame([(1, huge), (2, PAGES["table"][0]), (2, PAGES["table"][0])], "page_id int, html string")
    rows = [r.text for r in html_text.extract(df, html_text.fit(df)).orderBy("page_id").collect()]
    assert rows[0] == " ".join([A] * (html_text.TRAIN_BLOCKS + 1)) and rows[1] == rows[2]
