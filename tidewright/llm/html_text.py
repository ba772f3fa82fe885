"""Operator 5: main-text extraction by a conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between block-level tags, each with the innermost
element around it, which knows what its ancestors are (memory is linear in the page at any depth). Every
block is a step of a sequence; features are ancestor tags, words of the ancestors'
class, id and role, and the text itself (length, link share, stops). A linear-chain CRF decodes the
page by Viterbi into article and rest; the article's blocks, white space folded, are joined in order.
Text of scripts, styles and the like is markup and never becomes a block.

Training pages: at most TRAIN_PAGES of the table itself, labelled by their own semantic containers
(article, main against nav, header, footer, aside, form and containers named as such), and a fixed
set of labelled pages (LABELLED) that names the containers the sample may lack. Decoding covers
every page and the whole html.

Defined results: null or empty html gives the empty text; character references are decoded, also
unterminated ones; a tag cut off at the page's end is markup; very long and very deep pages are read
whole; an empty table gives an empty table; rows, repeated ones too, are kept one for one; a result
column whose name is taken is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, slices, table
from .crf import LinearChainCRF

#: Pages of the table that the model is fitted on, at most (those of smallest hash).
TRAIN_PAGES = 400
#: Blocks of a page that the model is fitted on, at most: pages of more are not chosen for it.
TRAIN_BLOCKS = 2000

# Kinds of HTML elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template iframe object svg canvas head title textarea select option button".split())
#: Elements that can stand in a head; any other ends it, even without its end tag.
IN_HEAD = set("base basefont bgsound link meta title style script noscript template noframes head html".split())
FOREIGN = ("svg",)
#: An open element of these is closed by the start of the same or of one that cannot stand in it.
CLOSED_BY = {"p": set("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote hr figure address fieldset".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
TAGS = "article main body p h1 h2 h3 h4 h5 h6 li ul ol dl table td th pre blockquote figure figcaption div section nav header footer aside form fieldset dialog menu address details".split()
#: Words in class, id or role, by what they stand for.
NAMED = {
    "content": "article|content|post|entry|story|main|body|text",
    "menu": "nav|navbar|navigation|menu|breadcrumbs?|toc|tabs?|pagination|pager",
    "head": "header|masthead|banner|topbar|hero",
    "foot": "footer|foot|copyright|colophon|legal",
    "side": "sidebar|aside|side|widget|related|recommended|rail|complementary",
    "notice": "cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|paywall|warning",
    "advert": "ads?|adverts?|advertisement|sponsor|sponsored|promo|promotion",
    "comment": "comments?|discussion|disqus|replies|reply|respond|commentlist",
    "share": "share|social|follow|tags|meta|byline|author",
    "form": "form|search|login",
}
_NAMED = [re.compile(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)") for words in NAMED.values()]
_BOILER_NAMES = [i for i, k in enumerate(NAMED) if k != "content"]
_STOP = re.compile(r"[.!?,;:]")
_PLACE = {t: i for i, t in enumerate(TAGS)}
_GOOD, _BAD = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"}


class Element:
    """An open element: its tag, the groups that its names belong to, and what holds for it and all elements around it."""

    __slots__ = ("tag", "named", "around", "tags", "groups", "depth", "state")

    def __init__(self, tag: str, named: tuple[int, ...], around: Element | None):
        self.tag, self.named, self.around = tag, named, around
        self.tags = (around.tags if around else 0) | (1 << _PLACE[tag] if tag in _PLACE else 0)
        self.groups = (around.groups if around else 0) | sum(1 << i for i in set(named))
        self.depth = around.depth + 1 if around else 1
        #: 0: no article around; 1: in one and in no other container; 2: in another container within one
        was = around.state if around else 0
        good = tag in _GOOD and was != 1
        clear = tag not in _BAD and not any(i in _BOILER_NAMES for i in named)
        self.state = 2 if was == 2 else (1 if clear else 2) if was == 1 or good else 0

    def path(self) -> list[tuple[str, tuple[int, ...]]]:
        """(tag, groups) of all elements around, the outermost first."""
        out, at = [], self
        while at:
            out.append((at.tag, at.named))
            at = at.around
        return out[::-1]


class _Blocks(HTMLParser):
    """Collects (innermost element or None, text, characters inside links) of every leaf block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.counts: dict[str, int] = {}
        self.blocks: list[tuple[Element | None, str, int]] = []
        self.text: list[str] = []
        self.linked = self.links = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.open[-1] if self.open else None, text, self.linked))
        self.text, self.linked = [], 0

    def end_head(self) -> None:
        if self.open and self.open[-1].tag == "head":
            self.flush()
            self.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in VOID or tag in INLINE:
            self.links += tag == "a"
            if tag in ("br", "hr"):
                self.text.append(" ")
            if tag == "hr":
                self.flush()
            return
        self.flush()
        while self.open and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self.pop()
        self.hidden += tag in HIDDEN
        said = " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role"))
        named = tuple(i for i, r in enumerate(_NAMED) if r.search(said)) if said else ()
        self.open.append(Element(tag, named, self.open[-1] if self.open else None))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN or any(self.counts.get(t) for t in FOREIGN):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE or tag in VOID:
            return
        self.flush()
        if self.counts.get(tag):
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.counts[tag] -= 1
        self.hidden -= tag in HIDDEN
        self.links = 0
        return tag

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[tuple[Element | None, str, int]]:
    """(innermost element, text, linked characters) of every leaf block, in page order."""
    if not html:
        return []
    # a tag that the page's end cuts off is markup
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<[A-Za-z/!?]", html[cut:]):
        html = html[:cut]
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def block_features(blocks: list[tuple[Element | None, str, int]]) -> np.ndarray:
    rows, n = np.zeros((len(blocks), 2 * len(TAGS) + len(NAMED) + 8), dtype=np.float32), len(blocks)
    places: dict[tuple, list[int]] = {}
    for k, (at, text, linked) in enumerate(blocks):
        row, around = rows[k], (at.tags, at.tag, at.groups) if at else (0, "", 0)
        if around not in places:
            tags, tag, groups = around
            own = [len(TAGS) + _PLACE[tag]] if tag in _PLACE else []
            places[around] = [i for i in range(len(TAGS)) if tags >> i & 1] + own + [2 * len(TAGS) + i for i in range(len(NAMED)) if groups >> i & 1]
        row[places[around]] = 1
        words = text.count(" ") + 1
        row[-8:] = np.log1p(len(text)), np.log1p(words), linked / len(text), len(_STOP.findall(text)) / words, text[-1] in ".!?", "©" in text, k / n, (at.depth if at else 0) / 10
    return rows


def own_labels(blocks: list[tuple[Element | None, str, int]]) -> list[int] | None:
    """1 inside article or main and in no container of another kind, else 0; None if the page has neither."""
    labels = [int(at is not None and at.state == 1) for at, _, _ in blocks]
    return labels if any(at is not None and at.state for at, _, _ in blocks) else None


def _labelled() -> list[str]:
    """Pages whose blocks are labelled by a leading + (article) or - (rest)."""
    prose = "Rain fell on the harbour all morning, and the boats stayed in. Nobody minded much; there was work to do on land, nets to mend and paint to dry."
    more = "By noon the wind had turned. The oldest of the crew said, as always, that it would clear before the evening tide, and this time it did."
    rest = {
        "nav": "<nav><ul><li><a>-Home</a></li><li><a>-News</a></li><li><a>-Contact us</a></li></ul></nav>",
        "menu": '<div class="menu"><a>-Home</a><ul><li><a>-Archive</a></li><li><a>-About</a></li></ul></div>',
        "header": "<header><p>-The Daily Harbour</p><p>-Friday edition</p></header>",
        "head": '<div id="masthead"><div>-The Daily Harbour</div></div>',
        "aside": "<aside><h3>-Read more</h3><p>-Ten boats you should know about, chosen by our readers.</p></aside>",
        "side": '<div class="sidebar"><h3>-Popular</h3><ul><li>-Why nets break</li><li>-A week of rain</li></ul></div>',
        "notice": '<div class="cookie-notice"><p>-We use cookies to improve your visit. You can change this at any time.</p></div>',
        "alert": '<div role="alert"><p>-This site will be down on Sunday, from ten to twelve.</p></div>',
        "ad": '<div class="ad"><p>-Buy two ropes, get one free. Only this week, at every shop.</p></div>',
        "promo": '<section class="sponsored"><p>-Our partner offers the best paint for boats of every size.</p></section>',
        "form": "<form><p>-Sign up for our letter, sent every Friday.</p><div>-Your address</div></form>",
        "search": '<div class="search"><p>-Search this site</p></div>',
        "footer": "<footer>-© 2020 The Daily Harbour. All rights reserved.</footer>",
        "foot": '<div id="footer"><p>-© 2020 The Daily Harbour</p><p>-Terms and privacy</p></div>',
        "comments": f'<section class="comments"><h2>-3 comments</h2><p>-I was there, and it rained much longer than that. {more}</p><div class="comment"><p>-{prose}</p></div></section>',
        "discussion": f'<div id="discussion"><p>-Well said. {prose}</p><ul><li>-{more}</li></ul></div>',
        "flat nav": "<nav><a>-Home</a> <a>News</a> <a>Contact us</a></nav>",
        "links": "<div><a>-Home</a> <a>News</a> | <a>About</a></div>",
        "copyright": "<div><p>-© 2020 The Daily Harbour</p></div>",
        "share": '<div class="share"><ul><li>-Share this</li><li>-Print</li></ul></div>',
    }
    article = f"<h1>+Rain at the harbour</h1><p>+{prose}</p><h2>+Afternoon</h2><p>+{more}</p><blockquote>+It always clears.</blockquote><ul><li>+Nets mended: four.</li><li>+Boats painted: two.</li></ul><table><tr><td>+Rain</td><td>+12 mm</td></tr></table><pre>+tide = 4.2</pre><p>+{more}</p>"
    boxes = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post">{}</div>', '<div class="entry story"><section>{}</section></div>', "<div>{}</div>"]
    pages, parts = [], list(rest.values())
    for k, part in enumerate(parts):
        box = boxes[k % len(boxes)]
        other, third = parts[(k + 5) % len(parts)], parts[(k + 9) % len(parts)]
        half = article.index("<h2>")
        pages.append(f"<body>{part}{box.format(article)}{other}</body>")
        pages.append(f"<body>{other}{box.format(article[:half] + part + article[half:])}{third}</body>")
        pages.append(f"<body>{third}{box.format(article + part)}{rest['foot']}</body>")
    # articles of one block, with lists of links, and with a headline in a header of their own
    flat = f"+{prose}<br><br>{more}<br>{prose}"
    names = "<ul>" + "".join(f"<li><a>+{n}</a></li>" for n in ("Anna Berg", "The harbour of Oban", "Nets and ropes", "Tom Lind", "North pier", "Rain", "Ida Holm", "Paint")) + "</ul>"
    linked = article.replace("<h2>", f"<p>+{prose}</p>{names}<h2>")
    headed = article.replace("<h1>+Rain at the harbour</h1>", "<header><h1>+Rain at the harbour</h1><p>+A morning on land</p></header>")
    for k, box in enumerate(boxes):
        for part in (parts[(3 * k) % len(parts)], parts[(3 * k + 7) % len(parts)]):
            pages.append(f"<body>{part}{box.format(flat)}{parts[(k + 4) % len(parts)]}</body>")
            pages.append(f"<body>{part}{box.format(linked)}{rest['foot']}</body>")
            pages.append(f"<body>{rest['nav']}{part}{box.format(linked)}</body>")
        pages.append(f"<body>{box.format(flat)}</body>")
    for k, part in enumerate(parts):
        pages.append(f"<body>{part}<div>{flat}</div>{rest[('footer', 'foot', 'copyright')[k % 3]]}</body>")
    for box in boxes[:2]:
        pages.append(f"<body>{rest['header']}{box.format(headed)}{rest['footer']}</body>")
        pages.append(f"<body>{rest['nav']}{box.format(headed)}{rest['aside']}</body>")
    return pages


def _sequence(html: str) -> tuple[np.ndarray, np.ndarray]:
    blocks = leaf_blocks(html)
    return block_features([(a, t[1:], n) for a, t, n in blocks]), np.array([int(t[0] == "+") for _, t, _ in blocks])


def fit(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES) -> LinearChainCRF:
    """The model from the fixed labelled pages and at most `limit` pages of the table that label themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(b, own_labels(b)) for b in map(leaf_blocks, batch.column(0).to_pylist())]
            kept = [(block_features(b).tobytes(), bytes(y)) for b, y in found if 0 < len(b) <= TRAIN_BLOCKS and y is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.binary()), pa.array([y for _, y in kept], pa.binary())], names=["x", "y"])

    # the least hashes of different pages are found first, so that only chosen pages move
    hashed = pages.select(col(html).cast("string").alias("html")).where("html is not null and html <> ''").withColumn("h", F.xxhash64("html"))
    last = hashed.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).orderBy("h").select("html")
    sample = chosen.mapInArrow(run, "x binary, y binary").collect()
    known = [_sequence(p) for p in _labelled()]
    width = known[0][0].shape[1]
    known += [(np.frombuffer(x, np.float32).reshape(-1, width), np.frombuffer(y, np.uint8).astype(int)) for x, y in sample]
    return LinearChainCRF.fit([x for x, _ in known], [y for _, y in known])


def main_text(html: str | None, model: LinearChainCRF) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    return " ".join(text for (_, text, _), m in zip(blocks, model.viterbi(model.scores(block_features(blocks)))) if m)


def extract(pages: DataFrame, model: LinearChainCRF, name: str = "text", html: str = "html") -> DataFrame:
    """pages with the column `name`: the main text."""
    if name in pages.columns:
        raise ValueError(f"the column {name} exists")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([main_text(h, model) for h in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn(name, F.arrow_udf(run, "string")(col(html).cast("string")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html_text": op5_html_text}
SQL: dict[str, str] = {}
