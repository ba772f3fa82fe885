"""Operator 9: URL rules with redirect equivalence. DataFrame functions only.

A rule names a host (with all its subdomains) and the beginning of a path; the longest rule that
fits a URL decides it. Aliases share a decision: URLs joined by a redirect (meta refresh in the
page) or a canonical link (<link rel="canonical">), or by edges handed in, form components
(distributed connected components), and a URL without a rule of its own takes its component's
decision: allow if any member is explicitly allowed, else block if any member is blocked. URLs that
differ only in fragment, letter case of scheme and host, default port or tracking parameters are
the same node. What nothing decides is allowed.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and has
no aliases; null html has no links; relative links are resolved against the page's
<base> or URL; html that is very long or never closed is read as far as its tags are whole; an empty table gives an empty table; only the
columns named are read, so others' names cannot clash; repeated rows are judged alike; rows are kept one for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, lower_ascii, table, written
from .components import connected_components

# The rules of the registered query (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Query parameters that only track.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid"

# Names of characters that stand in URLs.
REFERENCES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "colon": ":", "sol": "/", "quest": "?", "equals": "=", "num": "#", "percnt": "%", "period": ".", "lowbar": "_"}
#: Where a refresh goes: after a number of seconds and a semicolon, comma or space, with or without "url=".
REFRESH = r"(?is)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(.*?)\s*$"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def own_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones an allowing rule wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """The URL that stands for all spellings of one address; null if there is no host."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    query = F.regexp_extract(plain, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)")), "&")
    scheme = lower_ascii(F.regexp_extract(plain, r"(?s)^(.*?)://", 1))
    host = F.when(scheme == "http", F.regexp_replace(host_of(plain), ":80$", "")).when(scheme == "https", F.regexp_replace(host_of(plain), ":443$", "")).otherwise(host_of(plain))
    path = F.when(path_of(plain) == "", F.lit("/")).otherwise(path_of(plain))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """An absolute path with its segments . and .. resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    up = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    whole = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), up)
    return F.concat(F.array_join(whole, "/"), F.when(last.isin(".", "..") | (F.size(whole) == 1), F.lit("/")).otherwise(""))


def _absolute(link: Column, url: Column) -> Column:
    """The link's address, resolved against the page's; null if another scheme has no "://"."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (host_of(url) == ""), F.lit(None))
        .when(link.startswith("#"), url)
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def _attribute(name: str) -> Column:
    """The value of an attribute of `tag`, quoted or not; empty if it has none."""
    found = lambda value: F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*{value}", 1)
    return F.coalesce(*[F.nullif(found(v), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", "([^\"'\\s>][^\\s>]*)")], F.lit(""))


def plain(value: Column) -> Column:
    """value without character references (numbers of any character, and the names that stand in URLs) and white space around it."""

    def part(x: Column) -> Column:
        number = F.coalesce(F.conv(F.nullif(F.regexp_extract(x, "^#[xX]([0-9A-Fa-f]{1,6})", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(x, "^#([0-9]{1,7})", 1), F.lit(""))).cast("int")
        known = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        out = F.when(number.isNotNull(), F.concat(letter, F.regexp_replace(x, "^#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", "")))
        for name, sign in REFERENCES.items():
            out = out.when(x.startswith(f"{name};"), F.concat(F.lit(sign), F.substr(x, F.lit(len(name) + 2))))
        return out.otherwise(F.concat(F.lit("&"), x))

    parts = F.split(value, "&", -1)
    return F.trim(F.regexp_replace(F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), "")), r"[\t\n\r\f]", " "))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the pages' canonical links and redirects, as URLs resolved against the page's base; comments and scripts are left out."""
    tags = F.regexp_extract_all(
        F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", ""), F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0)
    )
    marked = pages.select(col(url).alias("url"), col(html).alias("html")).where(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv")).where("url is not null")
    listed = marked.select("url", tags.alias("tags"))
    # the first base of the page that names a place; links are relative to it
    bases = F.filter("tags", lambda t: t.rlike(r"(?is)^<base\b.*\shref\s*="))
    each = listed.select("url", F.try_element_at(bases, F.lit(1)).alias("tag"), "tags").select("url", plain(_attribute("href")).alias("base"), "tags").select("url", "base", F.explode("tags").alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)^<link\b") & F.array_contains(F.split(F.lower(_attribute("rel")), r"\s+"), "canonical"), plain(_attribute("href")))
    place = F.regexp_extract(plain(_attribute("content")), REFRESH, 1)
    refresh = F.when(F.col("tag").rlike(r"(?i)^<meta\b") & (F.lower(F.trim(_attribute("http-equiv"))) == "refresh"), F.regexp_replace(place, r"""^["']|["']\s*$""", ""))
    links = each.select("url", "base", F.coalesce(canonical, refresh).alias("link")).where("link <> ''")
    home = F.coalesce(F.when(F.col("base") != "", _absolute(F.col("base"), F.col("url"))), F.col("url"))
    return links.select(F.col("url").alias("src"), "link", home.alias("home")).select("src", _absolute(F.col("link"), F.col("home")).alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html", keep: list[str] = ["page_id"]) -> DataFrame:  # noqa: B006
    """Per row: the `keep` columns, host, path, rule, verdict. redirects: further edges (src, dst) of URLs."""
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    named = written(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")), "link-edges")
    members = connected_components(named)
    _, decided = own_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    votes = members.withColumn("own", decided)
    # a member's own rule is read from the spelling that links use: hosts and paths are the same in all
    shared = votes.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    shared = shared.where("allowed or blocked").select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("alias_verdict"))
    by_node = written(members.join(shared, "component").select("node", "alias_verdict"), "alias-verdicts")
    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(*[col(c) for c in keep], host_of(col(url)).alias("host"), path_of(col(url)).alias("path"), node_of(col(url)).alias("node"))
    return rows.join(by_node, "node", "left").select(*[col(c) for c in keep], "host", "path", rule.alias("rule"), F.coalesce(verdict, "alias_verdict", F.lit("allow")).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    host = r"translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    own = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{k}}}{h}{p}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    own = own.replace("{allow}", "allow ").replace("{block}", "block ")
    node = (
        r"(SELECT CASE WHEN h <> '' THEN s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || CASE p WHEN '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END END FROM (SELECT "
        + host.format("u") + " AS h, " + path.format("u") + r" AS p, lower(regexp_extract(u, '(?s)^(.*?)://', 1)) AS s, "
        + rf"array_to_string(list_filter(string_split(regexp_extract(u, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:{TRACKING})(?:=|$)')), '&') AS q FROM (SELECT regexp_replace({{0}}, '(?s)#.*$', '') AS u)))"
    )
    def attribute(name: str) -> str:
        found = ", ".join(rf"nullif(regexp_extract(tag, '(?is)\s{name}\s*=\s*{v}', 1), '')" for v in ('"([^"]*)"', "''([^'']*)''", r"""([^"''\s>][^\s>]*)"""))
        return f"coalesce({found}, '')"

    number = r"coalesce(try_cast('0x' || nullif(regexp_extract(x, '^#[xX]([0-9A-Fa-f]{1,6})', 1), '') AS INT), try_cast(nullif(regexp_extract(x, '^#([0-9]{1,7})', 1), '') AS INT))"
    names = " ".join(f"WHEN starts_with(x, '{n};') THEN '{c.replace(chr(39), chr(39) * 2)}' || substr(x, {len(n) + 2})" for n, c in REFERENCES.items())
    part = rf"CASE WHEN {number} IS NOT NULL THEN CASE WHEN {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr({number}) ELSE chr(65533) END || regexp_replace(x, '^#(?:[xX][0-9A-Fa-f]{{1,6}}|[0-9]{{1,7}});?', '') {names} ELSE '&' || x END"

    def readable(value: str) -> str:
        return rf"trim(regexp_replace(string_split({value}, '&')[1] || array_to_string(list_transform(string_split({value}, '&')[2:], lambda x: {part}), ''), '[\t\n\r\f]', ' ', 'g'))"

    place = "regexp_extract(" + readable(attribute("content")) + ", '" + REFRESH.replace("'", "''") + "', 1)"
    link = rf"""CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND list_contains(regexp_split_to_array(lower({attribute('rel')}), '\s+'), 'canonical') THEN {readable(attribute('href'))}
    WHEN regexp_matches(tag, '(?i)^<meta\b') AND lower(trim({attribute('http-equiv')})) = 'refresh' THEN regexp_replace({place}, '^["'']|["'']\s*$', '', 'g') END"""

    def absolute(link: str, url: str, relative: str) -> str:
        scheme, root = f"regexp_extract({url}, '(?s)^(.*?)://', 1)", f"regexp_extract({url}, '(?s)^(.*?)://', 1) || '://' || {host.format(url)}"
        return rf"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link} WHEN starts_with({link}, '/') THEN {root} || {link}
    WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {host.format(url)} = '' THEN NULL WHEN starts_with({link}, '#') THEN {url} WHEN starts_with({link}, '?') THEN {root} || {path.format(url)} || {link} ELSE {root} || {relative} || regexp_extract({link}, '(?s)^[^?#]*(.*)$', 1) END"""

    def folded(link: str, url: str) -> str:
        return f"'/' || regexp_extract({path.format(url)}, '(?s)^/(.*/)?', 1) || regexp_extract({link}, '(?s)^([^?#]*)', 1)"

    step = r"""CASE WHEN regexp_matches(p, '(?s)/\./') THEN regexp_replace(p, '(?s)/\./', '/') WHEN regexp_matches(p, '(?s)/\.$') THEN regexp_replace(p, '(?s)/\.$', '/')
    ELSE regexp_replace(regexp_extract(p, '(?s)^(.*?)/\.\.(?:/.*)?$', 1), '(?s)/[^/]*$', '') || '/' || regexp_extract(p, '(?s)^.*?/\.\.(?:/(.*))?$', 1) END"""
    more = r"regexp_matches(p, '(?s)/\.\.?(?:/|$)')"
    return rf"""
WITH RECURSIVE listed AS (
  SELECT DISTINCT url, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta|base)\b[^>]*>') AS tags FROM pages WHERE url IS NOT NULL),
based AS (SELECT url, tags, {readable(attribute('href'))} AS base FROM (SELECT url, tags, coalesce(list_filter(tags, lambda t: regexp_matches(t, '(?is)^<base\b.*\shref\s*='))[1], '') AS tag FROM listed)),
base_path AS (SELECT url, tags, base, {folded('base', 'url')} AS p FROM based UNION ALL SELECT url, tags, base, {step} FROM base_path WHERE {more}),
homes AS (SELECT tags, url, coalesce(CASE WHEN base <> '' THEN {absolute('base', 'url', 'p')} END, url) AS home FROM base_path WHERE NOT {more}),
links AS (SELECT url, home, {link} AS link FROM (SELECT url, home, unnest(tags) AS tag FROM homes)),
link_path AS (SELECT url, home, link, {folded('link', 'home')} AS p FROM links WHERE link <> '' UNION ALL SELECT url, home, link, {step} FROM link_path WHERE {more}),
edge AS (SELECT url AS src, {absolute('link', 'home', 'p')} AS dst FROM link_path WHERE NOT {more}),
near AS (SELECT {node.format('src')} AS a, {node.format('dst')} AS b FROM edge WHERE dst IS NOT NULL),
both_ways AS (SELECT a, b FROM near WHERE a <> b UNION SELECT b, a FROM near WHERE a <> b),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
decided AS (SELECT a, {own} AS own FROM (SELECT reach.a, {host.format('b')} AS host, {path.format('b')} AS path FROM reach)),
alias AS (SELECT a, CASE WHEN bool_or(starts_with(own, 'allow')) THEN 'allow' WHEN bool_or(starts_with(own, 'block')) THEN 'block' END AS v FROM decided GROUP BY a),
page AS (SELECT page_id, {host.format('url')} AS host, {path.format('url')} AS path, {node.format('url')} AS node FROM pages),
ruled AS (SELECT *, {own} AS own FROM page)
SELECT page_id, host, path, substr(own, 7) AS rule, coalesce(substr(own, 1, 5), v, 'allow') AS verdict
FROM ruled LEFT JOIN alias ON node = a"""


QUERIES = {"op9_url_rules": op9_url_rules}
SQL = {"op9_url_rules": _sql()}
