"""Operator 4: personal data, with bootstrapped contextual extraction.

Base patterns (email, ip, card, phone) are found in every whole text; they are the seed entities.
Every identifier-like token (three digits or more, six characters or more) is an instance, seed or
not, and the words around an occurrence are its lexical patterns: two words before, one on either
side, two words after. Spark scores the graph of patterns and instances in rounds: a pattern's
confidence is the mean score of its different instances (seeds 1, unknown ones 0 at first), and an
unknown instance's score is the noisy-or of its trusted patterns; rounds go on until neither changes. A
pattern is trusted from MIN_CONFIDENCE and MIN_SUPPORT scored instances on; occurrences of well scored instances in trusted
patterns are reported as kind `id`, unless they overlap a base span.

One pass reads the texts; what it finds (a few rows for a document with identifiers) is kept as a
table, on which the rounds run. Patterns with fewer instances than MIN_SUPPORT are left out before
the rounds, since they can never be trusted.

Names of instances and words of patterns of over NAME_LETTERS characters stand in the graph as digests
of the whole, so that very long ones stay apart and rows stay small.

Defined results: null texts are empty, an empty table gives an empty table; very long texts are read
whole; spans are code points, ends exclusive; copies of a text count once in the graph, since instances
of a pattern are counted when they differ; rows, repeated ones too, are kept one for one; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, passing, row_key, slices, table, written

KINDS = ["email", "ip", "card", "phone", "id"]
#: Rounds after which a run that has not settled is given up, loudly; scores only rise, so few are needed.
MAX_ROUNDS = 60
MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 3
MIN_SCORE = 0.9
#: Longer names are digests in the graph.
NAME_LETTERS = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match begins where a run of digits does, so that long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_HINT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"\S+")
_CORE = re.compile(r"[0-9A-Za-z+](?:.*[0-9A-Za-z])?", re.S)
_FOUND = "array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds counted from 1, in order."""
    out = [(a, 1, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 2, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 3, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 4, m.end()))
    return sorted(out)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens: runs without white space, less what is no letter or digit at either end."""
    last, n = 0, len(text)
    hint = _HINT.search(text)
    while hint:
        start = hint.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, hint.end())
        last = stop.start() if stop else n
        core = _CORE.search(text, start, last)
        if core and core.end() - core.start() >= 6 and len(_DIGIT.findall(core.group())) >= 3:
            yield core.start(), core.end()
        hint = _HINT.search(text, last)


def _name(text: str) -> str:
    return text if len(text) <= NAME_LETTERS else f"#{len(text)}:{xxhash.xxh3_128_hexdigest(text)}"


def patterns(text: str, start: int, end: int, runs: list[tuple[int, int]]) -> list[str]:
    """The lexical patterns around a span: two words before, one on either side, two after. runs: all of the text's runs without white space."""
    i, j = bisect_right(runs, (start, 0)) - 1, bisect_right(runs, (end, 0)) - 1
    # what of the span's own run stands beside it is a word of its own
    before = [text[a : min(b, start)] for a, b in runs[max(0, i - 1) : i + 1] if a < start]
    after = [text[max(a, end) : b] for a, b in runs[max(0, j) : j + 3] if b > end][:2]
    before, after = ([_name(_DIGIT.sub("0", w.lower())) for w in side] for side in (before, after))
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return out


def occurrences(text: str) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or 0, instance, patterns): base spans, and identifier-like tokens that touch none."""
    seeds = base_spans(text)
    spans = [(a, b, k) for a, k, b in seeds]
    i = reach = 0
    for a, b in _tokens(text):
        while i < len(seeds) and seeds[i][0] < b:
            reach = max(reach, seeds[i][2])
            i += 1
        if reach <= a:
            spans.append((a, b, 0))
    runs = [m.span() for m in _RUN.finditer(text)] if spans else []
    return [(a, b, k, _name(_NOT_DIGIT.sub("", text[a:b]) if k in (3, 4) else text[a:b].lower()), patterns(text, a, b, runs)) for a, b, k in spans]


def _found(docs: DataFrame) -> DataFrame:
    """(k, doc_id, found) of docs (k, doc_id, text): one reading of the texts."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    names = ("start", "end", "kind", "instance", "patterns")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([[dict(zip(names, x)) for x in occurrences(t)] for t in batch.to_pylist()], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select("k", "doc_id", F.arrow_udf(run, _FOUND)("text").alias("found"))


def trusted(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """edges (pattern, instance, seed: boolean), distinct -> trusted patterns (pattern, confidence) and scores of unknown instances (instance, score).

    Rounds go on until one trusts no further pattern and lifts no further instance to MIN_SCORE.
    """
    with passing(edges.sparkSession):
        seen = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= MIN_SUPPORT).select("pattern")
        graph = written(edges.join(seen, "pattern").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-graph")
        scores, mark = graph.where("false").select("instance", F.lit(0.0).alias("score")), None
        for _ in range(max_rounds):
            scored = graph.join(scores, "instance", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
            rated = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= 0.5).alias("support"))
            good = written(rated.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)).select("pattern", "confidence"), "good-patterns")
            unknown = graph.where("not seed").join(good, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
            scores = written(unknown, "instance-scores")
            # whole numbers that can only rise: patterns trusted, instances that they name, instances that may be reported
            before, mark = mark, (good.count(), *scores.agg(F.count("*"), F.count_if(F.col("score") >= MIN_SCORE)).first())
            if mark == before:
                break
        else:
            raise RuntimeError(f"patterns are not settled after {max_rounds} rounds")
        return written(good, "trusted-patterns", outlive=True), written(scores, "settled-scores", outlive=True)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and discovered (arrays of {start, kind, end}, kinds counted from 1 as in KINDS)."""
    keyed = docs.select(row_key(col(doc_id), col(text)).alias("k"), col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    found = written(_found(keyed), "identifiers")
    each = found.select("k", F.explode("found").alias("o")).select("k", "o.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", (F.col("kind") > 0).alias("seed")).distinct()
    good, scores = trusted(edges)
    unknown = each.where("kind = 0").select("k", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    hits = unknown.join(good.select("pattern"), "pattern", "left_semi").join(scores.where(F.col("score") >= MIN_SCORE).select("instance"), "instance", "left_semi")
    new = hits.groupBy("k").agg(F.collect_set(F.struct("start", F.lit(5).alias("kind"), "end")).alias("discovered"))
    base = F.transform(F.filter("found", lambda o: o["kind"] > 0), lambda o: F.struct(o["start"].alias("start"), o["kind"].alias("kind"), o["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.select("k", "doc_id", base.alias("base")).join(new, "k", "left").select("doc_id", "base", F.coalesce("discovered", none).alias("discovered"))


def joined(spans: Column) -> Column:
    """kind:start:end of each, by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {kind}))").cast("long").alias(f"n_{name}") for kind, name in enumerate(KINDS[:4], 1)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "discovered")).alias("spans"), F.size("discovered").cast("long").alias("n_discovered")
    )


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
