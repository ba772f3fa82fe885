"""Operator 3: quality rules, with line labelling by a conditional random field.

Rules on the whole text come first (too few words; too many words in repeated five-word windows).
Then every line is a step of a sequence; a linear-chain CRF, fitted on labelled documents, marks it
as content or boilerplate (Viterbi), and the share of a document's words that lie in content lines
decides whether it stays.

Training: line labels come from document labels in three ways. A line of a good document is content,
one of a bad document boilerplate; but a line that stands between FREQUENT or more different pairs of
neighbours in the sample is boilerplate in either (copies of one text keep their neighbours, so copying
makes no line frequent); blank lines take the label before them. And since real pages mix both, runs of
lines of bad documents are set into good ones and the other way round, so that the transitions are
learned from sequences that change. The sample is bounded (TRAIN_DOCS documents of either label, those of
smallest hash, and TRAIN_LINES lines in a row of each); everything else covers all rows and whole texts.

Defined results: a null text has no words and fails the rules; very long texts are judged whole; a
content share of exactly CONTENT_SHARE stays; if a label of either kind is missing, there is no model
and the rules alone decide; an empty table gives an empty table; rows, repeated ones too, and other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, col, free_name, slices, table, written
from .crf import LinearChainCRF

#: Labelled documents of either kind that the model is fitted on, at most.
TRAIN_DOCS = 1000
#: Lines of a document that train, at most: a run of them, placed by the text's hash.
TRAIN_LINES = 128
#: A line between so many different pairs of neighbours is boilerplate, whatever its document's label.
FREQUENT = 5
#: Lines of a run that is set into a document of the other label.
RUN_LINES = 6
#: A document stays if at least this share of its words is in lines marked as content.
CONTENT_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_STOP = re.compile(r"[.!?:;,]")
_RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, content_share double"


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == len(words):
        return 0
    keys = ids[:n]
    for k in range(1, window):
        keys = np.unique(keys * len(known) + ids[k : k + n], return_inverse=True)[1] if len(known) ** window >= 1 << 62 else keys * len(known) + ids[k : k + n]
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def line_features(lines: list[str], words: list[list[str]]) -> np.ndarray:
    """One row a line: its length, characters, variety, and place in the document."""
    seen: set[str] = set()
    rows, last = [], len(lines) - 1
    for i, (line, own) in enumerate(zip(lines, words)):
        n, chars = len(own), sum(map(len, own))
        per = 1 / max(chars, 1)
        rows.append((
            np.log1p(n), n == 0, n < 4, chars / max(n, 1), len(set(own)) / max(n, 1),
            min(1.0, len(_SYMBOL.findall(line)) / max(n, 1)), len(_UPPER.findall(line)) * per, len(_DIGIT.findall(line)) * per, len(_STOP.findall(line)) / max(n, 1),
            line.count("|") / max(n, 1), line.count("!!") / max(n, 1), line[-1:] in ".!?", line[:1].isupper(), line in seen, i == 0, i == last,
        ))
        seen.add(line)
    return np.array(rows, dtype=np.float32)


def _lines(text: str) -> tuple[list[str], list[list[str]]]:
    lines = text.split("\n")
    return lines, list(map(_WORD.findall, lines))


def _training_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and digests (0: blank) of a run of lines, one digest more at either end for the neighbours."""
    lines, words = _lines(text)
    first = xxhash.xxh64_intdigest(text, 3) % max(1, len(lines) - TRAIN_LINES + 1)
    digests = [0, *(xxhash.xxh64_intdigest(x.strip(), 42) if w else 0 for x, w in zip(lines, words)), 0]
    return line_features(lines, words)[first : first + TRAIN_LINES], np.array(digests[first : first + TRAIN_LINES + 2], np.uint64)


def frequent_lines(digests: list[np.ndarray]) -> np.ndarray:
    """Digests of lines that stand between FREQUENT or more different pairs of neighbours."""
    seen = np.unique(np.concatenate([np.stack([d[1:-1], d[:-2], d[2:]], axis=1) for d in digests]), axis=0)[:, 0]
    lines, counts = np.unique(seen, return_counts=True)
    return lines[(counts >= FREQUENT) & (lines != 0)]


def line_labels(quality: int, digests: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """1 for content, 0 for boilerplate; blank lines take the label before them."""
    own = digests[1:-1]
    y = np.where(np.isin(own, frequent), 0, quality)
    last = np.maximum.accumulate(np.where(own != 0, np.arange(len(own)), -1))
    return np.where(last >= 0, y[np.maximum(last, 0)], quality)


def mixed_sequences(good: list[tuple], bad: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences (features, labels) of one kind with a run of the other in the middle; as many as there are pairs, of either sort."""
    out = []
    for one, two in zip(good, bad):
        for (x, y), (run, marks) in ((one, two), (two, one)):
            at, run = len(x) // 2, run[:RUN_LINES].copy()
            run[:, -2:] = 0  # it is neither the first nor the last line there
            out.append((np.concatenate([x[:at], run, x[at:]]), np.concatenate([y[:at], marks[:RUN_LINES], y[at:]])))
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", limit: int = TRAIN_DOCS) -> LinearChainCRF | None:
    """The model from at most `limit` labelled documents of either kind; None if a kind is missing."""
    known = labels.select(col(doc_id).alias("doc_id"), col(quality).cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()
    order = F.xxhash64("doc_id", "quality"), "doc_id", "quality"
    chosen = known.where("quality = 0").orderBy(*order).limit(limit).union(known.where("quality = 1").orderBy(*order).limit(limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("quality")
        for batch in slices(batches):
            rows = [_training_rows(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([d.tobytes() for _, d in rows], pa.binary())], names=["h", "quality", "rows", "digests"])

    texts = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")).where("text is not null")
    # at most 2 * limit rows are sent to every task; bounded rows, not texts, are put in order
    joined = texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "quality", "text")
    sample = written(joined.mapInArrow(run, "h bigint, quality int, rows binary, digests binary"), "training-lines").orderBy("h", "quality").limit(2 * limit).collect()
    if len({r.quality for r in sample}) < 2:
        return None
    width = len(line_features([""], [[]])[0])
    digests = [np.frombuffer(r.digests, np.uint64) for r in sample]
    frequent = frequent_lines(digests)
    pairs = [(np.frombuffer(r.rows, np.float32).reshape(-1, width), line_labels(r.quality, d, frequent)) for r, d in zip(sample, digests)]
    of = lambda q: [p for r, p in zip(sample, pairs) if r.quality == q]
    pairs += mixed_sequences(of(1), of(0))
    return LinearChainCRF.fit([x for x, _ in pairs], [y for _, y in pairs])


def judge_text(text: str | None, model: LinearChainCRF | None) -> tuple:
    lines, by_line = _lines(text or "")
    words = [w for own in by_line for w in own]
    seen: set[str] = set()
    dups = 0
    for line, own in zip(lines, by_line):
        if own:
            dups += line in seen
            seen.add(line)
    n, repeats = len(words), repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    marks = model.viterbi(model.scores(line_features(lines, by_line))) if model else [1] * len(lines)
    inside = sum(len(own) for own, m in zip(by_line, marks) if m)
    share = inside / n if n else 0.0
    return n, sum(map(len, words)), len(_SYMBOL.findall(text or "")), dups, repeats, failed, not failed and share >= CONTENT_SHARE, len(lines), sum(marks), share


def judge(docs: DataFrame, model: LinearChainCRF | None, name: str, text: str = "text") -> DataFrame:
    """docs with the struct column `name`: the counts, the verdict `kept`, and the content share behind it."""
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("quality")
        for batch in slices(batches):
            rows = [judge_text(t, model) for t in batch.to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, f"struct<{', '.join(f.replace(' ', ': ') for f in _RESULT.split(', '))}>")(col(text).cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that stay, columns as they are."""
    name = free_name(docs, "verdict")
    return judge(docs, fit(docs, labels), name).where(F.col(name)["kept"]).drop(name)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return written(judge(docs, fit(docs, table(spark, sf_dir, "labels")), "v").select("doc_id", "v.*"), "verdicts")


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
