"""Operator 12: runs of repeated words, found with suffix trees.

A run is a stretch of consecutive words with smallest period q, at least MIN_WORDS and MIN_TIMES * q
words long, that no neighbouring word extends keeping that period. Every run has a Lyndon root: for one
of two orders of the words (one the other's inverse), the longest Lyndon word at some place of the run
is as long as its period. So the candidates of a stretch are the longest Lyndon words at each place in
either order, of which there are two a word; each is extended in both directions by the length of the
longest common extension of its two ends. Extensions come from Ukkonen suffix trees of the words and of
their reversal: a common extension is the depth of the lowest common ancestor of two leaves, read in
constant time as a minimum over the Euler tour.

Most words are in no run, and trees are built only where runs can be: in a run of period q, every window
of WINDOW words stands there twice, q words apart. Words outside of such windows are left out, then those
whose windows repeat in no stretch of what is left, and so on until nothing changes.

Defined results: a null or empty text has no runs and the empty collapsed text; very long texts are
taken whole (a tree takes about half a kilobyte a word of the longest stretch of repeated windows, one
tree at a time); repeated rows and equal texts have equal results, each its own; an empty table gives an
empty table; all other columns stay as they are; a result column whose name is taken is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, col, slices, table, written

#: A run has so many words, and so many times its period, at least.
MIN_WORDS, MIN_TIMES = 24, 3
#: Words of a window; 2q - 1 + WINDOW words fit into each run, so that each of its windows repeats at distance q.
WINDOW = 9
SPACES = r"[\x20\x09-\x0D]+"
#: Entries of a block of the range minimum.
_STEP = 16
#: Odd multiplier of the windows' hashes, and its powers.
_MIX, _MIX2, _MIX3, _MIX6 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 3, 6))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


class _RangeMin:
    """Minima of ranges of an array in constant time: a sparse table over blocks, prefixes and suffixes inside them."""

    def __init__(self, values: np.ndarray):
        padded = np.full(-(-len(values) // _STEP) * _STEP, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        rows = padded.reshape(-1, _STEP)
        self.values = padded
        self.prefix = np.minimum.accumulate(rows, axis=1).ravel()
        self.suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], last included."""
        a, b = first // _STEP, last // _STEP
        out = np.minimum(self.suffix[first], self.prefix[last])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            lo, n = a[wide] + 1, b[wide] - a[wide] - 1
            level = np.frexp(n.astype(np.float64))[1] - 1
            best = np.empty(len(wide), np.int32)
            for k in np.unique(level).tolist():
                at = level == k
                best[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][lo[at] + n[at] - (1 << k)])
            out[wide] = np.minimum(out[wide], best)
        near = np.flatnonzero(a == b)
        if len(near):
            i, j = first[near], last[near]
            best = self.values[i].copy()
            for k in range(1, _STEP):
                best = np.minimum(best, np.where(i + k <= j, self.values[np.minimum(i + k, j)], best))
            out[near] = best
        return out


class SuffixTree:
    """Ukkonen's suffix tree of numbers, with longest common extensions and the order of the suffixes.

    symbols: numbers from 1 on; the end is symbol 0, smaller than all.
    """

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self._text = [*symbols, 0]
        self._base = max(self._text) + 1
        self._build()
        self._tour()

    def _build(self) -> None:
        text, base = self._text, self._base
        n = len(text)
        start, stop, link, to = [0], [0], [0], {}
        node = edge = length = rest = 0
        for i in range(n):
            c = text[i]
            rest += 1
            waiting = 0
            while rest:
                if not length:
                    edge = i
                key = node * base + text[edge]
                below = to.get(key)
                if below is None:
                    to[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    first = start[below]
                    span = stop[below] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[first + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(start)
                    start += (first, i)
                    stop += (first + length, n)
                    link += (0, 0)
                    to[key] = middle
                    to[middle * base + c] = middle + 1
                    start[below] = first + length
                    to[middle * base + text[first + length]] = below
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        keys, below = np.fromiter(to.keys(), np.int64, len(to)), np.fromiter(to.values(), np.int64, len(to))
        order = np.argsort(keys)
        self._above, self._symbol, self._below = keys[order] // base, keys[order] % base, below[order]
        self._span = np.array(stop) - np.array(start)

    def _tour(self) -> None:
        """The Euler tour: depths as they are passed, where each suffix's leaf stands, and the suffixes in order."""
        nodes, n = len(self._span), len(self._text)
        ahead = np.searchsorted(self._above, np.arange(nodes + 1)).tolist()
        limit, below, span = ahead[1:], self._below.tolist(), self._span.tolist()
        leaf = [ahead[v] == limit[v] for v in range(nodes)]
        tour, at, order = [], [0] * n, []
        path, depths = [0], [0]
        while path:
            v, depth = path[-1], depths[-1]
            tour.append(depth)
            k = ahead[v]
            if k == limit[v]:
                path.pop()
                depths.pop()
                continue
            ahead[v] = k + 1
            v = below[k]
            depth += span[v]
            if leaf[v]:
                at[n - depth] = len(tour)
                order.append(n - depth)
                tour.append(depth)
            else:
                path.append(v)
                depths.append(depth)
        self._order, self._at, self._low = order, np.array(at), _RangeMin(np.array(tour, np.int32))
        self._limit, self._leaf, self._spans = limit, leaf, span

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal (i and j differ)."""
        a, b = self._at[i], self._at[j]
        return self._low.query(np.minimum(a, b), np.maximum(a, b))

    def ranks(self, inverse: bool = False) -> list[int]:
        """The place of each suffix in lexicographic order, of the symbols or of their inverse; the end is the smallest in both."""
        order = self._order
        if inverse:  # backwards through the tree, the end's own leaf first
            order, n = [], len(self._text)
            spans, leaf, limit, below, symbol = self._spans, self._leaf, self._limit, self._below.tolist(), self._symbol.tolist()
            first = [0, *limit[:-1]]
            path = [(0, 0)]
            while path:
                v, depth = path.pop()
                if leaf[v]:
                    order.append(n - depth)
                    continue
                a, b = first[v], limit[v]
                # what is pushed last is taken first
                ends = symbol[a] == 0
                path += [(w, depth + spans[w]) for w in below[a + ends : b]]
                if ends:
                    path.append((below[a], depth + spans[below[a]]))
        ranks = [0] * len(order)
        for k, i in enumerate(order):
            ranks[i] = k
        return ranks


def _longest_lyndon(ranks: list[int], n: int) -> list[int]:
    """Where the longest Lyndon word at each place ends: at the next smaller suffix."""
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while j < n and ranks[j] > own:
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(symbols: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one sequence of numbers, by start and period."""
    n = len(symbols)
    if n < max(min_words, min_times):
        return []
    text = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    ahead = SuffixTree(text)
    places = np.arange(n)
    pairs = np.unique(np.concatenate([np.stack([places, _longest_lyndon(ahead.ranks(inverse), n)], 1) for inverse in (False, True)]), axis=0)
    i, j = pairs[(pairs[:, 1] - pairs[:, 0]) * min_times <= n].T
    right = np.zeros(len(i), np.int64)
    inner = j < n
    right[inner] = ahead.common(i[inner], j[inner])
    del ahead
    left = np.zeros(len(i), np.int64)
    inner = i > 0
    left[inner] = SuffixTree(text[::-1]).common(n - i[inner], n - j[inner])
    start, end, period = i - left, j + right, j - i
    good = end - start >= np.maximum(min_words, min_times * period)
    found = np.unique(np.stack([start[good], period[good], end[good] - start[good]], 1), axis=0)
    return [(a, length, q) for a, q, length in found.tolist()]


def _stretches(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: maximal stretches of words of one owner all of whose windows repeat in the stretch."""
    at = np.arange(len(ids))
    while True:
        if len(ids) < MIN_WORDS:
            return []
        # windows of one owner; equal hashes of different windows only cost time
        three = ids[:-2] + _MIX * ids[1:-1] + _MIX2 * ids[2:]
        hashes = (three[:-6] + _MIX3 * three[3:-3] + _MIX6 * three[6:]) ^ (owner[: len(ids) - 8].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        whole = np.flatnonzero(owner[: len(ids) - 8] == owner[8:])
        hashes = (hashes[whole] ^ (hashes[whole] >> np.uint64(31))) * _MIX
        bits = max(len(hashes), 2).bit_length() + 1
        slots = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        shared = np.flatnonzero(np.bincount(slots, minlength=1 << bits)[slots] > 1)
        _, which, times = np.unique(hashes[shared], return_inverse=True, return_counts=True)
        again = whole[shared[times[which] > 1]]
        covered = np.zeros(len(ids) + 1, np.int64)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
        keep = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        if not len(keep):
            return []
        old, at_kept, ids_kept = owner[keep], at[keep], ids[keep]
        fresh = np.ones(len(keep), bool)
        fresh[1:] = (np.diff(at_kept) > 1) | (np.diff(old) != 0)
        sizes = np.diff(np.flatnonzero(fresh), append=len(keep))
        long = np.repeat(sizes >= MIN_WORDS, sizes)
        new = np.repeat(np.arange(len(sizes)), sizes)[long]
        if long.all() and len(keep) == len(ids) and len(np.unique(owner)) == len(sizes):
            edges = np.flatnonzero(fresh)
            return list(zip(at[edges].tolist(), (at[edges] + sizes).tolist()))
        at, ids, owner = at_kept[long], ids_kept[long], new


def collapse_batch(texts: pa.Array) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Of each text: its runs, and its words joined by one space without what each run repeats."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    letters = data[inside]
    ends = np.cumsum(inside)[starts] - 1
    ends = np.append(ends, len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters))
    ids = words.dictionary_encode().indices.to_numpy().astype(np.uint64) + np.uint64(1)
    edges = np.searchsorted(starts, bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    drop = np.zeros(len(ids) + 1, np.int64)
    for a, b in _stretches(ids, owner):
        own = int(owner[a])
        base = int(edges[own])
        for start, length, period in runs_of(ids[a:b]):
            runs[own].append((a - base + start, length, period))
            drop[a + start + period] += 1
            drop[a + start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    # each word that stays, with a space after it
    sizes = np.diff(ends)
    stays = np.repeat(kept, sizes)
    lengths = sizes[kept] + 1
    stops = np.cumsum(lengths)
    out = np.full(stops[-1] if len(stops) else 0, 32, np.uint8)
    spaces = np.zeros(len(out), bool)
    spaces[stops - 1] = True
    out[~spaces] = letters[stays]
    stops = np.concatenate([[0], stops])
    counts = np.concatenate([[0], np.cumsum(kept)])[edges]
    joined = [out[stops[i] : max(stops[j] - 1, stops[i])].tobytes().decode() for i, j in zip(counts[:-1], counts[1:])]
    return list(zip(map(sorted, runs), joined))


def collapse_runs(docs: DataFrame, name: str = "collapse", text: str = "text") -> DataFrame:
    """docs with the struct column `name`: runs, an array of (start, length, period) in words by start, then period; and
    collapsed, the words joined by one space without those that a run holds after its first period."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {name} exists")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("periodic")
        for batch in slices(batches):
            found = collapse_batch(batch)
            yield pa.StructArray.from_arrays([pa.array([[dict(zip(("start", "length", "period"), x)) for x in runs] for runs, _ in found], pa.list_(run_type)), pa.array([joined for _, joined in found], pa.string())], ["runs", "collapsed"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
    return docs.withColumn(name, F.arrow_udf(run, kind)(col(text)))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where documents chosen by a hash of their id repeat a stretch of words from some word on: known runs to find. Null ids stay as they are."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(hashed / 10)
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(hashed % 10 == 0, words).alias("words"))
    parts = chosen.selectExpr("doc_id", "text", "words", "size(words) as n", "cast(g % greatest(size(words), 1) as int) as a", "g").selectExpr("*", "cast(1 + floor((n - a) / (3 + g % 8)) as int) as p")
    repeated = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    return parts.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of runs, the one of greatest exponent (ties: smallest start, then period; four nulls without any), and digests. A table."""
    found = collapse_runs(with_repeats(docs)).select("doc_id", F.expr("transform(collapse.runs, r -> struct(r.start as start, r.length as length, r.period as period))").alias("runs"), F.col("collapse.collapsed").alias("collapsed"))
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (x, r) -> if(r.length * x.period > x.length * r.period, r, x))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    rows = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") > 0, best).alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).selectExpr("doc_id", "n_runs", "best.start", "best.length", "best.period", "(1000 * best.length) div best.period as exponent_milli", "runs_sha256", "collapsed_sha256")
    return written(rows, "periodic-digests")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op12_periodic": op12_periodic}
SQL: dict[str, str] = {}
