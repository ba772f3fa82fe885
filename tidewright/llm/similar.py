"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more: the near-dedup of the pipeline.

Candidates come from two searches, and every pair is verified on the whole sets, so that nothing below
the similarity links and nothing of it or above is lost.

1. Operator 6: fingerprints of the sets, searched by its planned pigeonhole within MAX_DISTANCE bits. At
   a similarity of 0.8 fingerprints differ by 10 bits or so, where no thresholds are selective; so this
   finds close copies only, at little cost, and most members of a large group with them.
2. Shared prefixes: in any one order of all shingles, two sets of similarity s or more share one of the
   first n - ceil(s * n) + 1 of the n shingles of either. Shingles that are common come last in the
   order (by their counts in an eighth of the texts; the order decides on cost only), so that a passage
   in many texts is in few prefixes. Sets of one bucket (shingle) are first compared with a few leaders.
   While crowded buckets hold more pairs of different groups than there are rows, they are led again, by
   sets outside their largest group, as long as that halves those pairs; then all pairs of a bucket that
   are still in different groups are compared. No bucket is cut.

Verification has two steps. A set's bitmap has 4 to 8 bits a shingle; bits in which two bitmaps differ
are at most as many as shingles in which the sets differ, which rules out nearly all unlike pairs without
loss. The rest are compared on their sets of 64-bit hashes.

Wide columns (texts, bitmaps) are not dealt to be met by a few keys: a bitmap of the keys' hashes, of bounded
size, goes to every task, and only rows that pass it are shuffled to the join that decides.

Defined results: null and empty texts have one shingle, that of nothing, and are equal; texts shorter
than a shingle are one shingle; rows are taken one by one, so that several texts under one id (null or
not) are several documents; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, col, free_name, passing, row_key, slices, written
from .components import connected_components
from .decontaminate import hash_bitmap, in_bitmap
from .simhash import _LOWER, _WORD, links, majority

SIMILARITY, SHINGLE = 0.8, 5
#: Bits in which the fingerprints of the first search may differ.
MAX_DISTANCE = 2
#: Leaders of a bucket in a round, and how many pairs a row a bucket may have left before it counts as crowded. Cost only.
LEADERS, CROWDED = 3, 4
#: One text of so many is counted for the order; so many of the most common shingles are told from the rest. Cost only.
ORDER_SHARE, ORDER_SHINGLES = 8, 100_000
#: Words whose hashes a worker keeps.
MEMO_WORDS = 100_000
_SLACK = 1e-6
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> bytes:
        h = xxhash.xxh64_intdigest(word.translate(_LOWER), 42).to_bytes(8, "little")
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h
        return h


_HASHES = _WordHashes()


def _begin() -> None:
    alone("similar", _HASHES.clear)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's different shingles in ascending order: those of the words, mixed in turn."""
    words = _WORD.findall(text) if text else []
    each = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), "<u8")
    size = min(shingle, len(words))
    n = len(words) - size + 1 if words else 1
    mixed = np.full(n, size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ each[i : i + n]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def prefix_length(n: int, similarity: float) -> int:
    return min(n, n - int(np.ceil(similarity * n - _SLACK)) + 1)


def set_prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of (count among the `common` ones, hash)."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: prefix_length(len(hashes), similarity)]]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """64-bit pieces of a bitmap of 4 to 8 bits a hash; one of half the size is the OR of the two halves."""
    size = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64), pa.int64()))


def _arrow_struct(docs: DataFrame, fields: dict[str, str], make) -> DataFrame:
    """docs with the struct f of the given fields (name: type) of column text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _begin()
        for batch in slices(batches):
            columns = make(batch.to_pylist())
            yield pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, {"int": pa.int32(), "bigint": pa.int64()}[kind]) for c, kind in zip(columns, fields.values())], list(fields))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("f", F.arrow_udf(run, f"struct<{', '.join(f'{k}: {v}' for k, v in fields.items())}>")("text"))


def _hashed(docs: DataFrame, shingle: int) -> DataFrame:
    """docs with `set`, the hashes of the text's shingles."""
    return _arrow_struct(docs, {"set": "array<bigint>"}, lambda texts: [_lists([shingle_hashes(t, shingle) for t in texts])]).withColumn("set", F.col("f.set")).drop("f", "text")


def _common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most common shingles of an eighth of the texts: a bounded number of rows."""
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0)
    # every set has a hash; a plain explode would add a filter on the set, and so make each set twice
    counts = written(_hashed(sample, shingle).select(F.explode_outer("set").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts")
    least, total = None, 0
    for n, many in sorted(counts.groupBy("n").count().collect(), reverse=True):
        total += many
        if total > ORDER_SHINGLES:
            break
        least = n
    rows = counts.where(F.col("n") >= least).collect() if least else []
    hashes = np.array([r.h for r in rows], np.int64).view(np.uint64)
    at = np.argsort(hashes)
    return hashes[at], np.array([r.n for r in rows], np.int64)[at]


def _marked(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """docs (.., text) with p (stands for the set), n (its size), fp (its fingerprint), bits and prefix instead of the text."""
    common, counts = _common_shingles(docs, shingle)

    def make(texts: list) -> list:
        sets = [shingle_hashes(t, shingle) for t in texts]
        keys = [xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) for x in sets]
        prints = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
        return [keys, [len(x) for x in sets], pa.array(prints), _lists([bitmap(x) for x in sets]), _lists([set_prefix(x, similarity, common, counts) for x in sets])]

    fields = {"p": "bigint", "n": "int", "fp": "bigint", "bits": "array<bigint>", "prefix": "array<bigint>"}
    return _arrow_struct(docs, fields, make).select(*[c for c in docs.columns if c != "text"], "f.*")


def _paired(left: DataFrame, right: DataFrame, similarity: float, *also: Column) -> DataFrame:
    """(a, b), a < b: rows of one bucket whose sets are large enough behind the shared shingle; the first shared one of a similar pair always passes."""
    a, b = (side.select("token", *[F.col(c).alias(f"{end}_{c}") for c in side.columns if c != "token"]) for side, end in ((left, "a"), (right, "b")))
    enough = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) * (1 + similarity) >= similarity * (F.col("a_n") + F.col("b_n")) - _SLACK
    both = a.join(b, "token").where("a_p <> b_p").where(enough)
    for condition in also:
        both = both.where(condition)
    return both.select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b"))


def _folded(bits: Column, size: Column) -> Column:
    """The bitmap at `size` pieces: as it is, or half as long."""
    return F.when(F.size(bits) <= size, bits).otherwise(F.zip_with(F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseOR(y)))


def _sieve(keys: DataFrame, key: str) -> Column:
    """True for every row whose key is in the table keys, and for few others as long as the bitmap has room."""
    bits, words = hash_bitmap(keys.select(F.xxhash64(key).alias("h")), keys.count())
    return in_bitmap(F.xxhash64(key), bits, words)


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in the table keys; those that surely are not stay where they are."""
    passes = _sieve(keys, key)
    return rows.where(~passes).union(rows.where(passes).join(keys, key, "left_anti").select(*map(col, rows.columns)))


def _ends(pairs: DataFrame) -> DataFrame:
    """(p) of the sets in pairs (a, b)."""
    return pairs.select(F.col("a").alias("p")).union(pairs.select("b")).distinct()


class _Search:
    """What the rounds of one search share: docs (k, text), prints (p, k, n, fp, bits, prefix)."""

    def __init__(self, docs: DataFrame, prints: DataFrame, similarity: float, shingle: int, twins: bool):
        """twins: several of docs may have one k."""
        self.docs, self.prints, self.similarity, self.shingle, self.twins = docs, prints, similarity, shingle, twins

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(src, dst): the pairs (a, b) whose sets have the similarity, by count."""
        s = self.similarity
        with passing(pairs.sparkSession):
            wanted = written(pairs.distinct(), "pairs")
            side = lambda end, source, *what: source.select(F.col("p").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in what])
            # bitmaps are wide: hardly more than those that pairs name are dealt
            prints = self.prints.select("p", "n", "bits").where(_sieve(written(_ends(wanted), "met"), "p"))
            both = wanted.join(side("a", prints, "n", "bits"), "a").join(side("b", prints, "n", "bits"), "b")
            both = both.where(F.least("a_n", "b_n") >= s * F.greatest("a_n", "b_n") - _SLACK).withColumn("size", F.least(F.size("a_bits"), F.size("b_bits")))
            differing = F.aggregate(F.zip_with(_folded(F.col("a_bits"), F.col("size")), _folded(F.col("b_bits"), F.col("size")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
            near = written(both.where(differing * (1 + s) <= (1 - s) * (F.col("a_n") + F.col("b_n")) + _SLACK).select("a", "b"), "near-pairs")
            # only sets that are compared are made again
            keys = written(self.prints.select("p", "k").join(_ends(near), "p", "left_semi"), "compared")
            sets = _hashed(self.docs.where(_sieve(keys, "k")).join(keys, "k").select("p", "text"), self.shingle)
            sets = written(sets.dropDuplicates(["p"]) if self.twins else sets, "sets")
            both = near.join(side("a", sets, "set"), "a").join(side("b", sets, "set"), "b")
            shared = F.size(F.array_intersect("a_set", "b_set")) * (1 + s) >= s * (F.size("a_set") + F.size("b_set")) - _SLACK
            return written(both.where(shared).select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar", outlive=True)

    def by_fingerprint(self) -> DataFrame:
        """Candidates (a, b) of operator 6: equal fingerprints by their least set, near ones by its links."""
        firsts = written(self.prints.groupBy("fp").agg(F.min("p").alias("first")), "firsts")
        equal = self.prints.join(firsts, "fp").where("p <> first").select(F.col("first").alias("a"), F.col("p").alias("b"))
        near = written(links(firsts.select("fp"), MAX_DISTANCE).distinct(), "fingerprint-links")
        named = lambda end, other: firsts.select(F.col("fp").alias(end), F.col("first").alias(other))
        linked = near.join(named("src", "x"), "src").join(named("dst", "y"), "dst")
        return equal.union(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))

    def buckets(self) -> DataFrame:
        """(token, p, n, pos): sets by the shingles of their prefixes, as far as several sets share them."""
        filed = self.prints.select("p", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = written(filed.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "shared-tokens")
        return written(filed.join(shared, "token"), "buckets", outlive=True)


def _mixed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows of those buckets that hold several groups of edges, with the group of each row in c."""
    with passing(rows.sparkSession):
        groups = connected_components(edges).select(F.col("node").alias("p"), F.col("component").alias("c"))
        named = written(rows.select("token", "p", "n", "pos").join(groups, "p", "left").select("token", "p", "n", "pos", F.coalesce("c", "p").alias("c")), "labelled")
        mixed = written(named.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token"), "mixed")
        return written(named.join(mixed, "token"), "mixed-rows", outlive=True)


def _led(rows: DataFrame, start: int) -> DataFrame:
    """(token, p, n, pos, c) of each bucket's leaders, the first in LEADERS orders: orders of all buckets, so that those of a group of near copies share theirs.

    Rare shingles come first in a set, so the set with the fewest before the bucket's is the most central one: it leads in the first order.
    """
    order = lambda i: F.struct((F.lit(0) if i else F.col("pos")).alias("before"), F.xxhash64("p", F.lit(start + i)).alias("x"))
    first = [F.min(F.struct(order(i).alias("h"), "p", "n", "pos", "c")).alias(f"l{i}") for i in range(LEADERS)]
    each = rows.groupBy("token").agg(*first).select("token", F.explode(F.array_distinct(F.transform(F.array(*[f"l{i}" for i in range(LEADERS)]), lambda x: F.struct(*[x[c].alias(c) for c in ("p", "n", "pos", "c")])))).alias("l"))
    return written(each.select("token", "l.*"), "leaders")


def _majors(rows: DataFrame) -> DataFrame:
    """(token, major, n, pairs) of each bucket: its largest group, its rows, and its pairs of rows of different groups."""
    sizes = rows.groupBy("token", "c").agg(F.count("*").alias("size"))
    sums = F.max(F.struct("size", "c"))["c"].alias("major"), F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("own")
    return written(sizes.groupBy("token").agg(*sums).select("token", "major", "n", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")), "major-groups")


def _edges(search: _Search) -> DataFrame:
    """(src, dst) of sets p: pairs of the similarity, such that all similar pairs are in one group."""
    with passing(search.docs.sparkSession):
        with passing(search.docs.sparkSession):
            rows = search.buckets()
        rows, other = rows.withColumn("c", F.col("p")), F.col("a_c") != F.col("b_c")
        edges = search.similar(_paired(rows, _led(rows, 0), search.similarity, other).union(search.by_fingerprint()))
        rows = _mixed(rows, edges)
        before, orders = None, LEADERS
        while True:
            majors = _majors(rows)
            crowds = F.col("pairs") > CROWDED * F.col("n")
            left, everything = majors.agg(F.sum(F.when(crowds, F.col("pairs")).otherwise(0)), F.sum("n")).first()
            if (left or 0) <= (everything or 0) or (before is not None and 2 * left > before):
                break
            crowded = majors.where(crowds)
            outside = rows.join(crowded.select("token", "major"), "token").where("c <> major").drop("major")
            edges = edges.union(search.similar(_paired(rows, _led(outside, orders), search.similarity, other)))
            rows = _mixed(rows, edges)
            before, orders = left, orders + LEADERS
        # every pair between different groups of a bucket has a side outside its largest group
        everyone = written(rows.join(majors.select("token", "major"), "token").withColumn("outside", F.col("c") != F.col("major")).drop("major"), "all-rows")
        # a pair of two outside it is met from both sides: once is enough
        once = (F.col("a_p") < F.col("b_p")) | ~F.col("b_outside")
        edges = edges.union(search.similar(_paired(everyone.where("outside").drop("outside"), everyone, search.similarity, other, once)))
        return written(edges, "all-links", outlive=True)


def _grouped(docs: DataFrame, similarity: float, shingle: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """rows (k, id, p), one for each of docs, and the groups (node, component) of linked sets p; k is the digest of the row."""
    if not 0 < similarity <= 1:
        raise ValueError("similarities above 0 and up to 1 are supported")
    spark = docs.sparkSession
    keyed = docs.select(row_key(*map(col, docs.columns)).alias("k"), col(doc_id).alias("id"), col(text).cast("string").alias("text"))
    with passing(spark):
        with passing(spark):
            marked = written(_marked(keyed.withColumn("r", F.monotonically_increasing_id()), shingle, similarity), "marked")
            rows = written(marked.select("k", "id", "p"), "rows", outlive=True)
            repeated = written(marked.groupBy("p").agg(F.min("r").alias("first"), F.count("*").alias("many")).where("many > 1").select("p", "first"), "repeated-sets")
            later = written(marked.select("p", "r").join(repeated, "p").where("r <> first").select("r"), "later-rows")
            prints = written(_without(marked, later, "r").select("p", "k", "n", "fp", "bits", "prefix"), "set-prints", outlive=True)
        # equal sets share p, but of rows that are equal in every column each would be read as that set
        twins = not rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        edges = _edges(_Search(keyed.select("k", "text"), prints, similarity, shingle, twins))
        with passing(spark):
            groups = written(connected_components(edges), "set-groups", outlive=True)
        return _outliving(rows, "rows"), _outliving(groups, "groups")


def _outliving(df: DataFrame, what: str) -> DataFrame:
    return written(df, what, outlive=True)


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) per row of docs: component_id is the smallest id of its group, null if that has none."""
    rows, groups = _grouped(docs, similarity, shingle, doc_id, text)
    named = rows.join(groups.withColumnRenamed("node", "p"), "p", "left").select("id", F.coalesce("component", "p").alias("c"))
    heads = named.groupBy("c").agg(F.min("id").alias("component_id"))
    return named.join(heads, "c").select(F.col("id").alias("doc_id"), "component_id")


def one_of_each_group(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group, the one of the smallest id (nulls last; of equal ids that of the least digest); columns and texts as they are."""
    rows, groups = _grouped(docs, similarity, shingle, doc_id, text)
    key, once = free_name(docs, "k"), free_name(docs, "once")
    with passing(docs.sparkSession):
        # of equal sets first, so that a group of copies is one row in what follows
        sets = written(rows.groupBy("p").agg(F.count("*").alias("many"), F.min(F.struct(F.col("id").isNull().alias("late"), "id", "k")).alias("least")), "set-rows")
        named = written(sets.join(groups.withColumnRenamed("node", "p"), "p", "left").withColumn("crowd", (F.col("many") > 1) | F.col("component").isNotNull()).where("crowd").select("p", F.coalesce("component", "p").alias("c"), "least"), "crowds")
        heads = written(named.groupBy("c").agg(F.min("least")["k"].alias("k")), "heads")
        members = rows.join(named.select("p"), "p", "left_semi").groupBy("k").agg(F.count("*").alias("twins"))
        decided = members.join(heads.select("k", F.lit(True).alias("head")), "k", "left")
        lost = written(decided.where("head is null or twins > 1").select(F.col("k").alias(key), F.col("head").isNotNull().alias(once)), "lost", outlive=True)
        # rows that are equal in every column share a digest: one of them stays
        twins = written(lost.where(col(once)).select(key), "twins", outlive=True)
        several = not twins.isEmpty()
    keyed = docs.withColumn(key, row_key(*map(col, docs.columns)))
    kept = _without(keyed, lost.select(key), key)
    if several:
        kept = kept.union(keyed.where(_sieve(twins, key)).join(twins, key, "left_semi").dropDuplicates([key]).select(*map(col, keyed.columns)))
    return kept.select(*map(col, docs.columns))
