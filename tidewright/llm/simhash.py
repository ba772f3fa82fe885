"""Operator 6: SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits: bit j is 1 if it is set in over half the hashes of the
document's word shingles (repeats count). Fingerprints within `max_distance` differing bits link;
a group is a connected component of links.

Search, over distinct fingerprints only (copies share one):

1. Bit statistics over all fingerprints give the correlation of every pair of bits. Correlated bits
   are grouped into the same partition, so that they spoil one partition instead of all.
2. If partitions 1..m have thresholds t_i (-1: skipped) that add up to max_distance - m + 1, two
   fingerprints within max_distance agree up to t_i bits in at least one partition i. For each
   layout (m = 2, 3), bucket counts over all fingerprints estimate the candidates of (i, t);
   dynamic programming picks the thresholds of least cost, and the cheaper layout is taken.
3. Each fingerprint is filed under its bits of partition i and probes every pattern within t_i bits;
   candidates are verified on all 64 bits.
4. A bucket of more than PAIR_LIMIT fingerprints is not paired. Its members (and whoever probes it)
   are linked exactly in another way: two fingerprints are within 2 bits if and only if some 64-bit
   point is within 1 bit of both, so each member is filed under itself and its 64 neighbours, and
   the at most 65 fingerprints at a point are all linked to the smallest. 65 rows a member, no pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; texts with
fewer words than a shingle are one shingle; very long texts are read whole; a null document id never
names a group; an empty table gives an empty table; other columns, whatever their names, are not
read; rows are kept one for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, col, passing, slices, table, written
from .components import connected_components

BITS = 64
#: A bucket up to this size is paired; a larger one is linked through shared neighbour points.
PAIR_LIMIT = 32
LAYOUTS = (2, 3)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, name: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """docs with the column `name` (bigint): the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("simhash")
        for batch in slices(batches):
            yield pa.array(np.array([fingerprint(t, shingle) for t in batch.to_pylist()], dtype=np.uint64).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "bigint")(col(text)))


def bit_correlations(prints: DataFrame) -> np.ndarray:
    """|correlation| of every two bits over all rows of prints (fp): 4,096 sums, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = np.hstack([bits, np.ones((len(fps), 1), np.uint8)]).astype(np.float32)
            together += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(together.size, dtype=np.int32)), pa.array(together.reshape(-1).astype(np.int64))], names=["cell", "n"])

    sums = np.zeros((BITS + 1) ** 2)
    for cell, n in prints.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        sums[cell] = n
    sums = sums.reshape(BITS + 1, BITS + 1)
    n = max(sums[-1, -1], 1)
    p = sums[-1, :-1] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    out = np.abs((sums[:-1, :-1] / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(out, 0)
    return out


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in `parts` groups of nearly equal size, each grown from the most correlated bits left."""
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        at = sorted(left)
        first = max(at, key=lambda i: (correlation[i, at].max(), -i))
        group = [first]
        left.discard(first)
        while len(group) < size:
            near = max(sorted(left), key=lambda i: (correlation[i, group].sum(), -i))
            group.append(near)
            left.discard(near)
        groups.append(sorted(group))
    return groups


@dataclass(frozen=True)
class Plan:
    groups: list[list[int]]
    thresholds: list[int]
    cost: float

    @property
    def masks(self) -> list[int]:
        return [_signed(sum(1 << b for b in g)) for g in self.groups]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one from each partition's costs {t: cost}, that add up to total at least cost; by dynamic programming over partitions."""
    best = {0: (0.0, [])}
    for at in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in at.items():
                new = (cost + more, [*chosen, t])
                if spent + t not in step or new < step[spent + t]:
                    step[spent + t] = new
        best = step
    return best[total]


def patterns(group: list[int], threshold: int) -> list[int]:
    """Every change of at most `threshold` bits of the group, as a mask to XOR with."""
    return [_signed(sum(1 << b for b in c)) for k in range(threshold + 1) for c in combinations(group, k)]


def plan_search(prints: DataFrame, max_distance: int) -> Plan:
    """The layout and thresholds of least estimated cost: rows filed and probed, and candidates to verify."""
    correlation = bit_correlations(prints)
    layouts = {m: grouped_bits(correlation, m) for m in LAYOUTS if m <= max_distance + 1} or {1: [list(range(BITS))]}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, groups in layouts.items() for i, mask in enumerate(Plan(groups, [], 0).masks)]
    counts = prints.select(F.explode(F.array(*keys)).alias("k")).select("k.*").groupBy("m", "i", "key").agg(F.count("*").alias("n"))
    found = {(m, i): (float(n), float(pairs)) for m, i, n, pairs in counts.groupBy("m", "i").agg(F.sum("n"), F.sum(F.col("n").cast("double") * (F.col("n") - 1))).collect()}
    plans = []
    for m, groups in layouts.items():
        costs = []
        for i, group in enumerate(groups):
            n, pairs = found.get((m, i), (0.0, 0.0))
            # neighbouring buckets are taken to be as full as the own one
            costs.append({-1: 0.0} | {t: (n + pairs) * len(patterns(group, t)) + n for t in range(max_distance + 1)})
        cost, thresholds = allocate(costs, max_distance - m + 1)
        plans.append(Plan(groups, thresholds, cost))
    return min(plans, key=lambda p: p.cost)


def _changed(fp: str, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, masks)), lambda x: F.col(fp).bitwiseXOR(x)))


def links(prints: DataFrame, max_distance: int, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(src, dst): pairs of different fingerprints (fp, distinct) within max_distance bits, or chains of such pairs through the smallest of their point."""
    if not 0 <= max_distance <= 2:
        raise ValueError("distances from 0 to 2 are supported")
    if not max_distance:
        return prints.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    plan = plan_search(prints, max_distance)
    used = [(i, mask, group, t) for i, (mask, group, t) in enumerate(zip(plan.masks, plan.groups, plan.thresholds)) if t >= 0]
    filed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, mask, _, _ in used])).alias("k")).select("fp", "k.*")
    probes = None
    for i, mask, group, t in used:
        own = prints.select("fp", F.lit(i).alias("i"), _changed("fp", patterns(group, t)).alias("key")).withColumn("key", F.col("key").bitwiseAND(F.lit(mask)))
        probes = own if probes is None else probes.union(own)
    crowded = written(filed.groupBy("i", "key").agg(F.count("*").alias("n")).where(F.col("n") > pair_limit).select("i", "key"), "crowded")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_distance
    pairs = probes.withColumnRenamed("fp", "src").join(filed.withColumnRenamed("fp", "dst").join(crowded, ["i", "key"], "left_anti"), ["i", "key"]).where("src <> dst").where(near).select("src", "dst")
    dense = probes.join(crowded, ["i", "key"], "left_semi").select("fp").distinct()
    if max_distance == 1:
        flipped = dense.select(F.col("fp").alias("src"), _changed("fp", patterns(list(range(BITS)), 1)[1:]).alias("dst"))
        return pairs.union(flipped.join(prints.select(F.col("fp").alias("dst")), "dst").select("src", "dst"))
    points = dense.select("fp", _changed("fp", patterns(list(range(BITS)), 1)).alias("point"))
    # at most 65 fingerprints lie at a point
    met = points.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    starred = met.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).where("src <> dst").distinct()
    return pairs.union(starred)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, doc_id: str = "doc_id", text: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its group)."""
    with passing(docs.sparkSession):
        slim = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
        marked = written(with_fingerprints(slim, "fp", "text", shingle).select("doc_id", "fp"), "fingerprints", outlive=True)
        prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
        groups = connected_components(links(prints.select("fp"), max_distance, pair_limit))
        # a fingerprint without links is its own group
        rooted = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
        named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        named = written(rooted.join(named, "root").select("fp", "component_id"), "named", outlive=True)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
