import numpy as np
import pytest
import xxhash

from tidewright.llm import simhash
from tidewright.llm.components import connected_components


def slow_fingerprint(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_by_definition():
    for text in (None, "", "one", "A b C", "a b\tc\x0bd e é 日本 f g", "x " * 50, "q" * 1000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("pair_limit", [0, 2, 32])
def test_links_against_all_pairs(spark, distance, pair_limit):
    """Clusters around a few centres, and buckets both below and above the pair limit."""
    rng = np.random.default_rng(distance * 10 + pair_limit)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    flips = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for c in centres for _ in range(40)]
    prints = sorted({*flips, *map(int, rng.integers(-(1 << 63), (1 << 63) - 1, 60, dtype=np.int64))})
    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    found = connected_components(simhash.links(df, distance, pair_limit)).collect()
    got = {n: n for n in prints} | {r.node: r.component for r in found}
    assert got == groups(near, prints)


def test_query_on_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.fingerprint) for r in rows if r.doc_id is not None) == sorted((d.doc_id, f"{slow_fingerprint(d.text):016x}") for d in docs if d.doc_id is not None)
    assert len(rows) == len(docs)
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert of[(1, zero)] == of[(2, zero)] == of[(8, zero)] == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_thresholds_by_dynamic_programming():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 9.0}, {-1: 0.0, 0: 100.0, 1: 900.0}]
    assert simhash.allocate(costs, 0) == (14.0, [0, 1, -1])


def test_correlated_bits_share_a_partition():
    c = np.zeros((64, 64))
    c[3, 40] = c[40, 3] = c[40, 60] = c[60, 40] = 0.9
    parts = simhash.grouped_bits(c, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({3, 40, 60} <= set(p) for p in parts)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 1), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
