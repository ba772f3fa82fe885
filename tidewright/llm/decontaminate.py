"""Operator 8: benchmark decontamination by a hash set of normalised test n-grams. DataFrame functions only.

Texts become words: A-Z in lower case, runs of letters, digits and all characters beyond ASCII. A
window is N consecutive words of a test item; an item of fewer words, but not none, is one window.
Training texts are scanned inside their rows, once: at each word the hash of the next words is looked
up in the hash set of all windows, which goes to every task with the query (Spark broadcasts it with the
task). The set is a bitmap, BITS_A_WINDOW bits a window and SET_WORDS 64-bit words at most, so that its
size is bounded; a benchmark of more windows than it has room for (half a million at 3 % of false hits)
lets more positions pass, and nothing else changes. Positions that pass are taken out, and an equal join
on the windows' words verifies them, so that neither a full bitmap nor a collision of hashes counts.
Then hits are gathered per document: words inside a window, and items.

Documents are told apart by 128 bits of id and text, so that null and repeated ids do no harm.

Defined results: null texts have no words; very long texts are scanned whole; repeated rows get the same
result each; an empty benchmark hits nothing, an empty table gives an empty table; items of equal text
each count; null item ids are left out of the list; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name, lower_ascii, row_key, table, written

N = 10
#: Size of the bitmap of window hashes: 64-bit words at most (2 MB), and bits a window below that.
SET_WORDS, BITS_A_WINDOW = 1 << 18, 32
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))


def windows(items: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, size, items): each different window's words, their number, and the sorted ids of its items, as strings."""
    worded = items.select(col(item_id).cast("string").alias("item"), words_of(col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = worded.select("item", F.explode(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice("w", i, size)).alias("window"), F.xxhash64(F.slice("w", i, size)).alias("h"), size.alias("size")))).alias("x"))
    return each.groupBy("x.window", "x.size", "x.h").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hash_bitmap(known: DataFrame, n: int) -> tuple[Column, int]:
    """The set of n hashes h, a constant array of 64-bit words, and the number of words (a power of two)."""
    words = 1
    while words < SET_WORDS and 64 * words < BITS_A_WINDOW * n:
        words *= 2
    place, bit = F.col("h").bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned("h", 58).cast("int")
    filled = {r["at"]: r["bits"] for r in known.groupBy(place.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).collect()}
    # as SQL text: thousands of numbers as literals would make a call to the JVM each
    return F.expr(f"cast(split('{','.join(str(filled.get(i, 0)) for i in range(words))}', ',') as array<bigint>)"), words


def in_bitmap(h: Column, bits: Column, words: int) -> Column:
    """Whether the set of hash_bitmap may hold the hash."""
    at, bit = h.bitwiseAND(F.lit(words - 1)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")
    return F.get(bits, at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)) != 0


def scan(docs: DataFrame, known: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns of docs, n_words, and taken: windows (pos, size, window) whose hash is in the set. A table; texts are read once."""
    sizes = {r["size"]: r["n"] for r in known.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits, words = hash_bitmap(known, sum(sizes.values()))

    def taken(size: int) -> Column:
        starts = F.expr(f"if(size(w) >= {size}, sequence(1, size(w) - {size} + 1), cast(array() as array<int>))")

        # the hash is kept beside its position, since a lambda would compute it anew for every use
        hashed = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("w", i, size)).alias("h")))
        return F.transform(F.filter(hashed, lambda x: in_bitmap(x["h"], bits, words)), lambda x: F.struct(x["pos"].alias("pos"), F.lit(size).alias("size"), F.concat_ws(" ", F.slice("w", x["pos"], size)).alias("window")))

    empty = F.array().cast("array<struct<pos:int,size:int,window:string>>")
    worded = docs.select(*keep, words_of(F.col(text)).alias("w"))
    return written(worded.select(*keep, F.size("w").cast("long").alias("n_words"), F.concat(empty, *[taken(size) for size in sorted(sizes)]).alias("taken")), "scanned")


def verified(scanned: DataFrame, known: DataFrame, key: str = "k") -> DataFrame:
    """Per key of a text with a hit: spans (sorted distinct {pos, size}, words counted from 1) and items (sorted)."""
    at = scanned.select(key, F.explode("taken").alias("x")).select(key, "x.*")
    found = at.join(known.select("window", "size", "items"), ["window", "size"]).select(key, F.struct("pos", "size").alias("span"), "items")
    return found.groupBy(key).agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """verified() of docs (k, text) against items."""
    known = written(windows(items, n), "windows")
    return verified(scan(docs, known, ["k"]), known)


def covered(spans: Column) -> Column:
    """Positions inside any of the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["size"] - 1))))


def judge(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (array of strings), spans."""
    keyed = docs.select(col(doc_id).alias("doc_id"), row_key(col(doc_id), col(text)).alias("k"), col(text).cast("string").alias("text"))
    known = written(windows(items, n), "windows")
    scanned = scan(keyed, known, ["doc_id", "k"])
    found = written(verified(scanned, known), "hits")
    none = F.array().cast("array<string>")
    return scanned.join(found, "k", "left").select(
        "doc_id", "n_words", F.coalesce(F.size(covered(F.col("spans"))), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<pos:int,size:int>>")).alias("spans")
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """docs without the rows that hold a window of a test item; columns as they are.

    The keys of hit rows are a table: small ones are broadcast, others meet the rows by key.
    """
    key = free_name(docs, "k")
    keyed = docs.withColumn(key, row_key(col(doc_id), col(text)))
    found = written(hits(keyed.select(F.col(key).alias("k"), col(text).cast("string").alias("text")), items, n).select(F.col("k").alias(key)), "hit")
    return keyed.join(found, key, "left_anti").select(*[col(c) for c in docs.columns])


def without_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """docs whose texts lose every word inside a window, with the characters up to the next word; clean texts stay as they are."""
    key = free_name(docs, "k")
    keyed = docs.withColumn(key, row_key(col(doc_id), col(text)))
    found = hits(keyed.select(F.col(key).alias("k"), col(text).cast("string").alias("text")), items, n).select(F.col("k").alias(key), covered(F.col("spans")).alias(f"{key}_at"))
    # pieces: what stands before the first word, then each word with what follows it
    pieces = F.regexp_extract_all(col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    rest = F.concat_ws("", F.filter(pieces, lambda p, i: ~F.array_contains(F.col(f"{key}_at"), i + 1)))
    return keyed.join(found, key, "left").withColumn(text, F.when(F.col(f"{key}_at").isNull(), col(text)).otherwise(F.concat(lead, rest))).select(*[col(c) for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op8_decontaminate": op8_decontaminate}
SQL = {
    "op8_decontaminate": f"""
WITH item AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {N}) AS size, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
spot AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, greatest(len(w) - size + 2, 1)::BIGINT)) AS i FROM doc, (SELECT DISTINCT size FROM win))),
hit AS (SELECT r, i, size, item_id FROM spot JOIN win USING (size, win)),
per AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN per USING (r) LEFT JOIN items USING (r)""",
}
