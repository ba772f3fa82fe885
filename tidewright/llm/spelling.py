"""Operator 11: groups of spelling variants by a variable-length gram index.

Two words are near if one inserted, deleted or replaced letter makes one the other. Words are cut into
grams of variable length: from every place the longest gram of a dictionary, without those that lie
inside another. The dictionary holds all pairs of letters, and longer grams only where the shorter one
that they begin with is frequent, so that no list of the index gets long while rare pairs stay whole. A
gram is frequent with over 1 / `FREQUENT` of all places of the words; at most FREQUENT grams of one
length are, whatever the corpus, which bounds the dictionary (see `gram_dictionary`) and lets it travel
to the tasks.

For each word, the most grams that one edit can affect are counted: those over the edited place, those
left of it from where a longer gram could now grow over it, and those right of it that such a gram could
swallow. All others stand in the other word too. A word of m letters uses grams of m // 2 letters at
most; then no edit affects both the gram at its start and the one at its end, so at least one stays.
(Words of different lengths are compared under the shorter one's limit.) Hence near words share one of
the rarest `affected + 1` grams of either at the same place (shifted by the difference in length or
not): the lists of these grams alone are merged, with the bound on the grams that must still follow,
and what is left is verified by edit distance.

Defined results: null texts have no words; a null document id counts as the empty text in the hash;
equal rows count each; very long texts and words are taken whole; words of equal counts go in code-point
order; an empty table gives an empty table; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, lower_ascii, passing, slices, table, written

MIN_LETTERS, MIN_COUNT = 6, 5
#: How many times as frequent a form is as the word.
FORM_TIMES = 5
#: Of the words' runs whose hash it divides, one letter goes.
DROP_EVERY = 199
#: The longest grams, and the share of all places (one in so many) over which a gram is frequent.
MAX_GRAM, FREQUENT = 5, 1000
MAX_ROUNDS = 60
#: Words of more letters are verified in another way. Cost only.
LONG_WORD = 100
_LETTERS = r"A-Za-zÀ-ÿ"


def _without_letter(run: Column, h: Column) -> Column:
    place = (h % F.length(run)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts, of enough letters and occurrences, after the deletions that the hash decides."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]{{{MIN_LETTERS},}}+"), F.lit(0))).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    words = hashed.select(_without_letter(F.col("run"), F.col("h")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def gram_dictionary(words: DataFrame, max_gram: int = MAX_GRAM, frequent: int = FREQUENT) -> tuple[dict[str, int], dict[str, int]]:
    """The frequent grams, and all grams of the dictionary, with the places of each in the different words.

    At most `frequent` grams of each length can have over 1 / frequent of all places, and every longer gram
    of the dictionary is a frequent one and a letter: with 90 letters, 90 * 90 + (max_gram - 2) * frequent * 90
    grams (278,100 by default) are the most that can come to the driver and go to the tasks.
    """
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    # all substrings of a length in one pass, however long the word
    grams = F.explode(F.flatten(F.array(*(F.regexp_extract_all("word", F.lit(f"(?=(.{{{k}}}))"), F.lit(1)) for k in range(2, max_gram + 1)))))
    counts = written(words.select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("places")), "grams")
    common = counts.where(f"places > {places} / {frequent} and length(gram) < {max_gram}")
    found = {gram: k for gram, k in common.collect()}
    begins = F.broadcast(words.sparkSession.createDataFrame([(g,) for g in found], "begin string"))  # at most (max_gram - 2) * frequent
    longer = counts.where("length(gram) > 2").withColumn("begin", F.expr("substring(gram, 1, length(gram) - 1)")).join(begins, "begin", "left_semi")
    known = counts.where("length(gram) = 2").select("gram", "places").union(longer.select("gram", "places"))
    return found, dict(map(tuple, known.collect()))


def decomposed(word: str, longest: int, frequent: Collection[str]) -> list[tuple[int, int]]:
    """Where the word's grams of at most `longest` letters begin and end."""
    grams, reach = [], 0
    for p in range(len(word) - 1):
        e = p + 2
        while e - p < longest and e < len(word) and word[p:e] in frequent:
            e += 1
        if e > reach:
            grams.append((p, e))
            reach = e
    return grams


def most_affected(word: str, grams: list[tuple[int, int]], longest: int, frequent: Collection[str], endings: Collection[str]) -> int:
    """The most of the word's grams that one edit can affect. endings: the frequent grams without their first letter."""
    n, most, first = len(word), 0, 0
    for i in range(n + 1):
        while first < len(grams) and grams[first][0] < i - longest:
            first += 1
        close = grams[first : first + 2 * longest + 2]  # they begin at different places; none further off is affected
        # a gram from j on could now grow over place i: word[j:i] begins a longer gram of the dictionary
        low = i
        while i - low + 1 < longest and low > 0 and (low == i or word[low - 1 : i] in frequent):
            low -= 1
        for skip in (0, 1):  # a letter put in before i; the letter at i taken out or replaced
            right = i + skip
            if right > n:
                continue
            # a gram that begins further left could end at `high`: word[right:high] ends a longer gram
            high = min(right + longest - 1, n)
            while high > right + 1 and word[right : high - 1] not in endings:
                high -= 1
            hit = 0
            for p, e in close:
                if e <= i:
                    hit += p >= low
                elif p >= right:
                    hit += e <= high
                else:  # over the place
                    hit += 1
            most = max(most, hit)
    return most


def index_rows(word: str, frequent: Mapping[str, int], endings: Collection[str], places: Mapping[str, int]) -> list[tuple]:
    """The entries of one word: m (letters of the shorter word), gram, place, whether it is the longer word, rank, grams, those that stay."""
    rows = []
    for longer in (False, True):
        m = len(word) - longer
        if m < MIN_LETTERS:
            continue
        longest = min(MAX_GRAM, m // 2)
        grams = decomposed(word, longest, frequent)
        affected = most_affected(word, grams, longest, frequent, endings)
        rarest = sorted((places.get(word[p:e], 0), word[p:e], p) for p, e in grams)[: affected + 1]
        for rank, (_, gram, p) in enumerate(rarest):
            for place in (p, p - 1) if longer else (p,):
                rows.append((m, gram, place, longer, rank, len(grams), len(grams) - affected))
    return rows


def _one_edit(a: str, b: str) -> Column:
    """Whether one edit makes a from b, which is as long or one letter longer. The edit distance takes the square of long words, so they are compared from the first letter that differs."""
    place = f"array_position(zip_with(split({a}, ''), split({b}, ''), (x, y) -> x <=> y), false)"
    rest = f"substring({a}, cast({place} as int) + if(length({a}) = length({b}), 1, 0), length({a})) = substring({b}, cast({place} as int) + 1, length({b}))"
    return F.expr(f"case when {a} = {b} then false when length({b}) <= {LONG_WORD} then levenshtein({a}, {b}, 1) = 1 else {rest} end")


_ENTRY = "word string, n bigint, m int, gram string, place int, longer boolean, rank int, grams int, stay int"


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each pair of words one edit apart once. words: word (different ones, each of MIN_LETTERS letters or more) and n."""
    frequent, places = gram_dictionary(words)
    sent = words.sparkSession.sparkContext.broadcast((frequent, {g[1:] for g in frequent}, places))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("spelling")
        common, endings, known = sent.value
        for batch in slices(batches, 2048):
            rows = [(w, n, *row) for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()) for row in index_rows(w, common, endings, known)]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _ENTRY.split(", ")])

    index = written(words.select("word", "n").mapInArrow(entries, _ENTRY), "gram-index")
    one, other = index.where("not longer").alias("one"), index.alias("other")
    merged = one.join(other, ["m", "gram", "place"]).where("other.longer or one.word < other.word")
    # the rarest shared gram stands here and there with so many grams after it
    enough = merged.where("least(one.grams - one.rank, other.grams - other.rank) >= greatest(one.stay, other.stay)")
    verified = enough.where(_one_edit("one.word", "other.word"))
    return verified.selectExpr("one.word as a", "other.word as b", "one.n as n_a", "other.n as n_b").distinct()


def variants(words: DataFrame) -> DataFrame:
    """words (word, n) with form, root, n_near, form_n: the most frequent near word of FORM_TIMES its count, and where following forms ends."""
    with passing(words.sparkSession):
        return written(_variants(written(words, "words")), "variants", outlive=True)


def _variants(words: DataFrame) -> DataFrame:
    pairs = written(near_words(words), "near-words")
    both = pairs.selectExpr("a as word", "b as near", "n_b as n").union(pairs.selectExpr("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    is_form = F.col("form_n") >= FORM_TIMES * F.col("n")
    found = words.join(best.selectExpr("word", "n_near", "best.near as form", "-best.less as form_n"), "word", "left")
    forms = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    return forms.join(_roots(forms.where("form is not null").select("word", F.col("form").alias("root"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where following the links ends. Every round doubles the steps taken; counts rise along links, so there is no way round."""
    now = links
    for _ in range(MAX_ROUNDS):
        beyond = now.selectExpr("word as root", "root as further")
        now = written(now.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")
    raise RuntimeError(f"forms are not settled after {MAX_ROUNDS} rounds")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(table(spark, sf_dir, "documents")))


QUERIES = {"op11_spelling": op11_spelling}
SQL: dict[str, str] = {}
