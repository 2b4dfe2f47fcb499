"""Benchmark passages in documents: a prefix-filtered set join on DataFrame functions alone.

A window is `window` consecutive words of a benchmark item (an item of fewer words is one window). A document must hold all words
of a window, so it must hold the rarest: ordered by document frequency in the corpus, the necessary prefix of an exact containment
is that one word. Neighbouring windows mostly share it, so an item has few (word, place) anchors.

1. Frequencies of the items' words over all documents.
2. Anchors: the rarest word of each window (ties: the smaller hash), with the item's words around it.
3. Candidates: document words that are anchors. The lookup is a table of word hashes by their low bits: of fixed width, so it is a constant
   number of slots, and each is exact. A candidate carries at most window - 1 words on either side.
4. Verification: equal words outwards from the anchor; length and positional bounds: the run must reach `window` words (or the whole
   of a shorter item) inside both texts.
Documents are read twice, and their texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 1 << 10


def words_of(text: str) -> Column:
    """Words of a text: A-Z lower-cased, all other ASCII but digits separates. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BREAK), "")


def slot_table(hashes: DataFrame, column: str = "h", slots: int = SLOTS) -> Column:
    """A scalar: `slots` arrays, the i-th holding the hashes that are i modulo `slots`. Its size follows the hashes, which must be few (a benchmark's
    words, a bounded lexicon)."""
    spark = hashes.sparkSession
    filled = hashes.select(column).distinct().groupBy(F.pmod(column, F.lit(slots)).alias("i")).agg(F.collect_list(column).alias("hs"))
    every = spark.range(slots).select(F.col("id").alias("i")).join(filled, "i", "left").select("i", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))
    return every.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "hs"))), lambda x: x["hs"]).alias("slots")).scalar()


def in_slots(table: Column, h: Column, slots: int = SLOTS) -> Column:
    return F.array_contains(F.element_at(table, (F.pmod(h, F.lit(slots)) + 1).cast("int")), h)


def anchors(items: DataFrame, frequencies: DataFrame, window: int) -> DataFrame:
    """items: item_id, item_row, words. (h, word, item_id, item_row, place, left, right, need): an anchor with the words before it
    (nearest first) and after it, and the run it needs."""
    at = items.select("item_row", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    ranked = at.join(frequencies, "word", "left").withColumn("rank", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.xxhash64("word").alias("h"), F.col("place")))
    # the windows that hold a place
    first, last = F.greatest(F.lit(0), F.col("place") - window + 1), F.least("place", F.greatest(F.lit(0), F.col("n") - window))
    rarest = ranked.select("item_row", F.explode(F.sequence(first, last)).alias("start"), "rank").groupBy("item_row", "start").agg(F.min("rank.df").alias("df"), F.min("rank").alias("rank"))
    place = rarest.select("item_row", F.col("rank.place").alias("place")).distinct()
    around = place.join(items, "item_row")
    n = F.size("words")
    low = F.greatest(F.lit(0), F.col("place") - (window - 1))
    return around.select(
        F.xxhash64(F.element_at("words", F.col("place") + 1)).alias("h"),
        F.element_at("words", F.col("place") + 1).alias("word"),
        "item_id",
        "place",
        F.reverse(F.slice("words", low + 1, F.col("place") - low)).alias("item_left"),
        F.slice("words", F.col("place") + 2, F.lit(window - 1)).alias("item_right"),
        F.least(n, F.lit(window)).alias("need"),
        F.when(n < window, n - 1 - F.col("place")).alias("whole_right"),
    )


def _equal(a: str, b: str) -> Column:
    """How many leading elements agree."""
    n = F.least(F.size(a), F.size(b))
    first_other = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(n).cast("int")


def contaminated_words(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = 13) -> DataFrame:
    """(id, n_words, spans, n_hit, items): per document the word ranges [start, end) inside occurring windows, their words, and the sorted ids of
    the items that own them.

    Rows with the same id and text are one document; null texts and texts without words have n_words 0; items without words own no
    window; equal items with several ids are all listed. Null ids are kept. Empty tables give no rows, or no hits.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), words_of(item_text).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("item_row", F.xxhash64("item_id", F.to_json("words"))).dropDuplicates(["item_row"])
    item_words = items.select(F.explode("words").alias("word"))
    wanted = slot_table(item_words.select(F.xxhash64("word").alias("h")))
    seen = docs.select(words_of("text").alias("words"), wanted.alias("slots"))
    seen = seen.select(F.explode(F.array_distinct(F.filter("words", lambda w: in_slots(F.col("slots"), F.xxhash64(w))))).alias("word"))
    frequencies = seen.groupBy("word").agg(F.count("*").alias("df"))
    anchor = anchors(items, frequencies, window).persist()
    slots = slot_table(anchor)

    side = window - 1
    parsed = docs.select("id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))
    hit = F.filter(F.transform("words", lambda w, i: F.when(in_slots(F.col("slots"), F.xxhash64(w)), i)), lambda i: i.isNotNull())
    parsed = parsed.withColumn("slots", slots).withColumn("hit", hit).drop("slots")
    around = lambda i: F.struct(
        i.alias("at"),
        F.element_at("words", i + 1).alias("word"),
        F.reverse(F.slice("words", F.greatest(F.lit(0), i - side) + 1, F.least(i, F.lit(side)))).alias("left"),
        F.slice("words", i + 2, F.lit(side)).alias("right"),
    )
    found = parsed.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.transform("hit", around)).alias("c")).select("id", "text_hash", "n_words", "c.*")
    joined = found.join(anchor, "word", "left")
    run = joined.withColumn("l", _equal("left", "item_left")).withColumn("r", _equal("right", "item_right"))
    whole = F.col("whole_right").isNull() | ((F.col("l") == F.col("place")) & (F.col("r") == F.col("whole_right")))
    ok = F.col("item_id").isNotNull() & (F.col("l") + 1 + F.col("r") >= F.col("need")) & whole
    span = F.when(ok, F.struct((F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r") + 1).alias("end")))
    per = run.withColumn("span", span).groupBy("id", "text_hash", "n_words").agg(F.array_sort(F.collect_set("span")).alias("raw"), F.array_sort(F.collect_set(F.when(ok, F.col("item_id").cast("string")))).alias("items"))
    spans = F.aggregate(
        "raw",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    per = per.withColumn("spans", spans)
    return per.select(F.col("id").alias(id_col), "n_words", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), "items")


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
