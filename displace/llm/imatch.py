"""I-Match fingerprints on DataFrame functions alone.

The lexicon holds the terms in a band of inverse document frequency: those in at least `low` and at most `high` of the documents. At
most (mean terms a document) / low terms can be in at least that share of the documents, so the lexicon's size depends on the
documents' lengths, not on their number. A document's sorted distinct lexicon terms are hashed once for each of several randomised lexicon
subsets; a subset keeps a term with probability 2**-r for some rate r, so short and long documents both have subsets that
hold few of their terms and outlive edits of the others. A term's bits for all draws come from two hashes of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from displace.llm.decontaminate import in_slots, slot_table
from displace.session import materialize

#: Rates of the subsets: the r-th keeps a term with probability 2**-r.
RATES = (2, 4, 6, 8)
#: Random draws for each rate.
SEEDS = 16  # a multiple of 8
#: Slots of the lexicon: about a term in each.
SLOTS = 1 << 14
#: The name of a subset that keeps no term.
EMPTY = 0


def terms(text: Column) -> Column:
    """Distinct 64-bit names of the lower-cased runs of letters and digits."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F\s]+"), ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """(h, df) of the terms in the band; counts cover all documents."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return df.withColumn("n", n).where((F.col("df") >= 2) & (F.col("df") >= F.col("n") * low) & (F.col("df") <= F.greatest(F.lit(2), F.col("n") * high))).select("h", "df")


def with_rates(kept: Column) -> Column:
    """Each term with its two words of random bits, a byte for each draw: drawn once for all subsets."""
    return F.transform(kept, lambda h: F.struct(h.alias("h"), *[F.xxhash64(h, F.lit(w)).alias(f"w{w}") for w in range(SEEDS // 8)]))


def _keeps(seed: int, rate: int):
    """The byte of the draw starts with `rate` zero bits."""
    mask = ((1 << rate) - 1) << (8 * (seed % 8) + 8 - rate)
    mask -= (mask >> 63) << 64
    return lambda t: t[f"w{seed // 8}"].bitwiseAND(F.lit(mask).cast("long")) == 0


def subset_hashes(docs: DataFrame, text: Column, lexicon_slots: Column, out: str) -> DataFrame:
    """docs with `out`: one 64-bit hash of the sorted lexicon terms for each randomised subset, EMPTY where a subset keeps none; the hash of the whole
    text alone where no lexicon term is in it. The subsets of a draw are nested: each is filtered from the one before."""
    # one step a projection: what a step makes is used many times by the next
    kept = docs.withColumn("_terms", terms(text)).withColumn("_slots", lexicon_slots)
    kept = kept.withColumn("_kept", F.array_sort(F.filter("_terms", lambda h: in_slots(F.col("_slots"), h, SLOTS)))).drop("_terms", "_slots")
    wide = kept.withColumn("_kept", with_rates(F.col("_kept")))
    for i, r in enumerate(RATES):
        wide = wide.withColumns({f"_{s}_{r}": F.filter("_kept" if i == 0 else f"_{s}_{RATES[i - 1]}", _keeps(s, r)) for s in range(SEEDS)})
    name = lambda s, r: F.when(F.size(f"_{s}_{r}") > 0, F.xxhash64(F.transform(f"_{s}_{r}", lambda t: t["h"]), F.lit(r))).otherwise(F.lit(EMPTY).cast("long"))
    hashes = F.array(*[name(s, r) for s in range(SEEDS) for r in RATES])
    wide = wide.withColumn(out, F.when(F.size("_kept") > 0, hashes).otherwise(F.array(F.xxhash64(text))))
    return wide.drop("_kept", *[f"_{s}_{r}" for s in range(SEEDS) for r in RATES])


def written(hashes: str) -> Column:
    """A fingerprint as text: the hashes in hex, joined by commas, "-" for a subset without terms; "=" before a whole text's hash."""
    one = lambda h: F.when(h == EMPTY, "-").otherwise(F.lower(F.hex(h)))
    return F.when(F.size(hashes) == 1, F.concat(F.lit("="), F.lower(F.hex(F.element_at(hashes, 1))))).otherwise(F.array_join(F.transform(hashes, one), ","))


def agreement(a: str, b: str) -> Column:
    """For each subset whether both texts have it equal; null where both are empty."""
    return F.zip_with(a, b, lambda p, q: F.when((p != EMPTY) | (q != EMPTY), F.when(p == q, 1).otherwise(0)))


def likeness(a: str, b: str, agree: str) -> Column:
    """Share of the draws whose smallest subset with a term of either text is equal (agree: their agreement); 1 for equal fingerprints, 0 if just one of
    them has a lexicon term or there is no other."""
    size = len(RATES)
    last = [F.coalesce(*[F.get(agree, F.lit(s * size + r)) for r in reversed(range(size))]) for s in range(SEEDS)]  # the last rate that keeps anything decides
    told = reduce(Column.__add__, [v.isNotNull().cast("int") for v in last])
    same = reduce(Column.__add__, [F.coalesce(v, F.lit(0)) for v in last])
    return F.when(F.col(b).isNull(), 0.0).when(F.col(a) == F.col(b), 1.0).when((F.size(a) == 1) | (F.size(b) == 1) | (told == 0), 0.0).otherwise(same / told)


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next): the next smaller distinct id (any ordered type), after the smallest the largest. Ids are sorted into ranges, each a task; what
    precedes a range is the largest id of the ranges before it (a row per range)."""
    from pyspark.sql import Window

    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    ranged = materialize(ids.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")), "ids")
    inside = ranged.withColumn("before", F.lag("id").over(Window.partitionBy("part").orderBy("id")))
    tops = ranged.groupBy("part").agg(F.max("id").alias("high"))
    earlier = tops.alias("a").join(tops.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.max("b.high").alias("earlier"))  # ranges, not ids
    return inside.join(F.broadcast(earlier), "part").withColumn("largest", tops.agg(F.max("high")).scalar()).select("id", F.coalesce("before", "earlier", "largest").alias("next"))


def with_next(own: DataFrame, following: DataFrame) -> DataFrame:
    """own (id, text, hashes) with the edited text and the next document's hashes. Texts are dealt by
    id once, for both joins (so both see the same rows: those with an id): askers' needs go to the next document and bring back only what is
    needed."""
    half = lambda: F.floor(F.length("text") / 2).cast("int")
    nameless = own.where("id is null").withColumn("given", F.lit(None).cast("struct<text:string,hashes:array<bigint>>"))
    own = own.where("id is not null")
    asks = own.select("id", half().alias("half")).groupBy("id").agg(F.max("half").alias("half")).join(following, "id").select(F.col("next").alias("id"), F.col("id").alias("asker"), "half")
    given = own.join(asks, "id").select("asker", F.struct(F.substring("text", F.lit(1), F.col("half")).alias("text"), "hashes").alias("given"))
    given = given.groupBy(F.col("asker").alias("id")).agg(F.min("given").alias("given"))
    joined = own.join(given, "id", "left").unionByName(nameless)
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - half()), F.substring(F.coalesce("given.text", F.lit("")), F.lit(1), half()))
    return joined.select("id", F.length("text").cast("long").alias("n_chars"), "hashes", edited.alias("edited"), F.col("given.hashes").alias("next_hashes"))


def imatch_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", low: float = 0.002, high: float = 0.1) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row. A text is edited by
    putting as much (or all) of the beginning of the next document, in descending order of id, in the place of its last half.

    Null texts are empty, equal texts have equal fingerprints; of rows with equal ids the smallest text stands for the next document;
    null ids have no next document (an empty one). Empty tables give no rows; other columns are ignored.
    """
    slots = slot_table(materialize(lexicon(docs, text, low, high), "lexicon"), slots=SLOTS)  # counted once, used by every fingerprint
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = with_next(subset_hashes(own, F.col("text"), slots, "hashes"), next_ids(docs, id_col))
    both = subset_hashes(texts, F.col("edited"), slots, "edited_hashes")
    both = both.withColumns({"_edited": agreement("hashes", "edited_hashes"), "_next": agreement("hashes", "next_hashes")})
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("hashes").alias("fingerprint"),
        written("edited_hashes").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes", "_edited").alias("near_edited"),
        likeness("hashes", "next_hashes", "_next").alias("near_next"),
    )
