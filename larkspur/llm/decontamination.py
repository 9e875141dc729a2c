"""Benchmark decontamination by winnowing (native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

#: Words of a window that must not be shared, and of the k-grams that are fingerprinted; w = WINDOW - GRAM + 1 of them
#: slide over each other, so every shared run of WINDOW words has a fingerprint that both texts keep.
WINDOW, GRAM = 10, 5
#: Up to so many bytes of benchmark fingerprints, with the words around them, are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: What stands between words, which are what is left: splitting there is ten times as fast as matching the words, as the
#: regular expressions of the JVM keep a table for such a class but not for its complement. The second is for texts whose A-Z aren't lowered.
BETWEEN, BETWEEN_ANY = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(lowered(text), BETWEEN), ""), F.array().cast("array<string>"))


def once(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use() names it; the optimizer would copy it into lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_words(df: DataFrame, *columns: Column, text: str, name: str) -> DataFrame:
    """The columns and the words of a text; the generator keeps the optimizer from copying the split into later lambdas."""
    return df.select(*columns, F.inline(F.array(F.struct(words(F.col(text)).alias(name)))))


def _grams(hashes: Column, k: int) -> Column:
    """A hash for each k consecutive words; empty if there are fewer."""
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: Column, width: int) -> Column:
    """Positions (from 0) of the least hash in each run of `width` grams, the first of equals; all runs shorter than that keep none.

    A position is kept if it is the least of some run around it: fewer than `width` positions lie between the nearest
    one before it whose hash isn't greater and the nearest one after it whose hash is less.
    """
    runs = F.sequence(F.lit(1), F.size(grams) - (width - 1))
    least = F.transform(runs, lambda i: once(F.slice(grams, i, F.lit(width)), lambda run: F.array_position(run, F.array_min(run)).cast("int") + i - 2))
    return F.when(F.size(grams) >= width, F.array_distinct(least)).otherwise(F.array().cast("array<int>"))


def _prints(words: Column, kinds: list[tuple[int, int, int]]) -> Column:
    """(h, at, kind) of the kept grams of a text, for each (kind, words in a gram, grams in a run)."""

    def of(hashes: Column, kind: int, k: int, width: int) -> Column:
        return once(_grams(hashes, k), lambda grams: F.transform(_kept(grams, width), lambda p: F.struct(F.get(grams, p).alias("h"), p.alias("at"), F.lit(kind).alias("kind"))))

    return once(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.concat(*[of(hashes, *x) for x in kinds]))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, fit, n_words, hits): each row of docs with a hash of its text, its runs of hit words and the items found.

    hits: array of (start, end, item_id) for every occurrence of every window, in word positions. Fingerprints of both sides
    join by hash; a match is extended to the windows that hold it, whose words are compared one by one, so no hash decides.
    A fingerprint of an item carries the few words that such windows can reach, never the whole item. Up to BROADCAST_BYTES
    of these are broadcast; beyond that fingerprints are joined by a shuffle that carries no words of documents, which are
    fetched afterwards, once a document.

    Items shorter than a window are one window, looked up whole among runs of as many words. Nulls and texts without words
    have no hits; so has an empty benchmark. Extra columns are ignored. Rows that repeat an id are answered each.
    """
    items = materialize(with_words(items, F.col(item_id).alias("item_id"), text=item_text, name="item_words").where(F.size("item_words") > 0), "items")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("item_words"), F.lit(window)).alias("n")).distinct().collect())
    text = F.coalesce(F.col(doc_text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("fit"), F.size(F.array_remove(F.split(text, BETWEEN_ANY), "")).cast("long").alias("n_words"))
    if not sizes:
        return rows.withColumn("hits", F.array().cast(_HITS))
    base = with_words(docs, F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("fit"), text=doc_text, name="words")
    kinds = [(n, gram, window - gram + 1) if n >= window else (n, n, 1) for n in sizes]  # at most `window` of them
    found = []
    for kind in kinds:
        of = items.where(F.size("item_words") >= window if kind[0] >= window else F.size("item_words") == kind[0])
        left = F.least(F.col("at"), F.lit(window - gram if kind[0] >= window else 0))
        near = F.slice("item_words", F.col("at") - left + 1, left + kind[0])
        found.append(of.select("item_id", "item_words", F.inline(_prints(F.col("item_words"), [kind]))).select("item_id", "kind", "h", left.alias("left"), near.alias("near")))
    prints = materialize(reduce(DataFrame.unionByName, found), "item-prints")
    size = prints.agg(F.sum(F.aggregate("near", F.lit(64).cast("long"), lambda a, w: a + F.octet_length(w) + 16))).first()[0] or 0
    exploded = base.select("doc_id", "fit", "words", F.inline(_prints(F.col("words"), kinds)))
    if size <= BROADCAST_BYTES:  # the words ride along only on rows that match, as this join is pipelined with the generator
        joined = exploded.join(F.broadcast(prints), ["h", "kind"])
    else:
        met = exploded.select("doc_id", "fit", "h", "kind", "at").join(prints, ["h", "kind"])
        of_doc = met.distinct().groupBy("doc_id", "fit").agg(F.collect_list(F.struct("at", "kind", "item_id", "left", "near")).alias("met"))
        of_doc = of_doc.select(F.col("doc_id").alias("d"), F.col("fit").alias("f"), "met")
        joined = base.join(of_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fit") == F.col("f"))).select("doc_id", "fit", "words", F.inline("met"))
    length = F.col("kind")
    offsets = F.sequence(F.lit(0), F.col("left"))
    same = F.filter(offsets, lambda o: (F.col("at") >= o) & (F.col("at") - o + length <= F.size("words")) & (F.col("left") - o + length <= F.size("near")) & (F.slice("words", F.greatest(F.col("at") - o + 1, F.lit(1)), length) == F.slice("near", F.col("left") - o + 1, length)))
    windows = joined.select("doc_id", "fit", "item_id", F.explode(F.transform(same, lambda o: F.struct((F.col("at") - o).alias("start"), (F.col("at") - o + length).alias("end")))).alias("w"))
    hits = windows.groupBy("doc_id", "fit").agg(F.array_sort(F.collect_set(F.struct("w.start", "w.end", "item_id"))).alias("hits"))
    hits = materialize(hits.select(F.col("doc_id").alias("d"), F.col("fit").alias("f"), "hits"), "hits")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fit") == F.col("f")), "left").select("doc_id", "fit", "n_words", F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))


_HITS = "array<struct<start:int,end:int,item_id:bigint>>"


def hit_words(hits: Column) -> Column:
    """How many word positions the (start, end, ...) runs cover; they are sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["until"]), F.lit(0))).alias("n"), F.greatest(x["end"], a["until"]).alias("until"))
    return F.coalesce(F.aggregate(hits, zero, step)["n"], F.lit(0)).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs."""
    found = contamination(docs, items)
    names = F.array_sort(F.array_distinct(F.transform(F.col("hits"), lambda h: h["item_id"].cast("string"))))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit_words(F.col("hits")).alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit_words(F.col("hits")) > 0).alias("contaminated"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
