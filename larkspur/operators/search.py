"""Street and address search: an inverted index with BM25, and the strategies that rank streets and entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import capped, score_column, single_line, tier
from ..functions.parse import Query, Term, parse
from .streets import entries as to_entries
from .streets import streets as to_streets
from .streets import visible, with_digits, with_ids

#: BM25 parameters, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST = 50


def words_of(text: Column) -> Column:
    """Index tokens: letters and digits in lower case, without accents on Latin letters."""
    accents, plain = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn"
    return F.filter(F.split(F.lower(F.translate(text, accents, plain)), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def postings(streets: DataFrame) -> DataFrame:
    """(street_id, token, pos, length): the inverted index over display_search."""
    listed = streets.select("street_id", words_of(F.col("display_search")).alias("ws"))
    return listed.select("street_id", F.size("ws").alias("length"), F.posexplode("ws").alias("pos", "token"))


def _hits(index: DataFrame, term: Term) -> DataFrame:
    """(street_id, tf) of one term: a phrase counts where its words follow each other, its last one by prefix if asked."""
    parts = [p for p in term.text.lower().split() if p]

    def at(k: int) -> DataFrame:
        match = F.col("token").startswith(parts[k]) if term.prefix and k == len(parts) - 1 else F.col("token") == parts[k]
        return index.where(match).select("street_id", (F.col("pos") - k).alias("pos"), *(["length"] if k == 0 else []))

    found = reduce(lambda a, b: a.join(b, ["street_id", "pos"]), [at(k) for k in range(len(parts))])
    return found.groupBy("street_id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def statistics(index: DataFrame) -> DataFrame:
    """One row: the number of streets that are indexed, and their mean length in tokens."""
    return index.where("pos = 0").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"))


def bm25(index: DataFrame, q: Query, total: DataFrame | None = None) -> DataFrame:
    """(street_id, rank) of streets that match every group of the query; smaller ranks are better.

    total: statistics(), if they are kept. Of the index only the rows of the query's words are read.
    """
    total = statistics(index) if total is None else total
    terms = []
    for g, group in enumerate(q.groups):
        for t, term in enumerate(group):
            terms.append(_hits(index, term).withColumn("g", F.lit(g)).withColumn("t", F.lit(t)))
    hits = reduce(DataFrame.unionByName, terms)
    df = hits.groupBy("g", "t").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(df), ["g", "t"]).join(F.broadcast(total))  # one row
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.groupBy("street_id").agg((-F.sum(part)).alias("rank"), F.count_distinct("g").alias("groups"))
    return out.where(F.col("groups") == len(q.groups)).select("street_id", "rank")


def bonus(q: Query) -> Column:
    """What lifts a street: its name is the first word or begins with it, the number fits its range, its size."""
    word, number, unit = q.words[0], q.street, q.flat if q.flat is not None else q.level
    name = F.when(F.col("street_name") == word, 100 if len(word) >= 4 else 15).when(F.col("street_name").startswith(word), 10).otherwise(0)
    at = F.when(F.lit(number).isNull() | F.col("num_min").isNull() | F.col("num_max").isNull(), 0).when(F.lit(number).between(F.col("num_min"), F.col("num_max")), 200).otherwise(-50)
    flat = F.when(F.lit(unit).isNotNull() & F.lit(unit).between(F.col("flat_min"), F.col("flat_max")), 50).otherwise(0)
    return name + at + flat + tier(F.col("address_count"))


def street_hits(streets: DataFrame, index: DataFrame, q: Query, limit: int, total: DataFrame | None = None) -> DataFrame:
    """The best streets for a query, with street_rank from 1: by prefix alone for one letter, else by BM25 less the bonus."""
    if len(q.words) == 1 and len(q.words[0]) == 1:
        rows = streets.where(F.col("street_name").startswith(q.words[0]))
        for hint, low, high in ((q.street, "num_min", "num_max"), (q.flat, "flat_min", "flat_max")):
            if hint is not None:
                rows = rows.where(capped(F.lit(hint)).between(F.col(low), F.col(high)))
        rows = rows.withColumn("_sort", -F.col("address_count").cast("double"))
    else:
        rows = streets.join(bm25(index, q, total), "street_id").withColumn("_sort", F.col("rank") - bonus(q))
    best = rows.orderBy("_sort", "street_id").limit(limit)
    return best.withColumn("street_rank", F.row_number().over(Window.orderBy("_sort", "street_id"))).drop("_sort")


def diversified(rows: DataFrame, limit: int) -> DataFrame:
    """First the best row of each street, then the rest, each by score."""
    order = [F.desc("score"), F.col("street_rank"), F.col("gnaf_pid")]
    first = F.row_number().over(Window.partitionBy("street_key").orderBy(*order))
    return rows.withColumn("_turn", F.when(first == 1, 0).otherwise(1)).orderBy("_turn", *order).limit(limit).drop("_turn")


def search(streets: DataFrame, index: DataFrame, entries: DataFrame, query: str, limit: int = 10, threshold: int = 100, total: DataFrame | None = None) -> DataFrame | None:
    """The best addresses for a free-text query, with score, street_rank and their text on one line; None if it has no words."""
    limit = min(limit, MOST)
    if query.strip().isascii() and query.strip().isdigit():
        return number_search(streets, entries, int(query), limit)
    q = parse(query)
    if q is None:
        return None
    found = street_hits(streets, index, q, max(30, 3 * limit) if q.numbers else limit, total)
    picked = visible(entries.join(F.broadcast(found.select("street_key")), "street_key", "left_semi"), q.street, q.flat, threshold)  # at most 150 streets
    rows = picked.join(F.broadcast(found), "street_key").withColumn("score", score_column(q)).where("score > 0")
    out = diversified(rows, limit) if not q.numbers else rows.orderBy(F.desc("score"), "street_rank", "gnaf_pid").limit(limit)
    return out.withColumn("sla", single_line()).select("gnaf_pid", "street_id", "street_rank", "score", "sla")


def number_search(streets: DataFrame, entries: DataFrame, number: int, limit: int = 10) -> DataFrame:
    """Addresses with a number: on the streets with most addresses whose range holds it; exact before range, bare before units."""
    best = streets.where(F.lit(number).between(F.col("num_min"), F.col("num_max"))).orderBy(F.desc("address_count"), "street_id").limit(max(30, 3 * limit))
    found = best.withColumn("street_rank", F.row_number().over(Window.orderBy(F.desc("address_count"), "street_id")))
    bare = F.col("flat_number").isNull() & F.col("level_number").isNull()
    value = F.when(F.col("number_first") == number, F.when(bare, 100).otherwise(90)).when(F.lit(number).between(F.col("number_first"), F.col("number_last")), 50)
    rows = entries.join(F.broadcast(found), "street_key").withColumn("score", value).where("score > 0")
    return diversified(rows, limit).withColumn("sla", single_line()).select("gnaf_pid", "street_id", "street_rank", "score", "sla")


def streets_of_numbers(streets: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, street_id) of streets whose range holds each number: ranges are spread over tens, so the join is on equality."""
    asked = numbers.select("number", F.floor(F.col("number") / 10).cast("int").alias("ten"))
    low, high = (F.floor(F.col(c) / 10).cast("int") for c in ("num_min", "num_max"))
    rows = streets.where("num_min <= num_max").select("street_id", "num_min", "num_max", F.explode(F.sequence(low, high)).alias("ten"))
    return asked.join(rows, "ten").where("number between num_min and num_max").select("number", "street_id")


def streets_of_beginnings(streets: DataFrame, letters: int = 2, limit: int = 10) -> DataFrame:
    """(q, street_id, score, place): the best streets whose name, locality or state begins with each text of so many letters."""
    rows = streets.select("street_id", "address_count", "street_name", F.explode(F.array_distinct(F.array(*[F.lower(F.left(c, F.lit(letters))) for c in ("street_name", "locality_name", "state")]))).alias("q"))
    points = F.when(F.lower("street_name") == F.col("q"), 115).when(F.lower("street_name").startswith(F.col("q")), 10).otherwise(0) + tier(F.col("address_count"))
    ranked = _best(rows.withColumn("score", points), limit, ["q"], F.desc("score"), F.desc("address_count"), F.col("street_id"))
    return ranked.select("q", "street_id", F.col("score").cast("int").alias("score"), "place")


def write_index(addresses: DataFrame, folder: str) -> None:
    """The standing index: streets, their entries, postings in the order of tokens, and statistics, each a table of `folder`."""
    with_ids(to_streets(addresses)).write.mode("overwrite").parquet(f"{folder}/streets")
    streets = addresses.sparkSession.read.parquet(f"{folder}/streets")
    to_entries(addresses).repartition("street_key").sortWithinPartitions("street_key").write.mode("overwrite").parquet(f"{folder}/entries")
    index = postings(streets)
    index.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{folder}/postings")
    statistics(index).write.mode("overwrite").parquet(f"{folder}/statistics")


def read_index(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(streets, postings, entries, statistics) of write_index(); filters on tokens and streets reach the files."""
    return tuple(spark.read.parquet(f"{folder}/{t}") for t in ("streets", "postings", "entries", "statistics"))


def short_queries(spark) -> DataFrame:
    """All 3,672 queries that are answered in advance: letters, digits, pairs, and numbers with a letter."""
    letters = spark.range(26).select(F.char(F.col("id") + 97).alias("l"))
    digits = spark.range(10).select(F.col("id").cast("string").alias("d"))
    two = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("n"))
    bounded = lambda a, b: a.join(F.broadcast(b))  # noqa: E731  alphabets of fixed size
    parts = [letters.select(F.col("l").alias("q")), digits.select(F.col("d").alias("q")), bounded(letters, letters.select(F.col("l").alias("m"))).select(F.concat("l", "m").alias("q")), two.select(F.col("n").alias("q")), bounded(digits, letters).select(F.concat("d", F.lit(" "), "l").alias("q")), bounded(two, letters).select(F.concat("n", F.lit(" "), "l").alias("q"))]
    return reduce(DataFrame.unionByName, parts)


def _best(rows: DataFrame, limit: int, keys: list[str], *order: Column) -> DataFrame:
    """The first rows of each key with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit)


def precomputed(streets: DataFrame, entries: DataFrame, limit: int = MOST, threshold: int = 100) -> DataFrame:
    """(q, kind, place, street_id, gnaf_pid, score, text): streets and addresses of every short query, the best `limit` of each.

    Queries without a word or number left to search for, such as 'm', '1 m' or 'se', have no rows. A word is the beginning of
    a street's name, locality or state; a number must fit the street's range. Words and tens make the joins equi-joins.
    """
    spark, queries = streets.sparkSession, []
    for (q,) in short_queries(spark).collect():  # 3,672 of them
        found = parse(q)
        if found:
            queries.append((q, found.words[0].lower(), found.street, found.numbers[0] if found.numbers else None))
        elif q.isdigit():
            queries.append((q, "", int(q), q))
    asked = spark.createDataFrame(queries, "q string, word string, number int, token string")
    keys = asked.select("word", "number", (F.col("number") / 10).cast("int").alias("ten")).distinct()

    names = ("street_name", "locality_name", "state")
    word = F.explode(F.array_distinct(F.array(F.lit(""), *[F.coalesce(F.lower(F.left(c, F.lit(k))), F.lit("")) for c in names for k in (1, 2)])))
    begun = streets.select("street_id", "address_count", "num_min", "num_max", F.lower("street_name").alias("name"), word.alias("word"))
    fits = begun.where("num_min <= 99 and num_max >= 0")
    tens = F.explode(F.sequence((F.greatest("num_min", F.lit(0)) / 10).cast("int"), (F.least("num_max", F.lit(99)) / 10).cast("int")))
    ranged = fits.where("num_min <= num_max").withColumn("ten", tens).join(F.broadcast(keys.where("number is not null")), ["word", "ten"]).where("number between num_min and num_max").drop("ten")
    plain = begun.join(F.broadcast(keys.where("number is null").drop("ten")), "word")
    exact = F.when(F.col("word") == "", 0).when(F.col("name") == F.col("word"), 115).when(F.col("name").startswith(F.col("word")), 10).otherwise(0)
    points = F.when(F.col("word") == "", 0).otherwise(exact + tier(F.col("address_count")) + F.when(F.col("number").isNotNull(), 200).otherwise(0))
    matched = plain.unionByName(ranged).withColumn("points", points)
    best = _best(matched, max(30, 3 * limit), ["word", "number"], F.desc("points"), F.desc("address_count"), F.col("street_id"))
    best = best.where(F.col("number").isNotNull() | (F.col("place") <= limit)).select(F.col("word").alias("_word"), F.col("number").alias("_number"), "street_id", "points", F.col("place").alias("street_rank"))
    same = (F.col("_word") == F.col("word")) & F.col("_number").eqNullSafe(F.col("number"))
    hits = best.join(F.broadcast(asked), same).drop("_word", "_number")
    shown = streets.select("street_id", "street_key", "display", "street_name", "street_type_abbrev", "street_suffix_code", "locality_name", "state", "postcode")
    hits = hits.join(shown, "street_id").persist()
    listed = hits.where(F.col("street_rank") <= limit).select("q", F.lit("street").alias("kind"), F.col("street_rank").alias("place"), "street_id", F.lit(None).cast("string").alias("gnaf_pid"), F.col("points").alias("score"), F.col("display").alias("text"))

    dealt = with_digits(entries, threshold)
    least = dealt.groupBy("street_key").agg(F.min("digit").alias("least"))
    rows = hits.join(dealt.join(least, "street_key"), "street_key")
    hinted = F.col("least").isNull() | (F.col("digit") == F.left(F.col("number").cast("string"), F.lit(1)))
    rows = rows.where(F.when(F.col("number").isNull(), F.col("digit").isNull() | (F.col("digit") == F.col("least"))).otherwise(hinted))
    bare, unit = F.col("flat_number").isNull() & F.col("level_number").isNull(), F.coalesce("flat_number", "level_number")
    first, within = F.col("number_first") == F.col("number"), F.col("number").between(F.col("number_first"), F.col("number_last"))
    by_number = F.when(first, F.when(bare, 100).otherwise(90)).when(within, 50)
    by_both = F.when(first | within, F.when(bare, 100).otherwise(90)).when(unit == F.col("number"), 80).when(F.col("display_prefix").contains(F.col("token")), 30)
    value = F.when(F.col("number").isNull(), F.when(bare, 2).otherwise(1)).when(F.col("word") == "", by_number).otherwise(by_both)
    order = [F.desc("score"), F.col("street_rank"), F.col("gnaf_pid")]
    scored = rows.withColumn("score", value).where("score > 0")
    turned = scored.withColumn("nth", F.row_number().over(Window.partitionBy("q", "street_id").orderBy(*order))).where(F.col("nth") <= limit)
    turn = F.when((F.col("nth") > 1) & (F.col("number").isNull() | (F.col("word") == "")), 1).otherwise(0)
    found = _best(turned.withColumn("turn", turn), limit, ["q"], F.col("turn"), *order)
    return listed.unionByName(found.select("q", F.lit("address").alias("kind"), "place", "street_id", "gnaf_pid", "score", single_line().alias("text")))
