"""Full-text search of names over an inverted index.

Postings are (lexeme, frequency, id, positions, length): every lexeme of every text with how
many texts have it, where it is in this one, and how many words this one has. Each distinct
word is stemmed once. Words and postings are never broadcast: they take little room in a file
and much in memory, of every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, stems, words_of

POSTINGS = "lexeme string, frequency long, id string, positions array<int>, length int"
#: Parts that a lexeme's postings are counted in, and postings of a lexeme that meet a query in one task.
PARTS, CHUNK = 256, 10_000


def _lexemes(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with one row for each word that isn't a stop word: its position from 1, its lexeme, and the text's words."""
    words = texts.withColumn("_words", words_of(F.col(text))).withColumn("length", F.size("_words"))
    rows = words.select(*texts.columns, "length", F.posexplode("_words").alias("position", "_word")).filter(~F.col("_word").isin(STOP_WORDS))
    known = rows.select("_word").distinct().withColumn("lexeme", stems(F.col("_word")))
    return rows.withColumn("position", F.col("position") + 1).join(known.hint("merge"), "_word").drop("_word")


def postings(texts: DataFrame) -> DataFrame:
    """The index of ``texts`` (id, text), with distinct ids.

    A lexeme may be in most texts, so its postings get its frequency in PARTS parts, by ids.
    """
    rows = _lexemes(texts.select("id", "text"), "text").groupBy("lexeme", "id", "length").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    many = rows.groupBy("lexeme", "_part").agg(F.count(F.lit(1)).alias("_n"))
    many = many.withColumn("frequency", F.sum("_n").over(Window.partitionBy("lexeme"))).drop("_n")  # at most PARTS rows a lexeme
    return rows.join(many.hint("merge"), ["lexeme", "_part"]).select("lexeme", "frequency", "id", "positions", "length")


def write_index(texts: DataFrame, path: str) -> None:
    """Store the postings by lexeme, so that a query reads few row groups."""
    postings(texts).repartitionByRange("lexeme", "id").sortWithinPartitions("lexeme", "id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, id, rank: the texts that have all lexemes of a query (``query``, distinct); one without lexemes finds nothing.

    A query goes to the postings of its rarest lexeme alone; the texts found there are then
    looked up under the others. Where even that lexeme has many postings, they are dealt out
    by id. The rank is a declared substitute: the occurrences of the query's lexemes over the
    text's words and the words before the first of them.
    """
    asked = _lexemes(queries.select("query"), "query").select("query", "lexeme").distinct()
    known = index.groupBy("lexeme").agg(F.first("frequency").alias("_n")).hint("merge")
    lexemes = F.sort_array(F.collect_list(F.struct("_n", "lexeme")))  # the lexemes of one query, the rarest first; unknown ones before all
    asked = asked.join(known, "lexeme", "left").groupBy("query").agg(lexemes.alias("_l")).filter(F.col("_l")[0]["_n"].isNotNull())
    parts = lambda n: F.ceil(n / CHUNK)
    lead = asked.select("query", F.col("_l")[0]["lexeme"].alias("lexeme"), F.slice("_l.lexeme", 2, F.size("_l")).alias("_rest"), F.explode(F.sequence(F.lit(0), parts(F.col("_l")[0]["_n"]) - 1)).alias("_part"))
    dealt = index.select("lexeme", F.pmod(F.xxhash64("id"), parts(F.col("frequency"))).alias("_part"), "id", "length", F.size("positions").alias("hits"), F.col("positions")[0].alias("first")).hint("merge")
    found = lead.join(dealt, ["lexeme", "_part"]).select("query", "id", "length", F.col("hits").alias("_hits"), F.col("first").alias("_first"), F.size("_rest").alias("_others"), F.explode_outer("_rest").alias("lexeme"))
    every = found.join(dealt.select("lexeme", "id", "hits", "first"), ["lexeme", "id"], "left").groupBy("query", "id", "length", "_hits", "_first", "_others")
    every = every.agg(F.count("hits").alias("_n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.min("first").alias("first")).filter("_n = _others")
    return every.select("query", "id", ((F.col("_hits") + F.col("hits")) / (F.col("length") + F.least("_first", "first") - 1)).alias("rank"))


def search(entities: DataFrame, index: DataFrame, query: str, limit: int) -> DataFrame:
    """Entities (syn_id, canonical_name) that a query finds in the index of their names, by syn_id; best rank first."""
    asked = entities.sparkSession.createDataFrame([(query,)], "query string")
    return entities.join(matches(asked, index).select(F.col("id").alias("syn_id"), "rank"), "syn_id").orderBy(F.desc("rank"), "canonical_name", "syn_id").limit(limit)
