"""Bindings of the driver's tables to the records the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .functions.numbers import LANGUAGES, spelled
from .functions.text import clean, corrupted, tokens
from .operators.entities import CATEGORIES
from .operators.names import folded_name
from .ship import ship

#: What a recogniser writes for a sound that is no word; no text of the tables has it. With words only left out or replaced by it,
#: the least number of edits is known in advance, so SQL has whole texts too.
FILLER = "[noise]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it has fewer partitions than cores: small files, of one row group even, keep one core busy
    otherwise. Other tables are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of text of a partition that texts are dealt to by their keys, about.
DEALT = 4 << 20


def dealt_parts(df: DataFrame, text: str) -> int:
    """Into how many partitions the texts are dealt: all cores have some, and the rows that a task makes of its texts fit its memory."""
    size = df.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"] or 0
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, r and h (words), ref and hyp (texts): a whole document and a corrupted copy of it."""
    return paired(documents(spark, sf_dir))


def paired(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "lang", "source", tokens("text").alias("r"))
    docs = docs.withColumn("h", corrupted("r", double=None, filler=FILLER))
    return docs.withColumn("ref", F.array_join("r", " ")).withColumn("hyp", F.array_join("h", " "))


def spoken_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_pairs`` with ref_said and hyp_said: each text and, in number words of a language, its reference's length and its own
    number, which the hypothesis gets wrong by one in every third document."""
    item = F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    pairs = text_pairs(spark, sf_dir).withColumn("length", F.length("ref")).withColumn("item", item)

    def said(text: str, item: str) -> Column:
        way = lambda k, x: F.when(F.col("doc_id") % len(LANGUAGES) == k, F.concat(F.lit(" total "), spelled("length", x), F.lit(" item "), spelled(item, x)))
        return F.concat(text, F.coalesce(*(way(k, x) for k, x in enumerate(LANGUAGES))))

    return pairs.withColumn("ref_said", said("ref", "doc_id")).withColumn("hyp_said", said("hyp", "item")).drop("length", "item")


#: Runs of one or more capitalised ASCII words, and letters that a fixture's name has at least.
CAPITALS, LEAST = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 6


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, category: a gazetteer of the tables' own capitalised runs that two documents have, with a category by their length."""
    runs = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CAPITALS), F.lit(0))).alias("run")).select("doc_id", folded_name(F.col("run")).alias("name"))
    names = runs.where(F.length("name") >= LEAST).groupBy("name").agg(F.count_distinct("doc_id").alias("n")).where("n >= 2")
    return names.select("name", F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.length("name") % len(CATEGORIES) + 1)).alias("category"))


def name_aliases(names: DataFrame) -> DataFrame:
    """alias, name: the first two words of longer names stand for them, as do the first seven letters of long single words that
    aren't names themselves."""
    words = F.split("name", " ")
    two = names.where(F.size(words) >= 3).select(F.array_join(F.slice(words, 1, 2), " ").alias("alias"), "name")
    short = names.where((F.size(words) == 1) & (F.length("name") >= 10)).select(F.substring("name", 1, 7).alias("alias"), "name")
    return two.unionByName(short).join(names.select(F.col("name").alias("alias")), "alias", "left_anti")


def timed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, speaker, transcript, start_ts, end_ts: turns one after the other, 0.4 s a word."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("transcript"), F.size(tokens("text")).alias("n"))
    upto = F.sum("n").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end_ts", upto * 0.4).withColumn("start_ts", (upto - F.col("n")) * 0.4).drop("n")


def hearings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two hearings of each conversation: segments (recording, pos, start_ts, end_ts, transcript), cleaned, with two of nine words
    capitalised and half a second of the neighbours at both ends; and the words as they are, 0.4 s each, with their times."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording"), F.col("turn").alias("pos"), tokens("text").alias("w"), tokens(clean("text")).alias("c"))
    before = F.coalesce(F.sum(F.size("w")).over(W.partitionBy("recording").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    capital = lambda x, i: F.when((i % 9).isin(3, 4) & x.rlike("^[a-z]"), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)
    times = [F.greatest(F.col("before") * 0.4 - 0.5, F.lit(0.0)).alias("start_ts"), ((F.col("before") + F.size("w")) * 0.4 + 0.5).alias("end_ts")]
    segments = rows.select("recording", "pos", *times, F.array_join(F.transform("c", capital), " ").alias("transcript"))
    words = rows.select("recording", "before", F.posexplode("w").alias("i", "word"))
    return segments, words.select("recording", "word", ((F.col("before") + F.col("i")) * 0.4).alias("word_start"), ((F.col("before") + F.col("i") + 1) * 0.4).alias("word_end"))


def labelled_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, ref, hyp: ``role: text`` lines; in the hypothesis the roles of each fifth turn are swapped."""
    rows = table(spark, sf_dir, "conversations")
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    rows = rows.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"), F.concat(F.when(F.col("turn") % 5 == 0, other).otherwise(F.col("role")), F.lit(": "), "text").alias("line2"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "line", "line2")))
    return rows.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("ref"), F.array_join(F.transform("p", lambda x: x["line2"]), "\n").alias("hyp"))
