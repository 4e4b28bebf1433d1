"""The corpus pipeline: classify quality, drop near duplicates, cut repeats, mix sources, tokenize."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.llm import byte_bpe, common, mixing, near_dup, quality, substring_dedup


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more), as they are.

    Null, empty and blank texts have no words and are scored by that; texts of any length are read whole; equal texts
    share one fate, repeated rows all stay or all go; rows with a null doc_id are judged like others. Further columns
    of any name stay. An empty table gives no rows.
    """
    good = quality.scorer(spark, quality.fit(docs))
    score = common.fresh(docs, "score")
    return docs.withColumn(score, good("text")).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least (doc_id, MD5 of the text).

    Repeated rows of it stay once: whichever of those that differ in other columns only. Different texts under one
    doc_id are documents of their own. Null and empty texts are one text. Rows with a null doc_id take no part and all
    stay. Further columns of any name stay. An empty table gives no rows.
    """
    classes = near_dup.near_classes(docs).where("id is not null")
    kept = classes.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("x")).select(F.col("x.id").alias("kept_id"), F.col("x.digest").alias("kept_digest"))
    digest = common.fresh(docs, "digest")
    own = docs.where("doc_id is not null").withColumn(digest, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    one = own.join(kept, (own["doc_id"] == kept["kept_id"]) & (own[digest] == kept["kept_digest"]), "left_semi").dropDuplicates(["doc_id", digest])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier too (smaller doc_id, or earlier in the document).

    Texts that lose none stay as they are; documents that lose all their words go. Null and empty texts have no words
    and stay. A null doc_id comes before all others; repeated rows are one document and are cut alike; different texts
    under one doc_id are ordered by a hash. n_chars, where it is a column, becomes the length of the new text. Further
    columns of any name stay. An empty table gives no rows.
    """
    name = common.fresh(docs, "cut")
    cut = substring_dedup.with_cuts(docs, name=name).where(f"{name}.n_removed = 0 or {name}.n_removed < {name}.n_words")
    cut = cut.withColumn("text", F.when(F.col(f"{name}.n_removed") > 0, F.col(f"{name}.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return cut.select(*docs.columns)


def _row_key(digest: Column) -> Column:
    """One string for a row's doc_id, text and source."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest, source))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; those that it doesn't take go.

    Null and empty texts have no words: within the budget they are taken like others. Rows of equal doc_id, text and
    source are told apart by number and may be taken unequally often; of those that differ in other columns, which
    gets which number is open. A null source is a source, a null doc_id a name. Further columns of any type and name
    stay. An empty table, or one without words, gives no rows.
    """
    taken = mixing.mix_sources(docs).where("n_taken > 0").select(_row_key(F.col("digest")).alias("taken_key"), "n_taken")
    taken = taken.groupBy("taken_key").agg(F.sort_array(F.collect_list("n_taken"), False).alias("taken_times"))
    key, place = common.fresh(docs, "key"), common.fresh(docs, "place")
    own = docs.withColumn(key, _row_key(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    both = own.join(taken, own[key] == taken["taken_key"]).withColumn(place, F.row_number().over(Window.partitionBy(own[key]).orderBy(F.lit(1))))
    times = F.coalesce(F.get(taken["taken_times"], F.col(place) - 1), F.lit(0)).cast("int")
    return both.withColumn(place, times).where(F.col(place) > 0).withColumn(key, F.explode(F.sequence(F.lit(1), F.col(place)))).select(*[own[c] for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: its token ids, and the text decoded from them.

    Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows and null doc_ids give a
    row each. Other columns are left out. An empty table gives no rows.
    """
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_shared_passages),
    ("mixing sources", mix),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
