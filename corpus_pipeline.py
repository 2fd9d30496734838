"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last adds the tokens. A driver writes and
rereads the rows between stages; ``run`` does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.jaccard import ngram_jaccard_join
from quire.llm.line_dedup import line_dedup
from quire.llm.quality_classifier import quality_classifier
from quire.llm.queries import model_file, table
from quire.llm.sentencepiece_codec import sentencepiece_encode
from quire.llm.source_mix import mix_sources
from quire.session import small, stored


def _hash(*columns: str) -> Column:
    """A hash of the columns in which a null differs from every value."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps, unchanged. Each row has its own verdict, with or without an id of its own."""
    keyed = docs.withColumn("__row", _hash(*docs.columns))
    verdict = quality_classifier(keyed, table(spark, sf_dir, "labels"), row_col="__row").where("keep").select(F.col("doc_id").alias("__id"), "__row").distinct()
    same = keyed["doc_id"].eqNullSafe(verdict["__id"]) & (keyed["__row"] == verdict["__row"])
    return keyed.join(verdict, same, "left_semi").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs of 50 words or more; ``n_chars`` follows the text."""
    out = line_dedup(docs, min_words=50)
    n = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 80 % of five-word shingles: that of the smallest id, rows without id last.

    Rows are told apart by their id where no other row has it, and by a hash of
    id and text otherwise, so rows that share an id are linked by their texts
    only. Rows without words all stay, but for repeats of the same id and text.
    """
    shared = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id", F.lit(True).alias("__shared")))
    alone = F.col("doc_id").isNotNull() & F.col("__shared").isNull()
    keyed = docs.join(small(shared), "doc_id", "left").withColumn("__alone", alone)
    keyed = keyed.withColumn("__row", F.when(alone, F.col("doc_id").cast("long")).otherwise(_hash("doc_id", "text"))).drop("__shared")
    found = ngram_jaccard_join(keyed.select("__row", "text"), id_col="__row", ngram=5, num=80, den=100)
    found = stored(found.select(F.col("doc_id").alias("__row"), "n_shingles", "component_id").distinct())
    ids = keyed.select("doc_id", "__row").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__row")
    first = found.where("n_shingles > 0").join(ids, "__row").groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first.__row").alias("__row"))
    kept = keyed.join(first.unionByName(found.where("n_shingles = 0").select("__row")), "__row", "left_semi")
    # only rows that aren't alone can repeat; the hash of all columns settles which stays
    again = Window.partitionBy("__row").orderBy(_hash(*docs.columns))
    odd = kept.where(~F.col("__alone")).withColumn("__rn", F.row_number().over(again)).where("__rn = 1")
    return kept.where("__alone").select(*docs.columns).unionByName(odd.select(*docs.columns))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: sources weigh 5, 2, 1 in turn and share 150 % of the words; a document taken twice is two rows, one not taken is none."""
    mixed = mix_sources(docs, share=1.5, repeats=2).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, their number and the text they decode to."""
    out = sentencepiece_encode(docs, model_file())
    return out.withColumn("n_tokens", F.size("ids").cast("long")).select(*docs.columns, "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: The classifier and the encoder can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
