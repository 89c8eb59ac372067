"""A training-data pipeline over ``documents``: five stages, each written and read again as Parquet.

1 toxicity: documents whose probability of a grade above 0 is one half or more go.
2 line_dedup: lines that five or more documents share go, except in the largest doc_id.
3 simhash: one document of each group of near copies (5-word Jaccard of 0.8 or more) stays, the smallest doc_id.
4 decontamination: documents that overlap a benchmark item go.
5 sentencepiece: the texts that are left become ids; the ids decode to the text.

Every stage works on all rows that the one before kept; all but the last keep the columns of ``documents``.

Near copies are those of a similarity of 0.8 or more; the contract of op4_simhash (4-word shingles, 64 bits, at most four
differing) binds its query alone and finds about half of them.

Defined results, with those of the operators: null and empty texts pass through (texts without words are one group of
copies), a null text's ids are null; very long texts count whole; rows without a doc_id are never copies of others and
stay; repeated rows of a doc_id are one document, which stays or goes as a whole; ties go to the smallest doc_id as copies,
to the largest in line dedup; other columns of any names pass through all stages but the last; an empty table of
documents, labels or benchmark items gives empty results, or nothing learned or matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.llm import decontam, linededup, nearcopies, simhash, spm, toxicity
from lawmill.llm.rows import pack, unpack
from lawmill.session import checkpoint_dir
from lawmill.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(pack(docs, "text"), model)
    return unpack(scored.filter(F.col("toxicity.toxic_probability") < 0.5), docs.columns, "text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs, nearcopies.near_copy_groups)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(pack(docs, "text"), table(spark, sf_dir, "benchmark"))
    return unpack(found.filter(F.size("contamination") == 0), docs.columns, "text")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, and whether the ids read back as the text."""
    done = spm.encode_checked(docs.select("doc_id", "source", "lang", "text"), spm.load_vocabulary())
    return done.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_ids"), "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]
#: SQL can express neither the regression, the similarity groups, the spaced seeds nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps goes through Parquet in the shared folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}"
    count = getattr(run, "count", 0) + 1
    run.count = count
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}-{count}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
