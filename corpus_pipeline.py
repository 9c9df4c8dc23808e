"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and
returns the documents that it keeps, but the last, which returns where every piece
of every document is packed. Tables beside docs are read from sf_dir. Stages that take texts to Python limit
the session's Arrow batches, as Spark reads that setting only when their rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import classifier, decontaminate, jaccard_join, packing, quality_rules
from spanforge.llm.batches import BATCH, small_batches
from spanforge.llm.storage import if_small, materialise


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under names that clash with none, and these by the columns' own names."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't reject.

    A null or empty text gets the score of no words; each row, repeated or without doc_id, is judged by its own text. Without
    labelled rows every score is 0.5, which keeps all. Other columns, whatever their names, come through; an empty table stays empty.
    """
    small_batches(spark)
    weights = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, names = _numbered(docs)
    scored = classifier.score(rows, weights, text=names["text"], keep=rows.columns)
    return scored.filter("predicted = 1").select(rows.columns).toDF(*docs.columns)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the references come from docs.

    A null, empty or blank text has no words and goes, however long others are. A null language, or one with few words, is held against all
    documents. Repeated rows fare alike; other columns come through whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    rows, names = _numbered(docs)
    judged = quality_rules.judge(rows, text=names["text"], lang=names["lang"], keep=rows.columns)
    return judged.filter("kept").select(rows.columns).toDF(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id.

    Documents without words (null, empty, blank) are in no group and stay, as do rows without doc_id.
    Rows that repeat a doc_id stay or go together. Other columns come through; an empty table stays empty.
    """
    small_batches(spark)
    found = jaccard_join.similar_components(docs)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(if_small(materialise(gone, "gone")), "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Each row is judged by its own text, whatever its doc_id; a null or empty text stays. Items without id or text, or under 8 words, are
    not looked for. Other columns come through; an empty table stays empty.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    A null or empty text is one piece, the end id alone; texts over 4096 ids are cut. Each row is packed, repeated or not; null ids come
    first among pieces of one length. Other columns are left out; an empty table gives no rows.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written to the shared folder before the next reads them.

    The stages' limit on batches ends with them: texts have been to Python by then.
    """
    docs, limited = spark.read.parquet(f"{sf_dir}/documents.parquet"), BATCH in spark.conf.getAll
    try:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        if not limited:
            spark.conf.unset(BATCH)
