"""From raw documents to token files: five stages, each written as Parquet and read again as the next one's documents.

Quality: documents that are likely below the good grade go.  Near duplicates: of each
group the document with the smallest id stays.  Decontamination: documents that hold
a benchmark item's passage go.  Mixing: sources are repeated by their temperature
weights, every document once at least, and laid out in the mixture's order.  Output:
token ids in plane files, in that order, with a row for each document written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.llm import store
from lodequery.llm.jaccard import jaccard_groups
from lodequery.llm.mixture import mixed_documents
from lodequery.llm.phrase_index import build_index, hits, write_phrases
from lodequery.llm.planes import plane_output
from lodequery.llm.quality import quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if the probability of the good grade is below this: what is doubtful stays.
SURELY_BAD = 0.35


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the good grade is at least SURELY_BAD; the labels teach it.

    Each row is judged by its own text, null and empty ones as texts without words; null and repeated ids
    don't matter to that.  No rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs, labels, cut=SURELY_BAD, keep=[F.col(c) for c in COLUMNS])
    return scored.where("keep").select(COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key for each row, as ids may be null or repeated: its file's number and its place there.

    Rows that aren't read from files, or from files without numbers of their own, are written to the shared folder first.
    """
    try:
        place = F.shiftleft(_file_number(), 40) + F.col("_metadata.row_index")
        files = docs.select(F.col("_metadata.file_path").alias("f"), _file_number().alias("n")).distinct()
        seen = files.agg(F.count("f").alias("f"), F.countDistinct("n").alias("n"), F.max("n").alias("most")).first()
        if seen.f == seen.n and (seen.most or 0) < 1 << 23:
            return docs.select(*COLUMNS, place.alias("_key"))
    except AnalysisException:
        pass
    folder = store.new_folder(docs.sparkSession, "rows")
    docs.select(COLUMNS).write.option("maxRecordsPerFile", 0).parquet(folder)
    return docs.sparkSession.read.schema(docs.select(COLUMNS).schema).parquet(folder).select(*COLUMNS, place.alias("_key"))


def _file_number() -> Column:
    return F.regexp_extract("_metadata.file_name", r"^part-([0-9]{1,18})", 1).try_cast("long")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id; rows without words and null ids stay.

    Of rows of one id and similar texts the first in the files stays; of different texts under one id each is judged by itself.  No rows give none.
    """
    null = docs.where("doc_id is null").select(COLUMNS)
    if not _repeats(docs):
        groups = jaccard_groups(docs)
        kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
        return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(COLUMNS).unionByName(null)
    rows = _keyed(docs)
    groups = jaccard_groups(rows, id_col="_key")
    ids = rows.where("doc_id is not null").select("_key", "doc_id")
    first = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("x")).select("x._key")
    return rows.join(first, "_key", "left_semi").select(COLUMNS).unionByName(null)


def _repeats(docs: DataFrame) -> bool:
    """Whether an id comes twice."""
    return bool(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage.

    Each row is judged by its own text, whatever its id; null and empty texts hold no passage; no rows give none.
    """
    rows = _keyed(docs)
    index = build_index(rows, id_col="_key")
    blocks = write_phrases(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), f"{index}/items")
    found = hits(spark, index, blocks, id_col="_key").where("contaminated").select("_key").distinct()
    found.write.parquet(f"{index}/found")
    store.remove(f"{index}/postings")
    return rows.join(spark.read.schema(found.schema).parquet(f"{index}/found"), "_key", "left_anti").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mixture draws it, in the mixture's order: blocks, each a small copy of the mixture.

    Every document is drawn once at least.  Null and empty texts take no budget and lie where they fall; a null
    source is a source; rows of null or equal ids are documents of their own; no rows give none.
    """
    return mixed_documents(docs.select(COLUMNS)).select(COLUMNS)


def token_planes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold: doc_id, start, n_tokens, ids_crc32 of each document written.

    Documents are written in the order in which the files of docs hold them, which is the mixture's; those of a
    table that isn't read from files in the order in which it is read.  Null and empty texts are the end id
    alone; null and repeated ids are written as they are; no rows give none.
    """
    return plane_output(_numbered(docs), public_tokenizers.path("byte_bpe_50k.json"), order=[F.col("_file"), F.col("_place")])


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with where each row lies: the number of its file, then its place there."""
    try:
        return docs.select("doc_id", "text", _file_number().alias("_file"), F.struct("_metadata.file_name", "_metadata.row_index").alias("_place"))
    except AnalysisException:  # not read from files
        return docs.select("doc_id", "text", F.lit(0).alias("_file"), F.monotonically_increasing_id().alias("_place"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_planes", token_planes),
]

#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the last one's rows."""
    folder = store.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}-{name}")
    return docs
