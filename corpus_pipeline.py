"""A training corpus from raw documents: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, lang_id, mixing, near_dedup, training_order
from quarry.llm.common import Scratch, free_name, number_rows, passing, table, without_keys
from quarry.llm.queries import byte_codec


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, and that column's name."""
    row = free_name(docs.columns, "row")
    return number_rows(spark, docs, row), row


def _without(spark: SparkSession, rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """rows without those numbered in `dropped`, and without the number."""
    ids = Scratch(spark, "dropped").keep(dropped.select(row), "ids")
    return without_keys(rows, row, ids, ids.count()).drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go: null, empty and letterless texts.

    Every other row stays as it is, whole and in all its columns, whatever its label, null or repeated id, or length.
    Where no language can be learned (no label outside the held-out part, or an empty table), all lettered rows stay.
    Columns beyond those of documents stay, whatever their names.
    """
    words = lang_id.sample_words(docs, "doc_id", "text", "lang")
    net = lang_id.train(words) if any(words.values()) else None
    if net is None:
        return lang_id.lettered(spark, docs)
    label, score = (free_name(docs.columns, x) for x in ("lang_pred", "score"))
    judged = lang_id.predict(spark, docs, net, "text", label, score)
    return judged.where(F.col(label) != lang_id.UNKNOWN).select([F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates stays.

    Of a group's rows that share the smallest id one stays; a null id comes last. Null and empty texts are nobody's
    duplicates and stay, repeated or not. Whole texts are compared, however long. An empty table stays empty;
    columns beyond those of documents stay, whatever their names.
    """
    rows, row = _numbered(spark, docs)
    number = F.col(row)
    groups = near_dedup.near_duplicates(spark, rows.select(number.alias("n"), "text"), id_col="n").select("n", F.col("component_id").alias("grp"))
    member = groups.join(rows.select(number.alias("n"), F.col("doc_id").alias("id")), "n")
    first = member.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("m")).select("m.n")
    return _without(spark, rows, row, groups.select("n").join(first, "n", "left_anti").select(F.col("n").alias(row)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold too much of a benchmark item go, each judged by its own whole text.

    Null, empty and wordless texts hold nothing and stay; null and repeated ids make no difference. An empty table of
    documents or items drops nothing. Columns beyond those of documents stay, whatever their names.
    """
    rows, row = _numbered(spark, docs)
    judged = decontam.judge(spark, rows.select(F.col(row).alias("n"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), "n")
    return _without(spark, rows, row, judged.where("contaminated").select(F.col("n").alias(row)))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: some several times, some not at all.

    A null source is a source of its own; rows without words are of no weight and are taken like
    the others of their block. Rows that share an id, or have none, are taken or left together. Sources without words, and an empty table, give no
    rows. Columns beyond those of documents stay, whatever their names.
    """
    plan, _ = mixing.plan_mix(spark, docs)
    return plan.realise(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order, and their index, one row a sequence.

    Every row is written, repeated ones each, texts of any length whole; a null or empty text is an end mark alone. Null
    ids stay null. An empty table writes no shard and gives no rows. Other columns are not written.
    """
    index = training_order.materialise(spark, docs.select("doc_id", "text"), Scratch(spark, "shards", lasting=True).base, byte_codec())
    first = F.get("spans", F.lit(0))
    return index.select("slot", "shard", "row", "byte_offset", "n_tokens", "n_docs", first["doc_id"].alias("first_doc_id"), "ids_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("token_output", token_output),
]

# Trained and sketched stages have no SQL; the tests compare each stage with a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again by the next; what a stage wrote on its way is
    deleted once its rows are written."""
    scratch = Scratch(spark, "pipeline", lasting=True)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
