"""The registered queries of this subpackage: problems 3, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, table
from .canonical import learned_wordings, map_to_list
from .language import label_languages
from .mixing import mix
from .packing import fill_report, pack
from .tokens import with_tokens


def _typed(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "event_file").select(F.lit("event_file").alias("src"), F.col("event_id").alias("row_key"), F.col("event").alias("value"))
    config = table(spark, d, "batch_config").select(F.lit("batch_config").alias("src"), F.col("config_id").alias("row_key"), F.col("behaviour").alias("value"))
    labels = table(spark, d, "behaviour_list").select(F.col("label").alias("value"))
    return events.unionByName(config).where("value is not null").join(labels, "value", "left_anti")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "behaviour_list").select(F.col("behaviour_id").alias("id"), "label")


def _by_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each different text of events and configurations, clean ones too, with the entry the similarity join finds."""
    events = table(spark, d, "event_file").select(F.col("event").alias("value"))
    config = table(spark, d, "batch_config").select(F.col("behaviour").alias("value"))
    return map_to_list(events.unionByName(config), _labels(spark, d))


def _wordings(spark: SparkSession, d: str, mapped: DataFrame) -> DataFrame:
    whole = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c.replace("_s", "_at"))
    source = F.struct("recording_id", "file_no").alias("source")
    bouts = table(spark, d, "event_file").where("event is not null").select(F.col("event_id").alias("row_key"), source, whole("start_s"), whole("end_s"), F.col("event").alias("value"))
    return learned_wordings(bouts, mapped)


def p3_wordings(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand for an entry though no edit distance tells, as learned from the bouts beside them."""
    return _wordings(spark, d, _by_edits(spark, d))


def p3_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Each different text with its entry, and those without one: first by edits from the entries, then,
    for texts without one, by edits from the learned wordings."""
    first = _by_edits(spark, d)
    wordings = durable(_wordings(spark, d, first))
    second = map_to_list(first.where("status = 'unmatched'"), _labels(spark, d).limit(0), wordings)
    mapped = first.where("status = 'matched'").unionByName(second)
    return mapped.join(_labels(spark, d).select(F.col("label").alias("value")), "value", "left_anti")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    mapped = p3_mapping(spark, d).select("value", "id")
    rows = _typed(spark, d).join(mapped, "value", "left")
    return rows.select("src", F.col("row_key").cast("bigint").alias("row_key"), F.coalesce("id", F.lit(0)).cast("int").alias("behaviour_id"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return pack(with_tokens(documents, ["doc_id"]), table(spark, d, "pack_sizes"), documents.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_packing(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(with_tokens(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(with_tokens(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))[1]


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return label_languages(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p10_languages(spark, d).where("lang is not null and (cue_no > 0 or label is distinct from lang)")
    return rows.select("doc_id", "cue_no", "lang")


QUERIES = {f.__name__: f for f in (p3_found, p3_mapping, p3_wordings, p8_packing, p8_fill, p9_mixture, p9_shares, p10_found, p10_languages)}
ORACLE: dict[str, str] = {}
