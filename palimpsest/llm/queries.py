"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import conversations, encodings, near_duplicates, neighbours, packing, private_details, splitting, tokens
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.broken_sessions(table(spark, d, "transcript_entry"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "transcript_entry"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_table(table(spark, d, "archive_result"), "archive_id", "full_content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # A text over the limit is one that came out as more than one piece.
    return p3_pieces(spark, d).where("piece_no = 2").select("archive_id")


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Of every archive: are its pieces within the limit, does each begin with the end of
    the one before, and do their bodies give the text back?"""
    raw = F.encode("piece", "utf-8")
    body = F.substring(raw, F.col("body_start") - F.col("start_byte") + 1, F.col("end_byte") - F.col("body_start"))
    overlap = F.col("body_start") - F.col("start_byte")
    good = F.octet_length("piece") <= splitting.LIMIT
    laps = F.when(F.col("piece_no") == 1, overlap == 0).otherwise(overlap.between(splitting.OVERLAP - 3, splitting.OVERLAP))
    pieces = p3_pieces(spark, d).select("archive_id", "piece_no", good.alias("good"), laps.alias("laps"), F.decode(body, "utf-8").alias("body"))
    joined = pieces.groupBy("archive_id").agg(
        F.min("good").alias("within_limit"), F.min("laps").alias("overlaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "body"))), lambda p: p["body"]), "").alias("whole"),
    )  # the pieces of one text, so no more than the text itself
    texts = table(spark, d, "archive_result").select("archive_id", "full_content")
    return joined.join(texts, "archive_id").select("archive_id", "within_limit", "overlaps", (F.col("whole") == F.col("full_content")).alias("rejoined"))


_TEXTS = (("transcript_entry", "entry_id", "content"), ("entity", "entity_id", "content"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lexicon = table(spark, d, "name_lexicon")
    one, two = (private_details.found_kinds(table(spark, d, t), lexicon, k, c, t) for t, k, c in _TEXTS)
    return one.unionByName(two)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    lexicon = table(spark, d, "name_lexicon")
    one, two = (private_details.redact_table(table(spark, d, t), lexicon, k, c, t) for t, k, c in _TEXTS)
    return one.unionByName(two)


def _described(spark: SparkSession, d: str) -> tuple[DataFrame, F.Column]:
    entities = table(spark, d, "entity").select("entity_id", "name", "abstract_text").where(r"abstract_text rlike '(?U)\\S'")
    return entities, F.concat_ws(" ", F.coalesce("name", F.lit("")), "abstract_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    entities, text = _described(spark, d)
    return near_duplicates.similar_pairs(entities, "entity_id", text, 0.6).select(
        F.col("key_1").alias("entity_id_1"), F.col("key_2").alias("entity_id_2")
    )


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    entities, text = _described(spark, d)
    return near_duplicates.similar_groups(entities, "entity_id", text, 0.6).withColumnRenamed("key", "entity_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "entity"), "entity_id", "embedding").select(
        F.col("key_1").alias("entity_id_1"), F.col("key_2").alias("entity_id_2")
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_table(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_table(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack_table(sizes, "doc_id", "n_tokens").withColumnsRenamed({"first_unit": "first_token", "n_units": "n_tokens"})


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of every document with a text: are all its tokens in containers that hold no more
    than they can, and is it whole unless it is longer than one?"""
    containers = materialize(p8_containers(spark, d), "containers")
    loads = containers.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    spans = containers.join(loads, "container").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("held"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"), F.count("*").alias("pieces"), F.max("load").alias("load")
    )
    sizes = tokens.count_table(table(spark, d, "documents"), "doc_id", "text").where("n_tokens > 0")
    full = packing.CAPACITY
    return sizes.join(spans, "doc_id", "left").select(
        "doc_id", F.coalesce((F.col("held") == F.col("n_tokens")) & (F.col("last") == F.col("n_tokens")), F.lit(False)).alias("covered"),
        (F.col("load") <= full).alias("fits"), (F.col("pieces") > F.ceil(F.col("n_tokens") / F.lit(full))).alias("needless"),
    )


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repair_table(table(spark, d, "documents"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repair_table(table(spark, d, "documents"), "doc_id", "text", "lang", with_text=False).where("garbled").select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p3_found, p3_pieces, p3_rejoined, p4_found, p4_redacted, p5_found, p5_groups, p6_found, p7_ids,
        p8_containers, p8_checked, p9_found, p9_restored,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
