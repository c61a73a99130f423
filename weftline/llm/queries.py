"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import canonical, entities, leakage, splitting, tokenizer, vector_neighbours, visual_form
from weftline.plans.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return vector_neighbours.neighbour_pairs(read_table(spark, sf, "embedding_datum"), "datum_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_sections(read_table(spark, sf, "sections")).where("piece_no = 1").select("section_id")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_sections(read_table(spark, sf, "sections"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("type_guess")
    loose = read_table(spark, sf, "unresolved").where(kind.isNull() | ~kind.isin("person", "organisation"))
    return canonical.map_to_canonical(loose, read_table(spark, sf, "suggestions"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return entities.node_names(read_table(spark, sf, "nodes")).unionByName(entities.loose_names(read_table(spark, sf, "unresolved")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_pairs(_names(spark, sf))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_groups(_names(spark, sf))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_corpus(read_table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual_form.lookalike_pairs(read_table(spark, sf, "documents"))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    return visual_form.visual_form(read_table(spark, sf, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_pieces, p3_found, p4_found, p4_groups, p6_ids, p7_found, p8_found, p8_forms)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT section_id FROM sections WHERE length(body) > 2000",
    }
