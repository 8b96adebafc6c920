"""The pN_ queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vedomost.llm import canonmap, lookalike, mixture, ocrnoise, party, sentences, survivor, tokens
from vedomost.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    values = lookalike.permit_values(table(spark, d, "register_rows"), table(spark, d, "register_copy"), table(spark, d, "rns_records"))
    return lookalike.lookalike_values(values).select("tab", "row_id").distinct()


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    values = lookalike.permit_values(table(spark, d, "register_rows"), table(spark, d, "register_copy"), table(spark, d, "rns_records"))
    return lookalike.canonical_values(lookalike.lookalike_values(values))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivor_cells(survivor.permit_survivors(table(spark, d, "rns_records")))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "rns_records")
    return survivor.survivor_values(survivor.permit_survivors(records, half_life_days=180), records)


def _places(spark: SparkSession, d: str) -> DataFrame:
    return canonmap.map_places(table(spark, d, "rns_records"), table(spark, d, "district_ref"), table(spark, d, "region_ref"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("rec_id", "field", "ref_id").distinct()


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).where("ref_id = -1").groupBy("field", "value").count().withColumnRenamed("count", "n_records")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return party.linked_pairs(party.cluster_parties(table(spark, d, "party_names")))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return party.link_counts(party.cluster_parties(table(spark, d, "party_names")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ocrnoise.found_noise(table(spark, d, "ocr_lines"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocrnoise.paragraphs(table(spark, d, "ocr_lines"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    back = tokens.decode_ids(tokens.encode_documents(documents)).withColumnRenamed("text", "decoded")
    both = documents.select("doc_id", "text").join(back, "doc_id")
    return both.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_texts(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
