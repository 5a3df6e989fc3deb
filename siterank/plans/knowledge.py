"""Append-only fact store and records extracted from response text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.functions import text as tx
from siterank.operators.ordering import first_values, keep_first
from siterank.operators.tables import append_new

SOURCES_PER_RECORD = 10
TITLE_LENGTH = 90
FACTS_PER_TOPIC = 8


def as_facts(rows: DataFrame) -> DataFrame:
    """(topic, value, source, well_id, ordinal) with the content key; empty values are dropped."""
    # the first character that isn't white space ends the search, so that only kept values are stripped, once each
    return rows.where(F.col("value").rlike(r"\S")).select(
        tx.content_key("topic", "value").alias("key"), "topic", tx.strip("value").alias("value"), "source", "well_id", "ordinal"
    )


def record_facts(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Store with the new facts appended once each."""
    fresh = append_new(store, as_facts(rows), "key", "ordinal")
    return store.unionByName(fresh.select(*store.columns))


def seed_facts(regulators: DataFrame, adapters: DataFrame) -> DataFrame:
    """Facts from the regulator and intake tables."""
    none = F.lit(None).cast("string")
    a = regulators.where(F.coalesce("agency", F.lit("")) != "").select(
        F.lit("state_program").alias("topic"),
        F.concat(F.col("state"), F.lit(": "), F.col("agency"), F.lit(" — "),
                 F.coalesce("program_name", F.lit("")), F.lit(" (BIL/IIJA-funded)")).alias("value"),
        F.lit("state_regulators.csv").alias("source"), none.alias("well_id"), "ordinal",
    )
    b = adapters.where((F.coalesce("org", F.lit("")) != "") & (F.coalesce("fit", F.lit("")) != "")).select(
        F.lit("funder").alias("topic"), F.concat(F.col("org"), F.lit(" — "), F.col("fit")).alias("value"),
        F.lit("intake_adapters.csv").alias("source"), none.alias("well_id"), (F.col("ordinal") + (1 << 30)).alias("ordinal"),
    )
    return a.unionByName(b)


def harvest_facts(dossiers: DataFrame) -> DataFrame:
    """Named operators from finished records."""
    text = tx.found_text("operator_history", 180)
    return dossiers.withColumn("__t", text).where("__t is not null").select(
        F.lit("operator").alias("topic"), F.concat(F.col("well_id"), F.lit(": "), F.col("__t")).alias("value"),
        F.lit("swarm dossier").alias("source"), "well_id", "ordinal",
    )


def facts_by_topic(store: DataFrame, n: int = FACTS_PER_TOPIC) -> DataFrame:
    return keep_first(store, ["topic"], "ordinal", n)


def parse_responses(responses: DataFrame) -> DataFrame:
    """(well_id, text) to record columns."""
    return responses.withColumn("__d", tx.parse_dossier("text")).select("well_id", "__d.*")


def unique_sources(cited: DataFrame, n: int = SOURCES_PER_RECORD) -> DataFrame:
    """First ``n`` distinct urls of each record in order, titles cut to 90 characters."""
    rows = cited.where(F.coalesce("url", F.lit("")) != "").withColumn(
        "title", F.substring(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")), 1, TITLE_LENGTH)
    )
    once = keep_first(rows, ["well_id", "url"], "position").withColumn("pair", F.struct("title", "url"))
    return first_values(once, "well_id", "pair", "position", n, "sources")


def cohort_status(dossiers: DataFrame) -> DataFrame:
    return dossiers.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "complete").alias("complete"),
        F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("status") == "error").alias("failed"),
    )
