"""The queries p1 to p4 and p6: the general data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from okrug.functions.registry import with_normal_inn
from okrug.operators.asof import in_force, last_known
from okrug.operators.badrows import contract_lines
from okrug.operators.nested import register_tables
from okrug.operators.snapshots import snapshot_changes
from okrug.operators.timestamps import normalise_timestamps, unread_timestamps
from okrug.plans.problem_sql import ORACLE  # noqa: F401  (read by the entry module)
from okrug.session import load, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank fact of the register files' documents, from their flat tables."""
    tables = register_tables(load(spark, sf_dir, "registry_docs"))
    doc = tables["document"]
    facts = F.array(*[F.struct(F.lit(child).alias("child"), F.col(x).alias("value")) for x, child in (("inn_legal", "inn"), ("inn_person", "inn"), ("inn", "inn"), ("district", "district"), ("okved_main", "okved_main"))])
    one = F.lit(1)
    found = doc.select("raw_id", "document_no", F.explode(facts).alias("x")).select("raw_id", F.col("document_no").alias("doc_no"), "x.child", F.lit(0).alias("parent_no"), one.alias("child_no"), "x.value")
    for name in ("okved_extra", "license", "license_activity", "product"):
        parent = F.col("license_no") if name == "license_activity" else F.lit(0)
        found = found.unionByName(tables[name].select("raw_id", F.col("document_no").alias("doc_no"), F.lit(name).alias("child"), parent.alias("parent_no"), F.col(f"{name}_no").alias("child_no"), F.col(name).alias("value")))
    return found.where(F.col("value").isNotNull())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of each readable contracts_msp_enriched.sign_date and msp_snapshot_rows.snapshot_date."""
    contracts = load(spark, sf_dir, "contracts_msp_enriched").select(F.lit("contracts_msp_enriched").alias("table_name"), "row_id", F.col("sign_date").alias("raw"), F.col("import_source_id").alias("source"))
    snapshots = load(spark, sf_dir, "msp_snapshot_rows").select(F.lit("msp_snapshot_rows").alias("table_name"), "row_id", F.col("snapshot_date").alias("raw"), F.col("source_id").alias("source"))
    found = normalise_timestamps(contracts.unionByName(snapshots), "raw", "source", load(spark, sf_dir, "sources"))
    return found.where(F.col("utc_epoch").isNotNull()).select("table_name", "row_id", "utc_epoch")


def p2_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of either table that name no instant, with the number of their rows."""
    contracts = load(spark, sf_dir, "contracts_msp_enriched").select(F.col("sign_date").alias("raw"), F.col("import_source_id").alias("source"))
    snapshots = load(spark, sf_dir, "msp_snapshot_rows").select(F.col("snapshot_date").alias("raw"), F.col("source_id").alias("source"))
    return unread_timestamps(contracts.unionByName(snapshots), "raw", "source", load(spark, sf_dir, "sources"))


def _category_class(text: Column) -> Column:
    """micro, small or medium of a freely spelt category; Latin letters that look like Cyrillic ones count as these."""
    plain = F.translate(F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))), "aceopx", "асеорх")
    return F.when(plain.startswith("микро"), "micro").when(plain.startswith("мал"), "small").when(plain.startswith("сред"), "medium")


def _snapshot_day(epoch: str) -> Column:
    """The day at UTC+5, as days since 1970."""
    return F.floor((F.col(epoch) + 5 * 3600) / 86400).cast("int")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INNs added, removed or changed in class between each two consecutive register snapshots."""
    rows = load(spark, sf_dir, "msp_snapshot_rows").select("row_id", "inn", "category", "category_code", "snapshot_date", "source_id", "received_at")
    rows = with_normal_inn(normalise_timestamps(rows, "snapshot_date", "source_id", load(spark, sf_dir, "sources")), "inn", "normal")
    code = F.trim("category_code")
    by_code = F.when(code == "1", "micro").when(code == "2", "small").when(code == "3", "medium")
    rows = rows.withColumn("class", F.coalesce(_category_class(F.col("category")), by_code)).withColumn("day", _snapshot_day("utc_epoch"))
    # an unknown class is no other class
    found = snapshot_changes(rows, "day", "normal", "class", ["received_at", "row_id"], differs=F.col("before") != F.col("after"))
    return found.select(F.col("key").alias("inn"), F.date_format(F.date_from_unix_date("snapshot"), "yyyy-MM-dd").alias("snapshot_date"), "change_kind")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contract row with the register row of its supplier that was known when it was signed."""
    contracts = load(spark, sf_dir, "contracts_msp_enriched").select(F.lit(1).alias("kind"), "row_id", F.col("supplier_inn").alias("raw_inn"), F.col("sign_date").alias("raw"), F.col("import_source_id").alias("source"), F.lit(None).cast("timestamp").alias("received_at"))
    snapshots = load(spark, sf_dir, "msp_snapshot_rows").select(F.lit(0).alias("kind"), "row_id", F.col("inn").alias("raw_inn"), F.col("snapshot_date").alias("raw"), F.col("source_id").alias("source"), "received_at")
    both = normalise_timestamps(contracts.unionByName(snapshots), "raw", "source", load(spark, sf_dir, "sources"))
    both = with_normal_inn(both.where(F.col("utc_epoch").isNotNull()), "raw_inn", "inn")
    time = F.when(F.col("kind") == 1, F.col("utc_epoch") * 1_000_000).otherwise(F.unix_micros("received_at"))
    both = written(both.select("kind", "row_id", "inn", time.alias("t"), F.when(F.col("kind") == 0, _snapshot_day("utc_epoch")).alias("day")), "contracts-and-register")
    changes = both.where("kind = 0")
    events = in_force(both.where("kind = 1 AND inn IS NOT NULL").drop("day"), changes, "t", "day", "day")
    found = last_known(events, changes, ["inn", "day"], "t", "row_id", "row_id", [])
    return found.select(F.col("event_id").alias("row_id"), F.col("change_id").alias("msp_row_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad contract lines with each of their reasons."""
    return contract_lines(load(spark, sf_dir, "contract_lines_raw").select("line_id", "line")).select("line_id", F.explode("reasons").alias("reason"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_unread": p2_unread, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found}
