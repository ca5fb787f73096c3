"""The queries p5 and p7 to p10 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from okrug.llm.binpack import pack_documents
from okrug.llm.canonical import map_to_canon
from okrug.llm.contamination import leaked_passages
from okrug.llm.entity_match import attributes, match_cascade
from okrug.llm.split import split_documents
from okrug.llm.tokens import token_count
from okrug.operators.badrows import amount_value, stripped
from okrug.operators.timestamps import normalise_timestamps
from okrug.session import load


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple[int, int, int]]:
    """text_limits is a table of a few settings."""
    rows = load(spark, sf_dir, "text_limits").where((F.col("purpose") == purpose) & F.col("max_tokens").isNotNull()).orderBy("limit_id").take(1001)
    if len(rows) > 1000:
        raise ValueError("text_limits is meant to hold a few settings")
    return [(r["limit_id"], r["max_tokens"], r["overlap_tokens"] or 0) for r in rows]


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register's contract that each observation shows, with the rule that found it and its confidence."""
    contracts = load(spark, sf_dir, "contracts_msp_enriched").select("canonical_contract_id", "contract_number", "sign_date", "import_source_id", "amount", "amount_cents", "customer", "subject", "supplier", "supplier_inn").where(F.col("canonical_contract_id").isNotNull())
    contracts = normalise_timestamps(contracts, "sign_date", "import_source_id", load(spark, sf_dir, "sources"))
    cents = F.coalesce(F.col("amount_cents"), (amount_value(stripped(F.col("amount"))) * 100).cast("bigint"))
    register = attributes(contracts, "canonical_contract_id", "contract_number", cents, "utc_epoch", "customer", "subject", "supplier", "supplier_inn")
    seen = load(spark, sf_dir, "atmo_contract_observations").withColumn("utc_epoch", F.unix_seconds(F.try_to_timestamp("contract_at_utc")))
    observations = attributes(seen, "row_id", "registration_number", F.col("price_kopecks"), "utc_epoch", "customer_name", "subject", "supplier_name", "supplier_inn")
    return match_cascade(observations, register).select(F.col("id").alias("atmo_row_id"), F.col("match").alias("canonical_contract_id"), "rule", "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of observation and contract that show the same contract."""
    return p5_matches(spark, sf_dir).select("atmo_row_id", "canonical_contract_id")


PLACE_FIELDS = {"district_raw": "district", "city_raw": "city", "locality_raw": "locality"}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of place_refs that each typed district, city or locality means."""
    return map_to_canon(load(spark, sf_dir, "msp_snapshot_rows"), "row_id", PLACE_FIELDS, load(spark, sf_dir, "place_refs"), context="district_raw").select("row_id", "field", "place_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's containers and places in them, for each limit of purpose `pack`."""
    sizes = load(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    return pack_documents(sizes, [(limit, most) for limit, most, _ in _limits(spark, sf_dir, "pack")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold 12 or more consecutive words of an evaluation item, with each such item."""
    return leaked_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a limit of purpose `split` divides."""
    return p10_pieces(spark, sf_dir).where("piece_no = 1").select("limit_id", "doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves."""
    return split_documents(load(spark, sf_dir, "documents"), _limits(spark, sf_dir, "split"))


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches, "p7_found": p7_found, "p8_containers": p8_containers, "p9_found": p9_found, "p10_found": p10_found, "p10_pieces": p10_pieces}

PLAIN = r"regexp_extract_all(translate(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g')), 'ёaceopx', 'еасеорх'), '[\p{L}\p{N}]+')"
RUNS = "SELECT {0}, list_slice(w, k, k + 11) AS run FROM (SELECT {0}, w, unnest(generate_series(1, len(w) - 11)) AS k FROM (SELECT {0}, " + PLAIN + " AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
ORACLE = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({RUNS.replace('{0}', 'doc_id').replace('{1}', 'documents')}) d JOIN ({RUNS.replace('{0}', 'item_id').replace('{1}', 'eval_items')}) i ON d.run = i.run",
    "p10_found": r"SELECT limit_id, doc_id FROM documents JOIN text_limits ON purpose = 'split' WHERE len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+')) > max_tokens",
}
