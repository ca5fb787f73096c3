"""Queries of data quality and of the dashboard's read-only questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from okrug.functions.registry import inn_valid, with_normal_inn
from okrug.operators import panel as P
from okrug.operators import quality as C
from okrug.operators.timestamps import normalise_timestamps
from okrug.plans.base import K, contracts, r, registry
from okrug.plans.problem_sql import VALID
from okrug.session import load, small

QUERIES, ORACLE, query = registry()

CHECKED = """SELECT 'sources known' AS "check", count(*) FILTER (source_id NOT IN (SELECT source_id FROM sources)) AS bad, count(source_id) AS total FROM msp_snapshot_rows
 UNION ALL SELECT 'row ids unique', count(*) FILTER (n > 1), count(*) FROM (SELECT count(*) AS n FROM msp_snapshot_rows GROUP BY row_id)
 UNION ALL SELECT 'negative prices', count(*) FILTER (price_kopecks < 0), count(*) FROM atmo_contract_observations
 UNION ALL SELECT 'one version an observation', count(*) FILTER (v > 1), count(*) FROM (SELECT count(DISTINCT coalesce(status_code, '-')) AS v FROM atmo_contract_observations GROUP BY api_contract_id)
 UNION ALL SELECT 'enrichment keeps rows', abs((SELECT count(*) FROM contracts_msp_enriched) - (SELECT count(*) FROM contracts_msp_enriched k LEFT JOIN sources ON source_id = import_source_id)), (SELECT count(*) FROM contracts_msp_enriched)"""


@query(f'SELECT "check", CAST(bad AS BIGINT) AS bad, CAST(total AS BIGINT) AS total, CASE WHEN bad = 0 THEN \'PASS\' ELSE \'FAIL\' END AS verdict FROM ({CHECKED})')
def k_quality_report(spark, sf):
    s, a, k = (load(spark, sf, t) for t in ("msp_snapshot_rows", "atmo_contract_observations", "contracts_msp_enriched"))
    sources = load(spark, sf, "sources")
    joined = k.join(small(sources.select(F.col("source_id").alias("import_source_id"), "role")), "import_source_id", "left")
    return C.report([
        C.orphans(s, "sources known", "source_id", sources, "source_id"),
        C.repeated_keys(s, "row ids unique", ["row_id"]),
        C.rows_that(a, "negative prices", F.col("price_kopecks") < 0),
        C.conflicting(a.withColumn("st", F.coalesce("status_code", F.lit("-"))), "one version an observation", ["api_contract_id"], ["st"]),
        C.same_count(k, joined, "enrichment keeps rows"),
    ])


@query("""SELECT snapshot_date, count(DISTINCT inn) AS inns, count(*) AS n, CAST(sum(inn_checksum_valid) AS BIGINT) AS declared_valid FROM msp_snapshot_rows GROUP BY 1""")
def k2_snapshot_counts(spark, sf):
    return load(spark, sf, "msp_snapshot_rows").groupBy("snapshot_date").agg(F.countDistinct("inn").alias("inns"), F.count(F.lit(1)).alias("n"), F.sum("inn_checksum_valid").alias("declared_valid"))


@query(f"SELECT inn_checksum_valid, count(*) AS n FROM (SELECT *, inn AS f FROM msp_snapshot_rows) WHERE CAST({VALID} AS INT) <> inn_checksum_valid GROUP BY 1")
def k3_checksum_disagreements(spark, sf):
    """Rows whose stored checksum verdict isn't that of the number as it stands."""
    s = load(spark, sf, "msp_snapshot_rows")
    return s.where(inn_valid(F.col("inn")).cast("int") != F.col("inn_checksum_valid")).groupBy("inn_checksum_valid").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT doc_kind, lang, mo_id, n_chars FROM documents), p AS (SELECT count(*) FILTER (lang = 'ru') AS pass_lang, count(*) FILTER (n_chars > 500) AS pass_long, count(*) FILTER (mo_id IS NOT NULL) AS has_place, count(*) FILTER (mo_id IS NULL) AS no_place, count(*) FILTER (lang = 'ru' AND n_chars > 500 AND mo_id IS NULL) AS lost_by_missing FROM x) SELECT * FROM p""")
def u2_selectivity(spark, sf):
    d = load(spark, sf, "documents")
    c = {"pass_lang": F.col("lang") == "ru", "pass_long": F.col("n_chars") > 500, "has_place": F.col("mo_id").isNotNull(), "no_place": F.col("mo_id").isNull(), "lost_by_missing": (F.col("lang") == "ru") & (F.col("n_chars") > 500) & F.col("mo_id").isNull()}
    return d.agg(*[F.count_if(x).alias(n) for n, x in c.items()])


@query("""SELECT kind, mo_id, name, CAST(row_number() OVER (PARTITION BY kind ORDER BY name, place_id) AS INT) AS place, count(*) OVER (PARTITION BY kind) AS k FROM place_refs WHERE contains(replace(lower(name), 'ё', 'е'), 'зул')""")
def u1_search_list(spark, sf):
    from pyspark.sql import Window

    p = load(spark, sf, "place_refs").where(F.contains(F.replace(F.lower("name"), F.lit("ё"), F.lit("е")), F.lit("зул")))
    w = Window.partitionBy("kind")
    return p.select("kind", "mo_id", "name", F.row_number().over(w.orderBy("name", "place_id")).alias("place"), F.count(F.lit(1)).over(w).alias("k"))


@query("""SELECT doc_kind AS topic, count(DISTINCT mo_id) AS entities, round(count(DISTINCT mo_id) / (SELECT count(DISTINCT mo_id) FROM documents), 6) AS share FROM documents GROUP BY 1""")
def u4_topic_index(spark, sf):
    d = load(spark, sf, "documents")
    n = d.agg(F.countDistinct("mo_id").alias("n"))
    return d.groupBy(F.col("doc_kind").alias("topic")).agg(F.countDistinct("mo_id").alias("entities")).join(F.broadcast(n)).select("topic", "entities", F.round(F.col("entities") / F.col("n"), 6).alias("share"))


@query(f"""WITH {K}, m AS (SELECT customer_mo AS mo, sum(price) AS v FROM k GROUP BY 1) SELECT n_nationkey AS mo, round(v, 2) AS v, CAST(rank() OVER (ORDER BY v DESC NULLS LAST) AS INT) AS place FROM nation LEFT JOIN m ON mo = n_nationkey""")
def u8_ranking(spark, sf):
    from pyspark.sql import Window

    m = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo")).agg(F.sum("price").alias("v"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("mo"))
    # one row an entity: the unpartitioned window is small by definition
    return n.join(m, "mo", "left").select("mo", r("v", 2), F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())).alias("place"))


@query("""SELECT c_nationkey AS mo, round(median(c_acctbal), 4) AS own, (SELECT round(median(c_acctbal), 4) FROM customer) AS whole, count(*) AS n, count(c_acctbal) AS present FROM customer GROUP BY 1""")
def u10_entity_card(spark, sf):
    c = load(spark, sf, "customer")
    whole = c.agg(F.round(F.median("c_acctbal"), 4).alias("whole"))
    return c.groupBy(F.col("c_nationkey").alias("mo")).agg(F.round(F.median("c_acctbal"), 4).alias("own"), F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("present")).join(F.broadcast(whole))


@query("""WITH m AS (SELECT c_nationkey AS mo, avg(c_acctbal) AS v FROM customer GROUP BY 1), p AS (SELECT mo, rank() OVER (ORDER BY v) / (SELECT count(*) FROM m) * 100 AS p FROM m) SELECT a.mo AS a, b.mo AS b, round(a.p - b.p, 4) AS delta, CASE WHEN abs(a.p - b.p) <= 5 THEN 'same' WHEN a.p > b.p THEN 'better' ELSE 'worse' END AS verdict FROM p a JOIN p b ON a.mo < b.mo""")
def u13_comparison(spark, sf):
    from okrug.operators.network import pairs_of

    m = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("mo")).agg(F.avg("c_acctbal").alias("v"))
    p = P.rank_percent(m.withColumn("all", F.lit(1)), ["all"], "v", "p")
    d = F.col("p_i") - F.col("p_j")
    return pairs_of(p, "mo", ["p"]).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round(d, 4).alias("delta"), F.when(F.abs(d) <= 5, "same").when(d > 0, "better").otherwise("worse").alias("verdict"))


@query("""WITH d AS (SELECT customer_inn, count(*) AS n FROM contracts_msp_enriched WHERE customer_inn IS NOT NULL GROUP BY 1) SELECT substr(sign_date, 1, 7) AS month, law, count(*) AS contracts, CAST(sum(amount_cents) AS BIGINT) AS cents FROM contracts_msp_enriched WHERE sign_date LIKE '____-__-__' AND customer_inn IN (SELECT customer_inn FROM d WHERE n > 3) GROUP BY 1, 2""")
def s16_example_queries(spark, sf):
    load(spark, sf, "contracts_msp_enriched").createOrReplaceTempView("okrug_contracts")
    return spark.sql("""SELECT substr(sign_date, 1, 7) AS month, law, count(*) AS contracts, sum(amount_cents) AS cents FROM okrug_contracts
        WHERE sign_date LIKE '____-__-__' AND customer_inn IN (SELECT customer_inn FROM okrug_contracts WHERE customer_inn IS NOT NULL GROUP BY customer_inn HAVING count(*) > 3) GROUP BY 1, 2""")


@query()
def s16_example_queries_all(spark, sf):
    """s16_example_queries over every contract row whose sign_date can be read, by its month at UTC+5 and normal customer INNs."""
    k = load(spark, sf, "contracts_msp_enriched").select("sign_date", "import_source_id", "law", "amount_cents", "customer_inn")
    k = with_normal_inn(normalise_timestamps(k, "sign_date", "import_source_id", load(spark, sf, "sources")), "customer_inn", "normal")
    often = k.where("normal IS NOT NULL").groupBy("normal").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("normal")
    month = F.date_format(F.timestamp_seconds(F.col("utc_epoch") + 5 * 3600), "yyyy-MM")
    return k.where("utc_epoch IS NOT NULL").join(often, "normal", "left_semi").groupBy(month.alias("month"), "law").agg(F.count(F.lit(1)).alias("contracts"), F.sum("amount_cents").alias("cents"))
