"""Relational queries: filters, joins, grouped aggregates, windows, sets and scalar functions over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from okrug.functions.registry import inn_valid, with_normal_inn
from okrug.operators import panel as P
from okrug.operators.timestamps import normalise_timestamps
from okrug.plans.base import K, contracts, r, registry
from okrug.session import load, small

QUERIES, ORACLE, query = registry()
QTR = "CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR)"


# --- aggregates -------------------------------------------------------------------------------------------------------------
@query(f"""WITH {K} SELECT customer_mo AS mo, {QTR} AS period, round(sum(price), 2) AS volume, round(sum(CASE WHEN single_supplier THEN price ELSE 0 END), 2) AS single_volume,
 round(sum(CASE WHEN customer_mo = supplier_mo THEN price ELSE 0 END), 2) AS local_volume, round(sum(CASE WHEN segment = 'MACHINERY' AND customer_mo = 0 THEN 0 ELSE price END), 2) AS municipal_volume, count(*) AS n FROM k GROUP BY 1, 2""")
def a1_panel_sums(spark, sf):
    k = contracts(spark, sf).withColumn("period", P.period("d", "Q")).withColumnRenamed("customer_mo", "mo")
    return P.masked_sums(k, ["mo", "period"], "price", {"volume": F.lit(True), "single_volume": F.col("single_supplier"), "local_volume": F.col("mo") == F.col("supplier_mo"), "municipal_volume": ~((F.col("segment") == "MACHINERY") & (F.col("mo") == 0))}, count="n").select("mo", "period", *[r(c, 2) for c in ("volume", "single_volume", "local_volume", "municipal_volume")], "n")


@query(f"WITH {K}, p AS (SELECT customer_mo AS mo, {QTR} AS period, sum(price) AS v FROM k GROUP BY 1, 2) SELECT mo, round(avg(v), 2) AS mean_volume, count(*) AS periods FROM p GROUP BY 1")
def a2_panel_mean(spark, sf):
    p = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo"), P.period("d", "Q").alias("period")).agg(F.sum("price").alias("v"))
    return p.groupBy("mo").agg(F.round(F.avg("v"), 2).alias("mean_volume"), F.count(F.lit(1)).alias("periods"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
@query(f"""WITH {K}, p AS (SELECT customer_mo AS mo, sum(price) AS total, {', '.join(f"coalesce(sum(price) FILTER (segment = '{s}'), 0) AS {s}" for s in SEGMENTS[:3])} FROM k GROUP BY 1)
 SELECT mo, {', '.join(f'round({s} / total, 6) AS sh_{s}' for s in SEGMENTS[:3])}, round(1 - {' - '.join(f'{s} / total' for s in SEGMENTS[:3])}, 6) AS sh_other FROM p""")
def a3_pivot_shares(spark, sf):
    k = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo"))
    wide = k.pivot("segment", SEGMENTS).agg(F.sum("price")).fillna(0.0)
    wide = wide.withColumn("total", sum((F.col(s) for s in SEGMENTS[1:]), F.col(SEGMENTS[0])))
    return P.shares_with_rest(wide, "total", SEGMENTS[:3]).select("mo", *[r(f"sh_{s}", 6) for s in SEGMENTS[:3]], r("sh_other", 6))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def a4_position_weight(spark, sf):
    return P.group_share(load(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "weight").select("l_orderkey", "l_linenumber", r("weight", 6))


@query(f"WITH {K} SELECT customer_mo AS mo, round(sum(price) FILTER (single_supplier) / nullif(sum(price), 0), 6) AS single_share, round(sum(price) / nullif(sum(qty), 0), 6) AS unit_price FROM k GROUP BY 1")
def a5_ratio_of_sums(spark, sf):
    g = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo")).agg(F.sum("price").alias("v"), F.sum("qty").alias("q"), F.sum(F.when(F.col("single_supplier"), F.col("price"))).alias("s"))
    return g.select("mo", F.round(P.ratio(F.col("s"), F.col("v")), 6).alias("single_share"), F.round(P.ratio(F.col("v"), F.col("q")), 6).alias("unit_price"))


@query(f"""WITH {K}, b AS (SELECT k.*, substr(p_brand, 7, 1) AS g FROM k JOIN part ON partkey = p_partkey) SELECT customer_mo AS mo, {', '.join(f"round(coalesce(sum(price) FILTER (g IN ('{i}')), 0) / sum(price), 6) AS code_{i}" for i in range(1, 6))} FROM b GROUP BY 1""")
def a6_code_group_shares(spark, sf):
    b = contracts(spark, sf).join(load(spark, sf, "part"), F.col("partkey") == F.col("p_partkey")).withColumn("g", F.substring("p_brand", 7, 1))
    return b.groupBy(F.col("customer_mo").alias("mo")).agg(*[F.round(F.coalesce(F.sum(F.when(F.col("g").isin(str(i)), F.col("price"))), F.lit(0.0)) / F.sum("price"), 6).alias(f"code_{i}") for i in range(1, 6)])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def a7_value_counts(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT inn, count(*) AS n, count(DISTINCT category) AS versions, min(name) AS name_min, max(name) AS name_max FROM msp_snapshot_rows WHERE inn IN (SELECT inn FROM msp_snapshot_rows GROUP BY inn HAVING count(DISTINCT category) > 1) GROUP BY 1")
def a9_having_semi(spark, sf):
    s = load(spark, sf, "msp_snapshot_rows")
    many = s.groupBy("inn").agg(F.countDistinct("category").alias("c")).where("c > 1").select("inn")
    return s.join(many, "inn", "left_semi").groupBy("inn").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("versions"), F.min("name").alias("name_min"), F.max("name").alias("name_max"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(round(CAST(o_totalprice AS DECIMAL(20, 6)) * 100, 0) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY 1")
def a11_month_cents(spark, sf):
    cents = F.round(F.col("o_totalprice").cast("decimal(20,6)") * 100, 0).cast("bigint")
    return load(spark, sf, "orders").groupBy(P.period("o_orderdate", "M").alias("month")).agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))


@query("""SELECT substr(loaded_at::VARCHAR, 1, 4) AS year, processing_group, law, currency, financial_status, count(*) AS contracts, count(*) FILTER (financial_status = 'known') AS known,
 CAST(coalesce(sum(amount_cents) FILTER (financial_status = 'known'), 0) AS BIGINT) AS cents FROM contracts_msp_enriched GROUP BY 1, 2, 3, 4, 5""")
def a13_summary_cube(spark, sf):
    k = load(spark, sf, "contracts_msp_enriched")
    known = F.col("financial_status") == "known"
    return k.groupBy(F.date_format("loaded_at", "yyyy").alias("year"), "processing_group", "law", "currency", "financial_status").agg(F.count(F.lit(1)).alias("contracts"), F.count_if(known).alias("known"), F.coalesce(F.sum(F.when(known, F.col("amount_cents"))), F.lit(0)).alias("cents"))


@query("SELECT law, currency, grouping_id(law, currency) AS g, count(*) AS n FROM contracts_msp_enriched GROUP BY CUBE (law, currency)")
def a28_cube(spark, sf):
    return load(spark, sf, "contracts_msp_enriched").cube("law", "currency").agg(F.grouping_id().cast("bigint").alias("g"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {K}, f AS (SELECT supplier_mo AS mo, customer_mo AS to_mo, sum(price) AS v FROM k WHERE supplier_mo <> customer_mo GROUP BY 1, 2) SELECT mo, count(DISTINCT to_mo) AS reach, round(count(DISTINCT to_mo) / (SELECT count(*) - 1.0 FROM nation), 6) AS reach_share FROM f WHERE v >= 100000 GROUP BY 1")
def a15_supply_reach(spark, sf):
    f = contracts(spark, sf).where("supplier_mo <> customer_mo").groupBy(F.col("supplier_mo").alias("mo"), "customer_mo").agg(F.sum("price").alias("v")).where("v >= 100000")
    n = load(spark, sf, "nation").agg((F.count(F.lit(1)) - 1).alias("n"))
    return f.groupBy("mo").agg(F.countDistinct("customer_mo").alias("reach")).join(F.broadcast(n)).select("mo", "reach", F.round(F.col("reach") / F.col("n"), 6).alias("reach_share"))


@query("SELECT c_nationkey AS mo, round(median(c_acctbal), 4) AS med, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS iqr FROM customer GROUP BY 1")
def a16_medians(spark, sf):
    q = P.quartiles(load(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")
    return q.select(F.col("c_nationkey").alias("mo"), F.round("median", 4).alias("med"), F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


@query("SELECT c_mktsegment AS type, count(c_acctbal) AS n, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q3, max(c_acctbal) AS max FROM customer GROUP BY 1")
def a17_five_numbers(spark, sf):
    return P.quartiles(load(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select(F.col("c_mktsegment").alias("type"), "n", "min", r("q1"), r("median"), r("q3"), "max")


@query("""WITH c AS (SELECT c_nationkey AS mo, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT mo, s, row_number() OVER (PARTITION BY mo ORDER BY n DESC, s) AS pos FROM c), f AS (SELECT c_nationkey AS mo, arg_min(c_name, c_custkey) AS first_name FROM customer GROUP BY 1) SELECT m.mo, s AS mode_segment, first_name FROM m JOIN f ON f.mo = m.mo WHERE pos = 1""")
def a18_first_and_mode(spark, sf):
    c = load(spark, sf, "customer").withColumnRenamed("c_nationkey", "mo")
    mode = P.keep_first(c.groupBy("mo", F.col("c_mktsegment").alias("mode_segment")).agg(F.count(F.lit(1)).alias("n")), ["mo"], [F.col("n").desc(), F.col("mode_segment")])
    return mode.select("mo", "mode_segment").join(c.groupBy("mo").agg(F.min_by("c_name", "c_custkey").alias("first_name")), "mo")


@query("SELECT c_nationkey AS mo, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY 1")
def a19_crosstab(spark, sf):
    return load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("mo")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT c_mktsegment AS type, round(median(c_acctbal), 4) AS med, round(avg(c_acctbal), 4) AS mean, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM customer GROUP BY 1")
def a20_multi_agg(spark, sf):
    return load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("type")).agg(F.round(F.median("c_acctbal"), 4).alias("med"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 6).alias("positive"))


@query("SELECT c_nationkey AS mo, first(c_custkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS custkey, max(abs(c_acctbal)) AS most FROM customer GROUP BY 1")
def a21_argmax(spark, sf):
    return load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("mo")).agg(F.max_by("c_custkey", F.struct(F.abs("c_acctbal"), -F.col("c_custkey"))).alias("custkey"), F.max(F.abs("c_acctbal")).alias("most"))


@query(f"WITH {K} SELECT a.n_regionkey AS from_type, b.n_regionkey AS to_type, round(sum(price), 2) AS volume, count(*) AS n FROM k JOIN nation a ON a.n_nationkey = supplier_mo JOIN nation b ON b.n_nationkey = customer_mo GROUP BY 1, 2")
def a23_type_flow(spark, sf):
    t = load(spark, sf, "nation")
    a, b = (t.select(F.col("n_nationkey").alias(f"{s}_mo"), F.col("n_regionkey").alias(f"{to}_type")) for s, to in (("supplier", "from"), ("customer", "to")))
    return contracts(spark, sf).join(small(a), "supplier_mo").join(small(b), "customer_mo").groupBy("from_type", "to_type").agg(F.round(F.sum("price"), 2).alias("volume"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, count(mo_id) AS placed, count(*) - count(mo_id) AS missing, CAST(coalesce(sum(n_chars) FILTER (mo_id IS NOT NULL), 0) AS BIGINT) AS chars FROM documents GROUP BY 1")
def a24_missing_counts(spark, sf):
    return load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("mo_id").alias("placed"), F.count_if(F.col("mo_id").isNull()).alias("missing"), F.coalesce(F.sum(F.when(F.col("mo_id").isNotNull(), F.col("n_chars"))), F.lit(0)).alias("chars"))


@query("""WITH m AS (SELECT DISTINCT user_id, day(ts) AS t FROM events), i AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM m) SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS length FROM i GROUP BY user_id, g""")
def a25_runs(spark, sf):
    return P.runs(load(spark, sf, "events").select("user_id", F.dayofmonth("ts").alias("t")).distinct(), "user_id", "t")


@query("""WITH m AS (SELECT c_nationkey AS mo, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT mo, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS z FROM m""")
def a26_profile_z(spark, sf):
    m = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("mo")).agg(F.avg("c_acctbal").alias("v"))
    whole = m.agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    return m.join(F.broadcast(whole)).select("mo", F.round((F.col("v") - F.col("a")) / F.col("s"), 6).alias("z"))


@query("""WITH s AS (SELECT source_file, min(line_no) AS a, max(line_no) AS b, count(DISTINCT line_no) AS n FROM contract_lines_raw GROUP BY 1) SELECT source_file, CAST(b - a + 1 AS BIGINT) AS expected, n AS present, CAST(b - a + 1 - n AS BIGINT) AS missing FROM s""")
def a27_completeness(spark, sf):
    s = load(spark, sf, "contract_lines_raw").groupBy("source_file").agg((F.max("line_no") - F.min("line_no") + 1).cast("bigint").alias("expected"), F.countDistinct("line_no").alias("present"))
    return s.withColumn("missing", F.col("expected") - F.col("present"))


# --- windows ----------------------------------------------------------------------------------------------------------------
def _quarterly(spark, sf):
    return contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo"), P.period("d", "Q").alias("period")).agg(F.sum("price").alias("v"))


PQ = f"p AS (SELECT customer_mo AS mo, {QTR} AS period, sum(price) AS v FROM k GROUP BY 1, 2)"
@query(f"WITH {K}, {PQ} SELECT mo, period, round(avg(v) OVER (PARTITION BY mo ORDER BY period ROWS 3 PRECEDING), 4) AS mean4, round(v - lag(v) OVER (PARTITION BY mo ORDER BY period), 2) AS diff FROM p")
def w1_rolling_and_difference(spark, sf):
    p = P.difference(P.rolling_mean(_quarterly(spark, sf), "mo", "period", "v", 4, "mean4"), "mo", "period", "v", "diff")
    return p.select("mo", "period", r("mean4", 4), r("diff", 2))


@query(f"""WITH {K}, f AS (SELECT supplier_mo AS src, customer_mo AS dst, year(d) * 4 + quarter(d) AS t, sum(price) AS v FROM k GROUP BY 1, 2, 3) SELECT src, dst, t, round(sum(v) OVER (PARTITION BY src, dst ORDER BY t RANGE 3 PRECEDING), 2) AS trailing FROM f""")
def w2_trailing_periods(spark, sf):
    f = contracts(spark, sf).groupBy(F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst"), (F.year("d") * 4 + F.quarter("d")).cast("bigint").alias("t")).agg(F.sum("price").alias("v"))
    return f.select("src", "dst", "t", F.round(F.sum("v").over(Window.partitionBy("src", "dst").orderBy("t").rangeBetween(-3, 0)), 2).alias("trailing"))


PM = "m AS (SELECT customer_mo AS mo, strftime(d, '%Y-%m') AS month, sum(price) AS v FROM k GROUP BY 1, 2)"
@query(f"WITH {K}, {PM}, x AS (SELECT mo, month, ln(v) - avg(ln(v)) OVER (PARTITION BY month) AS res FROM m) SELECT mo, month, round(res, 6) AS residual, round((res - avg(res) OVER (PARTITION BY mo)) / (stddev_pop(res) OVER (PARTITION BY mo) + 1e-12), 6) AS z FROM x")
def w5_residual_z(spark, sf):
    m = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo"), P.period("d", "M").alias("month")).agg(F.sum("price").alias("v"))
    x = P.zscores(P.demeaned(m, "month", F.ln("v"), "residual"), "mo", "residual", "z")
    return x.select("mo", "month", r("residual", 6), r("z", 6))


@query("""WITH x AS (SELECT c_custkey AS id, c_mktsegment AS g, CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal / 100) END AS v FROM customer) SELECT id, CASE WHEN v IS NOT NULL THEN round((rank() OVER (PARTITION BY g, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0) / count(v) OVER (PARTITION BY g) * 100, 6) END AS pct FROM x""")
def w7_rank_percent(spark, sf):
    x = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).alias("v"))
    return P.wide_rank(x, ["g"], "v", "pct", percent=True).select("id", r("pct", 6))


@query("""WITH x AS (SELECT s_suppkey AS id, s_acctbal AS a, s_nationkey AS b FROM supplier), k AS (SELECT id, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) AS rb FROM x) SELECT id, round((ra + rb) / 2, 4) AS mean_rank FROM k""")
def w8_mean_rank(spark, sf):
    # unpivoted, so that both metrics share one window
    x = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.create_map(F.lit("a"), F.col("s_acctbal"), F.lit("b"), F.col("s_nationkey").cast("double"))).alias("metric", "v"))
    return P.wide_rank(x, ["metric"], "v", "rank").groupBy("id").agg(F.round(F.avg("rank"), 4).alias("mean_rank"))


@query("""WITH p AS (SELECT vec_id AS id, label, (vec_id * 7919 % 1000 + 1) / 1001.0 AS p FROM embeddings), k AS (SELECT id, label, p, row_number() OVER (PARTITION BY label ORDER BY p, id) AS pos, count(*) OVER (PARTITION BY label) AS n FROM p)
 SELECT id, round(least(1.0, min(p * n / pos) OVER (PARTITION BY label ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k""")
def w9_false_discovery(spark, sf):
    p = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", ((F.col("vec_id") * 7919 % 1000 + 1) / 1001.0).cast("double").alias("p"))
    return P.false_discovery(p, ["label"], "p", "q").select("id", r("q", 6))


@query("""WITH x AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, CAST(coalesce(sum(CASE WHEN was <> event_type THEN 1 ELSE 0 END), 0) AS BIGINT) AS switches FROM x GROUP BY 1""")
def w10_switches(spark, sf):
    e = load(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return P.switches(e, "user_id", "o", "event_type")


@query("""WITH x AS (SELECT event_type AS from_label, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_label FROM events) SELECT from_label, to_label, count(*) AS n FROM x WHERE to_label IS NOT NULL GROUP BY 1, 2""")
def w11_transitions(spark, sf):
    return P.transitions(load(spark, sf, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "event_type")


@query("""WITH y AS (SELECT c_nationkey AS mo, year(o_orderdate) AS year, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT a.mo, CAST(a.year AS INT) AS year, round(a.v, 2) AS v, round(a.v - b.v, 2) AS delta, round(a.v / b.v - 1, 6) AS growth FROM y a LEFT JOIN y b ON b.mo = a.mo AND b.year = a.year - 1""")
def w12_year_on_year(spark, sf):
    y = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("mo"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    return P.year_on_year(y, "mo", "year", "v").select("mo", "year", r("v", 2), r("delta", 2), r("growth", 6))


@query("SELECT canonical_contract_id, row_id FROM (SELECT canonical_contract_id, row_id, row_number() OVER (PARTITION BY canonical_contract_id ORDER BY loaded_at NULLS FIRST, row_id) AS pos FROM contracts_msp_enriched) WHERE pos = 1")
def w13_keep_first(spark, sf):
    return P.keep_first(load(spark, sf, "contracts_msp_enriched").select("canonical_contract_id", "row_id", "loaded_at"), ["canonical_contract_id"], [F.col("loaded_at").asc_nulls_first(), F.col("row_id")]).select("canonical_contract_id", "row_id")


@query("SELECT * FROM (SELECT c_nationkey AS mo, c_custkey AS custkey, c_acctbal AS bal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank FROM customer) WHERE rank <= 5")
def w14_top_k(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("mo"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("bal"))
    return P.top_k(c, ["mo"], [F.col("bal").desc(), F.col("custkey")], 5)


@query("SELECT s_suppkey AS id, round(percent_rank() OVER (ORDER BY s_acctbal), 6) AS colour FROM supplier")
def w15_percent_rank(spark, sf):
    s = load(spark, sf, "supplier")
    return s.join(P.smaller_values(s, "s_acctbal"), "s_acctbal").select(F.col("s_suppkey").alias("id"), F.round(F.col("below") / F.greatest(F.col("total") - 1, F.lit(1)), 6).alias("colour"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (month(o_orderdate) = {m}), 0), 2) AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def w16_seasonal(spark, sf):
    months = [f"m{m}" for m in range(1, 13)]
    w = load(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.concat(F.lit("m"), F.month("o_orderdate").cast("string")).alias("m"), "o_totalprice").groupBy("year").pivot("m", months)
    return w.agg(F.round(F.sum("o_totalprice"), 2)).fillna(0.0)


# --- filters, joins, sets -----------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, least(greatest(o_totalprice, 1000), 200000) AS price FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def f1_filters(spark, sf):
    o = load(spark, sf, "orders").where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    o = o.where(~(F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)) & (F.col("o_orderpriority") == "1-URGENT"))).dropna(subset=["o_totalprice"])
    rich = load(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(rich, "o_custkey", "left_semi").select("o_orderkey", F.least(F.greatest("o_totalprice", F.lit(1000.0)), F.lit(200000.0)).alias("price"))


@query("""SELECT row_id, regexp_matches(lower(customer), '(гбуз|гку|государственн)') AS state, regexp_matches(lower(customer), '(мбдоу|мбук|мбоу|мау|мку|муп|муниципальн)') AS municipal, contains(lower(replace(replace(subject, 'Ё', 'е'), 'ё', 'е')), 'мебели') AS furniture FROM contracts_msp_enriched""")
def f4_flags(spark, sf):
    k = load(spark, sf, "contracts_msp_enriched")
    return k.select("row_id", F.lower("customer").rlike("(гбуз|гку|государственн)").alias("state"), F.lower("customer").rlike("(мбдоу|мбук|мбоу|мау|мку|муп|муниципальн)").alias("municipal"), F.contains(F.lower(F.translate("subject", "Ёё", "ее")), F.lit("мебели")).alias("furniture"))


@query("""WITH x AS (SELECT c_custkey AS id, c_acctbal AS v, percent_rank() OVER (ORDER BY c_acctbal) * 100 AS p FROM customer) SELECT id FROM x WHERE p >= 25 AND p <= 75""")
def f8_percentile_conditions(spark, sf):
    c = load(spark, sf, "customer")
    p = c.join(P.smaller_values(c, "c_acctbal"), "c_acctbal").withColumn("p", F.col("below") / (F.col("total") - 1) * 100)
    conditions = [F.col("p") >= 25, F.col("p") <= 75]  # a missing value passes none
    for c_ in conditions:
        p = p.where(c_)
    return p.select(F.col("c_custkey").alias("id"))


@query(f"""WITH {K}, f AS (SELECT supplier_mo AS src, customer_mo AS dst, sum(price) AS w FROM k WHERE supplier_mo <> customer_mo GROUP BY 1, 2), q AS (SELECT quantile_disc(w, 0.5) AS cut FROM f) SELECT src, dst, round(w, 2) AS w, CAST(row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS INT) AS rank FROM f, q WHERE w >= cut QUALIFY rank <= 12""")
def f10_edge_filter(spark, sf):
    f = contracts(spark, sf).where("supplier_mo <> customer_mo").groupBy(F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst")).agg(F.sum("price").alias("w"))
    cut = f.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)").alias("cut"))
    return P.top_k(f.join(F.broadcast(cut)).where("w >= cut").drop("cut"), ["src"], [F.col("w").desc(), F.col("dst")], 12).select("src", "dst", r("w", 2), "rank")


@query("""WITH s AS (SELECT inn, max(category) AS category FROM msp_snapshot_rows WHERE snapshot_date = '2026-09-10' AND inn IS NOT NULL GROUP BY 1) SELECT k.row_id, CASE WHEN k.supplier_inn IS NULL OR k.supplier_inn = '' THEN 'no id' WHEN s.inn IS NULL THEN 'not found' ELSE 'found' END AS status, s.category FROM contracts_msp_enriched k LEFT JOIN s ON s.inn = k.supplier_inn""")
def f11_status_join(spark, sf):
    s = load(spark, sf, "msp_snapshot_rows").where("snapshot_date = '2026-09-10' AND inn IS NOT NULL").groupBy(F.col("inn").alias("supplier_inn")).agg(F.max("category").alias("category"), F.lit(True).alias("hit"))
    k = load(spark, sf, "contracts_msp_enriched").select("row_id", "supplier_inn")
    none = F.col("supplier_inn").isNull() | (F.col("supplier_inn") == "")
    # rows without an id don't enter the join, where they would all meet in one task
    rest = k.where(none).select("row_id", F.lit("no id").alias("status"), F.lit(None).cast("string").alias("category"))
    found = k.where(~none).join(s, "supplier_inn", "left").select("row_id", F.when(F.col("hit"), "found").otherwise("not found").alias("status"), "category")
    return found.unionByName(rest)


@query()
def f11_status_join_all(spark, sf):
    """f11_status_join over every row that means 2026-09-10 in its feed's layout and zone, by normal INNs."""
    s = load(spark, sf, "msp_snapshot_rows").select("inn", "category", "snapshot_date", "source_id")
    s = normalise_timestamps(s, "snapshot_date", "source_id", load(spark, sf, "sources"))
    # the day at UTC+5, as for p3 and p4
    s = s.where(F.floor((F.col("utc_epoch") + 5 * 3600) / 86400) == F.unix_date(F.lit("2026-09-10").cast("date")))
    s = with_normal_inn(s, "inn", "normal").where("normal IS NOT NULL").groupBy("normal").agg(F.max("category").alias("category"), F.lit(True).alias("hit"))
    k = with_normal_inn(load(spark, sf, "contracts_msp_enriched").select("row_id", "supplier_inn"), "supplier_inn", "normal")
    blank = F.col("supplier_inn").isNull() | (F.trim("supplier_inn") == "")
    # rows without a usable INN don't enter the join
    rest = k.where("normal IS NULL").select("row_id", F.when(blank, "no id").otherwise("not found").alias("status"), F.lit(None).cast("string").alias("category"))
    found = k.where("normal IS NOT NULL").join(s, "normal", "left").select("row_id", F.when(F.col("hit"), "found").otherwise("not found").alias("status"), "category")
    return found.unionByName(rest)


@query("""WITH d AS (SELECT name, min(mo_id) AS mo FROM place_refs WHERE kind = 'district' GROUP BY 1), c AS (SELECT name, min(mo_id) AS mo FROM place_refs WHERE kind = 'city' GROUP BY 1) SELECT row_id, CASE WHEN d.mo IS NOT NULL AND c.mo IS NOT NULL AND d.mo <> c.mo THEN 'conflict' WHEN d.mo IS NOT NULL THEN 'district' WHEN c.mo IS NOT NULL THEN 'city' ELSE 'none' END AS method, CASE WHEN d.mo <> c.mo THEN NULL ELSE coalesce(d.mo, c.mo) END AS mo FROM msp_snapshot_rows s LEFT JOIN d ON d.name = district_raw LEFT JOIN c ON c.name = city_raw""")
def f12_conflict_resolution(spark, sf):
    ref = load(spark, sf, "place_refs")
    d, c = (ref.where(F.col("kind") == kind).groupBy(F.col("name").alias(f"{kind}_raw")).agg(F.min("mo_id").alias(f"{kind}_mo")) for kind in ("district", "city"))
    s = load(spark, sf, "msp_snapshot_rows").select("row_id", "district_raw", "city_raw").join(small(d), "district_raw", "left").join(small(c), "city_raw", "left")
    both = F.col("district_mo") != F.col("city_mo")
    method = F.when(both, "conflict").when(F.col("district_mo").isNotNull(), "district").when(F.col("city_mo").isNotNull(), "city").otherwise("none")
    return s.select("row_id", method.alias("method"), F.when(both, None).otherwise(F.coalesce("district_mo", "city_mo")).alias("mo"))


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS s, round(c_acctbal, -3) AS v FROM customer), b AS (SELECT s_suppkey AS id, s_nationkey AS n, round(s_acctbal, -3) AS v FROM supplier), j AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS hits FROM a JOIN b ON a.n = b.n AND a.v = b.v GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY hits DESC, b_id) AS pos FROM j) SELECT a_id, b_id, hits FROM t WHERE pos = 1""")
def j6_fingerprint(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("a_id"), F.col("c_nationkey").alias("n"), F.round("c_acctbal", -3).alias("v"))
    b = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("b_id"), F.col("s_nationkey").alias("n"), F.round("s_acctbal", -3).alias("v"))
    hits = a.join(b, ["n", "v"]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("hits"))
    return P.keep_first(hits, ["a_id"], [F.col("hits").desc(), F.col("b_id")]).select("a_id", "b_id", "hits")


@query("""WITH a AS (SELECT c_nationkey AS mo, year(o_orderdate) AS year, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT s_nationkey AS mo, year(l_shipdate) AS year, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT mo, CAST(year AS INT) AS year, a.orders, b.lines, n_name FROM a FULL JOIN b USING (mo, year) LEFT JOIN nation ON n_nationkey = mo""")
def j4_panel_outer(spark, sf):
    a = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("mo"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    b = load(spark, sf, "lineitem").join(load(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("mo"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("lines"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("mo"), "n_name")
    return a.join(b, ["mo", "year"], "full_outer").join(small(n), "mo", "left")


@query("""WITH c AS (SELECT substr(lpad(customer_inn, 10, '0'), 1, 7) AS prefix, law, count(*) AS n FROM contracts_msp_enriched WHERE customer_inn IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY prefix) AS total, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, law) AS pos FROM c) SELECT prefix, law AS mode_value, round(n / total, 6) AS confidence, CAST(total AS BIGINT) AS total FROM t WHERE pos = 1""")
def e1_prefix_inference(spark, sf):
    c = load(spark, sf, "contracts_msp_enriched").where("customer_inn IS NOT NULL").groupBy(F.substring(F.lpad("customer_inn", 10, "0"), 1, 7).alias("prefix"), F.col("law").alias("mode_value")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy("prefix")))
    return P.keep_first(c, ["prefix"], [F.col("n").desc(), F.col("mode_value").asc_nulls_last()]).select("prefix", "mode_value", F.round(F.col("n") / F.col("total"), 6).alias("confidence"), "total")


@query("""WITH x AS (SELECT c_custkey AS id, c_nationkey AS mo, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING'), s AS (SELECT s_nationkey AS mo, s_suppkey AS anchor, s_acctbal AS a FROM supplier), j AS (SELECT id, anchor, abs(v - a) AS dist, row_number() OVER (PARTITION BY id ORDER BY abs(v - a), anchor) AS pos FROM x JOIN s USING (mo)) SELECT id, anchor, round(dist, 2) AS dist FROM j WHERE pos = 1""")
def j16_nearest(spark, sf):
    x = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("mo"), F.col("c_acctbal").alias("v"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("mo"), F.col("s_suppkey").alias("anchor"), F.col("s_acctbal").alias("a"))
    return P.nearest_value(x, s.withColumnRenamed("a", "v"), "mo", "v", "id", "anchor").select("id", "anchor", r("dist", 2))


@query("SELECT c_nationkey AS mo FROM customer UNION SELECT s_nationkey FROM supplier")
def o4_union_distinct(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("mo")).union(load(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT 'both' AS kind, inn FROM (SELECT inn FROM msp_snapshot_rows INTERSECT SELECT supplier_inn FROM contracts_msp_enriched) WHERE inn IS NOT NULL UNION ALL SELECT 'register only', inn FROM (SELECT inn FROM msp_snapshot_rows EXCEPT SELECT supplier_inn FROM contracts_msp_enriched) WHERE inn IS NOT NULL")
def o7_set_operations(spark, sf):
    a, b = load(spark, sf, "msp_snapshot_rows").select("inn").where("inn IS NOT NULL"), load(spark, sf, "contracts_msp_enriched").select(F.col("supplier_inn").alias("inn")).where("supplier_inn IS NOT NULL")
    return a.intersect(b).select(F.lit("both").alias("kind"), "inn").unionByName(a.subtract(b).select(F.lit("register only").alias("kind"), "inn"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def j14_anti(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(load(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


@query("SELECT s_suppkey AS id, s_acctbal AS bal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 40")
def o1_order_by_abs(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")).orderBy(F.abs("bal").desc(), "id").limit(40)


# --- scalar functions ---------------------------------------------------------------------------------------------------------
CHECK = lambda s, w: "(" + " + ".join(f"CAST(substr({s}, {i}, 1) AS INT) * {x}" for i, x in enumerate(w, 1)) + f") % 11 % 10"
W10, W11, W12 = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
@query(f"""SELECT row_id, coalesce(CASE WHEN regexp_full_match(inn, '[0-9]{{10}}') THEN {CHECK('inn', W10)} = CAST(substr(inn, 10, 1) AS INT) WHEN regexp_full_match(inn, '[0-9]{{12}}') THEN {CHECK('inn', W11)} = CAST(substr(inn, 11, 1) AS INT) AND {CHECK('inn', W12)} = CAST(substr(inn, 12, 1) AS INT) END, false) AS valid FROM msp_snapshot_rows""")
def s1_inn_check(spark, sf):
    return load(spark, sf, "msp_snapshot_rows").select("row_id", inn_valid(F.col("inn")).alias("valid"))


@query("""SELECT row_id, trim(regexp_replace(replace(lower(coalesce(customer, '')), 'ё', 'е'), '\\s+', ' ', 'g')) AS norm, lpad(substr(canonical_contract_id, 1, 4), 6, '0') AS code, TRY_CAST(replace(replace(replace(amount, chr(160), ''), ' ', ''), ',', '.') AS DOUBLE) AS price, coalesce(contains(subject, 'лот'), false) AS lot FROM contracts_msp_enriched""")
def s2_strings(spark, sf):
    k = load(spark, sf, "contracts_msp_enriched")
    number = F.replace(F.replace(F.replace(F.col("amount"), F.lit(" "), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return k.select("row_id", F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce("customer", F.lit(""))), F.lit("ё"), F.lit("е")), r"\s+", " ")).alias("norm"), F.lpad(F.substring("canonical_contract_id", 1, 4), 6, "0").alias("code"), number.try_cast("double").alias("price"), F.coalesce(F.contains("subject", F.lit("лот")), F.lit(False)).alias("lot"))


@query("""SELECT row_id, strftime(CAST(contract_at_utc AS TIMESTAMP) + INTERVAL 5 HOUR, '%Y-%m-%d') AS day, CAST(year(CAST(contract_at_utc AS TIMESTAMP)) AS INT) AS y, strftime(CAST(contract_at_utc AS TIMESTAMP) - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_before FROM atmo_contract_observations WHERE contract_at_utc IS NOT NULL""")
def s3_dates(spark, sf):
    t = F.to_timestamp("contract_at_utc")
    a = load(spark, sf, "atmo_contract_observations").where("contract_at_utc IS NOT NULL")
    return a.select("row_id", F.date_format(F.from_utc_timestamp(t, "+05:00"), "yyyy-MM-dd").alias("day"), F.year(t).alias("y"), F.date_format(F.add_months(t, -12), "yyyy-MM-dd").alias("year_before"))


@query("""SELECT row_id, json_extract_string(raw_json, '$.id') AS id, coalesce(json_extract_string(raw_json, '$.contract.id'), json_extract_string(raw_json, '$.contract_id')) AS contract, CAST(round(CAST(json_extract_string(raw_json, '$.contract.price') AS DECIMAL(20, 6)) * 100, 0) AS BIGINT) AS cents, json_extract_string(raw_json, '$.status.code') AS status FROM atmo_contract_observations""")
def s4_json(spark, sf):
    j = lambda p: F.get_json_object("raw_json", p)
    return load(spark, sf, "atmo_contract_observations").select("row_id", j("$.id").alias("id"), F.coalesce(j("$.contract.id"), j("$.contract_id")).alias("contract"), F.round(j("$.contract.price").cast("decimal(20,6)") * 100, 0).cast("bigint").alias("cents"), j("$.status.code").alias("status"))


@query("SELECT s_suppkey AS id, round(ln(abs(s_acctbal) + 1), 6) AS l, round(sqrt(abs(s_acctbal)), 6) AS s, round(sign(s_acctbal) * pow(abs(s_acctbal), 0.5), 6) AS diverging, round(s_acctbal, 1) AS rounded FROM supplier")
def s5_math(spark, sf):
    b = F.col("s_acctbal")
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.log1p(F.abs(b)), 6).alias("l"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.round(F.signum(b) * F.pow(F.abs(b), F.lit(0.5)), 6).alias("diverging"), F.round(b, 1).alias("rounded"))


@query("SELECT raw_id, sha256(payload) AS digest, length(payload) AS size FROM registry_docs")
def s6_hash(spark, sf):
    return load(spark, sf, "registry_docs").select("raw_id", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("bigint").alias("size"))


@query("""WITH t AS (SELECT user_id, ts, value FROM events), s AS (SELECT user_id, list(value ORDER BY ts, value) AS v FROM t GROUP BY 1) SELECT user_id, len(v) AS n, round(list_sum(v), 4) AS total, round(list_max(v), 4) AS most, list_position(v, list_max(v)) AS pos FROM s""")
def s7_arrays(spark, sf):
    s = load(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x.value).alias("v"))
    most = F.array_max("v")
    return s.select("user_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(most, 4).alias("most"), F.array_position("v", most).cast("int").alias("pos"))
