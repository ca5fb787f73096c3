"""Queries of the remaining relational operators: projections and formats, maps and joins, checks of totals, indices, lists of pairs and edges, dynamics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from okrug.operators import network as N
from okrug.operators import panel as P
from okrug.operators import quality as C
from okrug.operators import stats as T
from okrug.operators import validity as V
from okrug.plans import network as Q
from okrug.plans.base import K, contracts, r, registry
from okrug.session import load, small

QUERIES, ORACLE, query = registry()


# --- projections, order, formats --------------------------------------------------------------------------------------------------
@query("SELECT c_custkey AS customer_custkey, c_name AS customer_name, c_nationkey AS customer_nationkey, c_acctbal AS customer_acctbal, c_mktsegment AS customer_mktsegment FROM customer")
def f13_prefix_projection(spark, sf):
    return P.prefixed(load(spark, sf, "customer").withColumn("other", F.lit(1)), "c_", "customer_")


@query("SELECT n_nationkey AS id, CAST(row_number() OVER (ORDER BY n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END COLLATE NOCASE DESC, n_nationkey) AS INT) AS place FROM nation")
def o3_collated_order(spark, sf):
    n = load(spark, sf, "nation").withColumn("name", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return n.select(F.col("n_nationkey").alias("id"), F.row_number().over(Window.orderBy("n_regionkey", F.collate("name", "UTF8_LCASE").desc(), "n_nationkey")).alias("place"))


@query("SELECT mo_id, arg_max(kind, mo_id) AS last_kind, min(place_id) AS first_id, max(place_id) AS last_id FROM (SELECT mo_id, place_id, last_value(kind) OVER (PARTITION BY mo_id ORDER BY place_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kind FROM place_refs) GROUP BY mo_id")
def o6_keep_last(spark, sf):
    p = load(spark, sf, "place_refs")
    last = P.keep_first(p, ["mo_id"], [F.col("place_id").desc()]).select("mo_id", F.col("kind").alias("last_kind"), F.col("place_id").alias("last_id"))
    return P.keep_first(p, ["mo_id"], [F.col("place_id").asc()]).select("mo_id", F.col("place_id").alias("first_id")).join(last, "mo_id")


@query("""WITH x AS (SELECT row_id, amount_cents AS c FROM contracts_msp_enriched WHERE amount_cents IS NOT NULL) SELECT row_id, replace(format('{:,}', c // 100), ',', ' ') || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS money, CASE WHEN c > 50000000 THEN '+' WHEN c < 50000000 THEN '-' ELSE '' END || replace(format('{:,}', abs(c - 50000000) // 100), ',', ' ') AS signed FROM x WHERE c >= 0""")
def fn_formats(spark, sf):
    x = load(spark, sf, "contracts_msp_enriched").where("amount_cents >= 0")
    return x.select("row_id", P.money_text(F.col("amount_cents")).alias("money"), P.signed_text(F.col("amount_cents") - 50_000_000, 100).alias("signed"))


# --- maps and joins ---------------------------------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT substr(customer_inn, 1, 4) AS prefix, min(law) AS zone FROM contracts_msp_enriched WHERE regexp_full_match(customer_inn, '[0-9]{10}') GROUP BY 1 HAVING count(*) >= 5) SELECT a.zone AS customer_zone, b.zone AS supplier_zone, count(*) AS n, count(*) FILTER (k.supplier_inn IS NOT NULL AND b.prefix IS NULL) AS outside FROM contracts_msp_enriched k LEFT JOIN m a ON a.prefix = substr(k.customer_inn, 1, 4) LEFT JOIN m b ON b.prefix = substr(k.supplier_inn, 1, 4) GROUP BY 1, 2""")
def j2_prefix_map_twice(spark, sf):
    """Both parties' zones by the first digits of their numbers; four digits have at most 10,000 prefixes."""
    k = load(spark, sf, "contracts_msp_enriched").select("customer_inn", "supplier_inn", "law")
    m = k.where(F.col("customer_inn").rlike("^[0-9]{10}$")).groupBy(F.substring("customer_inn", 1, 4).alias("prefix")).agg(F.min("law").alias("zone"), F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")
    side = lambda name: F.broadcast(m.select(F.col("prefix").alias(f"{name}_prefix"), F.col("zone").alias(f"{name}_zone")))
    both = k.join(side("customer"), F.substring("customer_inn", 1, 4) == F.col("customer_prefix"), "left").join(side("supplier"), F.substring("supplier_inn", 1, 4) == F.col("supplier_prefix"), "left")
    return both.groupBy("customer_zone", "supplier_zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("supplier_inn").isNotNull() & F.col("supplier_prefix").isNull()).alias("outside"))


@query(f"""WITH {K}, d AS (SELECT supplier_mo AS a, customer_mo AS b, avg(price) AS w, max(segment) AS kind FROM k WHERE segment = 'BUILDING' GROUP BY 1, 2), s AS (SELECT a, b, w FROM d UNION ALL SELECT b, a, w FROM d), m AS (SELECT a, b, min(w) AS w FROM s WHERE a <> b GROUP BY 1, 2) SELECT x.n_nationkey AS src, y.n_nationkey AS dst, round(w, 6) AS w FROM nation x JOIN nation y ON x.n_nationkey <> y.n_nationkey LEFT JOIN m ON m.a = x.n_nationkey AND m.b = y.n_nationkey""")
def n10_road_distance(spark, sf):
    roads = contracts(spark, sf).groupBy(F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst"), F.col("segment").alias("type")).agg(F.avg("price").alias("w"))
    return N.road_distance(roads, load(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), "BUILDING").select("src", "dst", r("w", 6))


@query(f"""WITH {K}, f AS (SELECT supplier_mo AS mo, sum(price) AS s FROM k WHERE supplier_mo <> customer_mo GROUP BY 1), p AS (SELECT c_nationkey AS mo, count(*) AS n FROM customer GROUP BY 1) SELECT n_nationkey AS mo, round(coalesce(s, 0) / n, 4) AS supplied FROM nation LEFT JOIN f ON f.mo = n_nationkey LEFT JOIN p ON p.mo = n_nationkey""")
def s2_supplied_to_others(spark, sf):
    c = contracts(spark, sf).where("supplier_mo <> customer_mo").groupBy(F.col("supplier_mo").alias("mo")).agg(F.sum("price").alias("s"))
    heads = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("mo")).agg(F.count(F.lit(1)).alias("n"))
    return load(spark, sf, "nation").select(F.col("n_nationkey").alias("mo")).join(c, "mo", "left").join(heads, "mo", "left").select("mo", F.round(P.ratio(F.coalesce("s", F.lit(0.0)), F.col("n")), 4).alias("supplied"))


# --- checks of totals ---------------------------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT year(o_orderdate) AS year, c_nationkey AS mo, CAST(round(sum(o_totalprice * 100)) AS BIGINT) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), t AS (SELECT year(o_orderdate) AS year, CAST(round(sum(o_totalprice * 100)) AS BIGINT) AS published FROM orders GROUP BY 1) SELECT t.year, count(*) AS parts, count(DISTINCT mo) AS entities, abs(sum(v) - published) <= count(*) AS holds FROM t JOIN p ON p.year = t.year GROUP BY t.year, published""")
def k1_published_totals(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"))
    cents = F.round(F.sum(F.col("price") * 100)).cast("bigint")
    parts = o.join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("year", F.col("c_nationkey").alias("mo")).agg(cents.alias("v"))
    return C.totals_hold(parts, o.groupBy("year").agg(cents.alias("published")), "year", "mo", "v", "published")


@query("SELECT source_file, count(*) AS lines, CAST(max(line_no) AS INT) AS last, count(DISTINCT line_no) = max(line_no) AND count(*) = max(line_no) AS complete FROM contract_lines_raw GROUP BY 1")
def k5_parts_complete(spark, sf):
    return C.parts_complete(load(spark, sf, "contract_lines_raw"), "source_file", "line_no")


@query(f"WITH {Q.FLOW} SELECT \"check\", CAST(bad AS BIGINT) AS bad, CAST(total AS BIGINT) AS total, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT 'symmetric' AS \"check\", count(*) FILTER (b.w IS NULL OR abs(a.w - b.w) > 1e-9) AS bad, count(*) AS total FROM flow a LEFT JOIN flow b ON a.src = b.dst AND a.dst = b.src UNION ALL SELECT 'finite', count(*) FILTER (w IS NULL OR isnan(w) OR isinf(w)), count(*) FROM flow UNION ALL SELECT 'no loops', count(*) FILTER (src = dst), count(*) FROM flow)")
def k9_layer_checks(spark, sf):
    e = N.flow_layer(Q._flows(spark, sf))
    infinite = F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))
    return C.report([C.asymmetric_edges(e, "symmetric"), C.rows_that(e, "finite", infinite), C.rows_that(e, "no loops", F.col("src") == F.col("dst"))])


@query(f"""WITH {K}, m AS (SELECT customer_mo AS mo, sum(price) AS volume, avg(price) AS mean FROM k GROUP BY 1), l AS (UNPIVOT m ON volume, mean INTO NAME metric VALUE v), p AS (SELECT metric, mo, (rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0) / count(*) OVER (PARTITION BY metric) * 100 AS p FROM l) SELECT metric, count(*) AS n, count(*) FILTER (abs(p - round(p, 1)) > 50.0 / 25) AS off FROM p GROUP BY 1""")
def k10_stored_percentiles(spark, sf):
    """Percentiles as they are stored, with one decimal, against those computed again; half a rank may lie between."""
    m = Q._metrics(spark, sf).where("metric IN ('volume', 'mean')")
    stored = P.rank_percent(m, ["metric"], "value", "stored").withColumn("stored", F.round("stored", 1))
    return C.percentiles_hold(stored, ["metric"], "value", "stored")


# --- indices -----------------------------------------------------------------------------------------------------------------------
INDICES = {"activity": {"volume": 1, "reach": 1}, "concentration": {"reach": -1, "mean": 1}, "scale": {"volume": 1, "mean": 1, "customers": 1}}
PCT = f"""{K}, m AS (SELECT customer_mo AS mo, sum(price) AS volume, avg(price) AS mean, CAST(count(DISTINCT supplier_mo) AS DOUBLE) AS reach, CAST(count(DISTINCT custkey) AS DOUBLE) AS customers FROM k GROUP BY 1), l AS (UNPIVOT m ON volume, mean, reach, customers INTO NAME metric VALUE v),
 d AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{m}', {s})" for i, parts in INDICES.items() for m, s in parts.items())}) t(index, metric, sense)), x AS (SELECT index, d.metric, mo, v, v * sense AS sv FROM l JOIN d ON d.metric = l.metric), p AS (SELECT *, (rank() OVER (PARTITION BY index, metric ORDER BY sv) + (count(*) OVER (PARTITION BY index, metric, sv) - 1) / 2.0) / count(*) OVER (PARTITION BY index, metric) * 100 AS pct FROM x), i AS (SELECT index, mo, avg(pct) AS score FROM p GROUP BY 1, 2)"""


@query(f"WITH {PCT} SELECT index, mo, round(score, 4) AS score, round((rank() OVER (PARTITION BY index ORDER BY score) + (count(*) OVER (PARTITION BY index, score) - 1) / 2.0) / count(*) OVER (PARTITION BY index) * 100, 4) AS pct FROM (SELECT index, mo, round(score, 6) AS score FROM i)")
def i1_indices(spark, sf):
    scores = P.composed_indices(Q._metrics(spark, sf), "mo", INDICES).select("index", "mo", F.round("score", 6).alias("score"))
    return P.rank_percent(scores, ["index"], "score", "pct").select("index", "mo", r("score"), r("pct"))


@query(f"WITH {PCT} SELECT p.index, p.mo, metric, round(v, 4) AS value, round(pct, 4) AS pct, round(score, 4) AS score FROM p JOIN i ON i.index = p.index AND i.mo = p.mo")
def u11_explain_index(spark, sf):
    parts = P.index_parts(Q._metrics(spark, sf), "mo", INDICES)
    score = parts.groupBy("index", "mo").agg(F.avg("pct").alias("score"))
    return parts.join(score, ["index", "mo"]).select("index", "mo", "metric", r("value"), r("pct"), r("score"))


# --- pairs ---------------------------------------------------------------------------------------------------------------------------
PAIRS = f"""{K}, m AS (SELECT customer_mo AS mo, sum(price) AS volume, avg(price) AS mean, CAST(count(DISTINCT custkey) AS DOUBLE) AS customers FROM k GROUP BY 1), l AS (UNPIVOT m ON volume, mean, customers INTO NAME metric VALUE v), rk AS (SELECT mo, metric, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM l),
 pr AS (SELECT a.metric AS x, b.metric AS y, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM rk a JOIN rk b ON a.mo = b.mo AND a.metric < b.metric GROUP BY 1, 2)"""


def _pairs(spark, sf):
    return T.spearman_pairs(Q._metrics(spark, sf).where("metric <> 'reach'"), "mo", "metric", "value").select("x", "y", "n", r("rho", 6))


@query(f"WITH {PAIRS} SELECT x, y, rho FROM pr UNION ALL SELECT y, x, rho FROM pr UNION ALL SELECT DISTINCT metric, metric, 1.0 FROM l")
def s7_correlation_matrix(spark, sf):
    names = Q._metrics(spark, sf).where("metric <> 'reach'").select("metric").distinct()
    p = _pairs(spark, sf)
    own = names.select(F.col("metric").alias("x"), F.col("metric").alias("y"), F.lit(1.0).alias("rho"))
    return p.select("x", "y", "rho").unionByName(p.select(F.col("y").alias("x"), F.col("x").alias("y"), "rho")).unionByName(own)


@query(f"WITH {PAIRS} SELECT x, y, n, rho FROM pr WHERE NOT (x = 'mean' AND y = 'volume')")
def i5_trivial_pairs(spark, sf):
    """Pairs of which neither is computed from the other, by a list of derivations in either order."""
    derived = spark.createDataFrame([("volume", "mean")], "a string, b string")
    return T.without_derived(_pairs(spark, sf), derived)


@query(f"WITH {PAIRS} SELECT x, y, rho, CAST((row_number() OVER (ORDER BY abs(rho) DESC, x, y) - 1) // 2 + 1 AS INT) AS page FROM pr WHERE x LIKE '%m%' OR y LIKE '%m%'")
def u16_pair_pages(spark, sf):
    p = _pairs(spark, sf).where(F.col("x").contains("m") | F.col("y").contains("m"))
    return P.paged(p, [F.abs("rho").desc(), F.col("x"), F.col("y")], 2).select("x", "y", "rho", "page")


@query()
def u17_significant_pairs(spark, sf):
    p = T.spearman_pairs(Q._metrics(spark, sf), "mo", "metric", "value")
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("q") < 0.05).alias("significant"))


@query("SELECT p_brand AS brand, CASE WHEN n = 0 THEN NULL ELSE best END AS best, CASE WHEN n = 0 THEN NULL ELSE least END AS least, round(hi - lo, 4) AS gap FROM (SELECT p_brand, count(*) AS n, max(m) AS hi, min(m) AS lo, first(p_size ORDER BY m DESC, p_size) AS best, first(p_size ORDER BY m, p_size) AS least FROM (SELECT p_brand, p_size, median(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1)")
def s14_widest_gaps(spark, sf):
    m = load(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), "p_size").agg(F.median("p_retailprice").alias("m"))
    return m.groupBy("brand").agg(F.max_by("p_size", F.struct("m", -F.col("p_size"))).alias("best"), F.min_by("p_size", F.struct("m", "p_size")).alias("least"), F.round(F.max("m") - F.min("m"), 4).alias("gap"))


@query(f"""WITH {Q.EMB}, d AS (SELECT a.vec_id, a.label, b.label AS g, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM e a JOIN e b ON true GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, max(CASE WHEN g = label AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN g <> label THEN t / n END) AS b FROM d GROUP BY 1, 2) SELECT label, count(*) AS n, count(*) FILTER (round(coalesce((b - a) / greatest(a, b), 0), 4) < 0) AS uncertain FROM s GROUP BY 1""")
def s15_uncertain_rows(spark, sf):
    s = V.silhouettes(Q._points(spark, sf), "vec_id", "label", "v")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round("s", 4) < 0).alias("uncertain"))


# --- edges ---------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {Q.FLOW}, {Q.KNN} SELECT dst AS other, round(w, 6) AS weight, CAST(row_number() OVER (ORDER BY round(w, 6) DESC, dst) AS INT) AS place FROM net WHERE src = 3")
def u9_edges_of_one(spark, sf):
    e = Q._net(spark, sf).where("src = 3").select(F.col("dst").alias("other"), r("w", 6, "weight"))
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.col("weight").desc(), "other")))


@query(f"WITH {Q.FLOW}, {Q.KNN}, {Q.LAB} SELECT node, CAST(row_number() OVER (ORDER BY label, round(s, 6) DESC, node) AS INT) AS place FROM (SELECT src AS node, label, sum(w) AS s FROM net JOIN lab ON lab.node = src GROUP BY 1, 2)")
def s12_matrix_order(spark, sf):
    s = Q._net(spark, sf).groupBy(F.col("src").alias("node")).agg(F.round(F.sum("w"), 6).alias("s"))
    return s.join(small(Q._labels(spark, sf)), "node").select("node", F.row_number().over(Window.orderBy("label", F.col("s").desc(), "node")).alias("place"))


@query(f"""WITH {Q.RES}, z AS (SELECT mo, t, (res - avg(res) OVER (PARTITION BY mo)) / (stddev_pop(res) OVER (PARTITION BY mo) + 1e-12) AS z FROM e), l AS (SELECT unnest([1, 2, 3]) AS lag), c AS (SELECT a.mo AS src, b.mo AS dst, lag, sum(a.z * b.z) / (80 - lag) AS w FROM z a JOIN l ON true JOIN z b ON b.t = a.t + lag AND a.mo <> b.mo GROUP BY 1, 2, 3),
 best AS (SELECT src, dst, max(w) AS w FROM c WHERE w > 0 GROUP BY 1, 2), y AS (SELECT x.src, x.dst, x.w - coalesce(y.w, 0) AS lead FROM best x LEFT JOIN best y ON x.src = y.dst AND x.dst = y.src) SELECT n_nationkey AS node, count(lead) FILTER (lead > 0) AS leads FROM nation LEFT JOIN y ON src = n_nationkey GROUP BY 1""")
def g4_leadership(spark, sf):
    """How many others an entity leads: those whose series follow it more closely than it follows theirs."""
    e = N.lead_lag(P.zscores(Q._residuals(spark, sf), "mo", "res", "z"), "mo", "t", "z", 3, 80)
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return n.join(N.leaders(e).groupBy(F.col("leader").alias("node")).agg(F.count(F.lit(1)).alias("leads")), "node", "left").select("node", F.coalesce("leads", F.lit(0)).alias("leads"))


@query("""WITH s AS (SELECT c_nationkey AS mo, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (1, 2, 3) GROUP BY 1, 2), d AS (SELECT min(v) AS lo, max(v) AS hi FROM s), x AS (SELECT lo, hi, (hi - lo) / 5 AS raw, pow(10, floor(log10((hi - lo) / 5))) AS p FROM d) SELECT round(lo, 2) AS lo, round(hi, 2) AS hi, CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS step FROM x""")
def u15_shared_domain(spark, sf):
    o = load(spark, sf, "orders").join(load(spark, sf, "customer").where(F.col("c_nationkey").isin(1, 2, 3)), F.col("c_custkey") == F.col("o_custkey"))
    s = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return P.shared_domain(s, "v", 5).select(r("lo", 2), r("hi", 2), "step")


# --- dynamics ------------------------------------------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT mo, y, label FROM (SELECT c_nationkey AS mo, year(o_orderdate) AS y, o_orderpriority AS label, row_number() OVER (PARTITION BY c_nationkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders JOIN customer ON c_custkey = o_custkey) WHERE pos = 1), p AS (SELECT a.y, a.label AS a, b.label AS b FROM q a JOIN q b ON a.mo = b.mo AND b.y = a.y + 1),
 x AS (SELECT y, sum(n * (n - 1) / 2.0) AS x, sum(n) AS n FROM (SELECT y, a, b, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), l AS (SELECT y, sum(n * (n - 1) / 2.0) AS l FROM (SELECT y, a, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), m AS (SELECT y, sum(n * (n - 1) / 2.0) AS m FROM (SELECT y, b, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1), c AS (SELECT x.y, x, l, m, l * m / (n * (n - 1) / 2.0) AS e FROM x JOIN l ON l.y = x.y JOIN m ON m.y = x.y)
 SELECT y AS year, round(CASE WHEN (l + m) / 2 = e THEN 1.0 ELSE (x - e) / ((l + m) / 2 - e) END, 6) AS ari FROM c""")
def d3_adjacent_ari(spark, sf):
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("mo"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("label"), "o_totalprice", "o_orderkey")
    q = P.keep_first(o, ["mo", "y"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("mo", "y", "label")
    later = q.select("mo", (F.col("y") - 1).alias("y"), F.col("label").alias("next"))
    return V.adjusted_rand_by(q.join(later, ["mo", "y"]), ["y"], "label", "next").select(F.col("y").alias("year"), r("ari", 6))


# --- filters and lists of the dashboard -----------------------------------------------------------------------------------------------
PRESETS = {"rich_newcomers": (("c_acctbal", ">=", 80), ("c_custkey", ">=", 60)), "poor_regulars": (("c_acctbal", "<=", 20), ("c_custkey", "<=", 40)), "middle": (("c_acctbal", ">=", 40), ("c_acctbal", "<=", 60))}


@query(f"""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_acctbal IS NOT NULL THEN percent_rank() OVER (PARTITION BY c_acctbal IS NULL ORDER BY c_acctbal) * 100 END AS c_acctbal, percent_rank() OVER (ORDER BY c_custkey) * 100 AS c_custkey FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer))
 {' UNION ALL '.join(f"SELECT '{n}' AS preset, id FROM p WHERE {' AND '.join(f'{c} {op} {v}' for c, op, v in conditions)}" for n, conditions in PRESETS.items())}""")
def f8_presets(spark, sf):
    """Named filters of conditions on percentiles, all of which must hold; a missing value never passes."""
    c = load(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("c_acctbal"))
    return P.by_presets(c, "c_custkey", PRESETS).withColumnRenamed("c_custkey", "id")


@query(f"WITH {K}, f AS (SELECT supplier_mo AS src, customer_mo AS dst, sum(price) AS w FROM k WHERE supplier_mo <> customer_mo GROUP BY 1, 2), t AS (SELECT quantile_cont(log10(w), 0.6) AS least FROM f) SELECT src, dst, round(w, 2) AS w, CAST(row_number() OVER (ORDER BY round(w, 2) DESC, src, dst) AS INT) AS place FROM f, t WHERE log10(w) >= least AND src IN (1, 2, 3) QUALIFY place <= 12")
def f10_directed_edges(spark, sf):
    """The heaviest edges out of chosen entities, above a percentile of the logarithms of all."""
    f = Q._flows(spark, sf).where("src <> dst")
    return N.shown_edges(f, 0.6, [1, 2, 3], "out", 12, log=True).select("src", "dst", r("w", 2), "place")


@query("SELECT CAST(k AS BIGINT) AS number FROM (SELECT unnest(generate_series(1, 2000)) AS k) WHERE k NOT IN (SELECT CAST(floor(c_acctbal) AS BIGINT) FROM customer)")
def a27_missing_numbers(spark, sf):
    """The numbers of a range that no row has."""
    return C.missing_numbers(load(spark, sf, "customer").withColumn("whole", F.floor("c_acctbal")), "whole", 1, 2000)


@query("""WITH m AS (SELECT mo_id, year(published_at) * 12 + month(published_at) AS t, count(*) AS n FROM documents WHERE mo_id IS NOT NULL AND published_at IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, t - lag(t) OVER (PARTITION BY mo_id ORDER BY t) - 1 AS gap FROM m) SELECT mo_id, count(*) AS covered, CAST(min(t) AS INT) AS first, CAST(max(t) AS INT) AS last, CAST(coalesce(max(gap), 0) AS INT) AS longest_gap, median(n) AS median, min(n) AS least, max(n) AS most FROM g GROUP BY 1""")
def a25_month_coverage(spark, sf):
    """Months with documents of each municipality, the longest gap between them, and what the months hold."""
    d = load(spark, sf, "documents").where("mo_id IS NOT NULL AND published_at IS NOT NULL")
    m = d.groupBy("mo_id", (F.year("published_at") * 12 + F.month("published_at")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return P.coverage(m, "mo_id", "t", "n")


LONG_PART = "l AS (SELECT p_brand AS g, 'price' AS metric, floor(p_retailprice / 10) AS v FROM part UNION ALL SELECT p_brand, 'size', p_size FROM part)"


@query(f"""WITH {LONG_PART}, k AS (SELECT metric, g, v, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM l), p AS (SELECT metric, g, sum(r) AS s, count(*) AS c FROM k GROUP BY 1, 2), t AS (SELECT metric, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT metric, count(*) AS c FROM l GROUP BY metric, v) GROUP BY 1), n AS (SELECT metric, CAST(sum(c) AS DOUBLE) AS n, sum(s * s / c) AS ss, count(*) AS g FROM p GROUP BY 1), h AS (SELECT n.metric, n, g, (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM n JOIN t ON t.metric = n.metric)
 SELECT metric, CAST(n AS BIGINT) AS n, round(h, 5) AS h, round((h - g + 1) / (n - g), 6) AS epsilon2 FROM h""")
def t6_external_checks(spark, sf):
    """Whether columns that the types were not made of differ between them."""
    p = load(spark, sf, "part")
    long = p.select(F.col("p_brand").alias("g"), F.explode(F.create_map(F.lit("price"), F.floor(F.col("p_retailprice") / 10).cast("double"), F.lit("size"), F.col("p_size").cast("double"))).alias("metric", "v"))
    return T.kruskal_wallis(long, "metric", "g", "v").select("metric", "n", r("h", 5), r("epsilon2", 6))


@query("SELECT p_brand AS brand, median(p_retailprice) AS price, median(p_size) AS size, count(*) AS n FROM part GROUP BY 1")
def t6_medians(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.median("p_retailprice").alias("price"), F.median("p_size").alias("size"), F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT mo, y, label FROM (SELECT c_nationkey AS mo, year(o_orderdate) AS y, o_orderpriority AS label, row_number() OVER (PARTITION BY c_nationkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders JOIN customer ON c_custkey = o_custkey) WHERE pos = 1), x AS (SELECT *, lead(label) OVER (PARTITION BY mo ORDER BY y) AS next FROM q) SELECT y AS year, label, next, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def s9_ribbons(spark, sf):
    """How many entities go from one type to the next, period by period; no next type in an entity's last period."""
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("mo"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label"), "o_totalprice", "o_orderkey")
    q = P.keep_first(o, ["mo", "year"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return q.withColumn("next", F.lead("label").over(Window.partitionBy("mo").orderBy("year"))).groupBy("year", "label", "next").agg(F.count(F.lit(1)).alias("n"))


@query()
def j15_one_to_one(spark, sf):
    """Names of two lists paired one to one, the most similar first, from a ratio of 0.6 on."""
    refs = load(spark, sf, "place_refs").where("kind <> 'locality'").select(F.col("place_id").alias("b"), F.lower("name").alias("n"))
    keys = load(spark, sf, "municipalities").select(F.col("mo_id").alias("a"), F.lower(F.regexp_replace("name", "^(ГО город|МР) ", "")).alias("v"))
    return N.greedy_pairs(N.name_ratios(keys, "a", "v", refs, "b", "n", 0.6))
