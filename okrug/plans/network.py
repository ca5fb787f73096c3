"""Queries over layers of similarity, graphs, clusters and their validity, dynamics, statistics and indices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from okrug.operators import graph as G
from okrug.operators import kernels as X
from okrug.operators import network as N
from okrug.operators import panel as P
from okrug.operators import stats as T
from okrug.operators import validity as V
from okrug.plans.base import K, contracts, r, registry
from okrug.session import load, small, written

QUERIES, ORACLE, query = registry()

FLOW = f"""{K}, f AS (SELECT supplier_mo AS src, customer_mo AS dst, sum(price) AS w FROM k WHERE supplier_mo <> customer_mo GROUP BY 1, 2),
 o AS (SELECT src, greatest(sum(w), 1) AS o FROM f GROUP BY 1), i AS (SELECT dst, greatest(sum(w), 1) AS i FROM f GROUP BY 1), n AS (SELECT f.src, f.dst, w / sqrt(o * i) AS w FROM f JOIN o ON o.src = f.src JOIN i ON i.dst = f.dst),
 s AS (SELECT src, dst, ln(1 + 1000 * sum(w)) AS w FROM (SELECT src, dst, w FROM n UNION ALL SELECT dst, src, w FROM n) GROUP BY 1, 2), flow AS (SELECT src, dst, w / (SELECT max(w) FROM s) AS w FROM s)"""
KNN = "best AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS pos FROM flow WHERE w > 0) WHERE pos <= 4), net AS (SELECT DISTINCT src, dst, w FROM (SELECT src, dst, w FROM best UNION ALL SELECT dst, src, w FROM best))"
LAB = "lab AS (SELECT n_nationkey AS node, n_regionkey AS label FROM nation)"


def _flows(spark, sf):
    # a few rows a pair of entities: written once, since everything after reads it several times
    return written(_flow_sums(spark, sf), "flows")


def _flow_sums(spark, sf):
    return contracts(spark, sf).groupBy(F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst")).agg(F.sum("price").alias("w"))


def _net(spark, sf):
    return written(N.knn(N.flow_layer(_flows(spark, sf)), 4), "network")


def _labels(spark, sf):
    return load(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("label"))


@query(f"WITH {FLOW} SELECT src, dst, round(w, 6) AS w FROM flow")
def n8_flow_layer(spark, sf):
    return N.flow_layer(_flows(spark, sf)).select("src", "dst", r("w", 6))


@query(f"WITH {FLOW}, {KNN} SELECT src, dst, round(w, 6) AS w FROM net")
def n1_knn_flow(spark, sf):
    return _net(spark, sf).select("src", "dst", r("w", 6))


MEANS = "m AS (SELECT label AS mo, list(v ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
@query(f"WITH {MEANS} SELECT a.mo AS src, b.mo AS dst, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 5) AS w FROM m a JOIN m b ON a.mo < b.mo")
def n2_cosine_layer(spark, sf):
    m = V.centroids(load(spark, sf, "embeddings"), "label", F.col("embedding").cast("array<double>")).select(F.col("label").alias("mo"), F.col("c").alias("v"))
    return N.cosine_layer(m, "mo", "v").select("src", "dst", r("w", 5))


RES = f"{K}, m AS (SELECT customer_mo AS mo, year(d) * 12 + month(d) AS t, ln(sum(price)) AS y FROM k GROUP BY 1, 2), e AS (SELECT mo, t, y - avg(y) OVER (PARTITION BY t) AS res FROM m)"


def _residuals(spark, sf):
    m = written(contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo"), (F.year("d") * 12 + F.month("d")).alias("t")).agg(F.ln(F.sum("price")).alias("y")), "monthly")
    return P.demeaned(m, "t", "y", "res")


@query(f"WITH {RES}, x AS (SELECT mo, t, res - lag(res) OVER (PARTITION BY mo ORDER BY t) AS d FROM e) SELECT a.mo AS src, b.mo AS dst, round(coalesce(corr(a.d, b.d), 0), 5) AS w FROM x a JOIN x b ON a.t = b.t AND a.mo < b.mo WHERE a.d IS NOT NULL AND b.d IS NOT NULL GROUP BY 1, 2")
def n4_comovement(spark, sf):
    return N.comovement(P.difference(_residuals(spark, sf), "mo", "t", "res", "d"), "mo", "t", "d").select("src", "dst", r("w", 5))


@query(f"""WITH {RES}, z AS (SELECT mo, t, (res - avg(res) OVER (PARTITION BY mo)) / (stddev_pop(res) OVER (PARTITION BY mo) + 1e-12) AS z FROM e), l AS (SELECT unnest([1, 2, 3]) AS lag), c AS (SELECT a.mo AS src, b.mo AS dst, lag, sum(a.z * b.z) / (80 - lag) AS w FROM z a JOIN l ON true JOIN z b ON b.t = a.t + lag AND a.mo <> b.mo GROUP BY 1, 2, 3),
 k2 AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w DESC, lag) AS pos FROM c WHERE w > 0) SELECT src, dst, round(w, 5) AS w, CAST(lag AS INT) AS lag FROM k2 WHERE pos = 1""")
def n5_lead_lag(spark, sf):
    z = P.zscores(_residuals(spark, sf), "mo", "res", "z")
    return N.lead_lag(z, "mo", "t", "z", 3, 80).select("src", "dst", r("w", 5), "lag")


@query()
def n7_dtw_similarity(spark, sf):
    s = _residuals(spark, sf).groupBy("mo").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "res"))), lambda x: x.res).alias("v"))
    return N.gaussian(N.dtw_distances(s, "mo", "v", 3)).select("src", "dst", r("w", 5))


@query(f"""WITH {FLOW}, a AS (SELECT x.n_nationkey AS src, y.n_nationkey AS dst, 1.0 AS w FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey), u AS (SELECT src, dst, 0.5 * w AS w FROM a UNION ALL SELECT src, dst, 0.5 * w FROM flow), g AS (SELECT src, dst, sum(w) AS w FROM u GROUP BY 1, 2) SELECT src, dst, round(w / (SELECT max(w) FROM g), 6) AS w FROM g""")
def n9_fuse(spark, sf):
    n = _labels(spark, sf)
    same = n.select(F.col("node").alias("src"), "label").join(n.select(F.col("node").alias("dst"), "label"), "label").where("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))
    return N.fuse(same, {"flow": (N.flow_layer(_flows(spark, sf)), 1.0)}, 0.5).select("src", "dst", r("w", 6))


@query(f"WITH d AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, CAST(abs(a.n_nationkey - b.n_nationkey) AS DOUBLE) AS w FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) SELECT src, dst, round(exp(-pow(w / (SELECT median(w) FROM d), 2)), 6) AS w FROM d")
def n11_distance_similarity(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("mo"))
    d = N.pairs_of(n, "mo", []).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.abs(F.col("i") - F.col("j")).cast("double").alias("w"))
    return N.gaussian(d).select("src", "dst", r("w", 6))


@query()
def n12_map_layout(spark, sf):
    names, w = G.dense(N.flow_layer(_flows(spark, sf)))
    d = np.where(w > 0, 1 / np.maximum(w, 1e-3), 1e3)
    np.fill_diagonal(d, 0)
    return spark.createDataFrame([(int(n), float(a), float(b)) for n, (a, b) in zip(names, X.mds((d + d.T) / 2))], "node int, x double, y double")


# --- graph ------------------------------------------------------------------------------------------------------------------
@query(f"WITH {FLOW}, {KNN} SELECT src AS node, round(sum(w), 6) AS degree, count(*) AS neighbours FROM net GROUP BY 1")
def g3_degrees(spark, sf):
    return G.degrees(_net(spark, sf)).select("node", r("degree", 6), "neighbours")


@query(f"""WITH RECURSIVE {K}, f AS (SELECT customer_mo AS src, supplier_mo AS dst, sum(price) AS w FROM k WHERE supplier_mo <> customer_mo GROUP BY 1, 2), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM f), nodes AS (SELECT src AS node FROM f UNION SELECT dst FROM f), c AS (SELECT count(*)::DOUBLE AS n FROM nodes),
 m AS (SELECT a.node AS src, b.node AS dst, 0.15 / n + 0.85 * CASE WHEN a.node IN (SELECT src FROM s) THEN coalesce(s, 0) ELSE 1 / n END AS p FROM nodes a JOIN nodes b ON true JOIN c ON true LEFT JOIN s ON s.src = a.node AND s.dst = b.node),
 r AS (SELECT 0 AS i, node, 1 / n AS rank FROM nodes, c UNION ALL SELECT i + 1, m.dst, sum(m.p * r.rank) FROM r JOIN m ON m.src = r.node WHERE i < 150 GROUP BY i, m.dst) SELECT node, round(rank, 6) AS rank FROM r WHERE i = 150""")
def g1_pagerank(spark, sf):
    """Money flows from customers to their suppliers."""
    paid = _flows(spark, sf).where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return G.pagerank(paid).select("node", r("rank", 6))


@query()
def g2_betweenness(spark, sf):
    names, w = G.dense(_net(spark, sf))
    return spark.createDataFrame([(int(n), float(b)) for n, b in zip(names, X.betweenness(w))], "node int, betweenness double")


@query()
def g6_backbone(spark, sf):
    names, w = G.dense(_net(spark, sf))
    edges = [(float(w[i, j]), i, j) for i in range(len(w)) for j in range(i + 1, len(w)) if w[i, j] > 0]
    return spark.createDataFrame([(int(names[i]), int(names[j]), x) for i, j, x in X.spanning_tree(len(w), edges)], "src int, dst int, w double")


@query(f"WITH {K}, f AS (SELECT supplier_mo AS src, customer_mo AS dst, sum(price) AS w, count(*) AS n FROM k WHERE supplier_mo <> customer_mo GROUP BY 1, 2) SELECT src, dst, round(w, 2) AS w, n FROM f ORDER BY w DESC, src, dst LIMIT 150")
def s4_top_flows(spark, sf):
    f = contracts(spark, sf).where("supplier_mo <> customer_mo").groupBy(F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst")).agg(F.sum("price").alias("w"), F.count(F.lit(1)).alias("n"))
    return f.orderBy(F.col("w").desc(), "src", "dst").limit(150).select("src", "dst", r("w", 2), "n")


# --- clusters and validity ----------------------------------------------------------------------------------------------------
def _clusters(name, run):
    def f(spark, sf):
        names, w = G.dense(_net(spark, sf))
        return spark.createDataFrame([(int(n), int(c)) for n, c in zip(names, run(w))], "node int, cluster int")

    f.__name__ = name
    query()(f)


_clusters("c1_kmeans", lambda w: X.kmeans(w, 5))
_clusters("c2_ward", lambda w: X.ward(w, 5))
_clusters("c3_gaussian_mixture", lambda w: X.gaussian_mixture(w, 5))
_clusters("c4_spectral", lambda w: X.spectral(w.copy(), 5))
_clusters("c5_louvain", lambda w: X.louvain(w))
_clusters("c6_louvain_resolution", lambda w: min((X.louvain(w, g) for g in np.linspace(0.3, 3.0, 28)), key=lambda c: abs(c.max() + 1 - 5)))


EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
CEN = "c AS (SELECT label, list(m ORDER BY pos) AS c, max(n) AS n FROM (SELECT label, pos, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY 1)"


def _points(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"""WITH {EMB}, d AS (SELECT a.vec_id, a.label, b.label AS g, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM e a JOIN e b ON true GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, max(CASE WHEN g = label AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN g <> label THEN t / n END) AS b FROM d GROUP BY 1, 2) SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 4) AS s FROM s""")
def v1_silhouettes(spark, sf):
    return V.silhouettes(_points(spark, sf), "vec_id", "label", "v").select("vec_id", "label", r("s"))


@query(f"""WITH {EMB}, {CEN}, g AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1)), b AS (SELECT sum(n * pow(list_distance(c, m), 2)) AS b, count(*) AS k, sum(n) AS n FROM c, g), w AS (SELECT sum(pow(list_distance(v, c), 2)) AS w FROM e JOIN c ON c.label = e.label) SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS ch FROM b, w""")
def v2_calinski_harabasz(spark, sf):
    return V.calinski_harabasz(_points(spark, sf), "label", "v").select(r("ch"))


@query(f"""WITH {EMB}, {CEN}, s AS (SELECT e.label, avg(list_distance(v, c)) AS s FROM e JOIN c ON c.label = e.label GROUP BY 1), x AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1) SELECT round(avg(r), 4) AS db FROM x""")
def v3_davies_bouldin(spark, sf):
    return V.davies_bouldin(_points(spark, sf), "label", "v").select(r("db"))


@query(f"WITH {FLOW}, {KNN}, {LAB}, e AS (SELECT a.label AS ls, b.label AS ld, w FROM net JOIN lab a ON a.node = src JOIN lab b ON b.node = dst) SELECT round((SELECT sum(w) FROM e WHERE ls = ld) / (SELECT sum(w) FROM e) - (SELECT sum(d * d) FROM (SELECT sum(w) AS d FROM e GROUP BY ls)) / pow((SELECT sum(w) FROM e), 2), 6) AS q")
def v5_modularity(spark, sf):
    return V.modularity(_net(spark, sf), _labels(spark, sf)).select(r("q", 6))


@query(f"""WITH {FLOW}, {KNN}, {LAB}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), e AS (SELECT a.label AS ls, b.label AS ld, w FROM net JOIN lab a ON a.node = src JOIN lab b ON b.node = dst), p AS (SELECT ls, coalesce(sum(w) FILTER (ls = ld), 0) AS i, coalesce(sum(w) FILTER (ls <> ld), 0) AS o FROM e GROUP BY 1), d AS (SELECT i / (i + o) AS s, i / (n * (n - 1)) AS di, o / (n * (25 - n)) AS ds FROM p JOIN c ON label = ls)
 SELECT round(avg(s), 6) AS avi, round(avg(di / (di + ds)), 6) AS avu FROM d""")
def v6_isolation(spark, sf):
    return V.isolation(_net(spark, sf), _labels(spark, sf), compat=True).select(r("avi", 6), r("avu", 6))


@query("""WITH p AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders), x AS (SELECT sum(n * (n - 1) / 2.0) AS x, sum(n) AS n FROM (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2)), y AS (SELECT sum(n * (n - 1) / 2.0) AS r FROM (SELECT a, count(*) AS n FROM p GROUP BY 1)), z AS (SELECT sum(n * (n - 1) / 2.0) AS c FROM (SELECT b, count(*) AS n FROM p GROUP BY 1)) SELECT round((x - r * c / (n * (n - 1) / 2.0)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2.0)), 8) AS ari FROM x, y, z""")
def v10_adjusted_rand(spark, sf):
    return V.adjusted_rand(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(r("ari", 8))


@query()
def v8_permutation_null(spark, sf):
    names, w = G.dense(_net(spark, sf))
    label = {x["node"]: x["label"] for x in _labels(spark, sf).collect()}

    def inside(lab):
        return float(w[lab[:, None] == lab[None]].sum() / w.sum())

    return V.permutation_z(spark, inside, np.array([label[n] for n in names]))


@query(f"""WITH q AS (SELECT c_mktsegment AS type, median(c_acctbal) AS m FROM customer GROUP BY 1), a AS (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer) SELECT type, round((q.m - a.m) / iqr, 6) AS effect FROM q, a""")
def v16_type_signature(spark, sf):
    c = load(spark, sf, "customer")
    whole = P.wide_quartiles(c, [], "c_acctbal").select(F.col("median").alias("m"), (F.col("q3") - F.col("q1")).alias("iqr"))
    return c.groupBy(F.col("c_mktsegment").alias("type")).agg(F.median("c_acctbal").alias("t")).join(F.broadcast(whole)).select("type", F.round((F.col("t") - F.col("m")) / F.col("iqr"), 6).alias("effect"))


# --- design matrix, statistics, models ------------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS i FROM customer) SELECT c_custkey AS id, round(least(4.0, greatest(-4.0, (c_acctbal - m) / i)), 6) AS x FROM customer, q""")
def x2_robust_scale(spark, sf):
    c = load(spark, sf, "customer")
    q = P.wide_quartiles(c, [], "c_acctbal")
    x = (F.col("c_acctbal") - F.col("median")) / (F.col("q3") - F.col("q1"))
    return c.join(F.broadcast(q)).select(F.col("c_custkey").alias("id"), F.round(F.least(F.lit(4.0), F.greatest(F.lit(-4.0), x)), 6).alias("x"))


def _metrics(spark, sf):
    c = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo")).agg(F.sum("price").alias("volume"), F.avg("price").alias("mean"), F.countDistinct("supplier_mo").cast("double").alias("reach"), F.countDistinct("custkey").cast("double").alias("customers"))
    return c.select("mo", F.explode(F.create_map(*[x for m in ("volume", "mean", "reach", "customers") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


@query(f"""WITH {K}, m AS (SELECT customer_mo AS mo, sum(price) AS volume, avg(price) AS mean, CAST(count(DISTINCT custkey) AS DOUBLE) AS customers FROM k GROUP BY 1), l AS (UNPIVOT m ON volume, mean, customers INTO NAME metric VALUE v), rk AS (SELECT mo, metric, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM l)
 SELECT a.metric AS x, b.metric AS y, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM rk a JOIN rk b ON a.mo = b.mo AND a.metric < b.metric GROUP BY 1, 2""")
def t1_spearman(spark, sf):
    return T.spearman_pairs(_metrics(spark, sf).where("metric <> 'reach'"), "mo", "metric", "value").select("x", "y", "n", r("rho", 6))


@query()
def t1_spearman_tests(spark, sf):
    return T.spearman_pairs(_metrics(spark, sf), "mo", "metric", "value")


@query("""WITH s AS (SELECT c_nationkey AS mo, year(o_orderdate) * 12 + month(o_orderdate) AS t, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), l AS (SELECT unnest([-2, -1, 0, 1, 2]) AS lag), j AS (SELECT a.mo, lag, a.x, b.y FROM s a JOIN l ON true JOIN s b ON b.mo = a.mo AND b.t = a.t + lag) SELECT * FROM (SELECT mo, CAST(lag AS INT) AS lag, count(*) AS n, round(corr(x, y), 5) AS r FROM j GROUP BY 1, 2 HAVING count(*) >= 10) WHERE r IS NOT NULL AND NOT isnan(r)""")
def t3_lagged_correlation(spark, sf):
    s = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("mo"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("o_totalprice").alias("y"))
    return T.lagged_correlation(s, "mo", "t", "x", "y", 2).select("mo", "lag", "n", r("r", 5))


@query("""WITH x AS (SELECT c_mktsegment AS g, floor(c_acctbal / 50) AS v FROM customer), k AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x), p AS (SELECT g, sum(r) AS s, count(*) AS c FROM k GROUP BY 1), t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM x GROUP BY v)), n AS (SELECT CAST(sum(c) AS DOUBLE) AS n, sum(s * s / c) AS ss FROM p)
 SELECT 'acctbal' AS metric, CAST(n AS BIGINT) AS n, round((12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h FROM n, t""")
def t4_kruskal(spark, sf):
    x = load(spark, sf, "customer").select(F.lit("acctbal").alias("metric"), F.col("c_mktsegment").alias("g"), F.floor(F.col("c_acctbal") / 50).alias("v"))
    return T.kruskal_wallis(x, "metric", "g", "v").select("metric", "n", r("h", 6))


@query(f"""WITH {EMB}, tr AS (SELECT * FROM e WHERE vec_id % 5 <> 0), c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM tr) GROUP BY 1, 2) GROUP BY 1), d AS (SELECT vec_id, e.label, c.label AS g, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), c.label) AS pos FROM e, c) SELECT vec_id % 5 = 0 AS held_out, count(*) AS n, round(avg(CASE WHEN label = g THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM d WHERE pos = 1 GROUP BY 1""")
def t7_nearest_centroid(spark, sf):
    p = _points(spark, sf)
    held = F.col("vec_id") % 5 == 0  # a hold-out is what this operator measures; every row is classified
    centres = V.centroids(p.where(~held), "label", "v")
    said = T.nearest_centroid(p, centres, "vec_id", "v", "label").withColumnRenamed("label", "said")
    return p.join(said, "vec_id").groupBy(held.alias("held_out")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("said")).cast("double")), 6).alias("accuracy"))


@query(f"""WITH {EMB}, d AS (SELECT a.vec_id, b.vec_id AS analog, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, analog) AS INT) AS rank FROM d) SELECT vec_id, analog, round(dist, 4) AS dist, rank FROM k WHERE rank <= 3""")
def m4_analogs(spark, sf):
    p = _points(spark, sf)
    return V.nearest_rows(p, "vec_id", "label", "v", 3).select("vec_id", "analog", r("dist"), "rank")


@query("""WITH m AS (SELECT c_mktsegment AS type, median(c_acctbal) AS med FROM customer GROUP BY 1), x AS (SELECT c_custkey AS id, c_mktsegment AS type, c_acctbal - med AS off FROM customer JOIN m ON type = c_mktsegment WHERE abs(c_acctbal - med) > 5000), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY abs(off) DESC, id) AS INT) AS rank FROM x) SELECT id, type, round(off, 3) AS off, rank FROM k WHERE rank <= 5""")
def i2_anomalies(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), "c_acctbal")
    m = c.groupBy("type").agg(F.median("c_acctbal").alias("med"))
    off = c.join(small(m), "type").withColumn("off", F.col("c_acctbal") - F.col("med")).where("abs(off) > 5000")
    return P.top_k(off, ["type"], [F.abs("off").desc(), F.col("id")], 5).select("id", "type", r("off", 3), "rank")


@query(f"""WITH {K}, m AS (SELECT customer_mo AS mo, sum(price) AS volume, avg(price) AS mean FROM k GROUP BY 1), p AS (SELECT mo, (rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0) / count(*) OVER () * 100 AS a, (rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0) / count(*) OVER () * 100 AS b FROM m) SELECT mo, round((a + b) / 2, 4) AS index FROM p""")
def i1_percentile_index(spark, sf):
    p = P.rank_percent(_metrics(spark, sf).where("metric IN ('volume', 'mean')"), ["metric"], "value", "pct")
    return p.groupBy("mo").agg(F.round(F.avg("pct"), 4).alias("index"))


# --- dynamics -------------------------------------------------------------------------------------------------------------------
@query()
def d1_evolution(spark, sf):
    """Yearly networks smoothed over time, clustered, labels aligned with the year before."""
    f = contracts(spark, sf).groupBy(F.year("d").alias("y"), F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst")).agg(F.sum("price").alias("w"))
    years = sorted(x[0] for x in f.select("y").distinct().collect())  # a handful of periods
    names, _ = G.dense(f.select("src", "dst", "w"))
    at, smooth, before, rows = {n: i for i, n in enumerate(names)}, None, None, []
    per = {y: np.zeros((len(names), len(names))) for y in years}
    for y, s, d, w in f.toLocalIterator():
        per[y][at[s], at[d]] += w
    for y in years:
        w = np.log1p(per[y] + per[y].T)
        np.fill_diagonal(w, 0)
        smooth = w if smooth is None else 0.5 * w + 0.5 * smooth
        lab = X.ward(smooth, min(5, len(names)))
        lab = lab if before is None else X.align(before, lab)
        rows += [(int(y), int(n), int(c)) for n, c in zip(names, lab)]
        before = lab
    return spark.createDataFrame(rows, "year int, node int, cluster int")


@query("""WITH q AS (SELECT c_nationkey AS mo, year(o_orderdate) AS y, first(o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS label FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), x AS (SELECT mo, y, label, lead(label) OVER (PARTITION BY mo ORDER BY y) AS nxt FROM q), t AS (SELECT label AS a, nxt AS b, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2) SELECT round(coalesce(sum(n) FILTER (a = b), 0) / sum(n), 6) AS stay, CAST(sum(n) AS BIGINT) AS moves FROM t""")
def s8_stay_share(spark, sf):
    q = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("mo"), F.year("o_orderdate").alias("y")).agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("label"))
    t = P.transitions(q, "mo", "y", "label")
    return t.agg(F.round(F.coalesce(F.sum(F.when(F.col("from_label") == F.col("to_label"), F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("stay"), F.sum("n").alias("moves"))
