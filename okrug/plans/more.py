"""Further analytics: sensitivity and stability of clusterings, profiles, partial correlations, model explanations, lists of the dashboard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from okrug.operators import graph as G
from okrug.operators import kernels as X
from okrug.operators import network as N
from okrug.operators import panel as P
from okrug.operators import stats as T
from okrug.operators import validity as V
from okrug.plans import network as Q
from okrug.plans.base import K, contracts, r, registry
from okrug.session import load, small

QUERIES, ORACLE, query = registry()


# --- validity, sensitivity, stability ---------------------------------------------------------------------------------------------
@query(f"""WITH {Q.EMB}, {Q.CEN}, f AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), sig AS (SELECT label, sqrt(sum(s * s)) AS sig FROM (SELECT label, pos, var_pop(x) AS s FROM f GROUP BY 1, 2) GROUP BY 1), a AS (SELECT sqrt(sum(s * s)) AS whole FROM (SELECT pos, var_pop(x) AS s FROM f GROUP BY 1)), sd AS (SELECT avg(sig) AS m, sqrt(sum(sig)) / count(*) AS sd FROM sig),
 p AS (SELECT x.label AS i, y.label AS j, x.c AS ci, y.c AS cj, list_transform(list_zip(x.c, y.c), lambda z: (z[1] + z[2]) / 2) AS u FROM c x JOIN c y ON x.label < y.label), d AS (SELECT i, j, count(*) FILTER (list_distance(v, u) <= sd) AS u, count(*) FILTER (list_distance(v, ci) <= sd) AS a, count(*) FILTER (list_distance(v, cj) <= sd) AS b FROM e JOIN p ON label = i OR label = j JOIN sd ON true GROUP BY 1, 2) SELECT round(m / (whole + 1e-12) + (SELECT avg(CASE WHEN greatest(a, b) > 0 THEN u / greatest(a, b) ELSE 0 END) FROM d), 5) AS s_dbw FROM sd, a""")
def v4_s_dbw(spark, sf):
    return V.s_dbw(Q._points(spark, sf), "label", "v").select(r("s_dbw", 5))


@query(f"WITH {Q.FLOW}, {Q.KNN}, {Q.LAB}, e AS (SELECT a.label AS a, b.label AS b, sum(w) AS w FROM net JOIN lab a ON a.node = src JOIN lab b ON b.node = dst GROUP BY 1, 2), p AS (SELECT a, sum(w) AS al, coalesce(sum(w) FILTER (a = b), 0) AS ins FROM e GROUP BY 1) SELECT round((SELECT avg(ins / al) FROM p), 6) AS avi, round((SELECT sum(w / (x.al - x.ins + y.al - y.ins - w)) FROM e JOIN p x ON x.a = e.a JOIN p y ON y.a = e.b WHERE e.a <> e.b) / (SELECT count(*) FROM p), 6) AS avu")
def v6b_isolation(spark, sf):
    return V.isolation(Q._net(spark, sf), Q._labels(spark, sf)).select(r("avi", 6), r("avu", 6))


@query()
def v11_agreement_matrix(spark, sf):
    """Adjusted Rand index of each two methods on one network."""
    names, w = G.dense(Q._net(spark, sf))
    labels = {"kmeans": X.kmeans(w, 5), "ward": X.ward(w, 5), "spectral": X.spectral(w.copy(), 5), "louvain": X.louvain(w)}
    rows = [(a, b, int(n), int(x), int(y)) for a in labels for b in labels for n, x, y in zip(names, labels[a], labels[b]) if a < b]
    d = spark.createDataFrame(rows, "a string, b string, node int, x int, y int")
    two = lambda n: n * (n - 1) / 2
    n = F.count(F.lit(1)).alias("n")
    cell = d.groupBy("a", "b", "x", "y").agg(n).groupBy("a", "b").agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("all"))
    x, y = (d.groupBy("a", "b", c).agg(n).groupBy("a", "b").agg(F.sum(two(F.col("n"))).alias(f"s{c}")) for c in "xy")
    e = F.col("sx") * F.col("sy") / two(F.col("all"))
    return cell.join(x, ["a", "b"]).join(y, ["a", "b"]).select("a", "b", F.coalesce(F.try_divide(F.col("s") - e, (F.col("sx") + F.col("sy")) / 2 - e), F.lit(1.0)).alias("ari"))


def _fan_out(spark, n: int, schema: str, one):
    """`one`(replicate) -> rows, for replicates 0..n-1, spread over the cluster; each draws from a seed of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for i in batch["id"] for x in one(int(i))], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(n).repartition(min(n, 32)).mapInPandas(run, schema)


@query()
def v12_alpha_sensitivity(spark, sf):
    """Labels over a grid of the attribute layer's weight."""
    names, w = G.dense(Q._net(spark, sf))
    region = {x["node"]: x["label"] for x in Q._labels(spark, sf).collect()}
    same = np.array([[float(region[a] == region[b] and a != b) for b in names] for a in names])
    alphas = [0.0, 0.25, 0.5, 0.75, 1.0]

    def one(i):
        lab = X.ward(alphas[i] * same + (1 - alphas[i]) * w, 5)
        return [(alphas[i], int(n), int(c)) for n, c in zip(names, lab)]

    return _fan_out(spark, len(alphas), "alpha double, node int, cluster int", one)


def _co_assignment(spark, names, w, labels, replicates: int, share: float, k: int):
    """(a, b, together) for each replicate and pair of nodes drawn in it, and (id, ari) of its labels against `labels`: which nodes a replicate holds is told by the least random keys."""
    size = max(k + 1, round(share * len(names)))

    def drawn(i):
        keys = np.random.default_rng(np.random.SeedSequence(7, spawn_key=(i,))).random(len(names))
        held = np.flatnonzero(keys <= np.partition(keys, size - 1)[size - 1])
        return held, X.spectral(w[np.ix_(held, held)], k)

    def pairs(i):
        held, own = drawn(i)
        return [(int(names[x]), int(names[y]), bool(own[p] == own[q]), bool(labels[x] == labels[y])) for p, x in enumerate(held) for q, y in enumerate(held) if p != q]

    def agreement(i):
        held, own = drawn(i)
        return [(i, X.rand_index(labels[held], own))]

    return _fan_out(spark, replicates, "a int, b int, together boolean, same boolean", pairs), _fan_out(spark, replicates, "id int, ari double", agreement)


@query()
def v14_bootstrap(spark, sf):
    """Per node, over 200 replicates on 80 % of the nodes, how often others of its type stay with it (not counting itself), and the mean agreement of the replicates with the whole."""
    names, w = G.dense(Q._net(spark, sf))
    pairs, agreement = _co_assignment(spark, names, w, X.spectral(w.copy(), 5), 200, 0.8, 5)
    stay = pairs.where("same").groupBy("a", "b").agg(F.avg(F.col("together").cast("double")).alias("p"))
    mean = agreement.agg(F.round(F.avg("ari"), 6).alias("mean_ari"))
    return stay.groupBy(F.col("a").alias("node")).agg(F.round(F.avg("p"), 6).alias("stability")).join(F.broadcast(mean))


@query()
def a22_co_assignment(spark, sf):
    """The share of replicates in which two nodes have one type, of those that hold both."""
    names, w = G.dense(Q._net(spark, sf))
    pairs, _ = _co_assignment(spark, names, w, X.spectral(w.copy(), 5), 200, 0.8, 5)
    return pairs.groupBy("a", "b").agg(F.round(F.avg(F.col("together").cast("double")), 6).alias("share"), F.count(F.lit(1)).alias("replicates"))


@query()
def v15_compactness(spark, sf):
    """Mean distance within types, from a table of distances, against shuffled types; pairs without a distance don't count."""
    names, w = G.dense(Q._net(spark, sf))
    road = {(x["src"], x["dst"]): x["w"] for x in n10_distances(spark, sf).collect()}  # pairs of a dimension whose size dense() has checked
    d = np.array([[road.get((a, b)) or np.nan for b in names] for a in names], float)

    def closeness(lab):
        inside = [np.nanmean(x) for c in np.unique(lab) if np.isfinite(x := d[np.ix_(lab == c, lab == c)]).any()]
        return -float(np.mean(inside)) if inside else 0.0

    return V.permutation_z(spark, closeness, X.ward(w, 5), 1000)


def n10_distances(spark, sf):
    """Distances of entities as an input: the mean price of what they trade stands in for kilometres."""
    roads = contracts(spark, sf).groupBy(F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst")).agg(F.avg("price").alias("w"), F.lit("road").alias("type"))
    return N.road_distance(roads, load(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), "road")


@query()
def v9_select_k(spark, sf):
    """The k whose modularity stands out most from shuffled labels, among those whose least cluster has two nodes."""
    names, w = G.dense(Q._net(spark, sf))
    q = lambda lab: X.modularity(w, lab)

    def one(i):
        lab, rng = X.ward(w, i + 3), np.random.default_rng([0, i])
        null = [q(rng.permutation(lab)) for _ in range(40)]
        return [(i + 3, int(np.bincount(lab).min()), q(lab), (q(lab) - np.mean(null)) / (np.std(null) or 1.0))]

    grid = _fan_out(spark, 6, "k int, least int, modularity double, z double", one)
    return grid.withColumn("place", F.row_number().over(Window.orderBy((F.col("least") >= 2).desc(), F.col("z").desc(), "k")))


# --- design matrix, statistics, models ----------------------------------------------------------------------------------------------
@query()
def x3_design_matrix(spark, sf):
    """Entity features: logs, zero fill with a coverage flag, imputation by neighbours, robust scale, clip."""
    c = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo")).agg(F.sum("price").alias("volume"), F.avg("price").alias("mean"), F.sum(F.when(F.col("single_supplier"), F.col("price"))).alias("single"), F.countDistinct("supplier_mo").alias("reach"))
    t = load(spark, sf, "nation").select(F.col("n_nationkey").alias("mo")).join(c, "mo", "left").orderBy("mo")
    if t.count() > X.MOST_NODES:
        raise ValueError("imputation by neighbours is for small tables")
    d = t.toPandas()
    x = np.column_stack([np.log(d["volume"].clip(lower=1).astype(float)), np.log(d["mean"].clip(lower=1).astype(float)), d["single"].astype(float).fillna(0), d["reach"].astype(float)])
    missing = np.isnan(x).any(1)
    x = X.knn_impute(x, 5)
    q1, m, q3 = np.percentile(x, [25, 50, 75], axis=0)
    z = np.clip((x - m) / np.where(q3 > q1, q3 - q1, 1), -4, 4)
    return spark.createDataFrame([(int(a), bool(b), [float(v) for v in row]) for a, b, row in zip(d["mo"], missing, z)], "mo int, imputed boolean, x array<double>")


@query(f"""WITH {K}, m AS (SELECT customer_mo AS mo, sum(price) AS a, avg(price) AS b, CAST(count(DISTINCT custkey) AS DOUBLE) AS z FROM k GROUP BY 1), rk AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}' for c in 'abz')} FROM m), s AS (SELECT corr(a, b) AS ab, corr(a, z) AS az, corr(b, z) AS bz, count(*) AS n FROM rk) SELECT n, round((ab - az * bz) / sqrt((1 - az * az) * (1 - bz * bz)), 6) AS rho FROM s""")
def t2_partial_rank(spark, sf):
    m = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo")).agg(F.sum("price").alias("a"), F.avg("price").alias("b"), F.countDistinct("custkey").cast("double").alias("z"))
    long = m.select("mo", F.explode(F.create_map(*[x for c in "abz" for x in (F.lit(c), F.col(c))])).alias("c", "v")).withColumn("g", F.lit(1))
    rk = P.average_rank(long, ["c"], "v", "rank").groupBy("mo").pivot("c", ["a", "b", "z"]).agg(F.first("rank"))
    s = rk.agg(F.count(F.lit(1)).alias("n"), *[F.corr(x, y).alias(x + y) for x, y in ("ab", "az", "bz")])
    return s.select("n", F.round(T.partial_correlation(F.col("ab"), F.col("az"), F.col("bz")), 6).alias("rho"))


@query(f"""WITH {Q.EMB}, f AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), g AS (SELECT DISTINCT label AS type FROM e) SELECT type, CAST(pos - 1 AS INT) AS feature, round(median(x) FILTER (label = type) - median(x) FILTER (label <> type), 5) AS effect FROM f, g GROUP BY 1, 2""")
def m3_type_signature(spark, sf):
    f = Q._points(spark, sf).select("label", F.posexplode("v").alias("feature", "x"))
    types = V.few(Q._points(spark, sf).select(F.col("label").alias("type")).distinct())
    met = f.join(types)
    med = met.groupBy("type", "feature").agg(F.median(F.when(F.col("label") == F.col("type"), F.col("x"))).alias("i"), F.median(F.when(F.col("label") != F.col("type"), F.col("x"))).alias("o"))
    return med.select("type", "feature", F.round(F.col("i") - F.col("o"), 5).alias("effect"))


# --- networks and profiles --------------------------------------------------------------------------------------------------------------
@query(f"""WITH {Q.RES}, z AS (SELECT mo, t, (res - avg(res) OVER (PARTITION BY mo)) / (stddev_pop(res) OVER (PARTITION BY mo) + 1e-12) AS z FROM e), l AS (SELECT unnest([1, 2, 3]) AS lag), c AS (SELECT a.mo AS src, b.mo AS dst, lag, sum(a.z * b.z) / (80 - lag) AS w FROM z a JOIN l ON true JOIN z b ON b.t = a.t + lag AND a.mo <> b.mo GROUP BY 1, 2, 3), x AS (SELECT src, dst, w, lag FROM c WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY w DESC, lag) = 1)
 SELECT src AS leader, dst AS follower, CAST(lag AS INT) AS lag, round(w, 5) AS w FROM x ORDER BY round(w, 5) DESC, leader, follower LIMIT 30""")
def s3_lead_lag_top(spark, sf):
    """The strongest pairs with their leader and follower."""
    z = P.zscores(Q._residuals(spark, sf), "mo", "res", "z")
    e = N.lead_lag(z, "mo", "t", "z", 3, 80)
    best = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("w", F.col("src").alias("leader"), F.col("dst").alias("follower"), "lag").alias("x")).groupBy("a", "b").agg(F.max("x").alias("x"))
    return best.select("x.leader", "x.follower", "x.lag", F.round("x.w", 5).alias("w")).orderBy(F.col("w").desc(), "leader", "follower").limit(30)


@query(f"WITH {Q.FLOW}, {Q.KNN} SELECT 'flow' AS layer, src AS source, dst AS target, round(w, 6) AS weight FROM net WHERE src < dst")
def n15_edge_export(spark, sf):
    return Q._net(spark, sf).where("src < dst").select(F.lit("flow").alias("layer"), F.col("src").alias("source"), F.col("dst").alias("target"), r("w", 6, "weight"))


@query("SELECT c_mktsegment AS type, n_regionkey AS macro, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def s5_profiles_and_nesting(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("macro"))
    return load(spark, sf, "customer").join(small(n), "c_nationkey").groupBy(F.col("c_mktsegment").alias("type"), "macro").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("""WITH x AS (SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS users, count(*) FILTER (kinds = 1) AS never_changed, round(avg(kinds), 6) AS mean_kinds FROM x""")
def s9_never_changed(spark, sf):
    x = load(spark, sf, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))
    return x.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("kinds") == 1).alias("never_changed"), F.round(F.avg("kinds"), 6).alias("mean_kinds"))


@query("SELECT kind_ok, count(*) AS n, count(mo_id) AS x, count(published_at) AS y, count(*) FILTER (mo_id IS NOT NULL AND published_at IS NOT NULL) AS complete FROM (SELECT *, lang = 'ru' AS kind_ok FROM documents) GROUP BY 1")
def s10_complete_cases(spark, sf):
    d = load(spark, sf, "documents").withColumn("kind_ok", F.col("lang") == "ru")
    return d.groupBy("kind_ok").agg(F.count(F.lit(1)).alias("n"), F.count("mo_id").alias("x"), F.count("published_at").alias("y"), F.count_if(F.col("mo_id").isNotNull() & F.col("published_at").isNotNull()).alias("complete"))


@query("""WITH s AS (SELECT c_nationkey AS mo, year(o_orderdate) * 12 + month(o_orderdate) AS t, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), l AS (SELECT unnest([-2, -1, 0, 1, 2]) AS lag), j AS (SELECT a.mo, lag, corr(a.x, b.y) AS r, count(*) AS n FROM s a JOIN l ON true JOIN s b ON b.mo = a.mo AND b.t = a.t + lag GROUP BY 1, 2), m AS (SELECT lag, median(r) AS med, count(*) AS n FROM j WHERE n >= 10 AND NOT isnan(r) AND r IS NOT NULL GROUP BY 1) SELECT CAST(lag AS INT) AS lag, round(med, 5) AS med, n, CAST(row_number() OVER (ORDER BY abs(med) DESC, lag) AS INT) AS place FROM m""")
def s11_best_lag(spark, sf):
    s = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("mo"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("o_totalprice").alias("y"))
    m = T.lagged_correlation(s, "mo", "t", "x", "y", 2).groupBy("lag").agg(F.median("r").alias("med"), F.count(F.lit(1)).alias("n"))
    return m.select("lag", r("med", 5), "n", F.row_number().over(Window.orderBy(F.abs("med").desc(), "lag")).alias("place"))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 5 THEN 'first' WHEN p_retailprice > 1500 THEN 'second' WHEN p_brand = 'Brand#11' THEN 'third' END AS main FROM part WHERE p_size < 5 OR p_retailprice > 1500 OR p_brand = 'Brand#11'")
def u5_first_by_order(spark, sf):
    marks = F.array_compact(F.array(F.when(F.col("p_size") < 5, "first"), F.when(F.col("p_retailprice") > 1500, "second"), F.when(F.col("p_brand") == "Brand#11", "third")))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.try_element_at(marks, F.lit(1)).alias("main")).where("main IS NOT NULL")


@query("SELECT p_type AS type, round(median(p_retailprice / nullif(p_size, 0)), 5) AS ratio, count(*) AS n, count(p_retailprice / nullif(p_size, 0)) AS present FROM part GROUP BY 1")
def u7_ratio_medians(spark, sf):
    x = P.ratio(F.col("p_retailprice"), F.col("p_size"))
    return load(spark, sf, "part").groupBy(F.col("p_type").alias("type")).agg(F.round(F.median(x), 5).alias("ratio"), F.count(F.lit(1)).alias("n"), F.count(x).alias("present"))


@query("WITH p AS (SELECT c_custkey AS id, c_mktsegment AS mo, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) * 50, 0) AS p FROM customer) SELECT mo, p, count(*) AS tied, min(id) AS first_id FROM p GROUP BY 1, 2 HAVING count(*) > 1")
def u14_ties(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal")
    p = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("mo"), F.round(F.percent_rank().over(w) * 50, 0).alias("p"))
    return p.groupBy("mo", "p").agg(F.count(F.lit(1)).alias("tied"), F.min("id").alias("first_id")).where("tied > 1")


@query(f"""WITH {K}, y AS (SELECT customer_mo AS mo, year(d) AS y, sum(price) AS v FROM k GROUP BY 1, 2) SELECT mo, round(coalesce(max(v) FILTER (y = 1996), 0), 2) AS y1996, round(coalesce(max(v) FILTER (y = 1997), 0), 2) AS y1997 FROM y GROUP BY 1""")
def u21_years_side_by_side(spark, sf):
    y = contracts(spark, sf).groupBy(F.col("customer_mo").alias("mo"), F.concat(F.lit("y"), F.year("d").cast("string")).alias("y")).agg(F.sum("price").alias("v"))
    return y.groupBy("mo").pivot("y", ["y1996", "y1997"]).agg(F.max("v")).fillna(0.0).select("mo", r("y1996", 2), r("y1997", 2))


@query("""WITH f AS (SELECT r.kind, r.name, s.v, levenshtein(lower(r.name), s.v) AS d, r.place_id FROM place_refs r JOIN (SELECT DISTINCT lower(regexp_replace(name, '^(ГО город|МР) ', '')) AS v FROM municipalities) s ON abs(length(r.name) - length(s.v)) <= 2) SELECT v, place_id, d FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, place_id) AS pos FROM f WHERE kind <> 'locality') WHERE pos = 1 AND d <= 3""")
def j15_fuzzy_names(spark, sf):
    """The nearest name of each key by edits; both sides are short lists."""
    refs = load(spark, sf, "place_refs").where("kind <> 'locality'").select("place_id", F.lower("name").alias("n"))
    keys = load(spark, sf, "municipalities").select(F.lower(F.regexp_replace("name", "^(ГО город|МР) ", "")).alias("v")).distinct()
    near = keys.join(V.few(refs), F.abs(F.length("n") - F.length("v")) <= 2).withColumn("d", F.levenshtein("n", "v"))
    return near.groupBy("v").agg(F.min(F.struct("d", "place_id")).alias("m")).select("v", "m.place_id", F.col("m.d").cast("bigint").alias("d")).where("d <= 3")
