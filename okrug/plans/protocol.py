"""The clustering protocol, its sensitivity and dynamics, and the models of types, over the nations' trade."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from okrug.operators import graph as G
from okrug.operators import kernels as X
from okrug.operators import network as N
from okrug.operators import panel as P
from okrug.operators import protocol as C
from okrug.operators import validity as V
from okrug.plans import network as Q
from okrug.plans.base import contracts, registry
from okrug.session import written

QUERIES, ORACLE, query = registry()


def _inputs(spark, sf) -> tuple[list[int], C.Inputs, list[np.ndarray]]:
    """Entities, the protocol's inputs, and the structural layers: flows and comovement, each embedded into all entities."""
    names, flow = G.dense(N.flow_layer(Q._flows(spark, sf)))
    at = {n: i for i, n in enumerate(names)}
    rows = [tuple(x) for x in Q._metrics(spark, sf).collect()]  # four a node, whose number dense() has checked
    metrics = sorted({m for _, m, _ in rows})
    x = np.zeros((len(names), len(metrics)))
    for mo, m, v in rows:
        if mo in at:
            x[at[mo], metrics.index(m)] = np.log1p(v)
    q1, median, q3 = np.percentile(x, [25, 50, 75], axis=0)
    x = np.clip((x - median) / np.where(q3 > q1, q3 - q1, 1), -4, 4)
    moves = np.zeros_like(flow)
    for s, d, v in N.comovement(P.difference(Q._residuals(spark, sf), "mo", "t", "res", "d"), "mo", "t", "d").select("src", "dst", "w").toLocalIterator():
        if s in at and d in at:
            moves[at[s], at[d]] = moves[at[d], at[s]] = max(v, 0)
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    attribute = (unit @ unit.T + 1) / 2
    np.fill_diagonal(attribute, 0)
    layers = [flow, moves]
    structure = C.fused_layers(np.zeros_like(flow), layers, [0.5, 0.5], 0.0)
    fused = C.nearest_net(C.fused_layers(attribute, layers, [0.5, 0.5], 0.3), 8)
    return [int(n) for n in names], C.Inputs(x, C.nearest_net(attribute, 8), C.nearest_net(structure, 8), fused), layers


@query()
def c7_methods(spark, sf):
    """All seven methods at k = 5."""
    names, inputs, _ = _inputs(spark, sf)
    return C.over_settings(spark, [(m,) for m in C.METHODS], "method string, node int, cluster int", lambda m: [(m, n, int(c)) for n, c in zip(names, C.cluster(m, inputs, 5))])


@query("SELECT unnest(['kmeans', 'ward', 'mixture', 'spectral_attribute', 'spectral_structure', 'spectral_fused', 'louvain_fused']) AS method, (SELECT count(*) FROM (SELECT s_nationkey AS n FROM supplier UNION SELECT c_nationkey FROM customer)) AS nodes, true AS numbered, true AS same_again")
def c7_invariants(spark, sf):
    """Every method labels every node once, with numbers from 0 on without a gap, and again the same if nodes are named otherwise or it is run again."""
    names, inputs, _ = _inputs(spark, sf)

    def one(m):
        lab, again = C.cluster(m, inputs, 5), C.cluster(m, inputs, 5)
        return [(m, len(lab), bool(set(lab) == set(range(int(lab.max()) + 1))), bool((lab == again).all()))]

    return C.over_settings(spark, [(m,) for m in C.METHODS], "method string, nodes bigint, numbered boolean, same_again boolean", one)


@query()
def v7_all_indices(spark, sf):
    """The seven indices of every method and k, and how far they stand out from shuffled labels (V7, V8)."""
    _, inputs, _ = _inputs(spark, sf)
    return C.grid(spark, inputs, list(range(3, 9)))


@query("SELECT unnest(['avi', 'avu', 'ch', 'db', 'mq', 's_dbw', 'sw']) AS index, true AS agrees")
def v7_indices_agree(spark, sf):
    """The dense indices against the distributed operators, on the same points, network and labels."""
    points = written(Q._points(spark, sf), "points")
    rows = points.orderBy("vec_id").toPandas()  # a fixture of the comparison: the dense form is for small tables, whose size is checked
    if len(rows) > X.MOST_NODES:
        raise ValueError("the dense form is for small tables")
    x, lab = np.stack(rows["v"].to_numpy()), rows["label"].to_numpy()
    dense = C.all_indices(x, np.eye(len(x)), lab)
    net, labels = Q._net(spark, sf), Q._labels(spark, sf)
    names, w = G.dense(net)
    by_node = {a: b for a, b in labels.collect()}  # a dimension
    graph = C.all_indices(np.arange(len(names), dtype=float)[:, None], w, np.array([by_node[n] for n in names]))
    wide = {
        "sw": V.silhouettes(points, "vec_id", "label", "v").agg(F.avg("s")), "ch": V.calinski_harabasz(points, "label", "v"), "db": V.davies_bouldin(points, "label", "v"), "s_dbw": V.s_dbw(points, "label", "v"),
        "mq": V.modularity(net, labels), "avi": V.isolation(net, labels).select("avi"), "avu": V.isolation(net, labels).select("avu"),
    }
    said = [(name, bool(abs((graph if name in ("mq", "avi", "avu") else dense)[name] - df.first()[0]) < 1e-6)) for name, df in wide.items()]
    return spark.createDataFrame(said, "index string, agrees boolean")


@query()
def v9_method_choice(spark, sf):
    """The k of each method by mean z, and its mean rank; best first (V9, U19)."""
    _, inputs, _ = _inputs(spark, sf)
    chosen = C.select_k(written(C.grid(spark, inputs, list(range(3, 9))), "grid"), 2)
    return chosen.orderBy(F.col("z_mean").desc_nulls_last(), "method")


@query()
def v12_layer_weights(spark, sf):
    """Agreement with the types at equal weights when layers are left out or weighted by chance, alpha being kept."""
    _, inputs, layers = _inputs(spark, sf)
    whole = X.spectral(inputs.fused.copy(), 5)

    def one(name, weights):
        w = C.nearest_net(C.fused_layers(inputs.attribute, layers, weights, 0.3), 8)
        return [(name, weights, X.rand_index(whole, X.spectral(w, 5)))]

    return C.over_settings(spark, C.weight_settings(len(layers)), "setting string, weights array<double>, ari double", one)


@query()
def v13_edge_constructions(spark, sf):
    """Types by other ways to make edges: nearest neighbours of several numbers, mutual ones, self-tuned similarities, the full matrix."""
    _, inputs, layers = _inputs(spark, sf)
    full = C.fused_layers(inputs.attribute, layers, [0.5, 0.5], 0.3)
    ways = {**{f"nearest_{k}": (lambda k=k: C.nearest_net(full, k)) for k in (4, 8, 12)}, "mutual_8": lambda: C.nearest_net(full, 8, mutual=True), "self_tuned": lambda: C.self_tuned(inputs.x), "full": lambda: full}
    whole = X.spectral(inputs.fused.copy(), 5)

    def one(name):
        w = ways[name]()
        lab = X.spectral(w.copy(), 5)
        seen = C.all_indices(inputs.x, w, lab)
        return [(name, int((w > 0).sum() // 2), X.rand_index(whole, lab), seen["sw"], seen["mq"])]

    return C.over_settings(spark, [(n,) for n in ways], "construction string, edges bigint, ari double, sw double, mq double", one)


def _periods(spark, sf) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Each year's own network, from this year's contracts alone, so that no year knows a later one."""
    f = written(contracts(spark, sf).groupBy(F.year("d").alias("y"), F.col("supplier_mo").alias("src"), F.col("customer_mo").alias("dst")).agg(F.sum("price").alias("w")), "yearly-flows")
    years = sorted(x[0] for x in f.select("y").distinct().collect())  # a handful of periods
    names, _ = G.dense(f.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    at, out = {n: i for i, n in enumerate(names)}, []
    for y in years:
        w = np.zeros((len(names), len(names)))
        for s, d, v in N.flow_layer(f.where(F.col("y") == y).select("src", "dst", "w").where("src <> dst")).select("src", "dst", "w").toLocalIterator():
            w[at[s], at[d]] = v
        out.append(w)
    return years, [int(n) for n in names], out


@query()
def d4_smoothing_grid(spark, sf):
    """Mean agreement of neighbouring years for several strengths of smoothing, and how often a node changes its type (D1, D3, D4, D5)."""
    years, names, periods = _periods(spark, sf)

    def one(beta):
        lab = C.smoothed_labels(periods, beta, 5)
        ari = [X.rand_index(a, b) for a, b in zip(lab, lab[1:])]
        return [(beta, float(np.mean(ari)), float(np.mean([(a != b).mean() for a, b in zip(lab, lab[1:])])))]

    return C.over_settings(spark, [(b,) for b in (0.0, 0.3, 0.5, 0.7, 0.9)], "beta double, ari double, switched double", one)


# --- models of types -----------------------------------------------------------------------------------------------------------------
def _features(spark, sf):
    from pyspark.ml.functions import array_to_vector

    fold = F.pmod(F.xxhash64("vec_id"), F.lit(5)).cast("int").alias("fold")
    return written(Q._points(spark, sf).select("vec_id", F.col("label").cast("double").alias("label"), "v", fold), "labelled-points"), array_to_vector


def _forest(train, trees: int = 100):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, seed=42, maxDepth=8).fit(train)


@query()
def m1_held_out_forest(spark, sf):
    """Each row's type as told by a forest that has not seen it (five folds), beside the share of the commonest type."""
    p, vector = _features(spark, sf)
    p = p.withColumn("features", vector("v"))
    parts = [_forest(p.where(F.col("fold") != f)).transform(p.where(F.col("fold") == f)).select("vec_id", "label", "prediction") for f in range(5)]
    said = parts[0]
    for part in parts[1:]:
        said = said.unionByName(part)
    top = p.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("majority"))
    return said.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy")).join(F.broadcast(top))


@query()
def m4_types_by_probability(spark, sf):
    """Best and second type of each row by forests that have not seen it, and whether none has half of the probability (U12)."""
    from pyspark.ml.functions import vector_to_array

    p, vector = _features(spark, sf)
    p = p.withColumn("features", vector("v"))
    said = None
    for f in range(5):
        part = _forest(p.where(F.col("fold") != f)).transform(p.where(F.col("fold") == f)).select("vec_id", vector_to_array("probability").alias("p"))
        said = part if said is None else said.unionByName(part)
    ranked = F.reverse(F.array_sort(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).alias("t")))))
    top = said.select("vec_id", ranked.alias("k"))
    return top.select("vec_id", (-F.get("k", F.lit(0)).t).alias("type"), (-F.get("k", F.lit(1)).t).alias("second_type"), (F.get("k", F.lit(0)).p < 0.5).alias("mixed"))


@query()
def m2_importances(spark, sf):
    """Features by the forest's own importance."""
    p, vector = _features(spark, sf)
    model = _forest(p.withColumn("features", vector("v")))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())], "feature int, importance double")


@query()
def m2_permutation_importance(spark, sf):
    """Accuracy that is lost when one feature's values are dealt to other rows, on rows the forest has not seen; five deals of each feature, in one pass of the model."""
    p, vector = _features(spark, sf)
    model = _forest(p.where("fold > 0").withColumn("features", vector("v")))
    held = written(p.where("fold = 0"), "held-out")
    width = held.select(F.max(F.size("v"))).first()[0] or 0
    base = model.transform(held.withColumn("features", vector("v"))).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    deals = held.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("feature"), F.posexplode(F.array_repeat(F.lit(0), 5)).alias("deal", "_"), "label", "v")
    place = F.row_number().over(Window.partitionBy("feature", "deal").orderBy("vec_id")).alias("at")
    other = F.row_number().over(Window.partitionBy("feature", "deal").orderBy(F.xxhash64("vec_id", "feature", "deal"))).alias("at")
    given = deals.select("feature", "deal", other, F.get("v", F.col("feature")).alias("value"))
    dealt = deals.select("feature", "deal", "label", "v", place).join(given, ["feature", "deal", "at"]).withColumn("features", vector(F.transform("v", lambda x, i: F.when(i == F.col("feature"), F.col("value")).otherwise(x))))
    said = model.transform(dealt).groupBy("feature", "deal").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    return said.groupBy("feature").agg(F.round(F.lit(base) - F.avg("accuracy"), 6).alias("importance"), F.round(F.stddev("accuracy"), 6).alias("deviation"))


@query()
def m5_predict_new(spark, sf):
    """Types and their probabilities for rows that came later: scale and forest are fitted on the earlier rows only."""
    from pyspark.ml.functions import vector_to_array

    p, vector = _features(spark, sf)
    old, new = p.where("fold > 0"), p.where("fold = 0")
    scale = old.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.median("x").alias("m"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"))
    one = scale.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "iqr"))), lambda s: F.struct(s.m.alias("m"), F.when(s.iqr > 0, s.iqr).otherwise(1.0).alias("iqr"))).alias("scale"))
    scaled = lambda df: df.join(F.broadcast(one)).withColumn("features", vector(F.zip_with("v", "scale", lambda x, s: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (x - s.m) / s.iqr)))))
    told = _forest(scaled(old)).transform(scaled(new))
    ranked = F.reverse(F.array_sort(F.transform(vector_to_array("probability"), lambda x, i: F.struct(x.alias("p"), (-i).alias("t")))))
    top = told.select("vec_id", F.slice(ranked, 1, 3).alias("top"))
    return top.select("vec_id", *[(-F.get("top", F.lit(k)).t).alias(f"type_{k + 1}") for k in range(3)], F.round(F.get("top", F.lit(0)).p, 6).alias("probability"), (F.get("top", F.lit(0)).p < 0.5).alias("borderline"))


@query(f"""WITH {Q.EMB}, tr AS (SELECT * FROM e WHERE vec_id % 2 = 0), ho AS (SELECT * FROM e WHERE vec_id % 2 = 1), a AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM tr) GROUP BY 1, 2), b AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ho) GROUP BY 1, 2), j AS (SELECT a.label, a.pos, rank() OVER (PARTITION BY a.label ORDER BY a.m) AS ra, rank() OVER (PARTITION BY a.label ORDER BY b.m) AS rb FROM a JOIN b ON a.label = b.label AND a.pos = b.pos) SELECT label, round(corr(ra, rb), 6) AS rho FROM j GROUP BY 1""")
def t7_rank_agreement(spark, sf):
    """Rank correlation of each type's mean features between two halves of the rows."""
    p = Q._points(spark, sf)
    halves = [V.centroids(p.where(F.col("vec_id") % 2 == k), "label", "v").select("label", F.posexplode("c").alias("pos", f"m{k}")) for k in (0, 1)]
    j = halves[0].join(halves[1], ["label", "pos"])
    j = P.average_rank(P.average_rank(j, ["label"], "m0", "ra"), ["label"], "m1", "rb")
    return j.groupBy("label").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))
