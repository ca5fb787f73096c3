"""Operators on small inputs: invariants, known values and bad inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from okrug.functions.hashing import xxhash64
from okrug.operators import graph as G
from okrug.operators import kernels as X
from okrug.operators import network as N
from okrug.operators import panel as P
from okrug.operators import quality as C
from okrug.operators import stats, validity
from okrug.sources import readers, writers
from okrug.streaming import events as S


def test_hash_equals_sparks(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 50))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a bigint, b bigint")
    got = df.select(F.xxhash64("a"), F.xxhash64("a", "b")).collect()
    assert [r[0] for r in got] == xxhash64(a).tolist() and [r[1] for r in got] == xxhash64(a, b).tolist()


def blobs():
    rng = np.random.default_rng(0)
    return np.vstack([rng.normal(c, 0.3, (15, 2)) for c in ((0, 0), (4, 0), (0, 4))]), np.repeat([0, 1, 2], 15)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_clusterings_find_blobs():
    x, y = blobs()
    for run in (X.kmeans, X.ward, X.gaussian_mixture):
        assert same_partition(run(x, 3), y)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    w = np.exp(-d)
    np.fill_diagonal(w, 0)
    assert same_partition(X.spectral(w, 3), y)
    assert same_partition(X.louvain(np.where(w > 0.05, w, 0)), y)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        cost = rng.random((n, m))
        got = sum(cost[i, j] for i, j in X.assignment(cost))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert math.isclose(got, best)
    assert X.align(np.array([0, 0, 1, 1, 2, 2]), np.array([8, 8, 3, 3, 7, 7])).tolist() == [0, 0, 1, 1, 2, 2]


def test_graph_kernels():
    path = np.zeros((4, 4))
    for i in range(3):
        path[i, i + 1] = path[i + 1, i] = 1
    assert np.allclose(X.betweenness(path), [0, 2 / 3, 2 / 3, 0])
    assert X.spanning_tree(3, [(1.0, 0, 1), (3.0, 1, 2), (2.0, 0, 2)]) == [(1, 2, 3.0), (0, 2, 2.0)]
    line = np.abs(np.arange(4)[:, None] - np.arange(4)[None]).astype(float)
    got = X.mds(line)
    assert np.allclose(np.abs(got[:, None] - got[None]).max(2), line)


def test_tails_and_imputation():
    assert math.isclose(X.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(X.t_two_sided(12.7062047, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(X.chi2_upper(11.070497694, 5), 0.05, rel_tol=1e-6) and math.isclose(X.chi2_upper(0.5, 3), 0.918891411655, rel_tol=1e-9)
    x = np.array([[1.0, 2], [1, 2], [9, 9], [1, np.nan]])
    assert X.knn_impute(x, 2)[3, 1] == 2


def test_layers(spark):
    rng = np.random.default_rng(0)
    a = rng.random((20, 20))
    a = (a + a.T) / 2
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(20) for j in range(20) if i != j], "src int, dst int, w double")
    net = {(r["src"], r["dst"]): r["w"] for r in N.knn(e, 3, 20).collect()}
    assert all(net[j, i] == w for (i, j), w in net.items()) and all(sum(i == k for i, _ in net) >= 3 for k in range(20))
    for k in (0, 20):
        with pytest.raises(ValueError):
            N.knn(e, k, 20)
    assert N.unit(e).agg(F.max("w")).first()[0] == 1.0
    flat = spark.createDataFrame([(i, [1.0] * 8) for i in range(4)], "mo int, v array<double>")
    d = N.dtw_distances(flat, "mo", "v", 2)
    assert {r["w"] for r in d.collect()} == {0.0} and {r["w"] for r in N.gaussian(d).collect()} == {1.0}
    assert N.dtw(np.array([0.0, 1, 2]), np.array([0.0, 1, 1, 2]), 2) == 0


def test_validity_prefers_the_true_partition(spark):
    x, y = blobs()
    rows = [(i, int(y[i]), int(i % 3), [float(v) for v in x[i]]) for i in range(45)]
    p = spark.createDataFrame(rows, "id int, good int, bad int, v array<double>")
    one = lambda f, lab: f(p, lab, "v").first()[0]
    assert one(validity.calinski_harabasz, "good") > one(validity.calinski_harabasz, "bad")
    assert one(validity.davies_bouldin, "good") < one(validity.davies_bouldin, "bad")
    s = validity.silhouettes(p, "id", "good", "v", rows_a_block=5)
    assert s.count() == 45 and s.agg(F.min("s")).first()[0] > 0.5
    assert validity.adjusted_rand(p, "good", "good").first()[0] == 1.0
    cliques = [(i, j, 1.0) for c in range(3) for i in range(4 * c, 4 * c + 4) for j in range(4 * c, 4 * c + 4) if i != j]
    e, lab = spark.createDataFrame(cliques, "src int, dst int, w double"), spark.createDataFrame([(i, i // 4) for i in range(12)], "node int, label int")
    assert validity.isolation(e, lab).first() == (1.0, 0.0)
    assert math.isclose(validity.modularity(e, lab).first()[0], 2 / 3)
    z = validity.permutation_z(spark, lambda v: float((v[:-1] == v[1:]).sum()), np.repeat([0, 1, 2], 10), 40).first()
    assert z["z"] > 3 and math.isclose(z["p"], 1 / 41)


def test_panel(spark):
    p = spark.createDataFrame([(0.001,), (0.01,), (0.02,), (0.04,), (0.5,), (None,)], "p double")
    q = sorted((r["p"], r["q"]) for r in P.false_discovery(p, [], "p", "q").collect() if r["p"])
    assert all(b >= a for a, b in q) and [b for _, b in q] == sorted(b for _, b in q) and math.isclose(q[0][1], 0.005)
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k string, v double")
    got = {r["k"]: r["x"] and round(r["x"], 6) for r in P.rank_percent(t.withColumn("g", F.lit(1)), ["g"], "v", "x").collect()}
    assert got == {"a": 33.333333, "b": 83.333333, "c": 83.333333, "d": None}
    z = P.zscores(spark.createDataFrame([(1, 5.0), (1, 5.0)], "g int, v double"), "g", "v", "z")
    assert {r["z"] for r in z.collect()} == {0.0}


def test_kruskal_and_spearman(spark):
    rows = [(i, "x", float(i), i % 3) for i in range(30)] + [(i, "y", float(i * i), i % 3) for i in range(30)] + [(i, "c", 1.0, i % 3) for i in range(30)]
    long = spark.createDataFrame(rows, "mo int, metric string, v double, g int")
    got = stats.spearman_pairs(long, "mo", "metric", "v").collect()
    assert [(r["x"], r["y"], round(r["rho"], 9)) for r in got] == [("x", "y", 1.0)]
    h = {r["metric"]: r for r in stats.kruskal_wallis(long, "metric", "g", "v").collect()}
    assert h["c"]["h"] is None and 0 <= h["x"]["p"] <= 1


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (1, 4, 1.0)], "src int, dst int, w double")
    r = {x["node"]: x["rank"] for x in G.pagerank(e, rounds=30).collect()}
    assert math.isclose(sum(r.values()), 1, rel_tol=1e-9) and r[3] > r[4]
    with pytest.raises(ValueError):
        G.dense(e, most=3)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_bytes("ИНН;имя\n01;Зуллёшук\n".encode("windows-1251"))
    (tmp_path / "in" / "sub" / "b.csv").write_bytes("ИНН;имя\n01;Зуллёшук\n02;\n".encode("windows-1251"))
    d = readers.read_delimited(spark, str(tmp_path / "in"), encoding="windows-1251", recursive=True)
    assert sorted(map(tuple, readers.union_files([d], {"ИНН": "inn", "имя": "name"}).collect()), key=str) == [("01", "Зуллёшук"), ("02", None)]
    (tmp_path / "x.xml").write_text('<Файл КолДок="3"><Документ ИдДок="1"><Имя>a</Имя></Документ><Документ ИдДок="2"/></Файл>', encoding="utf-8")
    schema = T.StructType([T.StructField("_ИдДок", T.StringType()), T.StructField("Имя", T.StringType())])
    assert sorted(map(tuple, readers.xml_documents(spark, str(tmp_path / "x.xml"), "Документ", schema).collect())) == [("1", "a"), ("2", None)]
    assert [r[1:] for r in map(tuple, readers.declared_and_found(spark, str(tmp_path / "x.xml"), "Файл", "КолДок", "Документ").collect())] == [(3, 2)]
    (tmp_path / "d.json").write_text('{"records": [{"a": 1}, {"b": "x"}]}')
    j = readers.json_records(spark, str(tmp_path / "d.json"), "records", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]))
    assert [tuple(r) for r in j.select(readers.first_of("a", "b"), "b").collect()] == [("1", None), ("x", "x")]
    html = spark.createDataFrame([("<script>var t='<tr><td>no</td><td>no</td></tr>'</script><table><tr><td> A&nbsp;<b>b</b></td><td>2</td></tr><tr><td>short</td></tr></table>",)], "html string")
    assert [r["cells"] for r in readers.html_rows(html, "html", 2).collect()] == [["A b", "2"]]
    lines = spark.createDataFrame([("  Район Южный   1 234  5,5   -7",), ("Итого",), (None,)], "value string")
    assert [tuple(r) for r in readers.text_table(lines, "value", 3).collect()] == [("Район Южный", [1234.0, 5.5, -7.0])]
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "id int, v double")
    assert writers.create_table(df, str(tmp_path / "t")) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.create_table(df, str(tmp_path / "t"))
    writers.replace_table(df, str(tmp_path / "t"))
    writers.write_documents(df, str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1}', '{"id":2,"v":1.5}']
    writers.write_parts(spark.range(120).coalesce(1), str(tmp_path / "p"), 50)
    assert len(list((tmp_path / "p").glob("*.csv"))) == 3
    assert writers.manifest(spark, str(tmp_path / "d.json")).first()["size"] == (tmp_path / "d.json").stat().st_size
    df.createOrReplaceTempView("okrug_test")
    assert ("okrug_test", 2) in set(map(tuple, readers.table_sizes(spark).collect()))


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, s string")
    got = {r["check"]: (r["bad"], r["verdict"]) for r in C.report([C.repeated_keys(df, "keys", ["k"]), C.orphans(df, "parents", "s", spark.createDataFrame([("a",)], "s string"), "s"), C.rows_that(df, "null", F.col("s").isNull()), C.conflicting(df, "versions", ["k"], ["s"]), C.same_count(df, df, "count")]).collect()}
    assert got == {"keys": (1, "FAIL"), "parents": (1, "FAIL"), "null": (1, "FAIL"), "versions": (1, "FAIL"), "count": (0, "PASS")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, CAST(id % 2 AS INT) AS k, CAST(id AS DOUBLE) AS v FROM range(10)").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("ts timestamp, k int, v double").parquet(src)

    def run(df, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName("okrug_out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [tuple(r) for r in spark.table("okrug_out").collect()]

    assert sum(r[3] for r in run(S.windowed(stream(), "ts", "k", "v", "5 minutes"), "complete")) == 10
    assert sorted(r[1] for r in run(S.first_seen(stream(), "ts", ["k"]), "append")) == [0, 1]
    assert sorted(run(S.smoothed(stream(), "k", "v"), "update")) == [(0, 5, 6.125), (1, 5, 7.125)]


def test_pagerank_runs_until_it_stands_still(spark):
    """A long ring with one shortcut mixes slowly; against the solved linear system."""
    edges = [(k, (k + 1) % 12, 1.0) for k in range(12)] + [(0, 6, 3.0)]
    w = np.zeros((12, 12))
    for i, j, x in edges:
        w[i, j] = x
    s = w / w.sum(1, keepdims=True)
    want = np.linalg.solve(np.eye(12) - 0.85 * s.T, np.full(12, 0.15 / 12))
    got = {r["node"]: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    assert max(abs(got[k] - want[k]) for k in range(12)) <= 1e-8
