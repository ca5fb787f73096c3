"""Sources, sinks and streams as queries: tables go out through a sink or come in as a stream, and must come back as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from okrug.operators import panel as P
from okrug.plans.base import registry
from okrug.session import fresh_path, load, small
from okrug.sources import readers as R
from okrug.sources import writers as W
from okrug.streaming import events as S

QUERIES, ORACLE, query = registry()


# --- sinks and the sources that read them ------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def src3_delimited(spark, sf):
    """Delimited parts of at most 500 rows, written and read again under a schema."""
    path, c = fresh_path(spark, "delimited"), load(spark, sf, "customer")
    W.write_parts(c, path, 500)
    return R.read_delimited(spark, path, c.schema).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS title FROM nation")
def src4_folder_in_another_encoding(spark, sf):
    """A folder tree of files in a national encoding, all columns texts; repeated rows are dropped."""
    path, n = fresh_path(spark, "encoded"), load(spark, sf, "nation")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for part in ("a", "b/c"):
        n.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("ё"), F.upper("n_name")).alias("name")).write.option("header", True).option("sep", ";").option("encoding", "windows-1251").csv(f"{path}/{part}")
    back = R.read_delimited(spark, path, encoding="windows-1251", recursive=True)
    return R.union_files([back, back], {"key": "id", "name": "title"}).select("id", F.regexp_replace("title", "^ё", "").alias("title"))


@query("SELECT p_partkey AS id, p_name AS name, round(p_retailprice, 2) AS price FROM part")
def src6_documents(spark, sf):
    """JSON documents, one a row, with a list of records."""
    path, p = fresh_path(spark, "documents"), load(spark, sf, "part")
    record = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    W.write_documents(p.select(F.col("p_size").alias("k"), F.array(record).alias("records")), path)
    schema = "struct<id:bigint,name:string,price:double>"
    lines = spark.read.text(path).select(F.explode(F.from_json("value", f"struct<records:array<{schema}>>").records).alias("x"))
    return lines.select("x.id", "x.name", F.round("x.price", 2).alias("price"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, n_name AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def src13_html_rows(spark, sf):
    """Tables of HTML pages, one page a nation."""
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    s = load(spark, sf, "supplier").join(small(n), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.concat(F.lit("<tr><td>"), F.col("s_suppkey"), F.lit("</td><td><b>"), F.col("s_name"), F.lit("</b></td><td>&nbsp;"), F.col("n_name"), F.lit("</td></tr>"))
    pages = s.groupBy("n_nationkey").agg(F.concat(F.lit("<script><tr><td>0</td></tr></script><table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    rows = R.html_rows(pages, "html", 3)
    return rows.select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(("id", "name", "place"))])


@query("SELECT translate(n_name, '0123456789_', 'ABCDEFGHIJ ') AS name, n_nationkey * 1234 AS a, -n_regionkey AS b FROM nation")
def src11_text_table(spark, sf):
    """Laid-out lines: a name and numbers whose thousands are parted by single blanks."""
    n = load(spark, sf, "nation")
    line = F.concat(F.lit("  "), F.rpad(F.translate("n_name", "0123456789_", "ABCDEFGHIJ "), 30, " "), F.translate(F.format_number(F.col("n_nationkey") * 1234, 0), ",", " "), F.lit("   "), -F.col("n_regionkey"))
    t = R.text_table(n.select(line.alias("line")).union(spark.createDataFrame([("a line without numbers",)], "line string")), "line", 2)
    return t.select("name", F.get("values", F.lit(0)).cast("int").alias("a"), F.get("values", F.lit(1)).cast("int").alias("b"))


@query("SELECT n_regionkey AS file, count(*) + CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS declared, count(*) AS found FROM nation GROUP BY 1 HAVING n_regionkey = 2")
def src16_xml_counts(spark, sf):
    """XML files that declare another number of elements than they hold."""
    path, n = fresh_path(spark, "xml"), load(spark, sf, "nation")
    element = F.concat(F.lit('<Doc id="'), F.col("n_nationkey"), F.lit('"/>'))
    files = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.collect_list(element), "").alias("body"))
    declared = F.col("n") + F.when(F.col("n_regionkey") == 2, 1).otherwise(0)
    whole = F.concat(F.lit('<File region="'), F.col("n_regionkey"), F.lit('" count="'), declared, F.lit('">'), F.col("body"), F.lit("</File>"))
    files.select(F.col("n_regionkey").alias("file"), whole.alias("value")).write.partitionBy("file").text(path)
    bad = R.declared_and_found(spark, path, "File", "count", "Doc")
    return bad.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("int").alias("file"), F.col("declared").cast("bigint").alias("declared"), F.col("found").cast("bigint").alias("found"))


@query("SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def src19_table_sizes(spark, sf):
    for t in ("nation", "region"):
        load(spark, sf, t).createOrReplaceTempView(t)
    return R.table_sizes(spark).where(F.col("name").isin("nation", "region"))


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def src18_sql_passthrough(spark, sf):
    return R.run_sql(spark, {t: load(spark, sf, t) for t in ("nation", "region")}, "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, round(sum(o_totalprice), 0) AS total, false AS replaced FROM orders")
def snk2_create_only(spark, sf):
    """A table that is written once, verified, and not overwritten by a second attempt."""
    path, o = fresh_path(spark, "created"), load(spark, sf, "orders")
    W.create_table(o, path)
    try:
        W.create_table(o.limit(0), path)
        replaced = True
    except Exception:
        replaced = False
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 0).alias("total"), F.lit(replaced).alias("replaced"))


@query("SELECT true AS whole, count(*) AS rows FROM nation")
def snk12_manifest(spark, sf):
    """Sizes and hashes of written files; a copy has the same."""
    path, n = fresh_path(spark, "manifest"), load(spark, sf, "nation").coalesce(1)
    for part in ("a", "b"):
        W.replace_table(n, f"{path}/{part}")
    m = W.manifest(spark, path).where("path LIKE '%.parquet'")
    same = m.agg((F.count_distinct("sha256") == 1) & (F.min("size") == F.max("size")) & (F.count(F.lit(1)) == 2)).first()[0]
    return spark.read.parquet(f"{path}/a").agg(F.lit(bool(same)).alias("whole"), F.count(F.lit(1)).alias("rows"))


# --- streams -----------------------------------------------------------------------------------------------------------------------
def _stream(spark, sf: str, files: int = 4) -> DataFrame:
    """The events as a stream of files, one a batch."""
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = fresh_path(spark, "event-files")
    e.repartitionByRange(files, "ts").write.parquet(path)
    return S.file_stream(spark, path, e.schema)


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def st1_incremental_files(spark, sf):
    out = S.run_available(_stream(spark, sf), fresh_path(spark, "appended"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT strftime(d - to_days(CAST(k AS INT)), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT date_trunc('day', ts) AS d, event_type, value, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2")
def st2_sliding_windows(spark, sf):
    """Windows of two days, each day; a window's last version stands."""
    w = S.windowed(_stream(spark, sf), "ts", "event_type", "value", "2 days", "1 day", "40 days")
    out = S.run_available(w, fresh_path(spark, "windows"), mode="update")
    last = P.keep_first(out, ["start", "event_type"], [F.col("batch").desc()])
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT event_type, count(*) AS n, true AS finite FROM events GROUP BY 1")
def st3_running_state(spark, sf):
    out = S.run_available(S.smoothed(_stream(spark, sf), "event_type", "value"), fresh_path(spark, "states"), mode="update")
    last = P.keep_first(out, ["event_type"], [F.col("batch").desc()])
    return last.select("event_type", "n", (~F.isnan("state") & F.col("state").isNotNull()).alias("finite"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st4_append_and_resume(spark, sf):
    """A second run over the same files finds nothing new: what was read is kept in the checkpoint."""
    path = fresh_path(spark, "resumed")
    source = _stream(spark, sf)
    for _ in range(2):
        out = S.run_available(source, path)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def st5_first_seen(spark, sf):
    return S.run_available(S.first_seen(_stream(spark, sf), "ts", ["user_id", "event_type"], "400 days"), fresh_path(spark, "first-seen")).select("user_id", "event_type")
