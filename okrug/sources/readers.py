"""Sources: delimited files, JSON documents, XML registers, HTML pages, text tables, catalog tables and other databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, delimiter: str = ";", encoding: str = "UTF-8", recursive: bool = False) -> DataFrame:
    """Delimited files with a header; all columns as texts unless a schema is given. A byte-order mark before the first name is dropped; recursion unions all files below a folder.

    Encodings other than Unicode and Latin-1 are only read under a session setting, which is then switched on.
    """
    if encoding.upper() not in ("UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "US-ASCII", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("sep", delimiter).option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", recursive)
    df = (reader.schema(schema) if schema is not None else reader).csv(paths)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def union_files(frames: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """Union by name of renamed, projected frames, without repeated rows."""
    return reduce(DataFrame.unionByName, (f.select(*[F.col(a).alias(b) for a, b in columns.items()]) for f in frames)).distinct()


def json_records(spark: SparkSession, paths: str | list[str], member: str, schema: T.DataType) -> DataFrame:
    """The objects of a list member of whole-file JSON documents, one row each, under an explicit schema."""
    whole = T.StructType([T.StructField(member, T.ArrayType(schema))])
    return spark.read.schema(whole).option("multiLine", True).json(paths).select(F.explode(member).alias("r")).select("r.*")


def first_of(*paths: str) -> Column:
    """The first non-null of alternative members, as text."""
    return F.coalesce(*[F.col(p).cast("string") for p in paths])


def xml_documents(spark: SparkSession, paths: str | list[str], row_tag: str, schema: T.StructType) -> DataFrame:
    """The repeated elements of XML files; attributes are columns with the prefix `_`."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(paths)


def declared_and_found(spark: SparkSession, paths: str | list[str], root_tag: str, count_attribute: str, row_tag: str) -> DataFrame:
    """(file, declared, found): the count that a file's root declares beside its elements, for files where they differ."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    declared = F.regexp_extract("value", rf'<{root_tag}\b[^>]*?\b{count_attribute}="(\d+)"', 1)
    found = F.regexp_count("value", F.lit(rf"<{row_tag}\b"))
    return text.select("file", declared.try_cast("int").alias("declared"), found.alias("found")).where("declared IS NULL OR declared <> found")


def html_rows(pages: DataFrame, html: str, cells: int) -> DataFrame:
    """One row per table row with exactly `cells` cells: their texts, without scripts, styles and tags."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", "")
    rows = F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)))
    out = pages.select("*", rows.alias("__row"))
    parts = F.regexp_extract_all("__row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    text = F.transform(parts, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"(?:\s|&nbsp;)+", " ")))
    return out.withColumn("cells", text).where(F.size("cells") == cells).drop("__row")


def text_table(lines: DataFrame, line: str, numbers: int) -> DataFrame:
    """(name, values): lines that are a name followed by exactly `numbers` numbers, as laid-out text tables have them.

    One blank between a number and three digits parts its thousands; wider gaps part columns.
    """
    number = r"-?(?:\d{1,3}(?:[ \u00a0]\d{3})+|\d+)(?:[.,]\d+)?"
    found = F.regexp_extract_all(F.col(line), F.lit(rf"(?<=\s)({number})(?=\s|$)"), F.lit(1))
    name = F.trim(F.regexp_extract(F.col(line), rf"^(.*?\p{{L}}[^0-9]*?)\s+{number}(?=\s|$)", 1))
    values = F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"[\s\u00a0]", ""), ",", ".").try_cast("double"))
    return lines.select(name.alias("name"), values.alias("values")).where((F.size("values") == numbers) & (F.col("name") != ""))


def totals_of_places(rows: DataFrame, code: str, name: str) -> DataFrame:
    """The rows of whole municipalities: their codes end with five zeros and their names are of no settlement."""
    return rows.where(F.col(code).endswith("00000") & ~F.lower(name).contains("поселение"))


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], text: str) -> DataFrame:
    """The result of a SQL text over named frames, which become views of the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def table_sizes(spark: SparkSession) -> DataFrame:
    """(name, rows) of the catalog's tables and views."""
    names = [t.name for t in spark.catalog.listTables()]
    parts = [spark.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, rows bigint")


def read_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of another database, read in parallel ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()
