"""The command line: `python -m okrug COMMAND`, with settings from a TOML file and from options."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The modules of the core's queries; further ones can be named in the settings.
MODULES = ("problems", "relational", "network", "checks", "more", "lists", "flows", "protocol")


@dataclass(frozen=True)
class Settings:
    """Where the tables are, where results go, how Spark is started, and which queries a step runs."""

    data: str = "."
    out: str = "out"
    format: str = "parquet"
    cores: str = "*"
    spark: dict[str, str] = field(default_factory=dict)
    modules: tuple[str, ...] = ()
    steps: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str | None) -> Settings:
        """Of a TOML file; unknown names raise, so that a slip doesn't pass as a default."""
        given = tomllib.loads(Path(path).read_text("utf-8")) if path else {}
        if unknown := given.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if k == "modules" else v for k, v in given.items()})


def all_queries(settings: Settings) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable] = {}
    for name in (*(f"okrug.plans.{m}" for m in MODULES), *settings.modules):
        found |= importlib.import_module(name).QUERIES
    return found


def _tables(spark: SparkSession, data: str) -> list[str]:
    """The data directory's tables, each as a view."""
    names = sorted(p.stem for p in Path(data).glob("*.parquet"))
    for name in names:
        spark.read.parquet(f"{data}/{name}.parquet").createOrReplaceTempView(name)
    return names


def _write(df: DataFrame, settings: Settings, name: str) -> str:
    from okrug.sources import writers

    path = f"{settings.out}/{name}"
    {"parquet": writers.replace_table, "csv": writers.write_parts, "json": writers.write_documents}[settings.format](df, path)
    return path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="okrug", description="Analytics over registries and economic data of territorial entities.")
    parser.add_argument("--config", help="a TOML file of settings")
    for name in ("data", "out", "format", "cores"):
        parser.add_argument(f"--{name}", help=f"the setting `{name}`")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    commands.add_parser("tables", help="tables of the data directory, with their rows")
    commands.add_parser("check", help="checks of the data; exit 1 if one fails")
    commands.add_parser("all", help="every query, each written to the output directory")
    run = commands.add_parser("run", help="the named queries or steps, each written to the output directory")
    run.add_argument("names", nargs="+")
    show = commands.add_parser("show", help="first rows of a query")
    show.add_argument("name")
    show.add_argument("--rows", type=int, default=20)
    sql = commands.add_parser("sql", help="a SQL text over the tables")
    sql.add_argument("text")
    sql.add_argument("--rows", type=int, default=20)
    ingest = commands.add_parser("ingest", help="adds delimited files of a folder to a table; rows that it holds already are left out")
    ingest.add_argument("folder")
    ingest.add_argument("table")
    ingest.add_argument("--delimiter", default=";")
    ingest.add_argument("--encoding", default="UTF-8")
    given = parser.parse_args(args)
    settings = replace(Settings.read(given.config), **{k: v for k in ("data", "out", "format", "cores") if (v := getattr(given, k)) is not None})
    queries = all_queries(settings)
    if given.command == "list":
        print("\n".join(queries))
        return 0
    names = list(queries) if given.command == "all" else [q for n in getattr(given, "names", ()) for q in settings.steps.get(n, [n])]
    if missing := [n for n in (*names, *([given.name] if given.command == "show" else ())) if n not in queries]:
        parser.error(f"no query or step {', '.join(missing)}")

    from okrug.session import get_spark

    spark = get_spark("okrug", cores=settings.cores, **settings.spark)
    if given.command == "tables":
        for name in _tables(spark, settings.data):
            print(f"{name}\t{spark.table(name).count()}")
    elif given.command == "sql":
        _tables(spark, settings.data)
        spark.sql(given.text).show(given.rows, truncate=False)
    elif given.command == "show":
        queries[given.name](spark, settings.data).show(given.rows, truncate=False)
    elif given.command == "check":
        report = queries["k_quality_report"](spark, settings.data)
        report.show(1000, truncate=False)
        return int(report.where("verdict <> 'PASS'").count() > 0)
    elif given.command == "ingest":
        from okrug.sources import readers

        new = readers.read_delimited(spark, given.folder, delimiter=given.delimiter, encoding=given.encoding, recursive=True).distinct()
        path = f"{settings.data}/{given.table}.parquet"
        if Path(path).exists():
            held = spark.read.parquet(path)
            new = new.join(held, [new[c].eqNullSafe(held[c]) for c in new.columns], "left_anti")
        new.write.mode("append").option("compression", "zstd").parquet(path)
    else:
        for name in names:
            began = time.time()
            print(f"{name}\t{_write(queries[name](spark, settings.data), settings, name)}\t{time.time() - began:.1f} s", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
