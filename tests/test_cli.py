"""The command line over small tables, and ranks and quartiles by ranges against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from okrug.cli import Settings, main
from okrug.operators import panel as P


def test_commands(spark, tmp_path, capsys):
    data, out = tmp_path / "data", tmp_path / "out"
    spark.createDataFrame([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{data}/nation.parquet")
    spark.createDataFrame([(0, "R"), (1, "S")], "r_regionkey int, r_name string").write.parquet(f"{data}/region.parquet")
    config = tmp_path / "c.toml"
    config.write_text(f'data = "{data}"\nout = "{out}"\nformat = "json"\n[steps]\nplaces = ["src18_sql_passthrough"]\n')
    assert main(["list"]) == 0 and "p3_found" in capsys.readouterr().out
    assert main(["--config", str(config), "tables"]) == 0 and "nation\t2" in capsys.readouterr().out
    assert main(["--config", str(config), "sql", "SELECT count(*) AS rows_here FROM nation"]) == 0 and "rows_here" in capsys.readouterr().out
    assert main(["--config", str(config), "run", "places"]) == 0
    assert sorted(r["value"] for r in spark.read.text(f"{out}/src18_sql_passthrough").collect()) == ['{"name":"A","region":"R"}', '{"name":"B","region":"S"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a;b\n1;x\n1;x\n2;\n")
    for _ in range(2):  # what the table holds already isn't added again
        assert main(["--config", str(config), "ingest", str(tmp_path / "in"), "added"]) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{data}/added.parquet").collect())) == [("1", "x"), ("2", None)]
    with pytest.raises(SystemExit):
        main(["run", "no_such_query"])
    config.write_text("dta = 'x'")
    with pytest.raises(ValueError, match="dta"):
        Settings.read(str(config))


def test_ranks_and_quartiles_by_ranges(spark):
    rng = random.Random(4)
    rows = [(i, g, None if rng.random() < 0.1 else float(rng.choice([7, rng.randrange(40), rng.random()]))) for i in range(400) for g in ("a", "b")]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    plain = {(r["i"], r["g"]): r["x"] for r in P.average_rank(df, ["g"], "v", "x").collect()}
    assert {(r["i"], r["g"]): r["x"] for r in P.wide_rank(df, ["g"], "v", "x").collect()} == plain
    part = {(r["i"], r["g"]): r["x"] for r in P.wide_rank(df, ["g"], "v", "x", percent=True).collect()}
    assert part == pytest.approx({(r["i"], r["g"]): r["x"] for r in P.rank_percent(df, ["g"], "v", "x").collect()})
    for r in P.wide_quartiles(df, ["g"], "v").collect():
        v = [x for _, g, x in rows if g == r["g"] and x is not None]
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(list(np.percentile(v, [25, 50, 75]))) and (r["n"], r["min"], r["max"]) == (len(v), min(v), max(v))
    assert P.wide_quartiles(df.where(F.lit(False)), ["g"], "v").count() == 0
    assert P.wide_rank(df.where("v IS NULL"), ["g"], "v", "x").where("x IS NOT NULL").count() == 0
