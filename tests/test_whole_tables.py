"""Queries over dates of any layout, on small tables against counts by hand."""

from okrug.plans.checks import s16_example_queries_all
from okrug.plans.relational import f11_status_join_all


def test_dates_of_every_layout_and_normal_inns(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("sources", [("a", "Asia/Yekaterinburg")], "source_id string, time_zone string")
    days = ["2026-09-10", "10.09.2026", "10 сентября 2026 г.", "20260910", "2026-09-11"]
    inns = ["7707083893", "7728168971", "7736050003", "7740000076", "5024002119"]
    put("msp_snapshot_rows", [(i, "micro", d, "a") for i, d in zip(inns, days)], "inn string, category string, snapshot_date string, source_id string")
    rows = [(k, i if k else "77 07-083893", "10.09.2026" if k % 2 else "2026-09-10", "a", "44", 100, "77 07 083893" if k % 2 else "7707083893") for k, i in enumerate(inns)]
    put("contracts_msp_enriched", [*rows, (9, None, "дата не указана", "a", "44", 1, "7707083893")], "row_id bigint, supplier_inn string, sign_date string, import_source_id string, law string, amount_cents bigint, customer_inn string")
    got = {r["row_id"]: r["status"] for r in f11_status_join_all(spark, str(tmp_path)).collect()}
    assert got == {0: "found", 1: "found", 2: "found", 3: "found", 4: "not found", 9: "no id"}
    assert [tuple(r) for r in s16_example_queries_all(spark, str(tmp_path)).collect()] == [("2026-09", "44", 5, 500)]
