"""The general data problems on small fixtures, against plain loops, with the cases that each operator defines."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from okrug.functions.registry import inn_valid, with_normal_inn
from okrug.functions.timeparse import with_epoch
from okrug.operators.asof import in_force, last_known
from okrug.operators.badrows import contract_lines, good_contracts
from okrug.operators.hotjoin import join_dictionary
from okrug.operators.nested import discover, nested_tables, register_tables, triples, triples_of
from okrug.operators.snapshots import snapshot_changes
from okrug.operators.timestamps import _parts, normalise_timestamps, read_dictionary, unread_timestamps
from okrug.session import fresh_path, written


def utc(*at):
    return int(dt.datetime(*at, tzinfo=dt.timezone.utc).timestamp())


TEXTS = [
    ("2023-11-25T16:24:25Z", None, utc(2023, 11, 25, 16, 24, 25)),
    ("20250920T202031Z", None, utc(2025, 9, 20, 20, 20, 31)),
    ("20240610", "Asia/Yekaterinburg", utc(2024, 6, 9, 19)),
    ("1728464123", None, 1728464123),
    ("1700929465999", None, 1700929465),
    ("01/03/2026 14:21", "UTC", utc(2026, 3, 1, 14, 21)),
    ("31.12.25", "Europe/Moscow", utc(2025, 12, 30, 21)),
    (" 2023.02.04 10:07 ", "UTC", utc(2023, 2, 4, 10, 7)),
    ("Sep 3, 2026 12:05 AM", "UTC", utc(2026, 9, 3, 0, 5)),
    ("Apr 20, 2024 12:02 PM", "UTC", utc(2024, 4, 20, 12, 2)),
    ("9 мая 2026 года", "Asia/Yekaterinburg", utc(2026, 5, 8, 19)),
    ("13.04.2026 19:42:37 (мск)", None, utc(2026, 4, 13, 16, 42, 37)),
    ("2023-01-19T15:39+0500", "UTC", utc(2023, 1, 19, 10, 39)),
    ("2023-02-06 07:13:36 UTC+5", "UTC", utc(2023, 2, 6, 2, 13, 36)),
    ("2023-01-11T04:57:46+03:00[Europe/Moscow]", None, utc(2023, 1, 11, 1, 57, 46)),
    ("2024-07-01T10:00:00[Europe/Berlin]", None, utc(2024, 7, 1, 8)),
    ("2024-10-27 02:30:00", "Europe/Berlin", utc(2024, 10, 27, 0, 30)),  # twice: the earlier
    ("2024-03-31 02:30:00", "Europe/Berlin", utc(2024, 3, 31, 1, 30)),  # skipped: the offset before
    ("2024-02-29", "UTC", utc(2024, 2, 29)),
    ("2024-01-01 10:00 Europe/Berlin", None, utc(2024, 1, 1, 9)),
    ("2024-07-01 10:00 CET", None, utc(2024, 7, 1, 9)),
    ("2024-01-01 10:00 EST", "UTC", utc(2024, 1, 1, 15)),
    ("Mon, 01 Jan 2024 10:00:00 GMT", "Europe/Berlin", utc(2024, 1, 1, 10)),
    ("пн, 1 января 2024 г.", "UTC", utc(2024, 1, 1)),
    ("1700929465999123", None, 1700929465),
    ("1700929465.5", None, 1700929465),
    ("2024-W01-1", "UTC", utc(2024, 1, 1)),
    ("2020W537T10:00Z", None, utc(2021, 1, 3, 10)),
    ("2021-W53-1", "UTC", None),
    ("2024-W01", "UTC", None),
    ("2024-366", "UTC", utc(2024, 12, 31)),
    ("2023-366", "UTC", None),
    ("2024-060T12:00Z", None, utc(2024, 2, 29, 12)),
    ("2024-01-01 24:00", "UTC", utc(2024, 1, 2)),
    ("2024-01-01 24:01", "UTC", None),
    ("10:15 01.02.2024", "UTC", utc(2024, 2, 1, 10, 15)),
    ("2023-02-29", "UTC", None),
    ("2026-13-31", "UTC", None),
    ("00.00.0000", "UTC", None),
    ("30.02.2023 10:15", "UTC", None),
    ("2023-07", "UTC", None),
    ("2024-01-01 25:00", "UTC", None),
    ("2024-01-01T10:00:00[Mars/Base]", "UTC", None),
    ("без даты", "UTC", None),
    ("2024-01-01", None, None),
    ("2024-01-01", "No/Where", None),
    (None, "UTC", None),
    ("", "UTC", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(TEXTS)], "i int, t string, z string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {r["i"]: r["e"] for r in with_epoch(df, "t", "z", "e").collect()}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == {i: e for i, (_, _, e) in enumerate(TEXTS)}


def test_dictionary_of_timestamps(spark):
    sources = spark.createDataFrame([("a", "Europe/Moscow"), ("b", "UTC"), ("c", None)], "source_id string, time_zone string")
    rows = [(1, "2024-01-01", "a", 9), (1, "2024-01-01", "a", 9), (2, "2024-01-01", "b", 9), (3, "2024-01-01", "c", 9), (4, None, "a", 9), (5, " ", "a", 9), (6, "2024-01-01", None, 9), (7, "2024-01-01T00:00Z", None, 9)]
    df = spark.createDataFrame(rows, "id int, t string, s string, utc_epoch int")
    path = fresh_path(spark, "test-dictionary")
    want = sorted([(1, utc(2023, 12, 31, 21)), (1, utc(2023, 12, 31, 21)), (2, utc(2024, 1, 1)), (3, None), (4, None), (5, None), (6, None), (7, utc(2024, 1, 1))], key=str)
    for _ in range(2):  # the second run finds every value in the dictionary
        got = normalise_timestamps(df, "t", "s", sources, dictionary=path)
        assert got.columns == ["id", "t", "s", "utc_epoch"]
        assert sorted(((r["id"], r["utc_epoch"]) for r in got.collect()), key=str) == want
    assert read_dictionary(spark, path).count() == 5 and len(_parts(spark, path)) == 1
    # values that two runs added at once are held once; a part that wasn't completed isn't read
    spark.read.parquet(*_parts(spark, path)).write.parquet(f"{path}/again")
    read_dictionary(spark, path).limit(1).write.parquet(f"{path}/broken")
    (pathlib.Path(path.removeprefix("file://")) / "broken" / "_SUCCESS").unlink()
    assert read_dictionary(spark, path).count() == 5 and len(_parts(spark, path)) == 2
    assert normalise_timestamps(df, "t", "s", sources, dictionary=path).count() == len(rows)
    blank = sources.union(spark.createDataFrame([("", "Asia/Tokyo"), (None, "Asia/Tokyo")], sources.schema))
    assert [r["utc_epoch"] for r in normalise_timestamps(df.where("id = 6"), "t", "s", blank).collect()] == [None]
    assert [tuple(r) for r in unread_timestamps(df, "t", "s", sources).orderBy("n", "source").collect()] == [(None, "2024-01-01", 1), ("c", "2024-01-01", 1)]
    assert normalise_timestamps(df.limit(0), "t", "s", sources).count() == 0


def test_inn(spark):
    given = [("7707083893", "7707083893"), ("500100732259", "500100732259"), ("ИНН 7707 083-893", "7707083893"), ("7707083894", None), ("123", None), ("нет", None), ("", None), (None, None), ("5" * 40, None)]
    df = with_normal_inn(spark.createDataFrame([(a,) for a, _ in given], "raw string"), "raw", "n")
    assert [r["n"] for r in df.collect()] == [b for _, b in given]
    assert [r[0] for r in df.select(inn_valid(F.col("raw"))).collect()] == [True, True] + [False] * 7


def test_triples_and_tables(spark):
    deep = '{"a":' * 300 + '"x"' + "}" * 300
    assert [len(p.split(".")) for p, _, _ in triples_of(deep, frozenset())] == [300]
    xml = '﻿{"Файл": {"Документ": {"ОргВклМСП": {"ИННЮЛ": " 1 "}, "СвОКВЭД": {"СвОКВЭДОсн": {"КодОКВЭД": 41.20}}, "СвЛиценз": {"НомЛиценз": "L", "НаимЛицВД": ["", {"Текст": "x"}, "y"]}}}}'
    plain = '{"records": [null, "{\\"normalized\\": {\\"inn\\": \\"2\\", \\"products\\": [null, \\"p\\"]}}", {"нормализовано": {"district": "D", "okved_extra": "e"}}, "{broken"]}'
    rows = [(1, xml), (2, plain), (3, plain), (4, None), (5, ""), (6, "[]"), (7, "null"), (8, '{"records": ['), (9, '{"records": NaN}')]
    df = spark.createDataFrame([(i, p, "extra") for i, p in rows], "raw_id bigint, payload string, document_no string")
    t = {k: sorted(map(tuple, v.collect()), key=str) for k, v in register_tables(df).items()}
    assert t["document"] == [(1, 1, "1", None, None, None, "41.20"), (2, 2, None, None, "2", None, None), (2, 3, None, None, None, "D", None), (3, 2, None, None, "2", None, None), (3, 3, None, None, None, "D", None)]
    assert t["license"] == [(1, 1, 1, "L")]
    assert t["license_activity"] == [(1, 1, 1, 2, "x"), (1, 1, 1, 3, "y")]
    assert t["product"] == [(2, 2, 2, "p"), (3, 2, 2, "p")]
    assert t["okved_extra"] == [(2, 3, 1, "e"), (3, 3, 1, "e")]
    assert register_tables(df.limit(0))["document"].count() == 0


def test_tables_of_an_unknown_schema_join_back_to_the_document(spark):
    rows = [
        (1, '{"order": {"no": 7, "lines": [{"sku": "a", "tags": ["x", "y"]}, {"sku": "b", "tags": ["z"], "price": {"net": 5}}]}, "a.b": "1", "a": {"b": "2"}}'),
        (2, '{"order": {"lines": {"sku": "c"}, "no": 8, "no": 9}}'),
        (3, "{"),
    ]
    df = spark.createDataFrame(rows, "doc bigint, body string")
    t = nested_tables(df, "doc", "body")
    line, tag = t["order.lines"], t["order.lines.tags"]
    assert sorted((r["doc"], r["order.no"], r["a\\u002eb"], r["a.b"]) for r in t[""].collect()) == [(1, "7", "1", "2"), (2, "9", None, None)]
    assert sorted((r["doc"], r["order.lines_no"], r["sku"], r["price.net"]) for r in line.collect()) == [(1, 1, "a", None), (1, 2, "b", "5"), (2, 1, "c", None)]
    back = tag.alias("t").join(line.alias("l"), (F.col("t.doc") == F.col("l.doc")) & (F.col("t.`order.lines_no`") == F.col("l.`order.lines_no`")))
    assert sorted((r["sku"], r["value"]) for r in back.select("l.sku", "t.value").collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    # nothing is lost: a member given twice, and paths beyond those that become columns
    assert [(r["doc"], r["table"], r["column"], r["value"]) for r in t["repeated"].collect()] == [(2, "", "order.no", "8")]
    assert t["other"].count() == 0
    found = triples(df, "doc", "body")
    few = nested_tables(df, "doc", "body", most=2)
    assert few["other"].count() == found.count() - 2 and few[""].columns == ["doc", "a.b", "a\\u002eb"]
    assert [s.name for s in discover(found)] == ["", "order.lines", "order.lines.tags"]
    assert nested_tables(df.limit(0), "doc", "body")["other"].count() == 0


def test_depth_is_no_limit():
    deep = '{"a":' * 100_000 + '"x"' + "}" * 100_000
    assert [(p.count("."), len(o), v) for p, o, v in triples_of(deep)] == [(99_999, 100_000, "x")]
    assert triples_of("[" * 100_000 + "]" * 100_000) == [] and triples_of(deep[:-1]) == []
    assert triples_of(r'{"a":"\ud800x","\udc00":"\ud83d\ude00"}') == [("a", [1], "\ufffdx"), ("\ufffd", [1], "\U0001f600")]
    for text in ('{"a":1,}', '{"a":01}', '{"a":"\\x"}', "[1,]", '{"a" 1}', "{} {}", '{"a":NaN}', '{"a":"\n"}'):
        assert triples_of(text) == []


def brute_changes(rows):
    states = {}
    for snap, key, value, at in rows:
        if snap is not None:
            best = states.setdefault(snap, {})
            if key is not None and (key not in best or best[key][0] < at):
                best[key] = at, value
    out, days = set(), sorted(states)
    for a, b in zip(days, days[1:]):
        was, now = states[a], states[b]
        out |= {(k, b, "added") for k in now.keys() - was.keys()} | {(k, b, "removed") for k in was.keys() - now.keys()}
        out |= {(k, b, "changed") for k in now.keys() & was.keys() if now[k][1] != was[k][1]}
    return out


@pytest.mark.parametrize("cells, rounds", [(384, 4), (6, 2), (3, 1)])
def test_snapshot_changes(spark, cells, rounds):
    rng = random.Random(cells)
    rows = [(rng.choice([1, 2, 2, 5, None]), rng.choice([*map(str, range(60)), None]), rng.choice(["x", "y", None]), i) for i in range(400)]
    rows += [(5, "hot", "x", 1000 + i) for i in range(200)] + [(9, None, "x", 0)]
    df = spark.createDataFrame(rows, "snapshot int, key string, v string, at int")
    got = snapshot_changes(df, "snapshot", "key", "v", ["at"], first_cells=cells, keys_a_bucket=20, rounds=rounds)
    assert sorted(map(tuple, got.collect())) == sorted(brute_changes(rows))
    assert snapshot_changes(df.where("snapshot = 1"), "snapshot", "key", "v", ["at"]).count() == 0
    assert snapshot_changes(df.limit(0), "snapshot", "key", "v", ["at"]).count() == 0


def test_last_known_with_hot_key(spark):
    rng = random.Random(1)
    day = 86_400_000_000
    changes = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([rng.randrange(20) * day // 2, None]), i) for i in range(1500)]
    events = [(rng.choice(["hot", "hot", "a", "c", None]), rng.choice([rng.randrange(24) * day // 2, None]), i) for i in range(1500)]
    c, e = (spark.createDataFrame(x, "k string, t bigint, id bigint") for x in (changes, events))
    want = {}
    for k, t, i in events:
        known = [(ct, ci) for ck, ct, ci in changes if k is not None and ck == k and t is not None and ct is not None and ct <= t]
        if known:
            want[i] = max(known)[1]
    got = last_known(e.withColumn("known", F.lit(0)), c.withColumn("event", F.lit(0)), ["k"], "t", "id", "id", [])
    assert {r["event_id"]: r["change_id"] for r in got.collect()} == want
    again = last_known(e.union(e), c.union(c), ["k"], "t", "id", "id", [])
    assert again.count() == 2 * len(want)
    assert last_known(e.limit(0), c, ["k"], "t", "id", "id", []).count() == last_known(e, c.limit(0), ["k"], "t", "id", "id", []).count() == 0


def test_in_force(spark):
    c = spark.createDataFrame([(10, 1), (20, 3), (30, 2), (None, 9), (5, None)], "t bigint, v int")
    e = spark.createDataFrame([(9,), (10,), (25,), (99,), (None,)], "t bigint")
    assert [r["f"] for r in in_force(e, c, "t", "v", "f").collect()] == [None, 1, 3, 3, None]
    assert {r["f"] for r in in_force(e, c.limit(0), "t", "v", "f").collect()} == {None}


GOOD = "C;n;2024-02-29;44;1 000,5;RUB;c;i;s;7707083893;x"
LINES = [
    (GOOD, []),
    ('C;n;" 29.02.2024 ";44;;RUB;"a ""b"" c";i;s;;"two; parts\nand a line"', []),
    ("C;n;2024-02-29;44;1 000 000.50;RUB;c;i;s;7707 083 893;x", []),
    (GOOD + '"', ["quoting"]),
    ('C;"n;2024-02-29;44;1;RUB;c;i;s;;x', ["quoting"]),
    ('C;"n" ;2024-02-29;44;1;RUB;c;i;s;;x', ["quoting"]),
    ('C;n"n;2024-02-29;44;1;RUB;c;i;s;;x', ["quoting"]),
    ('C;"a"b"c";2024-02-29;44;1;RUB;c;i;s;;x', ["quoting"]),
    (GOOD + ";y", ["column_count"]),
    ("C;n", ["column_count"]),
    ("", ["column_count"]),
    (None, ["column_count"]),
    ("C;n;2023-02-29;44;-1;RUB;c;i;s;7707083894;x", ["amount", "sign_date", "supplier_inn"]),
    ("C;n;;44;1 00,5;RUB;c;i;s;;x", ["amount", "sign_date"]),
    ("C;n;2024-02-29;44;1,234;RUB;c;i;s;нет;x", ["amount", "supplier_inn"]),
    ("C;n;2024-02-29;44;1;RUB;c;i;s;;" + "x" * 200_000, []),
    ('C;n;2024-02-29;44;1;RUB;c;i;s;;"' + '""' * 50_000 + '"', []),
]


def test_bad_rows(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(LINES)], "line_id bigint, line string, fields string")
    got = {r["line_id"]: sorted(r["reasons"]) for r in contract_lines(df).select("line_id", "reasons").collect()}
    assert got == {i: sorted(w) for i, (_, w) in enumerate(LINES)}
    good = {r["line_id"]: r for r in good_contracts(df).collect()}
    assert set(good) == {i for i, (_, w) in enumerate(LINES) if not w}
    assert str(good[0]["amount"]) == "1000.50" and good[0]["sign_date"] == dt.date(2024, 2, 29)
    assert good[1]["customer"] == 'a "b" c' and good[1]["subject"] == "two; parts\nand a line" and good[1]["amount"] is None
    assert str(good[2]["amount"]) == "1000000.50" and good[2]["supplier_inn"] == "7707083893"
    assert len(good[16]["subject"]) == 50_000
    assert contract_lines(df.limit(0)).count() == 0


def test_lines_too_wide_for_the_reader(spark):
    inside = ";".join(["x"] * 10 + ['"' + ";" * 40_000 + '"'])
    lines = [";" * 30_000, 'a"' + ";" * 30_000, inside]
    got = contract_lines(spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")).orderBy("line_id").collect()
    assert [r["reasons"][:1] for r in got] == [["column_count"], ["quoting"], ["supplier_inn"]]
    assert got[0]["corrupt"] == lines[0] and got[1]["corrupt"] == lines[1] and got[2]["fields"]["subject"] == ";" * 40_000


def test_join_dictionary(spark):
    rows = spark.createDataFrame([("hot",)] * 3000 + [(f"v{i}",) for i in range(1500)] + [(None,), ("unknown",)], "k string")
    known = written(rows.where("k IS NOT NULL AND k <> 'unknown'").groupBy("k").agg(F.count(F.lit(1)).alias("__n"), F.max(F.upper("k")).alias("u")), "test-values")
    out = join_dictionary(rows.withColumn("u", F.lit("clash")), known, ["k"])
    assert out.count() == 4502 and out.where("u = 'HOT'").count() == 3000 and out.where("u IS NULL").count() == 2 and out.where("u <> upper(k)").count() == 0
