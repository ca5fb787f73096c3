"""Workbooks, text documents, archives and streams on files made here; kernels against plain loops."""

import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from okrug.operators import kernels as X
from okrug.operators import network as N
from okrug.operators import panel as P
from okrug.operators import quality as C
from okrug.operators.graph import pagerank
from okrug.sources import office, readers, writers


def test_workbooks(spark, tmp_path):
    rows = [["Сводка"], [None, "Район", "Сумма", "2024"], [None, "Южный", None, "1,5"], [None, "Северный & Ко", None, "2"], [], [None, "Итого", None, "3,5"]]
    office.write_workbook({"Лист <1>": rows, "пустой": []}, str(tmp_path / "a.xlsx"))
    office.write_workbook({"x": [["нет", "заголовка"]]}, str(tmp_path / "b.xlsx"))
    got = office.read_workbooks(spark, str(tmp_path))
    assert [(r["sheet"], r["row"], r["cells"]) for r in got.where("path LIKE '%a.xlsx'").orderBy("row").collect()][:2] == [("Лист <1>", 1, ["Сводка"]), ("Лист <1>", 2, [None, "Район", "Сумма", "2024"])]
    assert [tuple(r)[2:] for r in office.sliced(got, 3, 4, {"name": 1, "value": 3}).orderBy("row").collect()] == [(3, "Южный", "1,5"), (4, "Северный & Ко", "2")]
    table = office.below_header(got, {"name": "Район", "value": "Сумма"}, by=("path", "sheet"))
    assert [r["name"] for r in table.orderBy("row").collect()] == ["Южный", "Северный & Ко", "Итого"]
    moved = office.below_header(got, {"value": "Сумма"}, offset=1)
    assert [r["value"] for r in moved.orderBy("row").collect()] == ["1,5", "2", "3,5"]
    assert office.below_header(got, {"value": "нет такого"}).count() == 0
    assert [office._column(x) for x in ("A1", "Z9", "AA7", "BC12")] == [0, 25, 26, 54]


def test_shared_texts_of_a_workbook(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="q"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>один</t></si><si><r><t>дв</t></r><r><t>а</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c t="s"><v>1</v></c><c><v>4.5</v></c><c r="E1" t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert [r["cells"] for r in office.read_workbooks(spark, str(tmp_path)).collect()] == [["два", "4.5", None, None, "один"]]


def test_documents_and_archives(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in (("Район", "2024"), ("Южный", "7"))) + "</w:tbl>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{p("Дотации")}{p(" ")}{table}{p("Иное")}{table}</w:body></w:document>')
    got = office.read_document_tables(spark, str(tmp_path)).orderBy("table_no", "row").collect()
    assert [(r["table_no"], r["heading"], r["row"], r["cells"]) for r in got][1:3] == [(1, "Дотации", 2, ["Южный", "7"]), (2, "Иное", 1, ["Район", "2024"])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.xml", "<a/>")
        z.writestr("b.txt", "no")
    assert [(r["member"], bytes(r["content"])) for r in office.read_archives(spark, str(tmp_path), r"\.xml$").collect()] == [("in/a.xml", b"<a/>")]
    places = spark.createDataFrame([("80401000000", "город Уфа"), ("80401000001", "Уфа"), ("80402000000", "Сельское Поселение X")], "oktmo string, name string")
    assert [r["name"] for r in readers.totals_of_places(places, "oktmo", "name").collect()] == ["город Уфа"]


def test_rank_flows_from_payer_to_payee(spark):
    edges = [(1, 3, 2.0), (2, 3, 1.0), (3, 4, 1.0), (4, 3, 1.0), (1, 2, 2.0)]
    got = {r["node"]: r["rank"] for r in pagerank(spark.createDataFrame(edges, "src int, dst int, w double")).collect()}
    m = np.zeros((4, 4))
    for s, d, w in edges:
        m[s - 1, d - 1] += w
    m /= m.sum(1, keepdims=True)
    r = np.full(4, 0.25)
    for _ in range(500):
        r = 0.15 / 4 + 0.85 * r @ m
    assert np.allclose([got[i] for i in range(1, 5)], r, atol=1e-7)


def test_alignment_against_all_renamings():
    rng = np.random.default_rng(3)
    for _ in range(40):
        ref, lab = rng.integers(0, 3, 20), rng.integers(0, 4, 20)
        got = X.align(ref, lab)
        assert len(np.unique(got)) == len(np.unique(lab)) and X.rand_index(got, lab) == 1.0
        names = list(range(8))
        best = max(sum(int(n[g] == r) for g, r in zip(np.unique(lab, return_inverse=True)[1], ref)) for n in itertools.permutations(names, len(np.unique(lab))))
        assert int((got == ref).sum()) == best
    assert list(X.align(np.array([0, 0, 1, 1, 2, 2]), np.array([8, 8, 3, 3, 7, 7]))) == [0, 0, 1, 1, 2, 2]


def test_scaling_and_ward_give_back_what_is_there():
    rng = np.random.default_rng(1)
    at = rng.normal(size=(30, 2))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    out = X.mds(d)
    assert np.allclose(np.sqrt(((out[:, None] - out[None]) ** 2).sum(2)), d)
    assert np.allclose(X.procrustes(out, at), at)
    blobs = np.concatenate([rng.normal(c, 0.3, (15, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    truth = np.repeat([0, 1, 2], 15)
    for lab in (X.ward(blobs, 3), X.gaussian_mixture(blobs, 3), X.kmeans(blobs, 3)):
        assert X.rand_index(lab, truth) == 1.0
    w = np.exp(-((blobs[:, None] - blobs[None]) ** 2).sum(2))
    np.fill_diagonal(w, 0)
    deg, same = w.sum(1), truth[:, None] == truth[None]
    assert np.isclose(X.modularity(w, truth), ((w - np.outer(deg, deg) / w.sum()) * same).sum() / w.sum())


def test_small_operators(spark, tmp_path):
    money = spark.createDataFrame([(123456789,), (5,), (0,), (None,)], "c bigint").select(P.money_text(F.col("c")).alias("m"), P.signed_text(F.col("c") - 500, 100).alias("s"))
    assert [tuple(r) for r in money.collect()] == [("1 234 567,89", "+1 234 562"), ("0,05", "-4"), ("0,00", "-5"), (None, None)]
    assert P.shared_domain(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), "v", 5).first()["step"] is None
    assert P.shared_domain(spark.createDataFrame([(0.0,), (13.0,)], "v double"), "v", 5).first()["step"] == 5.0
    parts = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 1)], "y int, e string, v bigint")
    totals = spark.createDataFrame([(1, 11), (2, 9), (3, 1)], "y int, t bigint")
    assert sorted(map(tuple, C.totals_hold(parts, totals, "y", "e", "v", "t").collect())) == [(1, 2, 2, True), (2, 1, 1, False), (3, 0, 0, False)]
    assert [tuple(r) for r in C.parts_complete(spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], "f string, k int"), "f", "k").orderBy("f").collect()] == [("a", 2, 3, False), ("b", 1, 1, True)]
    roads = spark.createDataFrame([(1, 2, "road", 5.0), (2, 1, "road", 4.0), (1, 3, "rail", 1.0)], "src int, dst int, type string, w double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    assert {(r["src"], r["dst"]): r["w"] for r in N.road_distance(roads, nodes, "road").collect()} == {(1, 2): 4.0, (2, 1): 4.0, (1, 3): None, (3, 1): None, (2, 3): None, (3, 2): None}
    with pytest.raises(Exception, match="(?i)exist"):
        writers.create_table(nodes, str(tmp_path / "t")) and writers.create_table(nodes, str(tmp_path / "t"))


def test_pairs_one_to_one_against_taking_one_after_the_other(spark):
    rng = np.random.default_rng(8)
    scores = [(int(a), int(b), float(rng.integers(6, 10)) / 10) for a in range(12) for b in range(9) if rng.random() < 0.6]
    want, used_a, used_b = [], set(), set()
    for a, b, s in sorted(scores, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used_a and b not in used_b:
            want.append((a, b, s))
            used_a.add(a)
            used_b.add(b)
    df = spark.createDataFrame(scores, "a int, b int, ratio double")
    assert sorted(map(tuple, N.greedy_pairs(df).collect())) == sorted(want)
    assert N.greedy_pairs(df.limit(0)).count() == 0
    names = spark.createDataFrame([(1, "белебей"), (2, ""), (3, None)], "i int, x string")
    other = spark.createDataFrame([(5, "белибей"), (6, "уфа")], "j int, y string")
    assert [(r["a"], r["b"], round(r["ratio"], 3)) for r in N.name_ratios(names, "i", "x", other, "j", "y", 0.6).collect()] == [(1, 5, 0.857)]
