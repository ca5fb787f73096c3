"""Matching of records without a key, on a small register with known pairs."""

import random

from pyspark.sql import functions as F

from okrug.llm.entity_match import attributes, match_cascade

SCHEMA = "id bigint, number string, amount bigint, at bigint, customer string, subject string"


def build(spark):
    rng = random.Random(5)
    things, jobs = ["мебели", "насосов", "окон", "водомеров", "светильников"], ["Поставка", "Ремонт", "Замена", "Аренда"]
    reg, obs, truth = [], [], {}
    for i in range(400):
        row = (i, f"А-{rng.randrange(10**8):08}/24", rng.randrange(10**5, 10**7), 1_700_000_000 + rng.randrange(800) * 86400, f'МБОУ "Школа {i % 90}" с. Село{i % 37}', f"{rng.choice(jobs)} {rng.choice(things)} для объекта {i % 23}")
        reg.append(row)
        kind = i % 8
        n, a, t, c, s = row[1:]
        if kind == 0:
            new = (n.lower().replace("-", " "), a, t, c.upper(), s)
        elif kind == 1:
            new = (None, a, t + 86400, " ".join(reversed(c.split())), s)
        elif kind == 2:
            new = (None, None, t, c.replace("о", "o"), s)
        elif kind == 3:
            new = (f"№ {n} от 2024", a + 5000, t, c, s.rsplit(" ", 2)[0])
        elif kind == 4:  # other contract of the same parties
            obs.append((10_000 + i, f"Б-{rng.randrange(10**8):08}/23", a + 777, t + 90 * 86400, c, s))
            continue
        elif kind == 5:  # only the number
            obs.append((10_000 + i, n, 5, t + 400 * 86400, "ООО Чужой заказчик", "Консервация музея"))
            continue
        elif kind == 6:  # only amount and date
            obs.append((10_000 + i, None, a, t, "ООО Чужой заказчик", "Консервация музея"))
            continue
        else:
            obs.append((10_000 + i, None, None, None, None, None))
            continue
        obs.append((10_000 + i, *new))
        truth[10_000 + i] = i
    make = lambda rows: attributes(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")), "id", "number", F.col("amount"), "at", "customer", "subject")
    return make(obs), make(reg), truth


def test_cascade(spark):
    obs, reg, truth = build(spark)
    got = match_cascade(obs, reg).collect()
    assert {r["id"]: r["match"] for r in got} == truth
    assert all(0 < r["confidence"] < 1 for r in got) and {r["rule"] for r in got} >= {"number", "amount_customer"}
    twice = match_cascade(obs, reg.union(reg)).collect()
    assert {r["id"]: r["match"] for r in twice} == truth
    assert match_cascade(obs.limit(0), reg).count() == match_cascade(obs, reg.limit(0)).count() == 0


def test_ties_are_left(spark):
    row = ("А-12345678/24", 1000, 1_700_000_000, "Школа 5", "Ремонт окон")
    make = lambda rows: attributes(spark.createDataFrame(rows, SCHEMA), "id", "number", F.col("amount"), "at", "customer", "subject")
    obs = make([(1, *row), (2, None, *row[1:]), (None, *row)])
    assert match_cascade(obs, make([(7, *row), (8, *row)])).count() == 0
    assert sorted((r["id"], r["match"]) for r in match_cascade(obs, make([(7, *row)])).collect()) == [(1, 7), (2, 7)]


def test_records_that_share_a_key_are_told_apart_by_what_must_agree(spark):
    day = 1_700_000_000
    reg = [(i, None, None, day, "МБОУ Школа 5", s) for i, s in enumerate(["Ремонт окон второго этажа", "Поставка школьной мебели", "Аренда насосных станций"])]
    reg += [(50 + i, None, None, day, "МБОУ Школа 6", "Вывоз мусора") for i in range(2)]
    reg += [(100 + i, None, None, day, "МБОУ Лицей", f"Покупка{i} товара{i} вида{i}") for i in range(3000)]  # a hot key
    obs = [(1, None, None, day, "МБОУ Школа 5", "Поставка школьной"), (2, None, None, day, "МБОУ Школа 6", "Вывоз"), (3, None, None, day, "МБОУ Лицей", "Покупка7 вида7")]
    make = lambda rows: attributes(spark.createDataFrame(rows, SCHEMA), "id", "number", F.col("amount"), "at", "customer", "subject")
    got = {r["id"]: r["match"] for r in match_cascade(make(obs), make(reg)).collect()}
    assert got[1] == 1 and 2 not in got
    # sketches of 64 bits may confuse a few of the 3,000, but never name a wrong one
    assert got.get(3, 107) == 107
    twice = {r["id"]: r["match"] for r in match_cascade(make(obs), make(reg + reg)).collect()}
    assert twice == got


def test_suppliers_tell_contracts_of_one_customer_and_day_apart(spark):
    day, schema = 1_700_000_000, SCHEMA + ", supplier string, inn string"
    make = lambda rows: attributes(spark.createDataFrame(rows, schema), "id", "number", F.col("amount"), "at", "customer", "subject", "supplier", "inn")
    reg = [(i, None, None, day, "МБОУ Школа 5", "Поставка мебели", f"ООО {s}", None) for i, s in enumerate(["Полюс", "Лагуна", "Сигма Снаб"])]
    reg += [(10 + i, None, 500, day + 40 * 86400, f"МБОУ Лицей {i}", f"Ремонт окон {i}", s, None) for i, s in enumerate(["ООО Вектор", "АО Родник"])]
    reg += [(20, None, None, day, "МУП Водоканал", "Аренда насосов", "ООО Теплолад", None)]
    reg += [(30 + i, None, None, day, "МБОУ Сад", "Вывоз мусора", "ИП", inn) for i, inn in enumerate(["7707083893", "7728168971"])]
    obs = [
        (1, None, None, day + 86400, "Школа 5 МБОУ", None, "«Лагуна» ООО", None), (2, None, None, day, "МБОУ Школа 5", "Поставка мебели", "Сигма", None), (3, None, None, day, "МБОУ Школа 5", "Поставка мебели", "ИП", None),
        (4, None, 500, None, None, "Ремонт окон", "Вектор", None), (5, None, None, day, "МУП Водоканал", "Аренда насосов № 4", "ООО Заречье", None), (6, None, None, day, "МБОУ Сад", "Вывоз мусора", "ИП", "7728168971"),
    ]
    got = {r["id"]: r["match"] for r in match_cascade(make(obs), make(reg)).collect()}
    assert got == {1: 1, 2: 2, 4: 10, 6: 31}
