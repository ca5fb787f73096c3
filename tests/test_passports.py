from okrug.sources.passports import flat_passport, passport_facts


def test_state_machine(spark):
    rows = [("f", 1, ["x", "5"]), ("f", 2, ["Труд"]), ("f", 3, ["Занятые", ""]), ("f", 5, ["2024", "1 234,5"]), ("f", 4, ["2023", "7"]), ("f", 6, ["2025", "н/д"]), ("f", 7, []), ("g", 1, [None, " "]), ("g", 2, ["Дом"]), ("g", 3, ["2023", "1"])]
    got = passport_facts(spark.createDataFrame(rows, "file string, row int, cells array<string>"), "file", "row", "cells")
    assert sorted(map(tuple, got.collect()), key=str) == [("f", "Труд", "Занятые", "2023", 7.0), ("f", "Труд", "Занятые", "2024", 1234.5), ("g", "Дом", None, "2023", 1.0)]


def test_flat_export(spark):
    m, p = "МР А", "январь-декабрь"
    rows = [(m, "Занятость", f"Всего — {p}", "человек", 2023, 100.0, 1), (m, "Занятость", f"Всего — {p}", "человек", 2023, 9.0, 2), (m, "Занятость", f"Раздел А — {p}", "человек", 2023, 30.0, 3), (m, "Занятость", f"Раздел C — {p}", "человек", 2023, 20.0, 4), (m, "Занятость", f"Всего — {p}", "рублей", 2023, 5e4, 5), (m, "Занятость", f"Всего — {p}", "рублей", 2022, 1.0, 6), (m, "Другое", f"Всего — {p}", "рублей", 2023, 2.0, 7)]
    r = flat_passport(spark.createDataFrame(rows, "municipality string, section string, indicator string, unit string, year int, value double, line int"), "Занятость", 2023, p).first()
    assert (r["employed"], r["employed_A"], r["employed_C"], r["employed_B"], r["wage"]) == (100.0, 30.0, 20.0, None, 5e4)
