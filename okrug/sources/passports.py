"""Passports of municipalities: a row state machine over laid-out cells, and a flat export with parentless indicators."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Cyrillic capitals that look like the Latin section letters.
LOOKALIKES = ("АВЕКМНОРСТХ", "ABEKMHOPCTX")


def passport_facts(cells: DataFrame, file: str, row_no: str, cells_col: str) -> DataFrame:
    """(file, block, section, period, value): the facts of tables whose rows are blocks, sections or periods.

    A row of one cell opens a block; a row of a text and empty cells opens a section; a row of a text and a number is a period of the
    section that is open. Rows before any block, and values that are no numbers, give nothing. Files are read in row order, one at a time.
    """
    schema = "file string, block string, section string, period string, value double"

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, block, section = [], None, None
        for row in group.sort_values("n")["c"]:
            texts = [str(x).strip() for x in row if x is not None]
            filled = [x for x in texts if x]
            if not filled:
                continue
            if len(texts) == 1:
                block, section = filled[0], None
            elif len(filled) == 1:
                section = filled[0]
            elif block:
                try:
                    value = float(re.sub(r"\s", "", filled[-1]).replace(",", "."))
                except ValueError:
                    continue
                out.append((key[0], block, section, filled[0], value))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    rows = cells.select(F.col(file).alias("file"), F.col(row_no).alias("n"), F.col(cells_col).alias("c"))
    return rows.groupBy("file").applyInPandas(walk, schema)


def flat_passport(export: DataFrame, section: str, year: int, period: str) -> DataFrame:
    """(municipality, employed, employed_<letter>, wage): facts of a flat export (municipality, section, indicator, unit, year, value, line).

    An indicator's block is told by its unit; of repeated indicators the first line stands, as the next is another form of
    ownership. Section letters typed in Cyrillic count as Latin ones.
    """
    d = export.where((F.col("section") == section) & (F.col("year") == year) & F.col("indicator").endswith(period))
    first = d.withColumn("__at", F.row_number().over(Window.partitionBy("municipality", "indicator", "unit").orderBy("line"))).where("__at = 1")
    letter = F.translate(F.regexp_extract("indicator", r"^Раздел\s+(\S)", 1), *LOOKALIKES)
    total = F.col("indicator").startswith("Всего")
    people, money = F.col("unit") == "человек", F.col("unit") == "рублей"
    sums = [F.sum(F.when(people & (letter == x), F.col("value"))).alias(f"employed_{x}") for x in "ABCDEFGHIJKLMNOPQRS"]
    return first.groupBy("municipality").agg(F.max(F.when(people & total, F.col("value"))).alias("employed"), *sums, F.max(F.when(money & total, F.col("value"))).alias("wage"))
