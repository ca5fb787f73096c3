"""Deeply nested documents to related flat tables: path-value-ordinal triples, grouped by repeated ancestor and pivoted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from okrug.session import written

TRIPLE = "id bigint, path string, ordinals array<int>, value string, seq int"
#: Triples that are handed on at once, and paths of an unknown schema that become columns; what lies beyond stays in the long table.
BATCH, MOST_PATHS = 50_000, 5_000
#: Marks a step that is a list. A name's own dots, brackets and backslashes are written as JSON escapes.
LIST = "[]"

_STRING = r'"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"'
_VALUE = rf"(?:{_STRING}|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)|([\[{{]))"
_BLANKS = r"[ \t\n\r]*"
_MEMBER = re.compile(rf"{_BLANKS}{_STRING}{_BLANKS}:{_BLANKS}{_VALUE}{_BLANKS}").match
_ELEMENT = re.compile(rf"{_BLANKS}(){_VALUE}{_BLANKS}").match
_CLOSE = {True: re.compile(rf"{_BLANKS}\}}{_BLANKS}").match, False: re.compile(rf"{_BLANKS}\]{_BLANKS}").match}


def _unescaped(text: str) -> str:
    """What a JSON string means; half a surrogate pair, which no text can hold, becomes the replacement character."""
    text = json.loads(f'"{text}"')
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _name(key: str) -> str:
    if "\\" in key:
        key = _unescaped(key)
    if "." in key or "[" in key or "\\" in key:
        key = key.replace("\\", "\\u005c").replace(".", "\\u002e").replace("[", "\\u005b")
    return key


def _scan(text: str, names: list[str], ordinals: list[int], embedded: frozenset[str], out: list[tuple[str, list[int], str]]) -> bool:
    """Reads one JSON text token by token and appends its triples to `out`; whether the text is complete.

    `names` and `ordinals` are the steps down to the text; a stack of its own takes them further, so that depth is no limit. The
    path of a container is put together when its first scalar comes, as most of the containers of a deep text have none.
    """
    stack: list[tuple[bool, bool, str | None, list[int] | None]] = []
    # of the open container: is it an object, were steps added for it, its path and its ordinals once they are known
    inside, stepped, prefix, base = None, False, None, None
    at, fresh = 0, True
    while True:
        if inside is not None and fresh and (m := _CLOSE[inside](text, at)):
            at = m.end()
        else:
            m = _MEMBER(text, at) if inside else _ELEMENT(text, at)
            if not m:
                return False
            at, kind = m.end(), m.lastindex
            if kind == 4:
                is_list = m[4] == "["
                added = bool(inside) or (inside is None and is_list)
                if added:
                    names.append((_name(m[1]) if inside else "$") + (LIST if is_list else ""))
                    ordinals.append(0 if is_list else 1)
                elif inside is False and not is_list:
                    ordinals[-1] += 1
                stack.append((inside, stepped, prefix, base))
                inside, stepped, prefix, base, fresh = not is_list, added, None, None, True
                continue
            if prefix is None:
                prefix = ".".join(names)
                base = ordinals[:-1] if inside is False else ordinals[:]
            if inside:
                path, steps = (f"{prefix}.{_name(m[1])}" if prefix else _name(m[1])), [*base, 1]
            elif inside is None:
                path, steps = prefix, base
            else:
                ordinals[-1] += 1
                path, steps = prefix, [*base, ordinals[-1]]
            value = m[kind]
            if kind == 2:
                if "\\" in value:
                    value = _unescaped(value)
                if embedded and inside is not None and path.replace(LIST, "") in embedded:
                    before = len(out)
                    if not _scan(value, path.split("."), list(steps), frozenset(), out):
                        del out[before:]
                elif value := value.strip():
                    out.append((path, steps, value))
            elif value != "null":
                out.append((path, steps, value))
            if inside is None:
                return at == len(text)
            if not (text.startswith(",", at) or (m := _CLOSE[inside](text, at))):
                return False
            if text.startswith(",", at):
                at, fresh = at + 1, False
                continue
            at = m.end()
        # one container is closed, and all that end with it
        while True:
            if stepped:
                names.pop()
                ordinals.pop()
            inside, stepped, prefix, base = stack.pop()
            if inside is None:
                return at == len(text)
            if text.startswith(",", at):
                at, fresh = at + 1, False
                break
            m = _CLOSE[inside](text, at)
            if not m:
                return False
            at = m.end()


def triples_of(payload: str | None, embedded: frozenset[str] = frozenset()) -> list[tuple[str, list[int], str]]:
    """(path, ordinals, value) of each non-blank scalar of a complete JSON text, in the order of the text; nothing for any other text.

    A path joins member names by dots, with `[]` after those of lists; `ordinals` has the position of each step in its own list, from 1, and 1 where there
    is no list. A list at the very top is a step named `$`. Lists within lists count through. Blank and null members keep their place; a member that is given twice has
    two triples. A text at a path (without `[]`) in `embedded` is itself JSON. Read token by token, nested as deep as it may be.
    """
    out: list[tuple[str, list[int], str]] = []
    return out if payload is not None and _scan(payload.removeprefix("\ufeff"), [], [], embedded, out) else []


def triples(df: DataFrame, id_col: str, payload_col: str, embedded: tuple[str, ...] = ()) -> DataFrame:
    """The triples of all payloads with their place `seq` in the payload, written once to the shared folder: every table is pivoted from them."""
    places = frozenset(embedded)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, steps, seqs, paths, values = [], [0], [], [], [], []

        def full() -> pa.RecordBatch:
            ordinals = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), ordinals, pa.array(values, pa.string()), pa.array(seqs, pa.int32())], ["id", "path", "ordinals", "value", "seq"])

        for batch in batches:
            for i, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = triples_of(payload.as_py(), places)
                ids += [i] * len(found)
                seqs += range(len(found))
                for path, ordinals, value in found:
                    paths.append(path)
                    values.append(value)
                    steps += ordinals
                    ends.append(len(steps))
                if len(ids) >= BATCH:
                    yield full()
                    ids, ends, steps, seqs, paths, values = [], [0], [], [], [], []
        yield full()

    return written(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(payload_col).alias("payload")).mapInArrow(walk, TRIPLE), "triples")


@dataclass(frozen=True)
class Flat:
    """A flat table: the paths of its repeated ancestor, its parent table, and for each column the paths below the ancestor ("" = the ancestor itself)."""

    name: str
    ancestors: tuple[str, ...]
    columns: dict[str, tuple[str, ...]]
    parent: str | None = None


def _steps(path: str) -> list[str]:
    return path.split(".") if path else []


def discover(found: DataFrame, most: int = MOST_PATHS) -> list[Flat]:
    """One table for each repeated ancestor that the paths of the triples show, parents first, with all the paths below it as columns.

    An ancestor is repeated if it is a list in any payload; what stands outside of all lists is the table "". Only distinct paths reach the driver; if there are
    more than `most`, as where member names are data, the further ones in order of name have no column and stay in the long table of flat_tables().
    """
    marked = [r["path"] for r in found.select("path").distinct().orderBy("path").limit(most).collect()]
    repeated = {".".join(s.removesuffix(LIST) for s in _steps(p)[: k + 1]) for p in marked for k, s in enumerate(_steps(p)) if s.endswith(LIST)}
    groups: dict[str, dict[str, tuple[str, ...]]] = {}
    above = lambda path: next((up for k in range(len(_steps(path)), 0, -1) if (up := ".".join(_steps(path)[:k])) in repeated), "")
    for path in sorted({p.replace(LIST, "") for p in marked}):
        own = above(path)
        tail = path[len(own) :].removeprefix(".")
        groups.setdefault(own, {})[tail or "value"] = (tail,)
    for own in list(groups):
        while own:
            own = above(own.rpartition(".")[0])
            groups.setdefault(own, {})
    return [Flat(own, (own,), groups[own], above(own.rpartition(".")[0]) if own else None) for own in sorted(groups, key=lambda p: (len(_steps(p)), p))]


def flat_tables(found: DataFrame, specs: list[Flat], id_name: str) -> dict[str, DataFrame]:
    """One DataFrame per spec: id, the ordinals of all its ancestors (`<table>_no`), and its columns; and two long tables of what these don't hold.

    A row is a member of the repeated ancestor; its parent's key is a prefix of its own, which is the parent-child link. Members
    that hold no value have no row. Of several values of one cell, as of a member given twice, the last in the text stands. The tables "other" (id, path,
    ordinals, value) and "repeated" (the same with the table and column) hold the values at paths of no spec and those that a later one displaced.
    """
    by_name = {s.name: s for s in specs}
    plain = F.replace(F.col("path"), F.lit(LIST), F.lit(""))
    found = found.withColumn("__path", plain)

    def lineage(spec: Flat) -> list[Flat]:
        return [*(lineage(by_name[spec.parent]) if spec.parent is not None else []), spec]

    tables, taken, cells = {}, [], []
    for spec in specs:
        line = [up for up in lineage(spec) if up.ancestors != ("",)]
        steps = []  # (path, column, where the ordinals of each ancestor stand)
        for way in spec.ancestors:
            depths = [next(len(_steps(a)) for a in up.ancestors if way == a or way.startswith(a + ".")) for up in line]
            steps += [(".".join(x for x in (way, tail) if x), name, depths) for name, tails in spec.columns.items() for tail in tails]
        if not steps:
            continue
        column = F.create_map(*[F.lit(x) for path, name, _ in steps for x in (path, name)])
        where: Column = F.create_map(*[x for path, _, d in steps for x in (F.lit(path), F.array(*map(F.lit, d)).cast("array<int>"))])
        paths = [p for p, _, _ in steps]
        taken += paths
        own = found.where(F.col("__path").isin(paths)).withColumns({"__column": column[F.col("__path")], "__depth": where[F.col("__path")]})
        numbers = [f"{up.name}_no" for up in line]
        keys = [F.get("ordinals", F.get("__depth", F.lit(i)) - 1).alias(n) for i, n in enumerate(numbers)]
        names = list(spec.columns)
        tables[spec.name] = own.select(F.col("id").alias("__id"), *keys, "__column", "value", "seq").groupBy("__id", *[F.col(f"`{n}`") for n in numbers]).agg(*[F.max_by(F.when(F.col("__column") == x, F.col("value")), F.when(F.col("__column") == x, F.col("seq"))).alias(x) for x in names]).withColumnRenamed("__id", id_name)
        cells.append(own.select(F.col("id").alias(id_name), F.lit(spec.name).alias("table"), "__column", F.array(*[F.get("ordinals", F.get("__depth", F.lit(i)) - 1) for i in range(len(line))]).cast("array<int>").alias("__key"), "path", "ordinals", "value", "seq"))
    long = [F.col("path"), F.col("ordinals"), F.col("value")]
    tables["other"] = found.where(~F.col("__path").isin(taken)).select(F.col("id").alias(id_name), *long)
    if cells:
        every = cells[0]
        for more in cells[1:]:
            every = every.unionByName(more)
        cell = [id_name, "table", "__column", "__key"]
        last = every.groupBy(*cell).agg(F.max("seq").alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        tables["repeated"] = every.join(last, cell).where("seq < __last").select(id_name, "table", F.col("__column").alias("column"), *long)
    return tables


def nested_tables(df: DataFrame, id_col: str, payload_col: str, embedded: tuple[str, ...] = (), most: int = MOST_PATHS) -> dict[str, DataFrame]:
    """The related flat tables of JSON of any schema, by the path of their repeated ancestor ("" for what is outside of all lists), as discover() finds them.

    Payloads that are null, blank or no complete JSON give no rows, an empty table gives only empty tables "other"; further columns of `df` don't count.
    """
    found = triples(df, id_col, payload_col, embedded)
    return flat_tables(found, discover(found, most), id_col)


# The layouts of a register file.
XML_DOC = "Файл.Документ"
JSON_DOCS = ("records.normalized", "records.нормализовано")
REGISTER_EMBEDDED = ("records",)


def _ways(xml: str, plain: str) -> tuple[str, ...]:
    return (f"{XML_DOC}.{xml}", *(f"{d}.{plain}" for d in JSON_DOCS))


REGISTER = [
    Flat("document", (XML_DOC, "records"), {
        "inn_legal": ("ОргВклМСП.ИННЮЛ",),
        "inn_person": ("ИПВклМСП.ИННФЛ",),
        "inn": ("normalized.inn", "нормализовано.inn"),
        "district": ("СведМН.Район.Наим", "normalized.district", "нормализовано.district"),
        "okved_main": ("СвОКВЭД.СвОКВЭДОсн.КодОКВЭД", "normalized.okved_main", "нормализовано.okved_main"),
    }),
    Flat("okved_extra", _ways("СвОКВЭД.СвОКВЭДДоп", "okved_extra"), {"okved_extra": ("", "КодОКВЭД", "code")}, "document"),
    Flat("license", _ways("СвЛиценз", "licenses"), {"license": ("НомЛиценз", "number")}, "document"),
    Flat("license_activity", (f"{XML_DOC}.СвЛиценз.НаимЛицВД", *(f"{d}.licenses.activities" for d in JSON_DOCS)), {"license_activity": ("", "Текст", "name")}, "license"),
    Flat("product", _ways("СвПрод", "products"), {"product": ("", "КодПрод", "code")}, "document"),
]


def register_tables(files: DataFrame, id_col: str = "raw_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """The flat tables document, okved_extra, license, license_activity and product of register files, and what they leave in "other" and "repeated".

    Payloads that are null, blank or not complete JSON (a leading byte-order mark aside) give no rows; repeated payloads
    give the rows of each file; other columns of `files` are ignored. Files are read one at a time, so a file's size is
    bounded by a task's memory only; the pivots group by file and position, keys that cannot be hot.
    """
    return flat_tables(triples(files, id_col, payload_col, REGISTER_EMBEDDED), REGISTER, id_col)
