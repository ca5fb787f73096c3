"""Text operators: round trips, brute force on small fixtures, and the cases that each operator defines."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from okrug.llm.binpack import Packer, pack_documents
from okrug.llm.canonical import Canon, distance, map_to_canon, tokens
from okrug.llm.contamination import WuManber, leaked_passages, words
from okrug.llm.split import boundaries, pieces, split_documents
from okrug.llm.tokens import PYTHON, token_count


def test_tokens_count_alike(spark):
    texts = ["a_b 1,5 — «Ёж»!", "x²½Ⅷ", "́a​b\xadc", "   \x1c\x85", "日本語。", "", None, "emoji 😀😀!", "é", "﻿a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [len(PYTHON.findall(t or "")) for t in texts]


@given(st.lists(st.integers(0, 30), max_size=200), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_packer_keeps_its_promises(sizes, most_open):
    packer, bins = Packer(30, most_open), {}
    for size in sizes:
        number, place = packer.place(size)
        bins.setdefault(number, []).append(size)
        assert place == len(bins[number]) and sum(bins[number]) <= 30
        assert packer.used <= most_open and packer.used == sum(map(len, packer.open.values()))


def test_packing(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0, rng.randrange(1, 90), rng.randrange(1, 400), None])) for i in range(3000)] + [(None, 5), (None, 5), (7, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens int").withColumn("shard", F.lit("clash"))
    out = pack_documents(df, [(1, 100), (2, 1000)], items_a_shard=500).collect()
    assert sum(r["tokens"] for r in out if r["limit_id"] == 1) == sum(t or 0 for _, t in rows)
    for limit, capacity in ((1, 100), (2, 1000)):
        bins, own = {}, {}
        for r in out:
            if r["limit_id"] == limit:
                bins.setdefault((r["shard"], r["container"]), []).append(r)
                own.setdefault(r["doc_id"], []).append(r)
        assert all(sum(r["tokens"] for r in b) <= capacity and sorted(r["place"] for r in b) == list(range(1, len(b) + 1)) for b in bins.values())
        assert len(own) == 3001
        for doc, size in rows[:3000]:
            if doc == 7:
                continue
            mine = sorted(own[doc], key=lambda r: r["piece_no"])
            assert len(mine) == max(1, -(-(size or 0) // capacity)) and sum(r["tokens"] for r in mine) == (size or 0)
            assert [r["first_token"] for r in mine] == [1 + capacity * k for k in range(len(mine))]
        used = sum(r["tokens"] for b in bins.values() for r in b)
        assert used / (len(bins) * capacity) > 0.9
    again = pack_documents(df, [(1, 100)], items_a_shard=500).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in out if r["limit_id"] == 1)
    assert pack_documents(df.limit(0), [(1, 100)]).count() == pack_documents(df, []).count() == 0


def test_words_as_a_reader_sees_them():
    assert words("Пёс,\xad​72,9 Cелo — cело Х_x") == words("пес 72 9 село село х х")
    assert words("ｗｉｄｅ ёж") == words("wide ёж")
    assert words(None) == words("") == []


def test_wu_manber_against_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        text = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        n = rng.randrange(2, 5)
        pats = [(tuple(rng.choice("abc") for _ in range(n)), k) for k in range(rng.randrange(1, 6))]
        got = {(at, i) for at, items in WuManber(pats, n).search(text) for i in items}
        assert got == {(at, i) for at in range(len(text) - n + 1) for p, i in pats if tuple(text[at : at + n]) == p}


def test_leaks(spark):
    item = "один два три четыре пять шесть семь восемь девять десять 11 12 13"
    docs = [
        (1, f"до. {item.upper().replace(' ', ', ')} после"), (1, f"до. {item}"), (2, " ".join(item.split()[:11])), (3, item.replace("о", "o").replace(" ", "\n")),
        (4, "​".join(item)), (5, None), (6, ""), (None, item), (8, "слово " * 100_000 + item), (9, "один " * 13),
    ]
    items = [(10, item), (11, item), (12, "коротко"), (13, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(0))
    want = sorted([(x, y) for x in (1, 1, 3, 4, 8) for y in (10, 11)])
    for block in (20_000_000, 20):
        out = leaked_passages(d, i, block_chars=block)
        got = [(r["doc_id"], r["item_id"]) for r in out.collect()]
        assert sorted(x for x in got if x[0] is not None) == want and sum(x[0] is None for x in got) == 2
    assert leaked_passages(d, i).where("doc_id = 8").first()["first_word"] == 100_000
    assert leaked_passages(d.limit(0), i).count() == leaked_passages(d, i.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaked_passages(d, i, min_words=1)


TEXT = st.text(st.sampled_from("аб1 .,\n#Б-"), max_size=400)


@given(TEXT, st.integers(2, 12), st.integers(0, 11))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    spans = [m.span() for m in PYTHON.finditer(text)]
    out = pieces(boundaries(text, spans), limit, overlap)
    assert [k for a, b, o in out for k in range(a + o, b)] == list(range(len(spans)))
    assert all(b - a <= limit and o == (overlap if n else 0) for n, (a, b, o) in enumerate(out))


def test_boundaries_are_natural():
    text = "# One\n\n" + "a b c. " * 5 + "\n\n# Two\n\n" + "d e f. " * 5
    spans = [m.span() for m in PYTHON.finditer(text)]
    out = pieces(boundaries(text, spans), 24, 0)
    assert [text[spans[a][0] : spans[b - 1][1]].split("\n")[0] for a, b, _ in out] == ["# One", "# Two"]
    words_ = "a b c d e f g h"
    assert [b - a for a, b, _ in pieces(boundaries(words_, [m.span() for m in PYTHON.finditer(words_)]), 3, 1)] == [3, 3, 3, 2]


def test_splitting(spark):
    long = "Слово за словом. " * 2000
    rows = [(1, long), (1, long), (2, "x"), (3, None), (4, ""), (None, "a " * 50), (5, "." * 10_000), (6, ";a" * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("limit_id", F.lit("clash"))
    limits = [(3, 40, 5), (4, 1000, 0)]
    out = split_documents(df, limits).collect()
    text = dict(rows)
    for limit, most, overlap in limits:
        for doc in (1, 6, None):
            mine = sorted((r for r in out if r["doc_id"] == doc and r["limit_id"] == limit), key=lambda r: r["piece_no"])
            n = len(PYTHON.findall(text[doc]))
            if n <= most:
                assert not mine
                continue
            for r in mine:
                assert r["piece"] == text[doc][r["char_start"] : r["char_end"]] and len(PYTHON.findall(r["piece"])) == r["last_token"] - r["first_token"] + 1 <= most
                assert r["overlap"] == (overlap if r["piece_no"] > 1 else 0)
            covered = [k for r in mine for k in range(r["first_token"] + r["overlap"], r["last_token"] + 1)]
            assert sorted(covered) == sorted(list(range(1, n + 1)) * (2 if doc == 1 else 1))
    assert not [r for r in out if r["doc_id"] in (2, 3, 4, 5)]
    assert split_documents(df.limit(0), limits).count() == split_documents(df, []).count() == 0
    assert {r["piece"] for r in split_documents(df, limits, with_text=False).collect()} == {None}
    with pytest.raises(ValueError):
        split_documents(df, [(1, 5, 5)])


REFS = [(1, "Зуллёшук", "city", 1), (2, "Белдитовский", "district", 2), (3, "Гронтутовский", "district", 3), (4, "Хорпосен", "locality", 2), (5, "Новый Хорпосен", "locality", 2), (6, "Хорпосен", "locality", 3), (7, "Вертлёзагат", "city", 4)]


@pytest.mark.parametrize("value, kind, name", [
    ("ЗУЛЛЕШУК", "city", "зуллешук"), ("г.Зуллёшук, РФ", "city", "зуллешук"), ("Zulleshuk g.", "city", "зуллешук"), ("u. Pekk`ier", "city", "зуллешук"), ("u.Dthnk`pfufn", "city", "вертлезагат"),
    ("МР Белдитовского района", "district", "белдитовский"), ("Белдитовск. м.р-н", "district", "белдитовский"), ("hfqjy <tklbnjdcrbq", "district", "белдитовский"), ("Гpoнтутoвcкому p-н", "district", "гронтутовский"),
    ("д. Новый Хорпосен", "locality", "новый хорпосен"), ("с. Хорпоесн", "locality", "хорпосен"), ("Старый Хорпосен", "locality", "хорпосен"), ("x. Хор-посен", "locality", "хорпосен"),
    ("пгт Курчелёлем", "city", None), ("не указано", "city", None), ("-", "city", None), ("000000", "city", None), ("х" * 5000, "city", None),
])
def test_names_are_found(value, kind, name):
    assert Canon([r[:3] for r in REFS]).resolve(value, kind)[0] == name


@pytest.mark.parametrize("value, kind, name", [
    ("с. Хорпоесн, ул. Садовая", "locality", "хорпосен"), ("Белдитовсикй, собственник Жужелицын", "district", "белдитовский"), ("Хорпоесн Новый", "locality", "новый хорпосен"),
    ("Кукушкин Зуллешкк", "city", "зуллешук"), ("Вертлезагтт, Гронтутовскмй р-н", "district", "гронтутовский"), ("Zuleshuk Sadovaya", "city", "зуллешук"), ("Садовая Кукушкин", "city", None),
])
def test_a_typo_beside_other_words(value, kind, name):
    assert Canon([r[:3] for r in REFS]).resolve(value, kind)[0] == name


NAMES = [(1, "Заречный", "locality"), (2, "Новая Деревня", "locality"), (3, "Красная Поляна", "locality"), (4, "Новая Ляда", "locality"), (5, "Ям", "locality")]


@pytest.mark.parametrize("value, name, sure", [
    ("Заречный", "заречный", True), ("г. Заречный", "заречный", True), ("Заречный край, д. Новая Деревня", "новая деревня", True), ("Заречный край", None, False), ("Новая Деревня", "новая деревня", True),
    ("деревня Новая Деревня", "новая деревня", True), ("Краснае Поляна", "красная поляна", False), ("Поляна Красная", "красная поляна", False), ("пос. Ям", "ям", True), ("Старая Поляна", None, False),
])
def test_words_of_kind_and_region_may_be_names(value, name, sure):
    got = Canon(NAMES).resolve(value, "locality")
    assert got[0] == name and (got[2] == 1.0 and got[1] == "mention") == sure and got[2] <= 1


def test_slips_cost_in_every_word():
    canon = Canon(NAMES)
    assert canon.resolve("Краснае Поляна", "locality")[2] < 1 > canon.resolve("Красная Полана", "locality")[2]
    # a word that is beside other names, too, is no part of a name
    assert canon.resolve("зареч ный уточнить", "locality")[0] is None and canon.resolve("зареч ный уточнить", "locality", frozenset(["уточнить"]))[0] == "заречный"


def test_noise_is_found_in_the_values(spark):
    rows = [(i, None, f"{n}, поселковый совет") for i, (_, n, _) in enumerate(NAMES)] + [(9, None, "Зареч ный поселковый совет")]
    refs = spark.createDataFrame([(*r, 1) for r in NAMES], "place_id int, name string, kind string, mo_id int")
    got = map_to_canon(spark.createDataFrame(rows, "row_id bigint, d string, l string"), "row_id", {"l": "locality"}, refs)
    assert {r["row_id"]: r["place_id"] for r in got.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 9: 1}


def test_distance():
    assert [distance(*x, 9) for x in (("", ""), ("абв", "авб"), ("абв", "аб"), ("абв", "эюя"))] == [0, 1, 1, 3] and distance("аааа", "бббб", 2) == 3
    assert tokens("м.р-н  «Ёж»") == ["район", "еж"]


def test_mapping(spark):
    rows = [(1, "Белдитовский р-н", "с. Хорпосен"), (2, "Гронтутовский", "Хорпосен"), (2, "Гронтутовский", "Хорпосен"), (3, None, "Хорпосен"), (4, " ", "нет"), (5, None, None), (6, "???", "Новый Хорпосен")]
    df = spark.createDataFrame(rows, "row_id bigint, d string, l string").withColumn("place_id", F.lit(9))
    refs = spark.createDataFrame(REFS, "place_id int, name string, kind string, mo_id int")
    fields = {"d": "district", "l": "locality"}
    got = sorted((r["row_id"], r["field"], r["place_id"]) for r in map_to_canon(df, "row_id", fields, refs, "d").collect())
    assert got == [(1, "d", 2), (1, "l", 4), (2, "d", 3), (2, "d", 3), (2, "l", 6), (2, "l", 6), (3, "l", 4), (4, "l", 0), (6, "d", 0), (6, "l", 5)]
    assert {r["place_id"] for r in map_to_canon(df, "row_id", fields, refs.limit(0), "d").collect()} == {0}
    assert map_to_canon(df.limit(0), "row_id", fields, refs, "d").count() == 0
