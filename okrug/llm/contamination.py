"""Evaluation passages inside a corpus: Wu-Manber search for runs of words."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, BLOCK_CHARS = 12, 20_000_000

# Latin letters that look like Cyrillic ones, and the letter that is written with or without dots.
LOOKALIKES = ("aceopxё", "асеорхе")
#: Invisible characters: all format characters and variation selectors of the basic plane.
INVISIBLE = {c: None for c in range(0x10000) if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or c == 0x034F}
FOLD = str.maketrans(*LOOKALIKES) | INVISIBLE
WORD = re.compile(r"[^\W_]+")
#: Letters with separate marks, and ligatures and wide or styled forms, which are composed first.
UNUSUAL = re.compile("[^\\W_][\u0300-\u036f]+|[\ufb00-\ufb06\uff00-\uffef\U0001d400-\U0001d7ff]")


def _composed(match: re.Match) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", match[0]) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """The words as a reader sees them: runs of letters or digits, whatever their case, dots on ё, look-alike letters or invisible characters."""
    if not text:
        return []
    if UNUSUAL.search(text):
        text = UNUSUAL.sub(_composed, text.translate(INVISIBLE))
    return WORD.findall(text.lower().translate(FOLD))


class WuManber:
    """Finds all given strings of exactly `length` words in one pass over a text of words.

    `shift` has, for each block of two words that occurs in a string, how far the window may move before such an end can
    align; any other block lets it jump by the most. At shift 0 the bucket of the block, by the hash of the string's first two words,
    gives the strings that may end here; a direct comparison confirms one.
    """

    def __init__(self, strings: Iterable[tuple[tuple[str, ...], int]], length: int):
        self.length, self.jump = length, length - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, str], list[tuple[str, ...]]]] = {}
        self.items: dict[tuple[str, ...], set[int]] = {}
        for string, item in strings:
            if string in self.items:
                self.items[string].add(item)
                continue
            self.items[string] = {item}
            for at in range(1, length):
                block = string[at - 1 : at + 1]
                self.shift[block] = min(self.shift.get(block, self.jump), length - 1 - at)
            self.buckets.setdefault(string[-2:], {}).setdefault(string[:2], []).append(string)

    def search(self, text: list[str]) -> Iterator[tuple[int, set[int]]]:
        """(position of the first word, items) of every occurrence."""
        shift, jump, n, reach = self.shift.get, self.jump, len(text), self.length - 1
        at = reach
        while at < n:
            block = (text[at - 1], text[at])
            step = shift(block, jump)
            if step:
                at += step
                continue
            start = at - reach
            for string in self.buckets[block].get((text[start], text[start + 1]), ()):
                if tuple(text[start : at + 1]) == string:
                    yield start, self.items[string]
            at += 1


def starts(texts: Iterable[tuple[object, str | None]], length: int) -> Iterator[tuple[tuple[str, ...], object]]:
    """(run of words, item) of every run of `length` words of the texts."""
    for item, text in texts:
        w = words(text)
        for k in range(len(w) - length + 1):
            yield tuple(w[k : k + length]), item


#: The index that this worker built last, with the name of its block.
_built: dict[str, WuManber] = {}


def _index(name: str, texts: list[tuple[object, str | None]], length: int) -> WuManber:
    """The index of a block, built once by each worker process from the block's texts; only the last one is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = WuManber(starts(texts, length), length)
    return _built[name]


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, passages): each document that holds `min_words` consecutive words of an item.

    `first_word` is the place of the first such passage, from 0; `passages` counts the starts of such runs. The test items are a
    stated query set: they go to the executors in blocks of at most `block_chars` characters, each block against all
    documents, so that no table sent out grows with the data. Whole texts are searched. No shuffle.

    Each worker builds the index of a block from its texts. Null and empty texts, and items of fewer words, have no rows; repeated documents each have theirs, as do repeated
    items; a row with a null id keeps it. Other columns are ignored.
    """
    spark = documents.sparkSession
    if min_words < 2:
        raise ValueError("a passage has two words at least")
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)[item_id]}, first_word int, passages int"
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == block).select(item_id, item_text)
        # the texts of a block, whose size is bounded; what is made of them is made on the executors
        shared, name = spark.sparkContext.broadcast([(item, body) for item, body in part.collect()]), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            search = _index(name, shared.value, min_words).search
            for batch in batches:
                rows = []
                for doc, body in zip(batch["doc_id"], batch["text"]):
                    found: dict[int, list[int]] = {}
                    for at, hit in search(words(body)):
                        for item in hit:
                            found.setdefault(item, [at, 0])[1] += 1
                    rows += [(doc, item, *x) for item, x in found.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "passages"])

        found = docs.where(F.length("text") > 0).mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out
