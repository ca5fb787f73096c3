"""Freely typed values mapped to a canonical list: an automaton over names and aliases, then the similarity of word sets."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from okrug.operators.hotjoin import join_dictionary
from okrug.session import discard, written

SIMILARITY, MOST_ENTRIES = 0.75, 200_000
#: Share of the score that a word beyond those of the name takes off, and names beside which a word must stand to count as no part of any.
EXTRA, BESIDE = 0.02, 3

# Keyboard layouts, transliteration, look-alike letters, words that name a kind of place, and words that name none.
LATIN_KEYS, RUSSIAN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`{}:\"<>~", "йцукенгшщзхъфывапролджэячсмитьбюёхъжэбюё"
LATIN_OF = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
LOOKALIKES = ("aceopx", "асеорх")
KINDS = {
    "district": "район р-н мр муниципальный мун муниципального rayon mr mun",
    "city": "г гор город го городской округ g gor gorod go",
    "locality": "с село д дер деревня п пос поселок х хутор рп пгт снт s selo d der derevnya p pos kh rp",
}
#: Words that make a name of the word before them one of a region, which contains the places of the list.
REGIONS = frozenset("край области область обл республика респ kray oblast".split())
TYPES = {word: kind for kind, words in KINDS.items() for word in words.split()}
#: Abbreviations that keep their dot when typed in the wrong layout.
SWAPPED_DOT = re.compile(r"(?:(?<=^)|(?<=[\s(\"]))(u|ujh|c|l|lth|g|gjc|\[|v|vey)\.")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
CASE_ENDING = re.compile(r"(?<=ск)(?:ого|ому|ом|им|ая|ой|ую|ое)$")
UNSWAP, LOOK = str.maketrans(LATIN_KEYS, RUSSIAN_KEYS), str.maketrans(*LOOKALIKES)


def transliterated(text: str) -> str:
    return "".join(LATIN_OF.get(c, c) for c in text)


def tokens(text: str) -> list[str]:
    """Lower-case words without punctuation; a word's look-alike Latin letters count as Cyrillic if it has a Cyrillic letter."""
    text = INVISIBLE.sub("", text.lower()).replace("ё", "е")
    out = []
    for chunk in re.split(r"[\s,;:/()\"«»„“”'№\[\]{}]+", text):
        if re.search("[а-я]", chunk) or chunk.rstrip(".") in ("c", "x", "p"):
            chunk = chunk.translate(LOOK)
        chunk = re.sub(r"(?:м\.?|m\.?)?(?:р-н|r-n)", " район ", chunk)
        for part in chunk.split():
            word = ""
            for bit in re.split(r"[.\-–—]+", part):  # a stray dot or hyphen inside a word is noise, one after an abbreviation isn't
                if bit in TYPES and not word:
                    out.append(bit)
                else:
                    word += bit
            if word:
                out.append(CASE_ENDING.sub("ий", word))
    return out


class Word:
    """A word to compare with others: its edits to another, a swap of neighbours being one, by bit-parallel columns (Hyyro's form of Myers' method)."""

    def __init__(self, text: str):
        self.text, self.places = text, {}
        for k, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << k
        self.full, self.last = (1 << len(text)) - 1, 1 << len(text) >> 1

    def edits(self, other: str, most: int) -> int:
        """Edits to `other`; most + 1 if there are more."""
        score, n = len(self.text), len(other)
        if abs(score - n) > most:
            return most + 1
        if not score:
            return n
        full, last, places = self.full, self.last, self.places
        up, down, diagonal, before = full, 0, 0, 0
        for k, c in enumerate(other, 1):
            here = places.get(c, 0)
            swap = ((~diagonal & here) << 1) & before
            diagonal = ((((here & up) + up) ^ up) | here | down | swap) & full
            right, left = (down | ~(diagonal | up)) & full, diagonal & up
            if right & last:
                score += 1
            elif left & last:
                score -= 1
            if score - (n - k) > most:
                return most + 1
            right = (right << 1 | 1) & full
            up, down, before = (left << 1 | ~(diagonal | right)) & full, right & diagonal, here
        return score if score <= most else most + 1


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    return Word(a).edits(b, most)


def _bigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + 2] for k in range(len(padded) - 1)]


class Canon:
    """The canonical list: (name, kind) to place ids, the automaton, and an index of bigrams."""

    def __init__(self, entries: list[tuple[int, str, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.places: dict[tuple[str, str], list[int]] = defaultdict(list)
        names: dict[str, set[str]] = defaultdict(set)
        for place, name, kind in entries:
            words = tokens(name or "")
            if words:
                key = " ".join(words)
                self.places[key, kind].append(place)
                names[key].add(kind)
        self.kinds = {k: sorted(v) for k, v in names.items()}
        #: words that tell apart names of one base, such as Upper and Lower
        self.modifiers = {n.split()[0] for n in names if " " in n}
        self.automaton = ahocorasick.Automaton()
        for name in names:
            for alias in {name, transliterated(name)}:
                self.automaton.add_word(f" {alias} ", (len(alias) + 2, name))
        if names:
            self.automaton.make_automaton()
        bases = {n: [w for w in n.split() if w not in self.modifiers] or n.split() for n in names}
        self.index = self._indexed(("".join(base), name) for name, base in bases.items())
        #: names by their words without modifiers, and an index of the words' bigrams
        self.bases = bases
        self.holders: dict[str, list[str]] = defaultdict(list)
        for name, base in self.bases.items():
            for w in set(base):
                self.holders[w].append(name)
        self.word_index = self._indexed((w, w) for w in self.holders)
        self.spelt = [(m, transliterated(m)) for m in sorted(self.modifiers)]
        self._known: dict[str, tuple[float, str] | None] = {}

    @staticmethod
    def _indexed(entries: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str, int]]]:
        """(form, entry, number of bigrams) by bigram, of each form and its transliteration."""
        index: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
        for form, entry in entries:
            for spelling in {form, transliterated(form)}:
                grams = set(_bigrams(spelling))
                for gram in grams:
                    index[gram].append((spelling, entry, len(grams)))
        return dict(index)

    def mentions(self, words: list[str]) -> list[str]:
        """Names that stand in the words: the longest match wins, and matches don't overlap."""
        if not self.kinds or not words:
            return []
        text, found = f" {' '.join(words)} ", []
        hits = sorted(((end + 1 - n, end + 1, name) for end, (n, name) in self.automaton.iter(text)), key=lambda h: (h[0] - h[1], h[0]))
        for start, end, name in hits:
            if all(end - 1 <= a or start >= b - 1 for a, b, _ in found):
                found.append((start, end, name))
        taken = {w for a, b, _ in found for w in text[a:b].split()}
        if any(w in self.modifiers for w in words if w not in taken):
            return []  # another place of the same base
        return [name for _, _, name in sorted(found)]

    def _near(self, text: str, index: dict[str, list[tuple[str, str, int]]]) -> Iterator[tuple[float, str]]:
        """(similarity, entry) of the entries of an index whose form is similar enough to `text`, the similarity being 1 - edits / length."""
        counts = Counter(entry for gram in set(_bigrams(text)) for entry in index.get(gram, ()))
        word, n = Word(text), len(text)
        for (form, name, grams), shared in counts.items():
            longest = max(len(form), n)
            most = int((1 - self.similarity) * longest + 1e-9)
            # an edit breaks at most three bigrams, so that fewer in common rule a name out
            if shared < grams - 3 * most or abs(len(form) - n) > most:
                continue
            edits = word.edits(form, most)
            if edits <= most:
                yield 1 - edits / longest, name

    def _modifier(self, word: str) -> tuple[float, str] | None:
        """(similarity, modifier) of the modifier that a word is, with a slip or two."""
        if word not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[word] = self._read_modifier(word)
        return self._known[word]

    def _read_modifier(self, word: str) -> tuple[float, str] | None:
        if word in self.modifiers:
            return 1.0, word
        typed, latin = Word(word), word.isascii()
        for m, spelt in self.spelt:
            if latin and spelt == word:
                return 1.0, m
            most = 1 if len(m) < 7 else 2
            if len(word) > 3 and (edits := typed.edits(m, most)) <= most:
                return 1 - edits / max(len(word), len(m)), m
        return None

    def similar(self, words: list[str], kind: str = "") -> tuple[float, str] | None:
        """(score, name) of the name whose set of words is most similar to that of `words`, or None.

        Each word of a name is compared to its most similar word here, wherever it stands; the score is the mean by length, and each further word takes EXTRA off. All
        words as one are a second reading, as a name may be split. A modifier here must be one of the name, and one of the name must be here. Names of `kind` win, then the better score, then the first name.
        """
        slips = {w: m for w in words if (m := self._modifier(w))}
        modifiers = {m for _, m in slips.values()}
        rest = [w for w in words if w not in slips]
        if not rest:
            return None
        near: dict[str, float] = {}
        for w in set(rest):
            for score, word in [(1.0, w)] if w in self.holders else self._near(w, self.word_index) if len(w) >= 4 else ():
                near[word] = max(near.get(word, 0.0), score)
        sure = {m: max(s for s, x in slips.values() if x == m) for m in modifiers}
        own = lambda name: [w for w in name.split() if w in self.modifiers] if " " in name else []

        def total(name: str, base: float, length: int) -> float:
            mods = own(name)
            return (base * length + sum(sure[m] * len(m) for m in mods)) / (length + sum(map(len, mods)))

        found = []
        for name in {n for word in near for n in self.holders[word]}:
            base = self.bases[name]
            if set(own(name)) == modifiers and all(w in near for w in base):
                length = sum(map(len, base))
                score = total(name, sum(near[w] * len(w) for w in base) / length, length)
                found.append((kind not in self.kinds[name], -score * (1 - EXTRA) ** min(max(len(rest) - len(base), 0), 10), name))
        glued = "".join(rest)
        if len(glued) >= 4:
            for score, name in self._near(glued, self.index):
                if set(own(name)) == modifiers:
                    found.append((kind not in self.kinds[name], -total(name, score, len(glued)), name))
        best = min(found, default=None)
        return best and (-best[1], best[2])

    def readings(self, value: str) -> list[list[str]]:
        """The value's words without numbers: as they stand, and as typed in the wrong keyboard layout; names of regions are left out where the list has none such."""
        out = [tokens(value)]
        if not re.search("[а-яё]", value.lower()):
            out.append(tokens(SWAPPED_DOT.sub(r"\1 ", value.lower()).translate(UNSWAP)))
        return [self._without_regions([w for w in r if not w.isdigit()]) for r in out]

    def _without_regions(self, words: list[str]) -> list[str]:
        out: list[str] = []
        for w in words:
            if w in REGIONS and f"{out[-1]} {w}" not in self.kinds if out else w in REGIONS:
                out = out[:-1]
            else:
                out.append(w)
        return out

    def mentioned(self, value: str, kind: str) -> tuple[str | None, list[str]]:
        """(name, words beside it): the name that stands in the value, words that tell a kind of place counting at first, as names may have them."""
        for plain in (False, True):
            for words in self.readings(value):
                words = [w for w in words if w not in TYPES] if plain else words
                if found := self.mentions(words):
                    name = min(found, key=lambda n: (kind not in self.kinds[n], -len(n), n))
                    taken = {w for n in found for w in (*n.split(), *transliterated(n).split())}
                    return name, [w for w in words if w not in taken and w not in TYPES]
        return None, []

    def resolve(self, value: str, kind: str, noise: frozenset[str] = frozenset()) -> tuple[str | None, str, float]:
        """(name, method, confidence) of the entry meant by `value`, typed where `kind` is expected; name is None if there is none. Words in `noise` are no part of a name."""
        name, _ = self.mentioned(value, kind)
        return (name, "mention", 1.0) if name else self.resembled(value, kind, noise)

    def resembled(self, value: str, kind: str, noise: frozenset[str] = frozenset()) -> tuple[str | None, str, float]:
        """As resolve(), for a value in which no name stands as it is."""
        near = [x for words in self.readings(value) if (x := self.similar([w for w in words if w not in TYPES and w not in noise], kind))]
        if near:
            score, name = min(near, key=lambda x: (-x[0], x[1]))
            return name, "similar", score
        return None, "none", 0.0


def map_to_canon(rows: DataFrame, row_id: str, fields: dict[str, str], refs: DataFrame, context: str | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(row_id, field, value, place_id, method, confidence): one row per non-blank value of the columns in `fields`.

    `fields` tells the kind of entry that a column asks for; another kind is found too, but that one wins if several are meant. `refs`
    (place_id, name, kind, mo_id) is the canonical list, whose size is checked before it is sent out. place_id is 0 where no
    entry is meant. Of entries that share a name, the one whose mo_id is that of the entry in the row's column `context` is meant; where
    that tells nothing, the least place_id stands.

    Words that stand beside BESIDE or more names of the list, as regions, streets or remarks do, are left out of the comparison of words.
    Each distinct value is resolved once; values are joined back by broadcast if hot, else by a shuffle. Null and blank
    values have no row; repeated rows each have theirs; an empty list maps everything to 0; long values are read whole.
    """
    entries = refs.select("place_id", "name", "kind", "mo_id").where(F.col("place_id").isNotNull()).take(MOST_ENTRIES + 1)
    if len(entries) > MOST_ENTRIES:
        raise ValueError("the canonical list is too long to be sent out")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([(e["place_id"], e["name"], e["kind"]) for e in entries])
    blank = r"^[\s\u00a0\u1680\u2000-\u200f\u202f\u205f\u2060\u3000\ufeff]*$"
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in fields.items()])
    asked = F.when(F.col(context).rlike(blank), None).otherwise(F.col(context)) if context else F.lit(None).cast("string")
    long = rows.select(F.col(row_id).alias("row_id"), asked.alias("context"), F.explode(each).alias("x")).select("row_id", "context", "x.*").where(F.col("value").isNotNull() & ~F.col("value").rlike(blank))
    counts = written(long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("__n")), "typed-values")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def places(known: Canon, name: str | None, kind: str) -> list[int]:
        kinds = known.kinds.get(name, [])
        chosen = kind if kind in kinds else kinds[0] if kinds else None
        return sorted(known.places.get((name, chosen), []))

    def mention(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Canon(shared.value, similarity)
        for batch in batches:
            out = []
            for kind, value, rows_ in zip(batch["kind"], batch["value"], batch["__n"]):
                name, beside = known.mentioned(value, kind)
                if name:  # a word of a name is never noise
                    beside = sorted({w for w in beside if w not in known.holders and w not in known.modifiers})
                else:
                    beside = sorted({w for words in known.readings(value) for w in words})
                out.append((kind, value, rows_, name, beside, places(known, name, kind)))
            yield pd.DataFrame(out, columns=["kind", "value", "__n", "name", "words", "places"])

    def resemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Canon(shared.value, similarity)
        for batch in batches:
            out = []
            for kind, value, rows_, noise in zip(batch["kind"], batch["value"], batch["__n"], batch["noise"]):
                name, method, confidence = known.resembled(value, kind, frozenset(() if noise is None else noise))
                out.append((kind, value, rows_, places(known, name, kind), method, confidence))
            yield pd.DataFrame(out, columns=["kind", "value", "__n", "places", "method", "confidence"])

    said = written(counts.repartition(n, "value").mapInPandas(mention, "kind string, value string, __n bigint, name string, words array<string>, places array<bigint>"), "typed-values-mentions")
    # a word that stands beside several names is no slip of another one
    beside = said.where("name IS NOT NULL").select("name", F.explode("words").alias("word")).groupBy("word").agg(F.count_distinct("name").alias("names")).where(F.col("names") >= BESIDE).select("word")
    open_ = said.where("name IS NULL")
    noise = open_.select("kind", "value", F.explode("words").alias("word")).join(beside, "word").groupBy("kind", "value").agg(F.collect_set("word").alias("noise"))
    rest = open_.join(noise, ["kind", "value"], "left").select("kind", "value", "__n", "noise").repartition(n, "value")
    resembled = rest.mapInPandas(resemble, "kind string, value string, __n bigint, places array<bigint>, method string, confidence double")
    sure = said.where("name IS NOT NULL").select("kind", "value", "__n", "places", F.lit("mention").alias("method"), F.lit(1.0).alias("confidence"))
    known = written(sure.unionByName(resembled), "typed-values-resolved")
    discard(counts, said)
    found = join_dictionary(long, known, ["kind", "value"])
    sure = found.where(F.size("places") <= 1).withColumn("place_id", F.coalesce(F.get("places", F.lit(0)), F.lit(0)))
    open_ = found.where(F.size("places") > 1)
    # the municipality of the context's entry, for the few rows whose name is shared
    mo = refs.select(F.col("place_id").cast("bigint").alias("p"), F.col("mo_id").alias("mo"))
    kind = fields.get(context, "")
    contexts = known.where((F.col("kind") == kind) & (F.size("places") == 1)).select(F.col("value").alias("context"), "__n", F.col("places")[0].alias("p")).join(F.broadcast(mo), "p").select("context", "__n", "mo")
    placed = join_dictionary(open_, contexts, ["context"])
    choice = placed.select("row_id", "field", "value", "method", "confidence", "mo", "places", F.posexplode("places").alias("at", "p")).join(F.broadcast(mo.withColumnRenamed("mo", "own")), "p", "left")
    rank = F.struct(F.when(F.col("own") == F.col("mo"), 0).otherwise(1).alias("far"), F.col("p").alias("p"))
    # per value of a row; rows may be repeated, so their copies are counted and given back
    chosen = choice.groupBy("row_id", "field", "value", "method", "confidence", "mo").agg(F.min(rank).alias("best"), F.sum(F.when(F.col("at") == 0, 1)).alias("copies"))
    chosen = chosen.withColumn("place_id", F.col("best.p")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    columns = ["row_id", "field", "value", F.col("place_id").cast("int").alias("place_id"), "method", "confidence"]
    return sure.select(*columns).unionByName(chosen.select(*columns))
