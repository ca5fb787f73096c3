"""Records of two sources that share no key, matched by a cascade of exact joins on ever weaker attributes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from okrug.functions.registry import with_normal_inn
from okrug.session import HOT_SHARE, bucketed, discard, written

#: Days between the two sources' dates; edits between two spellings of a number; labelled rows in the mean, and the counts by which a precision is smoothed.
DAYS, EDITS, LABELLED, SMOOTHING = 4, 3, 50_000, (1.0, 1.0)
#: Rows of one key that need no dealing over tasks, and the hash places by which keys with more are looked for.
FEW_ROWS, PLACES = 10_000, 65_536

# Look-alike letters, invisible characters, words of legal forms, and words that carry no meaning in a subject.
LOOKALIKES = ("aceopxyё", "асеорхуе")
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
FORMS = (
    "мбдоу мбук мбоу мау мку муп гбуз гку ооо ао пк нпо ип муниципальное муниципальный бюджетное дошкольное образовательное общеобразовательное учреждение учреждения "
    "культуры автономное казенное унитарное предприятие государственное общество с ограниченной ответственностью акционерное производственный кооператив научно объединение"
).split()
SUBJECT_FILLERS = "договор контракт проект для по в на и с от лот согласно".split()


@dataclass(frozen=True)
class Rule:
    """Exact equality of `keys` (d within DAYS), and what must agree in part besides, of one register record only."""

    name: str
    keys: tuple[str, ...]
    verify: str
    #: whether a record of another supplier is ruled out
    supplier: bool = False
    #: the pass in which the rule's join runs; the rules of a pass are tried in their order
    turn: int = 0


RULES = [
    Rule("number", ("n",), "either"),
    Rule("amount_customer", ("a", "c"), "subject", turn=1),
    Rule("amount_subject", ("a", "s"), "customer", turn=1),
    Rule("amount_date", ("a", "d"), "either", turn=1),
    Rule("amount_supplier", ("a", "u"), "either", turn=1),
    Rule("customer_subject_date", ("c", "s", "d"), "none", turn=2),
    Rule("customer_supplier_date", ("c", "u", "d"), "no other subject", turn=2),
    Rule("subject_supplier_date", ("s", "u", "d"), "no other customer", turn=2),
    Rule("supplier_inn_date", ("i", "d"), "either", turn=3),
    Rule("customer_date", ("c", "d"), "subject", supplier=True, turn=3),
    Rule("subject_date", ("s", "d"), "customer", supplier=True, turn=3),
]


def _words(text: Column, without: list[str]) -> Column:
    """The text's distinct words in one fixed order, joined by blanks; null where there is none."""
    plain = F.translate(F.lower(text), LOOKALIKES[0] + INVISIBLE, LOOKALIKES[1])
    parts = F.array_distinct(F.split(plain, r"[^\p{L}\p{N}]+"))
    words = F.array_join(F.sort_array(F.array_except(parts, F.array(*[F.lit(x) for x in ["", *without]]))), " ")
    return F.nullif(words, F.lit(""))


def attributes(df: DataFrame, id_col: str, number: str, amount: Column, epoch: str, customer: str, subject: str, supplier: str | None = None, supplier_inn: str | None = None) -> DataFrame:
    """(id, n, a, d, i, c, s, u): number, amount, day, the supplier's INN, and the words of customer, subject and supplier.

    A number counts by its digits, without what follows the word for "of"; an amount by its value where it is positive; a
    name or subject by its set of words, whatever their order, case, punctuation, legal form or look-alike letters; an INN if it is normal. What is missing is null.
    """
    text = F.lit(None).cast("string")
    df = df.withColumns({"__supplier": F.col(supplier) if supplier else text, "__inn": F.col(supplier_inn) if supplier_inn else text})
    df = with_normal_inn(df, "__inn", "__normal")
    digits = F.regexp_replace(F.regexp_replace(F.col(number), r"(?iu)\s+от\s.*$", ""), "[^0-9]", "")
    out = df.select(F.col(id_col).alias("id"), digits.alias("digits"), amount.cast("bigint").alias("a"), F.floor((F.col(epoch) + 5 * 3600) / 86400).cast("int").alias("d"), F.col("__normal").cast("bigint").alias("i"), _words(F.col(customer), FORMS).alias("c"), _words(F.col(subject), SUBJECT_FILLERS).alias("s"), _words(F.col("__supplier"), FORMS).alias("u"))
    number = F.when(F.length("digits").between(4, 18), F.col("digits").cast("bigint"))
    return out.select("id", number.alias("n"), F.when(F.col("a") > 0, F.col("a")).alias("a"), "d", "i", "c", "s", "u")


def _shares(name: str) -> tuple[Column, Column]:
    """Shares of common words: of all words, and of the shorter text's; null where either side has none."""
    a, b = F.split(F.col(name), " "), F.split(F.col(f"{name}2"), " ")
    both = F.size(F.array_intersect(a, b))
    some = F.col(name).isNotNull() & F.col(f"{name}2").isNotNull()
    return F.when(some, both / (F.size(a) + F.size(b) - both)), F.when(some, both / F.least(F.size(a), F.size(b)))


def _with_shares(met: DataFrame) -> DataFrame:
    """Adds the shares that rules ask for, and `far`: 0 where INN or name tell the same supplier, 2 where they tell another one, 1 where nothing is told."""
    met = met.withColumns({"__c": _shares("c")[0], "__s": _shares("s")[1], "__u": _shares("u")[1]})  # subjects are cut short, so the shorter one's words count
    return met.withColumn("far", F.when(F.col("i") == F.col("i2"), 0).when(F.col("i") != F.col("i2"), 2).when(F.col("__u") >= 0.5, 0).when(F.col("__u") < 0.5, 2).otherwise(1))


VERIFIED = {
    "subject": "coalesce(__s >= 0.75, false)",
    "customer": "coalesce(__c >= 0.5, false)",
    "no other subject": "coalesce(__s >= 0.5, true)",
    "no other customer": "coalesce(__c >= 0.3, true)",
    "either": "coalesce(__s >= 0.75 OR __c >= 0.9 OR (__s IS NULL AND __c >= 0.5), false)",
    "none": "true",
}


def _agrees(rule: Rule) -> Column:
    """Whether a pair has the rule's keys in common and agrees as it asks."""
    parts = [f"abs(d - d2) <= {DAYS}" if k == "d" else f"{k} = {k}2" for k in rule.keys] + [VERIFIED[rule.verify]]
    if "n" not in rule.keys:  # two numbers that differ by more than slips tell two records
        parts.append(f"(n IS NULL OR n2 IS NULL OR levenshtein(CAST(n AS STRING), CAST(n2 AS STRING), {EDITS}) >= 0)")
    if rule.supplier:
        parts.append("far < 2")
    return F.coalesce(F.expr(" AND ".join(parts)), F.lit(False))


def _key(at: int, rule: Rule, block: Column) -> Column:
    """The rule's keys as one hash, null where one of them is missing; what it brings together is compared attribute by attribute."""
    return F.when(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in rule.keys)), F.xxhash64(F.lit(at), *[block if k == "d" else F.col(k) for k in rule.keys]))


def _block(day: Column) -> Column:
    """Blocks of days as long as the span around a date, which then touches two blocks at most."""
    return F.floor(day / (2 * DAYS + 1))


def _register_keys(rules: list[tuple[int, Rule]], register: DataFrame) -> DataFrame:
    keys = F.array(*[_key(at, rule, _block(F.col("d"))) for at, rule in rules])
    return register.select("rid", F.col("d").alias("d2"), F.explode(keys).alias("key")).where("key IS NOT NULL")


def hot_keys(rules: list[Rule], register: DataFrame, few: int = FEW_ROWS) -> DataFrame | None:
    """(key, salts) of the keys that more than `few` rows and one register row in 1024 have; None if there are none.

    There are at most 1024 such keys a rule, so that they can be broadcast. Keys are counted by places of a hash first, a table of
    fixed size, and only those of places that hold so many rows are counted one by one.
    """
    total = register.count()
    share = max(total / HOT_SHARE, few)
    if total <= share:
        return None
    keys = _register_keys(list(enumerate(rules)), register)
    place = F.pmod("key", F.lit(PLACES)).cast("int").alias("place")
    places = keys.groupBy(place).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > share).select("place").collect()  # at most 1024 a rule
    if not places:
        return None
    full = keys.where(F.pmod("key", F.lit(PLACES)).cast("int").isin([p["place"] for p in places]))
    hot = written(full.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > share).select("key", F.ceil(F.col("rows") / share).cast("int").alias("salts")), "hot-keys")
    return None if hot.isEmpty() else hot


def candidates(rules: list[tuple[int, Rule]], asked: DataFrame, register: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(id, trial, rid): each observation with every register row that has a key in common with it, by one exact join on the keys of all `rules`.

    A key in `hot` (key, salts) is dealt over its salts, so that no task has to hold more than about a 1024th of the register for one key.
    """
    rows = _register_keys(rules, register)
    ways = [_key(at, rule, b) for at, rule in rules for b in ((_block(F.col("d") - DAYS), _block(F.col("d") + DAYS)) if "d" in rule.keys else (F.lit(0),))]
    probes = asked.select("id", "trial", "d", F.explode(F.array_distinct(F.array(*ways))).alias("key")).where("key IS NOT NULL")
    on = ["key"]
    if hot is not None:
        salts, on = F.coalesce("salts", F.lit(1)), ["key", "salt"]
        rows = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod("rid", salts).cast("int")).drop("salts")
        probes = probes.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    met = probes.join(rows, on)
    if all("d" in rule.keys for _, rule in rules):
        met = met.where(F.abs(F.col("d") - F.col("d2")) <= DAYS)
    return met.select("id", "trial", "rid")


def verdicts(rules: list[tuple[int, Rule]], pairs: DataFrame, asked: DataFrame, register: DataFrame) -> DataFrame:
    """(id, trial, at, match, same_amount, same_text): for each rule the only register record that agrees with the observation.

    Of the records that agree that of the same supplier and then the nearest day comes first; on a tie there is none. Copies of a record count once.
    """
    other = register.select("rid", F.col("id").alias("match"), *[F.col(x).alias(f"{x}2") for x in "nadicsu"])
    met = _with_shares(pairs.join(other, "rid").drop("rid").join(asked, ["id", "trial"]))
    off = lambda rule: F.abs(F.col("d") - F.col("d2")) if "d" in rule.keys else F.lit(0)
    each = F.array_compact(F.array(*[F.when(_agrees(rule), F.struct(F.lit(at).alias("at"), off(rule).alias("off"))) for at, rule in rules]))
    same = {"same_amount": F.coalesce(F.col("a") == F.col("a2"), F.lit(False)), "same_text": F.coalesce(F.expr(f"c = c2 AND s = s2 AND abs(d - d2) <= {DAYS}"), F.lit(False))}
    agreed = met.select("id", "trial", "match", "far", *[x.alias(k) for k, x in same.items()], F.explode(each).alias("x"))
    order = F.struct(F.col("far"), F.col("x.off"), F.col("match"), "same_amount", "same_text")
    last = F.struct(-F.col("far"), -F.col("x.off"), F.col("match"))
    near = agreed.groupBy("id", "trial", F.col("x.at").alias("at")).agg(F.min(order).alias("first"), F.max(last).alias("last"))
    return near.where("first.match = last.match").select("id", "trial", "at", "first.match", "first.same_amount", "first.same_text")


def match_cascade(observations: DataFrame, register: DataFrame, rules: list[Rule] | None = None, labelled: int = LABELLED) -> DataFrame:
    """(id, match, rule, confidence): at most one register record per observation; both inputs as attributes() gives them.

    Passes run in the order of `turn`, each on the observations that no pass before resolved: an exact join on the keys of its rules brings the
    candidates, whose attributes are then compared themselves; the first rule that leaves one record holds. A rule's confidence is its precision on labelled rows,
    smoothed: (right + 1) / (all + 2). Labelled rows are about `labelled` observations that the number resolves, chosen by the hash of their ids; all other rules
    judge them without the number. A rule on amounts is judged where the number's record has the observation's customer, subject and date, any other where it
    has its amount, so that no rule is judged by what it asks itself; the number is judged by rules on amounts where amount, customer, subject and date are all the same.

    Repeated observations are matched each; an observation or record without an attribute takes no part in the rules that
    need it; ids of observations must be 64-bit integers, null ids don't count; ties leave a row to later rules; empty inputs give an empty result.
    """
    rules = RULES if rules is None else rules
    left = written(observations.where(F.col("id").isNotNull()).withColumn("trial", F.lit(False)), "observations")
    register = bucketed(register.where(F.col("id").isNotNull()).withColumn("rid", F.xxhash64("id")), "rid", "register")
    hot = hot_keys(rules, register)
    sample, trials, out, spent = None, [], [], [hot]
    for turn in sorted({rule.turn for rule in rules}):
        own = [(at, rule) for at, rule in enumerate(rules) if rule.turn == turn]
        asked = left if sample is None else left.unionByName(sample.drop("truth", "same_amount", "same_text"))
        pairs = candidates(own, asked, register, hot)
        said = written(verdicts(own, pairs, asked, register), f"verdicts-{turn}")
        found = said.where("NOT trial").groupBy("id").agg(F.min(F.struct("at", "match", "same_amount", "same_text")).alias("x")).select("id", "x.*")
        out.append(found.select("id", "match", "at"))
        if sample is not None:
            trials.append(said.where("trial").drop("trial"))
        rest = written(left.join(found, "id", "left_anti"), "observations-left")
        if sample is None and rules[0].keys == ("n",) and turn == rules[0].turn:
            sure = found.where("at = 0")
            places = -(-labelled * 2**20 // max(sure.count(), 1))
            sure = sure.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2**20)) < places).select("id", F.col("match").alias("truth"), "same_amount", "same_text")
            sample = written(left.join(sure, "id").withColumns({"n": F.lit(None).cast("bigint"), "trial": F.lit(True)}), "labelled-observations")
        spent.append(left)
        left = rest
    seen = {}
    if trials:
        judged = reduce(DataFrame.unionByName, [t.withColumnsRenamed({"same_amount": "own_amount", "same_text": "own_text"}) for t in trials]).join(sample.select("id", "truth", "same_amount", "same_text"), "id")
        amount = [at for at, rule in enumerate(rules) if "a" in rule.keys]
        right = F.count_if(F.col("match") == F.col("truth"))
        each = judged.where(F.when(F.col("at").isin(amount), F.col("same_text")).otherwise(F.col("same_amount"))).groupBy("at").agg(right.alias("good"), F.count(F.lit(1)).alias("all"))
        number = judged.where(F.col("at").isin(amount) & F.col("own_amount") & F.col("own_text")).groupBy("id").agg(F.min("match").alias("match"), F.min("truth").alias("truth")).agg(F.lit(0).alias("at"), right.alias("good"), F.count(F.lit(1)).alias("all"))
        seen = {r["at"]: (r["good"], r["all"]) for r in each.unionByName(number).collect()}  # one row a rule
    confidence = [(seen.get(at, (0, 0))[0] + SMOOTHING[0]) / (seen.get(at, (0, 0))[1] + sum(SMOOTHING)) for at in range(len(rules))]
    discard(register, left, sample, *spent)
    named = F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.lit(float(x)).alias("confidence")) for rule, x in zip(rules, confidence)])
    return reduce(DataFrame.unionByName, out).select("id", "match", F.get(named, F.col("at")).alias("x")).select("id", "match", "x.*")
