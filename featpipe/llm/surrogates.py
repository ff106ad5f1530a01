"""PII surrogates, in DataFrame expressions only.

Entities are found by one pattern. Each is replaced by a surrogate drawn from a keyed digest of its kind and its canonical
form (letters and digits, lower case), so the same entity gets the same surrogate wherever and however it is
written, and only the key's holder can link the two. A surrogate keeps kind and format: digits stay digits and letters letters of the
same case and script, separators stay; dotted quads stay valid addresses, card numbers keep a valid check digit.

A person's name is found behind a title. Its given and its family name are entities of their own, each with its own surrogate:
"Mr. John Smith" and "Mr. Smith" keep the family name in common. Distinct parts have distinct surrogates, so distinct names
have, too. Title, gender, capitals and script (that of the name's own letters) stay.

Distinctness is checked over the whole corpus: entities whose surrogate another entity has, or which is itself an
entity of the corpus, draw again (the next attempt) until none collide. Every attempt lengthens names, mail addresses and
secrets by a syllable or letter, so there are always enough of them; formats of fixed length cannot grow. Rows with redrawn entities get them by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import bound, stored

# fixed values: titles and name parts by gender and script
MALE = ["Mr", "Herr", "Señor", "Monsieur", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "госпожа", "κυρία"]
NEUTRAL = ["Dr.", "Prof."]  # with their full stop: "Dr" alone is also a drive
FIRST = {
    ("latin", "m"): "Adam Albert Carl Daniel David Felix Henry Hugo Jonas Leo Lucas Martin Max Oscar Paul Simon".split(),
    ("latin", "f"): "Alice Anna Clara Elena Emma Eva Ida Julia Laura Lena Maria Marta Nina Nora Paula Sofia".split(),
    ("cyrillic", "m"): "Иван Пётр Олег Антон Борис Виктор Глеб Денис Егор Игорь Лев Максим Никита Павел Роман Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Светлана Тамара Ульяна Юлия Яна".split(),
    ("greek", "m"): "Άγγελος Ανδρέας Βασίλης Γιάννης Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σπύρος Στέφανος Φώτης Χρήστος".split(),
    ("greek", "f"): "Αγγελική Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Ξένια Ρένα Σοφία Φωτεινή Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba den for gar hol jen kel lan mor nel par ros san tor vel win".split(),
    "cyrillic": "ба ве гор дан жел зор кал лин мар нов пол рос сел тор фед чер".split(),
    "greek": "βα γε δο ζη θα κι λα μο νε πα ρο σα τη φι χα ψε".split(),
    "han": "安 柏 成 德 方 光 海 嘉 林 明 平 青 文 星 永 志".split(),
    "hiragana": "あ い か き さ し た ち な に は ひ ま み ら り".split(),
    "katakana": "ア イ カ キ サ シ タ チ ナ ニ ハ ヒ マ ミ ラ リ".split(),
    "hangul": "가 나 도 라 민 보 서 선 아 영 우 재 준 지 현 희".split(),
    "arabic": "با تا جا دا را سا شا طا فا قا كا لا ما نا ها يا".split(),
    "hebrew": "בא גל דן הד זיו טל יר כר לב מן נר עד פז צח רן שי".split(),
    "devanagari": "अ क ग च ज त द न प ब म य र ल व स".split(),
}
CASELESS = [s for s in SYLLABLES if s not in ("latin", "cyrillic", "greek")]  # names without capitals and of few characters
ENDING = {("latin", "m"): "", ("latin", "f"): "", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ίδης", ("greek", "f"): "ίδου"}

# a capitalised word, or a word of a script without capitals
_PART = r"(?:\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+|\p{Lo}[\p{L}\p{M}]*)"
_NAME = rf"{_PART}(?:[ -]{_PART})?"
KINDS = {  # in the order in which they are tried at a place
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,}",
    "key": r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,})\b",
    "address": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}\b",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "person": rf"\b(?:(?:{'|'.join(MALE + FEMALE)})\.?|{'|'.join(t.replace('.', r'[.]') for t in NEUTRAL)}) {_NAME}",
}


def _pattern() -> str:
    parts = dict(KINDS)
    parts["card"] = parts["card"].replace(r"([ -])", r"[ -]").replace(r"\1", r"[ -]")  # no groups in the joint pattern
    return "|".join(f"(?:{p})" for p in parts.values())


PATTERN = _pattern()


# every entity holds one of these characters or strings: texts without any are not searched
_SIGN = "[0-9@=:]"
_SIGNS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", *sorted(t for t in MALE + FEMALE + NEUTRAL if not any(o != t and o in t for o in MALE + FEMALE))]


def may_hold(text: Column) -> Column:
    """False only for texts that hold no entity."""
    return reduce(lambda out, sign: out | text.contains(sign), _SIGNS, text.rlike(_SIGN))


def _kind(m: Column) -> Column:
    out = F.lit("person")
    for k, p in reversed([x for x in KINDS.items() if x[0] != "person"]):
        out = F.when(m.rlike(f"^(?:{p})$"), k).otherwise(out)
    return out


def _lead(kind: Column, m: Column) -> Column:
    """The part of a match that is no private value and stays: a secret's name, a key's prefix, a person's title, a
    telephone's country."""
    rest = {"secret": r"^([^=:]*[=:]\s*[\"']?)", "key": r"^(AKIA|ASIA|gh[pousr]_|sk-)", "person": r"^(\S+ )",
            "phone": r"^(\+\d{1,3}[ .-]?)"}
    return reduce(lambda out, x: F.when(kind == x[0], F.regexp_extract(m, x[1], 1)).otherwise(out), rest.items(), F.lit(""))


def _canonical(kind: Column, value: Column) -> Column:
    plain = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    return F.when(kind.isin("email", "address"), F.lower(value)).when(kind.isin("secret", "key"), value).otherwise(plain)


def entities(text: Column) -> Column:
    """Array of a text's entities, in order: kind, lead, value, canonical, female, match (number of the match, from 0)
    and last (whether it ends the match: a name of two parts is two entities)."""
    def parts(m, i):
        def entity(kind, lead, value, canonical, female=None, last=True):
            return F.struct(kind.alias("kind"), lead.alias("lead"), value.alias("value"), canonical.alias("canonical"),
                            F.coalesce(female if female is not None else F.lit(False), F.lit(False)).alias("female"),
                            i.alias("match"), F.lit(last).alias("last"))

        def split(x):
            kind, lead, value = x["kind"], x["lead"], x["value"]
            sep = F.regexp_extract(value, "[ -]", 0)
            given, family = F.regexp_extract(value, "^([^ -]*)", 1), F.regexp_extract(value, "([^ -]*)$", 1)
            female = _female(lead, given, family)
            other = entity(kind, lead, value, _canonical(kind, value))
            two = F.array(entity(F.lit("given"), lead, given, F.lower(given), female, False),
                          entity(F.lit("family"), sep, family, F.lower(family), female))
            one = F.array(entity(F.lit("family"), lead, family, F.lower(family), female))
            return F.when(kind != "person", F.array(other)).when(sep != "", two).otherwise(one)

        kind = _kind(m)
        found = F.transform(F.array(F.struct(kind.alias("kind"), _lead(kind, m).alias("lead"))), lambda x: F.struct(
            x["kind"].alias("kind"), x["lead"].alias("lead"), F.substr(m, F.length(x["lead"]) + 1).alias("value")))
        return F.transform(found, split)[0]

    found = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return F.flatten(F.transform(F.coalesce(found, F.array().cast("array<string>")), parts))


def _byte(digest: Column, i) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substr(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _choose(items: list[str], byte: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), F.pmod(byte, F.lit(len(items))))


# fixed values: what a letter or digit may become
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
             "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρςστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def _respell(value: Column, digest: Column) -> Column:
    """The value with the i-th of its letters and digits replaced by the digest's i-th of the same alphabet; others stay."""
    hexadecimal = value.rlike("^(?=.*[a-f])[0-9a-f]{16,}$")

    def step(acc, c):
        def pick(letters):
            return F.substr(letters, F.pmod(_byte(digest, acc["i"]), F.length(letters)) + 1, F.lit(1))

        alphabet = F.when(hexadecimal, F.lit("0123456789abcdef")).otherwise(
            F.get(F.filter(F.array(*[F.lit(x) for x in ALPHABETS]), lambda x: F.contains(x, c)), F.lit(0)))
        return F.struct(F.concat(acc["s"], F.coalesce(pick(alphabet), c)).alias("s"),
                        (acc["i"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("i"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), step, lambda a: a["s"])


def _female(lead: Column, given: Column, family: Column) -> Column:
    """By the title; behind a title for all, by the given name or the family name's ending, where they tell."""
    title = F.regexp_replace(lead, " ", "")
    names = [n.lower() for (_, gender), some in FIRST.items() if gender == "f" for n in some]
    return F.regexp_replace(title, "[.]", "").isin(*FEMALE) | (
        title.isin(*NEUTRAL) & (F.lower(given).isin(*names) | F.lower(family).rlike("(ова|ева|ина|ская|ίδου)$")))


def _longer(digest: Column, attempt: Column, start: int, items: list[str]) -> Column:
    """One more syllable or letter for each attempt after the first, by the digest's bytes from ``start`` on."""
    return F.when(attempt > 0, F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: _choose(items, _byte(digest, i + start - 1))), "")).otherwise("")


def _name(kind: Column, value: Column, female: Column, digest: Column, attempt: Column) -> Column:
    """A given or family name in the value's script: a known given name or syllables, one more for each attempt."""
    of = lambda script: value.rlike(rf"\p{{Is{script.capitalize()}}}")
    texts = lambda items: F.array(*[F.lit(x) for x in items])
    by = lambda made, rest: reduce(lambda out, s: F.when(of(s), made(s)).otherwise(out), [s for s in SYLLABLES if s != "latin"][::-1], rest)
    gendered = lambda table, s: F.when(female, table[s, "f"]).otherwise(table[s, "m"])
    syllables = by(lambda s: texts(SYLLABLES[s]), texts(SYLLABLES["latin"]))
    caseless = reduce(lambda out, s: out | of(s), CASELESS, F.lit(False))
    lists = {k: texts(v) for k, v in FIRST.items()}
    endings = {k: F.lit(v) for k, v in ENDING.items()}
    pick = lambda items, byte: F.get(items, F.pmod(byte, F.size(items)))
    cased = lambda table: F.when(of("cyrillic"), gendered(table, "cyrillic")).when(
        of("greek"), gendered(table, "greek")).otherwise(gendered(table, "latin"))
    n = F.when(caseless, 2).when(kind == "given", 0).otherwise(4) + attempt
    body = F.when(n > 0, F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: pick(syllables, _byte(digest, i))), "")).otherwise("")
    first = F.when((kind == "given") & ~caseless, pick(cased(lists), _byte(digest, 0))).otherwise("")
    ending = F.when((kind == "family") & ~caseless, cased(endings)).otherwise("")
    made = F.initcap(F.concat(first, body, ending))
    return F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(made)).otherwise(made)


def surrogate(e: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity's value (its lead stays)."""
    seed = F.concat_ws("\x1f", F.lit(key), e["kind"], e["canonical"], attempt.cast("string"))

    def make(digest):
        def of(spelled):  # bound once: every kind below starts from it
            # quads of 1 to 254, the top level of a mail domain kept, check digits kept valid, area codes from 2 on
            quad = F.concat_ws(".", *[(F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string") for i in range(4)])
            more = _longer(digest, attempt, 32, list(ALPHABETS[1]))
            mail = F.concat(more, F.lower(F.regexp_extract(spelled, r"^(.*)\.[^.]*$", 1)), F.regexp_extract(e["value"], r"\.[^.]*$", 0))
            body = F.substr(spelled, F.lit(1), F.length(spelled) - 1)
            checked = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))),
                                     lambda s: F.call_function("luhn_check", F.regexp_replace(s, "[ -]", ""))), F.lit(0))
            card = F.when(F.call_function("luhn_check", F.regexp_replace(e["value"], "[ -]", "")), checked).otherwise(spelled)
            area = F.regexp_replace(spelled, r"(?<=^\(?)[01]", "2")
            return F.when(e["kind"] == "address", quad).when(e["kind"] == "email", mail).when(e["kind"] == "card", card).when(
                e["kind"] == "phone", area).when(
                e["kind"].isin("given", "family"), _name(e["kind"], e["value"], e["female"], digest, attempt)).when(
                e["kind"] == "secret", F.concat(spelled, more)).otherwise(spelled)

        # mail addresses differ in case without being different
        own = F.when(e["kind"] == "email", F.lower(e["value"])).otherwise(e["value"])
        return F.transform(F.array(_respell(own, digest)), of)[0]

    return F.transform(F.array(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))), make)[0]


def _collisions(found: DataFrame, key: str, rounds: int) -> DataFrame | None:
    """(kind, canonical, attempt) of the entities that must draw again, or None."""
    e = F.struct("kind", "lead", "value", "canonical", "female")
    # one spelling stands for each entity (a name's surrogate also depends on the gender); its surrogate's
    # canonical form stands for all spellings' surrogates
    known = stored(found.groupBy("kind", "canonical", "female").agg(
        F.min("lead").alias("lead"), F.min("value").alias("value")), "pii-entities")
    now = known.withColumn("attempt", F.lit(0))
    redrawn, least, since = False, None, 0
    while True:
        # drawn once: what follows reads the written table
        drawn = stored(bound(now, spelled=surrogate(e, key, F.col("attempt"))).select(
            "kind", "canonical", "attempt", F.when(
                F.col("kind").isin("given", "family"), F.lower("spelled")).otherwise(_canonical(F.col("kind"), F.col("spelled"))).alias("made")), "pii-surrogates")
        taken = known.select("kind", F.col("canonical").alias("made")).distinct()
        twice = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("holder"), F.min("canonical").alias("low"),
                                                  F.max("canonical").alias("high")).where("low <> high").drop("low", "high")
        bad = drawn.join(twice, ["kind", "made"]).where(
            F.struct("attempt", "canonical") != F.col("holder")).select("kind", "canonical").unionByName(
            drawn.join(taken, ["kind", "made"], "left_semi").select("kind", "canonical")).distinct()
        bad = stored(bad, "pii-collisions")
        n = bad.count()
        if not n:
            break
        # only formats of fixed length can run out of surrogates: then their collisions stop becoming fewer
        least, since = (n, 0) if least is None or n < least else (least, since + 1)
        if since >= rounds:
            raise ValueError(f"{n} surrogates still collide: their formats hold too few values for the entities found")
        redrawn = True
        now = stored(now.join(bad.withColumn("again", F.lit(1)), ["kind", "canonical"], "left").withColumn(
            "attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"), "pii-drawn")
    return now.where("attempt > 0").select("kind", "canonical", "attempt").distinct() if redrawn else None


def replace_entities(docs: DataFrame, key: str, text: str = "text", rounds: int = 30) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and n_entities (a column of that name is replaced).

    NULL texts stay NULL and empty ones empty, with no entities. Texts without entities stay as they are; repeated rows stay
    rows and get the same text. An empty table gives an empty table. Very long texts are searched whole. Names in scripts
    without an entry in SYLLABLES get Latin surrogates; behind a title, up to two words of a script without capitals count as
    the name. A format of fixed length whose values run out (``rounds`` draws without progress) is an error.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__p_c{k}") for k, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("__p_t"))
    found = inner.select(F.inline(entities(F.col("__p_t"))))
    again = _collisions(found, key, rounds)
    if again is None:
        rows = bound(bound(inner, __p_e=entities(F.coalesce("__p_t", F.lit("")))), __p_a=F.transform("__p_e", lambda e: F.lit(0)))
    else:
        rows = stored(bound(inner.withColumn("__p_r", F.expr("uuid()")), __p_e=entities(F.coalesce("__p_t", F.lit("")))), "pii-rows")
        drawn = rows.select("__p_r", F.posexplode("__p_e").alias("i", "e")).select("__p_r", "i", "e.kind", "e.canonical").join(
            again, ["kind", "canonical"], "left").groupBy("__p_r").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("attempt", F.lit(0)).alias("a")))), lambda x: x["a"]).alias("__p_a"))
        rows = rows.join(drawn, "__p_r", "left")
    rows = bound(rows, __p_n=F.size(F.filter("__p_e", lambda e: e["last"])), __p_g=F.when(F.size("__p_e") > 0, F.split("__p_t", PATTERN, -1)))
    new = F.zip_with("__p_e", "__p_a", lambda e, a: F.concat(
        e["lead"], surrogate(e, key, a), F.when(e["last"], F.get("__p_g", e["match"] + 1)).otherwise("")))
    whole = F.concat(F.get("__p_g", F.lit(0)), F.array_join(new, ""))
    out = F.when(F.col("__p_n") > 0, whole).otherwise(F.col("__p_t"))
    rows = bound(rows, __p_out=out)
    return rows.select(*[F.col("__p_out" if c == text else f"__p_c{k}").alias(c) for k, c in enumerate(names)],
                       F.col("__p_n").cast("long").alias("n_entities"))
