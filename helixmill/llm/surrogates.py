"""Personal data replaced by keyed, type-consistent surrogates.

Kinds: e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, social
security numbers, payment card numbers, and names after a form of address.  A
surrogate is a function of a secret, the kind and the normalised entity, so all
mentions of an entity, in whatever format, get the same one (coreference):

* Numbers keep their punctuation, length and first digit; a telephone number
  its country code, which is no part of the entity; a card whether its check
  digit is right.  An IPv4 address keeps its first octet.  These spaces can't
  grow, so the rest is permuted by a keyed Feistel network: two entities never
  share a surrogate, however many there are.
* An IPv6 address keeps its first group.  An e-mail address keeps the places of
  letters, digits and signs of its local part (padded to ten characters) and
  gets a reserved domain, the same for the same domain; upper case is kept.
* Names keep the script, hyphens and case; given names the gender that the forms
  of address show over the whole table (none, if they differ or show none).
  They are made of syllables.  Later or earlier mentions of a replaced name
  without a form of address, written with a capital, are replaced alike; a
  common word that is also such a name is replaced too where it is capitalised.

Distinctness is checked over the whole table: where two entities share a
surrogate, a surrogate of a name or an e-mail address equals an entity that
occurs, or one holds the very name that it hides, all but the least entity move
to the next counter, until no conflict is left.  The space of names and e-mail
addresses grows with the counter, so this ends for any number of entities.
Only entities that moved, and names whose forms of address differ, are joined
back to their documents; all other surrogates follow from the text alone.

A text is rewritten in one pass, so a surrogate is never replaced again.

Only DataFrame functions are used; documents without a match pass untouched.
Edge cases: a null text stays null; an empty one empty; repeated rows are
returned each; a null key is a key; very long texts are handled whole; other
columns, whatever their names, are kept by ``replace``; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Stash

#: Only a default; production passes its own.
SECRET = "surrogate-key-1"
MAX_ROUNDS = 64
KINDS = ("email", "ip", "phone", "ssn", "card", "given", "family")

# Patterns of the kinds.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\.?[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Signora", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин")
OTHER = ("Mx", "Prof", "Dr")
TITLE = r"(?<!\p{L})(?:" + "|".join(FEMALE + MALE + OTHER) + r")\.?"
WORD = r"\p{Lu}(?:\p{L}+|(?=['-]\p{Lu}))(?:['-]\p{Lu}\p{L}+)*"
NAME = f"{TITLE} {WORD}(?: {WORD})?"
ANY = "|".join((EMAIL, IP, IP6, PHONE, SSN, CARD, NAME))
# Consonants, vowels and endings (female, male, other) of made-up names by script.
SOUNDS = {
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", {"f": "на лия ра са", "m": "н рд с к", "n": "ль ми ка ли"}),
    "greek": ("βγδζθκλμνπρστφ", "αειου", {"f": "να λια ρα σα", "m": "νος ρης λος σας", "n": "λι μι κι τι"}),
    "latin": ("bdfgklmnprstvz", "aeiou", {"f": "na lia ra sa", "m": "n rd s k", "n": "l x m th"}),
}


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 512)


def _byte(digest: Column, i: Column | int) -> Column:
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str | list[str], digest: Column, i: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), _byte(digest, i) % len(choices) + 1)


def _network(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column) -> Column:
    """Keyed permutation of the pairs ``a < size_a, b < size_b``: a Feistel network by modular sums."""

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, i.cast("string"), F.when(odd, acc["b"]).otherwise(acc["a"]).cast("string")), 256), 1, 13), 16, 10).cast("long")
        return F.struct(F.when(odd, (acc["a"] + h) % size_a).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise((acc["b"] + h) % size_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _permuted(digits: Column, tweak: Column) -> Column:
    """Another string of digits of the same length; a bijection for each length."""

    def of(d: Column) -> Column:
        n = F.length(d)
        left = F.floor(n / 2).cast("int")
        part = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
        ten = lambda k: F.pow(F.lit(10), k).cast("long")
        out = _network(part(F.substring(d, F.lit(1), left)), part(F.substring(d, left + 1, n)), ten(left), ten(n - left), F.concat_ws("|", tweak, n.cast("string")))
        return _let(out, lambda x: F.concat(F.lpad(x["a"].cast("string"), left, F.lit("0")), F.lpad(x["b"].cast("string"), n - left, F.lit("0"))))

    return _let(digits, of)


def _luhn(d: Column) -> Column:
    """Check sum modulo 10 of a string of digits."""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        y = F.when((n - i) % 2 == 1, x * 2).otherwise(x)
        return acc + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _letters(digest: Column, first: Column | int, n: Column | int) -> Column:
    first, n = (F.lit(x) if isinstance(x, int) else x for x in (first, n))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(digest, first + i) % 26 + 1, F.lit(1))), "")).otherwise("")


def _email(norm: Column, h: Column, counter: Column, secret: Column) -> Column:
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    n = F.length(local)

    def char(i: Column) -> Column:
        c = F.substring(local, i, F.lit(1))
        return F.when(F.rlike(c, F.lit("[a-z]")), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(h, i) % 26 + 1, F.lit(1))).when(F.rlike(c, F.lit("[0-9]")), (_byte(h, i) % 10).cast("string")).otherwise(c)

    shape = F.array_join(F.transform(F.sequence(F.lit(1), n), char), "")
    more = _letters(h, n, F.greatest(F.lit(10) - n, F.lit(0)) + counter * 4)
    tld = F.substring_index(domain, ".", -1)
    at = _let(_digest(secret, F.lit("domain"), domain), lambda d: F.concat(_letters(d, 0, 8), F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise(_pick(["com", "net", "org"], d, 40))))
    return F.concat(shape, more, F.lit("@"), at)


def _name(norm: Column, gender: Column, h: Column, syllables: Column, given: bool) -> Column:
    """Syllables and an ending; one such word for each side of a hyphen."""

    def word(script: str, first: int) -> Column:
        consonants, vowels, ends = SOUNDS[script]
        body = F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.concat(_pick(consonants, h, i * 2 + first), _pick(vowels, h, i * 2 + first + 1))), "")
        if given:
            last = F.coalesce(*[F.when(gender == g, _pick(e.split(), h, first + 31)) for g, e in ends.items()], F.lit(""))
        else:  # Slavic family names agree with the gender of who bears them
            last = F.when(F.rlike(norm, F.lit("(?:ова|ева|ина|ая)$")), "ва").otherwise("в") if script == "cyrillic" else F.lit("")
        return F.concat(body, last)

    def of(script: str) -> Column:
        return F.when(F.contains(norm, F.lit("-")), F.concat(word(script, 0), F.lit("-"), word(script, 32))).otherwise(word(script, 0))

    return F.when(F.rlike(norm, F.lit(r"\p{IsCyrillic}")), of("cyrillic")).when(F.rlike(norm, F.lit(r"\p{IsGreek}")), of("greek")).otherwise(of("latin"))


def surrogate(kind: Column, norm: Column, gender: Column, counter: Column, secret: str = SECRET) -> Column:
    """Normalised surrogate (lower case) of a normalised entity."""
    key = F.lit(secret)
    n = F.length(norm)
    first = F.substring(norm, 1, 1)

    def card(body: Column) -> Column:
        return F.concat(body, ((_luhn(norm) - _luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))

    def number(tweak: Column) -> Column:
        rest = F.concat(first, _permuted(F.substring(norm, F.lit(2), F.when(kind == "card", n - 2).otherwise(n)), tweak))
        return _let(rest, lambda r: F.when(kind == "card", card(r)).otherwise(r))

    def ip(tweak: Column) -> Column:
        low = F.aggregate(F.slice(F.split(norm, r"\.", -1), 2, 3), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
        half = F.lit(4096).cast("long")
        mixed = _let(low, lambda v: _network(F.shiftright(v, 12), v.bitwiseAND(F.lit(4095).cast("long")), half, half, tweak))
        return _let(_let(mixed, lambda x: x["a"] * 4096 + x["b"]), lambda v: F.concat_ws(".", F.substring_index(norm, ".", 1), F.shiftright(v, 16).cast("string"), (F.shiftright(v, 8) % 256).cast("string"), (v % 256).cast("string")))

    def hashed(h: Column) -> Column:
        ip6 = F.concat_ws(":", F.substring_index(norm, ":", 1), F.lit(""), *[F.substring(h, 1 + 4 * i, 4) for i in range(4)])
        return F.when(kind == "email", _email(norm, h, counter, key)).when(kind == "ip6", ip6).when(kind == "given", _name(norm, gender, h, counter + 3, True)).otherwise(_name(norm, gender, h, counter + 4, False))

    fixed = F.when(kind == "ip", F.substring_index(norm, ".", 1)).otherwise(first)
    tweak = F.concat_ws("|", key, kind, counter.cast("string"), fixed)
    return F.when(kind.isin("phone", "ssn", "card"), _let(tweak, number)).when(kind == "ip", _let(tweak, ip)).otherwise(_let(_digest(key, kind, norm, counter.cast("string")), hashed))


def _kind(m: Column) -> Column:
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(F.contains(m, F.lit(":")), "ip6").when(F.rlike(m, F.lit(f"^(?:{IP})$")), "ip").when(F.rlike(m, F.lit(f"^(?:{SSN})$")), "ssn")
        .when(F.rlike(m, F.lit(f"^(?:{PHONE})$")), "phone").when(F.rlike(m, F.lit("^[0-9]")), "card").otherwise("name")
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _parts(m: Column) -> Column:
    """The entities of a match: ``(kind, norm, gender, word)``; a name gives a family name and maybe a given one."""

    def of(kind: Column) -> Column:
        title = F.regexp_extract(m, r"^(\p{L}+)", 1)
        gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")
        words = F.slice(F.split(F.regexp_replace(m, r"^\p{L}+\.? ", ""), " ", -1), 1, 2)
        item = lambda k, n, g, w: F.struct(k.alias("kind"), n.alias("norm"), g.alias("gender"), w.alias("word"))
        given, family = F.get(words, F.lit(0)), F.element_at(words, -1)
        last = item(F.lit("family"), F.lower(family), F.lit("n"), family)
        names = F.when(F.size(words) > 1, F.array(item(F.lit("given"), F.lower(given), gender, given), last)).otherwise(F.array(last))
        norm = F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "ip", m).when(kind == "phone", F.right(_digits(m), F.lit(10))).otherwise(_digits(m))
        return F.when(kind == "name", names).otherwise(F.array(item(kind, norm, F.lit("n"), m)))

    return _let(_kind(m), of)


def _written(word: Column, s: Column, kind: Column) -> Column:
    """A surrogate in the format of what it replaces."""

    def fill(digits: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            is_digit = F.rlike(c, F.lit("^[0-9]$"))
            return F.struct((acc["i"] + is_digit.cast("int")).alias("i"), F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(F.split(word, "", -1), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda a: a["out"])

    whole = _let(_digits(word), lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - F.length(s)), s))  # a country code stays
    capital = F.array_join(F.transform(F.split(s, "-", -1), lambda x: F.initcap(x)), "-")
    loud = (F.upper(word) == word) & (F.lower(word) != word)
    return F.when(kind == "ip", s).when(kind.isin("phone", "ssn", "card"), _let(whole, fill)).when(loud & (F.length(word) > 1), F.upper(s)).when(kind.isin("given", "family"), capital).otherwise(s)


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, th, kind, norm, gender``: the entities of each document that has any; ``th`` is a hash of its text."""
    t = F.col(f"`{text}`")
    some = docs.where(F.rlike(t, F.lit(ANY))).select(F.col(f"`{key}`").alias("k"), F.xxhash64(t).alias("th"), F.explode(F.flatten(F.transform(_matches(t), _parts))).alias("x"))
    return some.select("k", "th", "x.kind", "x.norm", "x.gender").distinct()


def resolved(found: DataFrame) -> DataFrame:
    """``kind, norm, gender, mixed``: each entity once, with the gender that all its forms of address allow."""
    has = lambda g: F.max((F.col("gender") == g).cast("int")) == 1
    gender = F.when(has("f") & ~has("m"), "f").when(has("m") & ~has("f"), "m").otherwise("n")
    return found.groupBy("kind", "norm").agg(gender.alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed"))


def counters(ents: DataFrame, stash: Stash, secret: str = SECRET) -> DataFrame:
    """Adds ``counter``: 0, or the number of times that an entity moved to escape a conflict."""
    now = ents.withColumn("counter", F.lit(0))
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("space")
    for _ in range(MAX_ROUNDS):
        now = stash.put(now.select("kind", "norm", "gender", "mixed", "counter", space, surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("counter"), secret).alias("s")))
        place = F.struct("counter", "kind", "norm")
        shared = now.groupBy("space", "s").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("space", "s", "first")
        grows = F.col("kind").isin("given", "family", "email")
        taken = now.where(grows).select("space", F.col("norm").alias("s")).distinct().withColumn("taken", F.lit(True))
        seen = now.join(shared, ["space", "s"], "left").join(taken, ["space", "s"], "left")
        holds = (F.col("s") == F.col("norm")) | (F.col("kind").isin("given", "family") & ((F.length("norm") > 2) & F.contains("s", "norm")))
        bad = F.coalesce(F.col("taken"), F.lit(False)) | holds | F.coalesce(place != F.col("first"), F.lit(False))
        new = stash.put(seen.select("kind", "norm", "gender", "mixed", F.when(bad, F.col("counter") + 1).otherwise(F.col("counter")).alias("counter"), bad.alias("bad")))
        stash.drop(now)
        now = new.drop("bad")
        if not new.where("bad").limit(1).count():
            return now
    raise RuntimeError(f"conflicts left after {MAX_ROUNDS} rounds")


def replace(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = SECRET) -> DataFrame:
    """The documents with surrogates in ``text``, and ``__found``, an array of ``(kind, word, new)`` per mention that names its kind."""
    stash = Stash(docs.sparkSession)
    found = stash.put(mentions(docs, key, text))
    odd = counters(resolved(found), stash, secret).where("counter > 0 or mixed")
    entry = F.struct(F.concat_ws("|", "kind", "norm").alias("e"), F.struct("gender", "counter").alias("v"))
    odd_of = stash.put(found.select("k", "th", "kind", "norm").join(odd.select("kind", "norm", "gender", "counter"), ["kind", "norm"]).groupBy("k", "th").agg(F.map_from_entries(F.collect_set(entry)).alias("odd")))
    stash.drop_others(odd_of)
    t = F.col(f"`{text}`")
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{key}`").alias("key"), t.alias("t"), F.xxhash64(t).alias("h"), F.coalesce(F.rlike(t, F.lit(ANY)), F.lit(False)).alias("some"))
    src = src.join(odd_of, src["key"].eqNullSafe(odd_of["k"]) & (src["h"] == odd_of["th"]), "left").select("doc", "t", "some", "odd")

    def one(x: Column) -> Column:
        def made(v: Column) -> Column:
            of = surrogate(x["kind"], x["norm"], F.coalesce(v["gender"], x["gender"]), F.coalesce(v["counter"], F.lit(0)), secret)
            return _let(of, lambda s: F.struct(x["kind"].alias("kind"), x["norm"].alias("norm"), x["word"].alias("word"), s.alias("s"), _written(x["word"], s, x["kind"]).alias("new")))

        return _let(F.element_at(F.col("odd"), F.concat_ws("|", x["kind"], x["norm"])), made)

    src = src.select("doc", "t", "some", F.when(F.col("some"), F.transform(_matches(F.col("t")), lambda m: F.struct(m.alias("m"), F.transform(_parts(m), one).alias("parts")))).alias("ms"))
    # names are looked for again without a form of address, as written, as well as in capitals
    src = src.select("doc", "t", "some", "ms", F.filter(F.flatten(F.transform("ms", lambda x: x["parts"])), lambda p: p["kind"].isin("given", "family")).alias("names"))
    words = F.array_distinct(F.concat(F.transform("names", lambda p: p["word"]), F.transform("names", lambda p: F.upper(p["word"])), F.transform("names", lambda p: F.array_join(F.transform(F.split(p["norm"], "-", -1), lambda x: F.initcap(x)), "-"))))
    again = F.concat(F.lit(ANY + r"|(?<!\p{L})(?<!\p{L}['-])(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})(?!['-]\p{Lu})"))
    src = src.select("doc", "t", "some", "ms", "names", F.when(F.size("names") > 0, again).alias("again"))

    def final(x: Column) -> Column:
        """What a match becomes: its words one by one, a form of address as it is."""
        name = F.get(x["parts"], F.lit(0))["kind"].isin("given", "family")
        return F.when(name, F.concat(F.regexp_extract(x["m"], r"^\p{L}+\.? ", 0), F.array_join(F.transform(x["parts"], lambda p: p["new"]), " "))).otherwise(F.get(x["parts"], F.lit(0))["new"])

    fixed = F.map_from_entries(F.array_distinct(F.transform("ms", lambda x: F.struct(x["m"], final(x)))))
    every = F.when(F.col("again").isNull(), F.transform("ms", lambda x: x["m"])).otherwise(F.regexp_extract_all(F.col("t"), F.col("again"), F.lit(0)))
    src = src.select("doc", "t", "ms", "names", "again", F.when(F.col("some"), fixed).alias("fixed"), F.when(F.col("some"), every).alias("every"))

    def becomes(m: Column) -> Column:
        bare = _let(F.get(F.filter("names", lambda p: p["norm"] == F.lower(m)), F.lit(0)), lambda p: _written(m, p["s"], p["kind"]))
        return F.coalesce(F.element_at(F.col("fixed"), m), bare)

    def joined(p: Column) -> Column:
        return F.concat(F.array_join(F.zip_with(F.slice(p, F.lit(1), F.size("every")), F.transform("every", becomes), lambda a, b: F.concat(a, b)), ""), F.element_at(p, -1))

    new = F.when(F.col("every").isNotNull(), _let(F.split(F.col("t"), F.coalesce("again", F.lit(ANY)), -1), joined)).otherwise(F.col("t"))
    told = F.coalesce(F.transform(F.flatten(F.transform("ms", lambda x: x["parts"])), lambda p: F.struct(p["kind"], p["word"], p["new"])), F.array().cast("array<struct<kind:string,word:string,new:string>>"))
    out = src.select("doc", new.alias("new"), told.alias("told"))
    return out.select(*[F.col("new").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns], F.col("told").alias("__found"))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = SECRET) -> DataFrame:
    """One row per document: key, number of mentions of each kind, and the new text."""
    out = replace(docs.select(key, text), key, text, secret)
    n = lambda *k: F.size(F.filter("__found", lambda x: x["kind"].isin(*k))).cast("long")
    return out.select(key, n("email").alias("n_email"), n("ip", "ip6").alias("n_ip"), *[n(k).alias(f"n_{k}") for k in KINDS[2:5]], n("given", "family").alias("n_name"), F.col(text).alias("text"))
