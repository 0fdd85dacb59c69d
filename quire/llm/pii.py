"""Personal data: keyed, type-consistent surrogates, in DataFrame expressions only.

Mentions are found by one pattern. A mention's units (an address, the last ten digits of a phone
number, each name) are brought to a canonical form, and a keyed digest of that form chooses the
replacement: the same unit gets the same surrogate everywhere (coreference), in the layout of each
mention. Letters keep their script and case, card numbers and IBANs their check digits, IBANs their
country. Card numbers and IBANs whose check digits are wrong are left alone.

Persons are found after a title. The names that a document's titles establish are replaced wherever
they stand in it. A given name has the gender of its title, or where the title tells none that of
another mention in the document. Initials are shifted by a keyed distance, particles stay.

The distinct units of the whole corpus are then checked: a surrogate that two units share, or that
is itself a real unit, is drawn again for all but one of them. Such redrawn units are few; they
reach their documents by a join, and where none exist texts are never shuffled.

Not found: names that no title establishes in their document, phone numbers without separators
that don't begin with a plus sign, postal addresses, dates of birth, and words for numbers.

Defined results: a null text stays null with no entities; empty texts stay empty; repeated rows get
the same text; all other columns are kept as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

SECRET_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
#: Titles, and the gender that they tell.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora"],
    "n": ["Dr", "Prof"],
}
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "bin", "ibn", "al"]
_TITLE = "|".join(sorted({x for t in TITLES.values() for y in t for x in (y, y.upper())}, key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{L}'’-]+"
_PART = r"(?:\p{Lu}\.|(?:" + "|".join(PARTICLES) + r")(?= )|" + _NAME + ")"
PERSON = r"(?:" + _TITLE + r")\.?(?: " + _PART + r"){0,3} " + _NAME
_H = "[0-9A-Fa-f]{1,4}"
#: Kinds in order: the first that fits a mention is its kind.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?i:" + SECRET_NAMES + r")\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ip6": rf"(?<![:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![:\p{{L}}\p{{N}}])",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!-?\d)",
    "phone": r"(?:(?:\+\d{1,3}[ .-]?|(?<!\d[ .-]))(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![ .-]?\d)|\+\d{8,15}(?!\d)|(?<!\d )0\d(?: \d\d){4}(?! ?\d)|(?<!\d )0\d{1,4}[ /-]\d{5,8}(?!\d))",
    "person": PERSON,
}
#: No mention begins inside a word, which most places of a text are. A plus sign or bracket may begin one anywhere.
_BEGIN = r"(?<![\p{L}\p{N}])(?:"
_ANY = "|".join(p.replace(r"\1", r"[ -]").replace("([ -])", "[ -]") for p in KINDS.values())
PATTERN = _BEGIN + _ANY + ")"
#: Letters by script, lower and upper case; any other letter becomes Latin.
SCRIPTS = [
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{L}", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
]
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke ko la le lo ma me mo na ne no ra re ro sa ta va".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ха хе жа жо ка ке ко ла ле ло ма ме мо на не но ра ре ро са та ва".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο χα χε ζα ζο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα τα πα".split(),
}
ENDINGS = {
    "latin": {"given_m": ["n", "r", "l", "s"], "given_f": ["a", "ia", "na", "ra"], "given_n": ["e", "i"], "family": ["nd", "rt", "lm", "sk"]},
    "cyrillic": {"given_m": ["н", "р", "л", "с"], "given_f": ["а", "ия", "на", "ра"], "given_n": ["е", "и"], "family": ["ов", "ин", "ев", "ский"]},
    "greek": {"given_m": ["ς", "νος"], "given_f": ["α", "ια", "να"], "given_n": ["ε", "ι"], "family": ["δης", "ου", "κος"]},
}
#: Rounds of drawing again that keep the format; after them a surrogate is lengthened.
ROUNDS = 16
#: Documents with redrawn units up to this number are sent to every task; beyond, texts are shuffled.
BROADCAST_DOCUMENTS = 100_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def kind(mention: Column) -> Column:
    """The kind of a mention; what fits none is a bare name."""
    plain = {k: p.replace(r"(?<![\p{L}\p{N}._%+-])", "") for k, p in KINDS.items()}
    return F.coalesce(*(F.when(mention.rlike("^(?:" + p + ")$"), F.lit(k)) for k, p in plain.items()), F.lit("name"))


def _secret_prefix(mention: Column) -> Column:
    return F.regexp_extract(mention, r"^(.*?[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+-]+$", 1)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.coalesce(each, F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x) % 10


def _mod97(x: Column) -> Column:
    """The number that digits and letters A-Z (10 to 35) write, modulo 97."""
    return F.aggregate(F.split(x, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban_sum(iban: Column) -> Column:
    return _mod97(F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4)))


def _parts(person: Column) -> Column:
    """The words after the title."""
    return F.split(F.regexp_replace(person, r"^\S+ ", ""), " ")


def _gender(person: Column) -> Column:
    title = F.lower(F.regexp_extract(person, r"^([^ .]+)", 1))
    return F.when(title.isin([t.lower() for t in TITLES["m"]]), "m").when(title.isin([t.lower() for t in TITLES["f"]]), "f").otherwise("n")


def _is_name(part: Column) -> Column:
    return (F.length(part) > 1) & ~part.rlike(r"^\p{Lu}\.$") & ~part.isin(PARTICLES)


def _persons(text: Column) -> Column:
    """array<struct<given array<string>, family, gender>> of the titled mentions, names in lower case."""
    titled = reduce(lambda a, t: a | text.contains(f"{t} ") | text.contains(f"{t}. "), _TITLE.split("|"), F.lit(False))
    found = F.when(titled, F.regexp_extract_all(text, F.lit(_BEGIN + PERSON + ")"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    split = F.transform(found, lambda p: F.struct(F.filter(_parts(p), _is_name).alias("names"), _gender(p).alias("gender")))
    return F.transform(split, lambda p: F.struct(F.slice(p["names"], F.lit(1), F.size(p["names"]) - 1).alias("given"), F.element_at(p["names"], -1).alias("family"), p["gender"].alias("gender")))


def _may_mention(text: Column) -> Column:
    """Every kind needs a digit, an at sign, an equals sign, a colon or a title: texts with none aren't searched."""
    return reduce(lambda a, t: a | text.contains(f"{t} ") | text.contains(f"{t}. "), _TITLE.split("|"), text.rlike("[0-9@=:]"))


def _units(m: Column, k: Column, known: Column) -> Column:
    """array<struct<kind, value>>: what a mention names, in canonical form. known: the document's families, and given names by gender."""

    def unit(kind_of: Column, value: Column) -> Column:
        return F.struct(kind_of.alias("kind"), value.alias("value"))

    def given(value: Column, gender: Column) -> Column:
        low = F.lower(value)
        told = F.when(gender != "n", gender).when(F.array_contains(known["m"], low), "m").when(F.array_contains(known["f"], low), "f").otherwise("n")
        return unit(F.concat(F.lit("given_"), told), low)

    def person(p: Column) -> Column:
        names = F.filter(_parts(p), _is_name)
        return F.transform(names, lambda x, i: F.when(i == F.size(names) - 1, unit(F.lit("family"), F.lower(x))).otherwise(given(x, _gender(p))))

    value = (
        F.when(k == "email", F.lower(m))
        .when(k == "secret", F.substr(m, F.length(_secret_prefix(m)) + 1))
        .when(k == "phone", F.right(_digits(m), F.lit(10)))
        .when(k.isin("card", "ssn"), _digits(m))
        .otherwise(m)
    )
    wrong = ((k == "card") & (_luhn(_digits(m)) != 0)) | ((k == "iban") & (_iban_sum(m) != 1))
    bare = F.when(F.array_contains(known["families"], F.lower(m)), unit(F.lit("family"), F.lower(m))).otherwise(given(m, F.lit("n")))
    return F.when(wrong, F.array().cast("array<struct<kind:string,value:string>>")).when(k == "person", person(m)).when(k == "name", F.array(bare)).otherwise(F.array(unit(k, value)))


def found(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """docs with ``out``: struct<pattern, ms: array<struct<m, k, us>>>, what the text's pattern finds, of what kind, and its units.

    Each step is a column of its own, so that no step is repeated in the next one's expression.
    """
    persons, known, pattern, ms = unused(docs, "persons", "known", "pattern", "ms")
    t = F.coalesce(F.col(text), F.lit(""))

    def of(gender: str) -> Column:
        mine = F.filter(persons, lambda p: p["gender"] == gender)
        return F.transform(F.flatten(F.transform(mine, lambda p: p["given"])), F.lower)

    rows = docs.withColumn(persons, _persons(t))
    families = F.transform(persons, lambda p: p["family"])
    every = F.concat(families, F.flatten(F.transform(persons, lambda p: p["given"])))
    rows = rows.withColumn(known, F.when(F.size(persons) > 0, F.struct(F.transform(families, F.lower).alias("families"), of("m").alias("m"), of("f").alias("f"), F.array_distinct(every).alias("names"))))
    forms = F.array_distinct(F.flatten(F.transform(F.col(known)["names"], lambda x: F.array(x, F.upper(x), F.initcap(x)))))
    # Longer names first, so that none is cut by its own beginning.
    forms = F.transform(F.array_sort(F.transform(forms, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: x["x"])
    named = F.concat(F.lit(_BEGIN + _ANY + "|(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}'’-]))"))
    rows = rows.withColumn(pattern, F.coalesce(named, F.lit(PATTERN)))
    rows = rows.withColumn(ms, F.when(_may_mention(t), F.regexp_extract_all(t, F.col(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(ms, F.transform(ms, lambda m: F.struct(m.alias("m"), kind(m).alias("k"))))
    rows = rows.withColumn(ms, F.transform(ms, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), _units(x["m"], x["k"], F.col(known)).alias("us"))))
    return rows.withColumn(out, F.struct(F.col(pattern).alias("pattern"), F.col(ms).alias("ms"))).drop(persons, known, pattern, ms)


def drawn(kind_of: Column, value: Column, attempt: Column, key: str) -> Column:
    """struct<kind, value, attempt, hex>: a unit with its keyed digest. attempt counts how often it was drawn again."""
    return F.struct(kind_of.alias("kind"), value.alias("value"), attempt.alias("attempt"), F.sha2(F.concat_ws("\x01", F.lit(key), kind_of, value, attempt.cast("string")), 512).alias("hex"))


def with_bytes(u: Column) -> Column:
    """The same with the digest's bytes as numbers."""
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(u["hex"], i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.struct(*(u[x].alias(x) for x in ("kind", "value", "attempt", "hex")), each.alias("bytes"))


def surrogate(u: Column) -> Column:
    """The replacement of a unit in canonical form, from its digest."""
    kind_of, value, attempt = u["kind"], u["value"], u["attempt"]

    def byte(i: Column) -> Column:
        return F.get(u["bytes"], F.pmod(i, F.lit(64)))

    def pick(choices: list[str], i: Column) -> Column:
        return F.get(F.array(*map(F.lit, choices)), F.pmod(byte(i), F.lit(len(choices))))

    def letter(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^\d$"), F.pmod(byte(i), F.lit(10)).cast("string"))
        for script, low, high in SCRIPTS:
            n = F.pmod(byte(i), F.lit(len(low))) + 1
            out = out.when(c.rlike(rf"^{script}$") & (F.lower(c) != c), F.substring(F.lit(high), n, F.lit(1))).when(c.rlike(rf"^{script}$"), F.substring(F.lit(low), n, F.lit(1)))
        return out.otherwise(c)

    def alike(x: Column) -> Column:
        """Digit for digit, letter for letter."""
        return F.array_join(F.transform(F.split(x, ""), letter), "")

    def hexed(x: Column) -> Column:
        """Hexadecimal digit for digit, in capitals where x has no small letters."""
        each = F.transform(F.split(x, ""), lambda c, i: F.when(c.rlike("^[0-9A-Fa-f]$"), F.substring(u["hex"], F.pmod(i, F.lit(128)) + 1, F.lit(1))).otherwise(c))
        out = F.array_join(each, "")
        return F.when(x.rlike("[A-F]") & ~x.rlike("[a-f]"), F.upper(out)).otherwise(out)

    def card(x: Column) -> Column:
        check = F.pmod(F.lit(10) - _luhn(F.concat(x, F.lit("0"))), F.lit(10))
        return F.concat(x, check.cast("string"))

    def iban(own: Column) -> Column:
        country = F.substring(value, 1, 2)
        return F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own)

    def one(x: Column, then) -> Column:
        """then(x) with x computed once."""
        return F.element_at(F.transform(F.array(x), then), 1)

    host = F.regexp_extract(value, r"^(.*)(\.[^.]+)$", 2)
    names = F.lit(None).cast("string")
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", r"")):
        stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: pick(SYLLABLES[script], i)), "")
        ending = reduce(lambda a, x: a.when(kind_of == x[0], pick(x[1], F.lit(60))), ENDINGS[script].items(), F.when(F.lit(False), ""))
        names = F.coalesce(names, F.when(value.rlike(test), F.concat(stem, ending)))
    out = (
        F.when(kind_of == "email", F.concat(alike(F.substr(value, F.lit(1), F.length(value) - F.length(host))), host))
        .when(((kind_of == "secret") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")) | (kind_of == "ip6"), hexed(value))
        .when(kind_of == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda c, i: (F.pmod(byte(i), F.lit(254)) + 1).cast("string")), "."))
        .when(kind_of == "card", one(F.concat(F.substring(value, 1, 1), F.substr(alike(value), F.lit(2), F.length(value) - 2)), card))
        .when(kind_of == "iban", one(alike(F.substr(value, F.lit(5))), iban))
        .when(kind_of.isin("phone", "ssn"), F.concat((F.pmod(byte(F.lit(63)), F.lit(9)) + 1).cast("string"), F.substring(alike(value), 2, 1000)))
        .when(kind_of.startswith("given_") | (kind_of == "family"), names)
        .otherwise(alike(value))
    )
    return F.when(attempt > ROUNDS, F.concat(out, F.substring(u["hex"], 1, 16))).otherwise(out)


def _shifted(part: Column, key: str) -> Column:
    """An initial moved by a keyed distance within its alphabet, so that distinct ones stay distinct."""
    seed = hashlib.sha256(key.encode()).digest()[0]
    turned = [high[1 + seed % (len(high) - 1) :] + high[: 1 + seed % (len(high) - 1)] for _, _, high in SCRIPTS]
    return F.translate(part, "".join(h for _, _, h in SCRIPTS), "".join(turned))


def _layout(x: Column, key: str) -> Column:
    """A mention with its units replaced. x: struct<m, k, new>, new the surrogates of its units."""
    m, k, new = x["m"], x["k"], x["new"]
    first = F.get(new, F.lit(0))

    def placed(digits: Column) -> Column:
        """digits, where the mention has its last ones."""
        extra = F.length(_digits(m)) - F.length(digits)

        def at(c: Column, i: Column) -> Column:
            n = F.length(_digits(F.substr(m, F.lit(1), i + 1))) - extra
            return F.when(c.rlike(r"^\d$") & (n > 0), F.substring(digits, n, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(m, ""), at), "")

    def cased(s: Column, part: Column) -> Column:
        return F.when(F.upper(part) == part, F.upper(s)).otherwise(F.initcap(s))

    parts = _parts(m)

    def part(p: Column, i: Column) -> Column:
        # The names among the parts before this one tell which surrogate is its.
        before = F.size(F.filter(F.slice(parts, F.lit(1), i), _is_name))
        return F.when(_is_name(p), cased(F.get(new, before), p)).when(p.rlike(r"^\p{Lu}\.$"), _shifted(p, key)).otherwise(p)

    person = F.concat(F.regexp_extract(m, r"^(\S+ )", 1), F.array_join(F.transform(parts, part), " "))
    return (
        F.when(F.size(new) == 0, m)
        .when(k == "email", F.when(F.upper(m) == m, F.upper(first)).otherwise(first))
        .when(k == "secret", F.concat(_secret_prefix(m), first))
        .when(k.isin("phone", "card", "ssn"), placed(first))
        .when(k == "person", person)
        .when(k == "name", cased(first, m))
        .otherwise(first)
    )


def _draw(table: DataFrame, key: str) -> DataFrame:
    """table (kind, value, attempt) with ``surrogate``."""
    u = table.select("kind", "value", "attempt", drawn(F.col("kind"), F.col("value"), F.col("attempt"), key).alias("u")).withColumn("u", with_bytes(F.col("u")))
    return u.select("kind", "value", "attempt", surrogate(F.col("u")).alias("surrogate"))


def redrawn(docs: DataFrame, key: str, text: str = "text") -> DataFrame | None:
    """(kind, value, attempt > 0) of the units that were drawn again, or None where there are none.

    Counting and not windows: a unit keeps its surrogate if it is the smallest of those that drew it
    and if no real unit has that form.
    """
    each = found(docs.select(F.col(text).alias("t")), "found", "t").where(F.size("found.ms") > 0)
    real = each.select(F.explode(F.flatten(F.transform("found.ms", lambda x: x["us"]))).alias("u"))
    real = written(real.select("u.kind", "u.value").distinct(), "pii-units")
    first = written(_draw(real.withColumn("attempt", F.lit(0)), key), "pii-drawn")

    def losers(rows: DataFrame, taken: DataFrame | None) -> DataFrame:
        """Rows whose surrogate is real, taken, or drawn by a smaller row too."""
        shared = rows.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("least")).where("n > 1")
        lost = rows.join(shared, ["kind", "surrogate"]).where("value <> least").select(*rows.columns)
        lost = lost.unionByName(rows.join(real.withColumnRenamed("value", "surrogate"), ["kind", "surrogate"], "left_semi").select(*rows.columns))
        if taken is not None:
            lost = lost.unionByName(rows.join(taken, ["kind", "surrogate"], "left_semi").select(*rows.columns))
        return lost.distinct()

    lost = written(losers(first, None), "pii-lost")
    if lost.isEmpty():
        return None
    kept: list[DataFrame] = []
    taken = first.join(lost, ["kind", "value"], "left_anti").select("kind", "surrogate")
    while not lost.isEmpty():
        again = written(_draw(lost.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), key), "pii-again")
        lost = written(losers(again, taken), "pii-lost")
        won = again.join(lost, ["kind", "value"], "left_anti")
        kept.append(won.select("kind", "value", "attempt"))
        taken = written(taken.unionByName(won.select("kind", "surrogate")), "pii-taken")
    return reduce(DataFrame.unionByName, kept)


def _attempts(docs: DataFrame, again: DataFrame, text: str) -> DataFrame:
    """(sha of a text, map<kind|value, attempt>) of the texts that hold redrawn units."""
    each = found(docs.select(F.col(text).alias("t")), "found", "t").where(F.size("found.ms") > 0)
    held = each.select(F.sha2("t", 256).alias("sha"), F.explode(F.flatten(F.transform("found.ms", lambda x: x["us"]))).alias("u"))
    held = held.select("sha", "u.kind", "u.value").join(again, ["kind", "value"])
    held = held.select("sha", F.concat_ws("|", "kind", "value").alias("k"), "attempt").distinct()
    return written(held.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("known")), "pii-held")


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with surrogates in the text; count names a column for the number of mentions."""
    again = redrawn(docs, key, text)
    sha, known, hits, new = unused(docs, "sha", "known", "hits", "new")
    none = F.create_map().cast("map<string,int>")
    if again is None:
        rows = docs.withColumn(known, none)
    else:
        # Which documents hold redrawn units; a document is told by its text.
        held = _attempts(docs, again, text).toDF(sha, known)
        small = held.count() <= BROADCAST_DOCUMENTS
        rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(F.broadcast(held) if small else held, sha, "left").drop(sha)
        rows = rows.withColumn(known, F.coalesce(known, none))

    def attempt(u: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(known), F.concat_ws("|", u["kind"], u["value"])), F.lit(0))

    def mapped(f) -> Column:
        """Each mention with f of its units."""
        return F.transform(new, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), F.transform(x["us"], f).alias("us")))

    rows = found(rows, hits, text)
    rows = rows.withColumn(new, F.col(hits)["ms"])
    rows = rows.withColumn(new, mapped(lambda u: drawn(u["kind"], u["value"], attempt(u), key)))
    rows = rows.withColumn(new, mapped(with_bytes))
    rows = rows.withColumn(new, F.transform(new, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), F.transform(x["us"], surrogate).alias("new"))))
    laid = F.transform(new, lambda x: _layout(x, key))
    whole = F.array_join(F.zip_with(F.split(F.col(text), F.col(hits)["pattern"]), laid, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    n = F.size(F.filter(new, lambda x: F.size(x["new"]) > 0))
    rows = rows.withColumn(text, F.when(F.size(new) == 0, F.col(text)).otherwise(whole))
    if count:
        rows = rows.withColumn(count, n.cast("long"))
    return rows.drop(known, hits, new)
