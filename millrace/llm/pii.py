"""PII surrogates: keyed, type-consistent replacements; DataFrame operations only.

Entities are found by one pattern a kind.  The surrogate of a value is a function of key, kind and value
alone, so one value has one surrogate in all documents (coreference) without any lookup.  It keeps the
value's format: digits stay digits, letters keep script, case and (Latin, Cyrillic, Greek) whether they are vowels, separators
stay; cards keep their first digit and phones their country code, valid check digits of cards and IBANs stay valid,
titles stay, given names keep gender and script.

Letters and digits go through a keyed permutation: each is moved inside its class by an offset that the key, the
length and the signs before it tell.  Reading from the left, equal beginnings have equal offsets, so the first
sign in which two values differ stays different: distinct values of one format can't have one surrogate.  Names
are composed of such parts, hence a surname has one surrogate under every title and given name, and no other has it.

Some forms lose something (addresses' domains, numbers moved to reserved ranges), so distinctness is also checked:
surrogates of all distinct values are grouped, and a value whose surrogate is taken, or is someone's real value,
tries again with the next attempt number until none clashes; from attempt ``WIDE`` on the permutation of the
whole format is used.  Only those values (usually none) have to be looked up when texts are rewritten: as
one small map while they are few, by a join on the text's digest beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, read_table, require

# What is looked for, first kind first where two begin at one place.
MALE_TITLES = ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Госпожа")
OTHER_TITLES = ("Dr", "Doctor", "Prof", "Professor", "Rev", "Доктор", "Профессор")
MALE_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Oliver", "George", "Henry", "Edward", "Peter", "Paul", "Stephen", "Andrew",
    "Brian", "Kevin", "Joseph", "Samuel", "Benjamin", "Alexander", "Nicholas", "Jonathan", "Pierre", "Jean", "Michel", "Jacques", "Philippe", "François", "Nicolas", "Laurent", "Antoine", "Hans", "Klaus", "Jürgen", "Wolfgang",
    "Stefan", "Andreas", "Heinrich", "Friedrich", "Carlos", "José", "Juan", "Miguel", "Antonio", "Manuel", "Francisco", "Javier", "Fernando",
)
FEMALE_NAMES = (
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Anna", "Emma", "Olivia", "Sophia", "Emily", "Laura", "Helen", "Catherine",
    "Rebecca", "Michelle", "Amanda", "Charlotte", "Victoria", "Julia", "Rachel", "Marie", "Isabelle", "Sophie", "Camille", "Claire", "Nathalie", "Françoise", "Hélène", "Ursula", "Monika", "Petra", "Sabine",
    "Katharina", "Susanne", "Gisela", "María", "Carmen", "Ana", "Lucía", "Isabel", "Dolores", "Pilar", "Teresa",
)
CYRILLIC_MALE = ("Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей", "Владимир", "Александр", "Павел")
CYRILLIC_FEMALE = ("Анна", "Елена", "Ольга", "Мария", "Наталья", "Татьяна", "Ирина", "Светлана", "Екатерина", "Юлия")
POOLS = (MALE_NAMES, FEMALE_NAMES, CYRILLIC_MALE, CYRILLIC_FEMALE)
PARTICLES = ("von", "van", "der", "den", "ter", "de", "del", "della", "di", "da", "la", "le")
CUES = ("my name is", "name:", "author:", "contact:", "signed:", "signed,", "regards,", "sincerely,", "dear", "mein name ist", "je m'appelle", "me llamo", "меня зовут")
CREDENTIALS = ("PhD", r"Ph\.D\.", "MD", r"M\.D\.", r"Jr\b\.?", "Esq")
#: Signs that take each other's place: classes as texts, then as ranges of code points (accented, Hebrew, Arabic, Devanagari, Thai,
#: Georgian, Armenian, Hiragana, Katakana, Han, Hangul; Arabic-Indic, Devanagari and wide digits, wide letters).
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "āăąćčďđēĕėęěĝğģĥĩīĭįĵķĺļľńņňōŏőŕřśŝşšţťũūŭůűųŵŷźżž", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
RANGES = (
    (0xE0, 0xF6), (0xF8, 0xFE), (0x5D0, 0x5EA), (0x627, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10FA), (0x561, 0x586), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F), (0xFF10, 0xFF19), (0xFF41, 0xFF5A),
)
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
_MORE = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_NAME}(?:-{_NAME})?"
_GIVEN = f"(?iu:{'|'.join(dict.fromkeys(n for pool in POOLS for n in pool))})"
_TITLE = f"(?iu:{'|'.join(sorted({*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES} - {'Miss'}, key=lambda t: (-len(t), t)))}|(?-i:M)iss)"  # "miss" is a verb
_BEFORE_NAME = rf"\b(?=\p{{L}}+\.? (?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) ))"
_TWO_NAMES = r"\b(?=\p{Lu}\p{L}+ \p{Lu})"  # asked before what is dear
_CUED = rf"{_TWO_NAMES}(?:(?<=(?iu:{'|'.join(CUES)}) ){_NAME}(?: {_NAME}){{1,2}}|{_NAME}(?: {_NAME}){{1,2}}(?=,? (?:{'|'.join(CREDENTIALS)})(?!\p{{L}})))"
KINDS = {
    "email": r"[\p{L}\p{N}._%+\-]+@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"(?<=(?i:token) = \")[0-9a-fA-F]{32,64}(?=\")",
    "password": r"(?<=(?i:password)=)[^\s\"']{6,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w+])(?:\d{13,19}|(?:\d{4}[ \-]){3}\d{1,7})(?!\w)",
    "phone": r"(?<![\w.])(?:\+?\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "person": rf"{_BEFORE_NAME}(?:{_TITLE}\b\.? (?:{_TITLE}\b\.? )?(?:\p{{Lu}}\. ){{0,2}}{_MORE}(?:[ \-](?!{_TITLE}\b){_MORE}){{0,2}}|{_GIVEN} (?:\p{{Lu}}\. )?{_MORE})|{_CUED}",
}
UNION = "|".join(f"(?:{p})" for p in KINDS.values())
#: What is found by its surroundings, which are gone from the value.
BARE = {"token": r"[0-9a-fA-F]{32,64}", "password": r"[^\s\"']{6,}", "person": rf"{KINDS['person']}|{_NAME}(?: {_NAME}){{1,2}}"}
#: Texts without any of these can't hold an entity.
CHEAP = rf"[0-9@]|(?i:password)=|{_BEFORE_NAME}(?:{_TITLE}|{_GIVEN})(?!\p{{L}})|{_CUED}"
DEFAULT_KEY = "millrace"
#: Values that needed another attempt are sent as one map up to so many; beyond, they are joined.
MAP_LIMIT = 5_000
#: The attempt from which whole formats are permuted, and after how many rounds the check gives up with an error.
WIDE, MAX_ATTEMPTS = 4, 64
#: How many signs before one tell its offset.
REACH = 12


def kind_of(value: Column) -> Column:
    """The kind whose pattern fits; null for a number in a card's format that no issuer could have given."""
    out = F.lit(None).cast("string")
    # password is asked last, as it fits most values, and token first, as upper-case hex can look like an IBAN
    for kind, pattern in sorted(KINDS.items(), key=lambda k: (k[0] != "password") + (k[0] == "token")):
        fits = value.rlike(rf"^(?:{BARE.get(kind, pattern)})$")
        if kind == "card":
            out = F.when(fits, F.when(value.rlike("^[2-6]") & (_luhn_sum(value) == 0), F.lit(kind))).otherwise(out)
        else:
            out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def _digest(key: str, kind: Column | str, value: Column, attempt: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 512)


def _byte(digest: Column, i: int) -> Column:
    return F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")


def _pick(pool: tuple[str, ...], digest: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), _byte(digest, i) % len(pool) + 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; the expression stays small, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _literal_map(pairs: Iterable[tuple[str, str]]) -> Column:
    """A map of texts in one expression; built in one call, as each sign of a class has an entry."""
    return F.expr("map(" + ", ".join(f"'{x}'" for pair in pairs for x in pair) + ")")


def _sign(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _moved(c: Column, offset: Column, first: Column, classes: tuple[str, ...]) -> Column:
    """``c`` moved inside its class, a first sign never to itself; case stays.

    A letter or digit of no class moves among the 16 code points around it.
    """
    of = _literal_map((c, signs) for signs in classes for c in signs)
    ranges = F.expr("array(" + ", ".join(f"named_struct('low', {low}, 'high', {high})" for low, high in RANGES) + ")")

    def placed(x: Column) -> Column:
        span = F.get(F.filter(ranges, lambda r: (x["code"] >= r["low"]) & (x["code"] <= r["high"])), 0)
        return F.struct(
            F.coalesce(span["low"], x["code"] - x["code"] % 16).alias("low"),
            F.coalesce(F.length(x["signs"]), span["high"] - span["low"] + 1, F.lit(16)).alias("n"),
        )

    def stepped(x: Column, y: Column) -> Column:
        step = F.when(x["first"], 1 + x["offset"] % (y["n"] - 1)).otherwise(x["offset"] % y["n"])
        own = F.coalesce(F.position(x["low"], x["signs"]) - 1, x["code"] - y["low"])
        return ((own + step) % y["n"]).cast("int")

    def body(x: Column) -> Column:
        new = _let(placed(x), lambda y: _let(stepped(x, y), lambda at: F.coalesce(F.substr(x["signs"], at + 1, F.lit(1)), _sign(y["low"] + at))))
        return F.when(x["low"] != x["c"], F.upper(new)).otherwise(new)

    low = F.lower(c)
    return _let(F.struct(c.alias("c"), low.alias("low"), F.ascii(low).alias("code"), F.try_element_at(of, low).alias("signs"), offset.alias("offset"), first.alias("first")), body)


def _mapped(value: Column, key: str, kind: str, attempt: Column, tweak: Column | None = None, classes: tuple[str, ...] = CLASSES) -> Column:
    """The keyed permutation: letters and digits move, all else stays and has no influence."""

    def body(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.substr(x["low"], F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)))
            seed = F.sha2(F.concat_ws("\x1f", x["salt"], i.cast("string"), before).cast("binary"), 256)
            return _moved(c, F.conv(F.substr(seed, F.lit(1), F.lit(12)), 16, 10).cast("long"), i == 0, classes)

        moved = F.transform(x["signs"], one)
        return F.array_join(F.zip_with(x["between"], moved, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit("")))), "")

    def cut(x: Column) -> Column:
        salt = F.concat_ws("\x1f", F.lit(f"{key}\x1f{kind}"), x["attempt"].cast("string"), F.length(x["plain"]).cast("string"), x["tweak"])
        signs = F.filter(F.split(x["plain"], ""), lambda c: c != "")
        return F.struct(F.lower(x["plain"]).alias("low"), salt.alias("salt"), signs.alias("signs"), F.split(x["value"], r"[\p{L}\p{N}]", -1).alias("between"))

    plain = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    given = F.struct(value.alias("value"), plain.alias("plain"), attempt.alias("attempt"), (F.lit("") if tweak is None else tweak).alias("tweak"))
    return _let(given, lambda x: _let(cut(x), body))


def _cased(word: Column, like: Column) -> Column:
    """``word`` in upper or lower case where ``like`` is all in it."""
    return F.when(F.upper(like) == like, F.upper(word)).when(F.lower(like) == like, F.lower(word)).otherwise(word)


def _luhn_sum(value: Column) -> Column:
    """The sum that is 0 for a valid number, from 0 to 9."""
    digits = F.split(F.reverse(F.regexp_replace(value, r"\D", "")), "")
    term = lambda c, i: F.coalesce(F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)).otherwise(c.cast("int")), F.lit(0))
    return F.aggregate(F.transform(digits, term), F.lit(0), lambda a, x: a + x) % 10


def _with_last(value: Column, offset: Column) -> Column:
    """``value``, which ends with 0, with a last digit that is as far above the valid one as ``offset`` says."""
    return F.concat(F.substr(value, F.lit(1), F.length(value) - 1), ((10 - _luhn_sum(value) + offset) % 10).cast("string"))


def _iban_check(country: Column, body: Column) -> Column:
    """The valid check digits, as a number."""
    signs = F.split(F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00")), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).when(c != "", a * 100 + F.ascii(c) - 55).otherwise(a) % 97
    return 98 - F.aggregate(signs, F.lit(0), step)


def _iban(value: Column, key: str, attempt: Column) -> Column:
    """Country and separators stay; check digits stay as far above the valid ones as they are."""

    def body(x: Column) -> Column:
        above = F.substr(x["value"], F.lit(3), F.lit(2)).cast("int") - _iban_check(x["country"], x["body"])
        check = lambda new: F.lpad(F.pmod(_iban_check(x["country"], new) + above, F.lit(100)).cast("string"), 2, "0")
        return _let(_mapped(x["body"], key, "iban", attempt, x["country"]), lambda new: F.concat(x["country"], check(new), new))

    parts = F.struct(value.alias("value"), F.substr(value, F.lit(1), F.lit(2)).alias("country"), F.substr(value, F.lit(5), F.length(value)).alias("body"))
    return _let(parts, body)


def _permuted(name: Column, pool: tuple[str, ...], key: str) -> Column:
    """A keyed permutation of the pool: distinct names get distinct names."""
    import hashlib

    order = sorted(pool, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
    other = _literal_map((n.lower(), s) for n, s in zip(order, order[1:] + order[:1], strict=True))
    return _cased(F.try_element_at(other, F.lower(name)), name)


def _person(value: Column, key: str) -> Column:
    """Titles, particles and separators stay; a known given name becomes one of its gender and script, other parts are permuted.

    A permuted part that is a known given name is permuted once more, so it can't meet one of those.
    """
    again = lambda name: _mapped(name, key, "surname", F.lit(0))

    def one(part: Column) -> Column:
        def body(x: Column) -> Column:
            given = F.coalesce(F.when(x["name"].isin(*PARTICLES), x["name"]), *[_permuted(x["name"], pool, key) for pool in POOLS])
            other = _let(again(x["name"]), lambda once: F.when(once.rlike(f"^{_GIVEN}$"), again(once)).otherwise(once))
            return F.concat(F.coalesce(given, other), F.substr(x["part"], F.length(x["name"]) + 1, F.length(x["part"])))

        return _let(F.struct(part.alias("part"), F.regexp_extract(part, r"^[^ \-]+", 0).alias("name")), body)

    def whole(x: Column) -> Column:
        names = F.substr(x["value"], F.length(x["title"]) + 1, F.length(x["value"]))
        return F.concat(x["title"], F.array_join(F.transform(F.regexp_extract_all(names, F.lit(r"[^ \-]+[ \-]?"), 0), one), ""))

    return _let(F.struct(value.alias("value"), F.regexp_extract(value, rf"^(?:{_TITLE}\b\.? ){{0,2}}", 0).alias("title")), whole)


def _email(value: Column, key: str, attempt: Column) -> Column:
    """The name permuted in its script; one reserved domain for each domain."""

    def body(x: Column) -> Column:
        d = _digest(key, "domain", x["domain"], F.lit(0))
        host = _let(d, lambda h: F.concat(F.substr(h, F.lit(1), F.lit(8)), F.lit(".example."), _pick(("com", "net", "org"), h, 40)))
        return F.concat(_mapped(x["name"], key, "email", attempt, x["domain"]), F.lit("@"), host)

    at = F.instr(value, "@")
    return _let(F.struct(F.substr(value, F.lit(1), at - 1).alias("name"), F.lower(F.substr(value, at + 1, F.length(value))).alias("domain")), body)


def _phone(value: Column, key: str, attempt: Column) -> Column:
    """The country code stays, with a plus or before an area code in brackets."""
    code = F.coalesce(F.nullif(F.regexp_extract(value, COUNTRY_CODE, 0), F.lit("")), F.regexp_extract(value, r"^\d{1,3}(?=[ .\-]?\()", 0))
    return _let(code, lambda c: F.concat(c, _mapped(F.substr(value, F.length(c) + 1, F.length(value)), key, "phone", attempt)))


def _ip(value: Column, key: str, attempt: Column) -> Column:
    """An address of the reserved range; from ``WIDE`` on each octet moves by what those before it tell."""
    reserved = _let(_digest(key, "ip", value, attempt), lambda d: F.concat_ws(".", (F.lit(240) + _byte(d, 0) % 15).cast("string"), *[_byte(d, i).cast("string") for i in (1, 2, 3)]))

    def permuted(octets: Column) -> Column:
        def octet(x: Column, i: Column) -> Column:
            step = _byte(_digest(key, "ip", F.concat_ws(".", F.slice(octets, F.lit(1), i)), attempt), 0)
            return ((x.cast("int") + F.when(i == 0, 1 + step % 255).otherwise(step)) % 256).cast("string")

        return F.array_join(F.transform(octets, octet), ".")

    return F.when(attempt >= WIDE, _let(F.split(value, r"\."), permuted)).otherwise(reserved)


def _token(value: Column, key: str, attempt: Column) -> Column:
    """Hex digits for hex digits; one without lower-case letters has none afterwards."""
    upper = value.rlike("[A-F]") & ~value.rlike("[a-f]")
    return _let(_mapped(value, key, "token", attempt, classes=("0123456789abcdef",)), lambda new: F.when(upper, F.upper(new)).otherwise(new))


def _surrogate(value: Column, kind: Column, key: str, attempt: Column) -> Column:
    behind = lambda n: F.substr(value, F.lit(n + 1), F.length(value))
    first = F.substr(value, F.lit(1), F.lit(1))
    ssn = F.when(attempt >= WIDE, _mapped(value, key, "ssn", attempt)).otherwise(F.concat(F.lit("9"), _mapped(behind(1), key, "ssn", attempt, first)))
    middle = F.substr(value, F.lit(2), F.length(value) - 2)
    card = _let(F.concat(first, _mapped(middle, key, "card", attempt, first), F.lit("0")), lambda body: _with_last(body, _luhn_sum(value)))
    plain = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")) < 4  # too few to map
    hidden = F.substr(_digest(key, "password", value, attempt), F.lit(1), F.greatest(F.length(value), F.lit(8)))
    forms = {
        "email": _email(value, key, attempt), "phone": _phone(value, key, attempt), "ip": _ip(value, key, attempt), "card": card, "ssn": ssn,
        "iban": _iban(value, key, attempt), "key": F.concat(F.lit("AKIA"), _mapped(behind(4), key, "key", attempt)),
        "token": _token(value, key, attempt), "person": _person(value, key),
        "password": F.when(plain, hidden).otherwise(_mapped(value, key, "password", attempt)),
    }
    out = F.lit(None).cast("string")
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return out


def surrogate(value: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The replacement of ``value``; of a person whatever ``attempt`` is."""
    given = F.struct(value.alias("value"), kind.alias("kind"), attempt.alias("attempt"))
    return _let(given, lambda x: _surrogate(x["value"], x["kind"], key, x["attempt"]))


def found(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.rlike(CHEAP), F.regexp_extract_all(text, F.lit(UNION), 0)).otherwise(F.array().cast("array<string>"))


def attempts(values: DataFrame, key: str) -> DataFrame:
    """``(value, kind, attempt)`` of the distinct ``values(value)`` whose first surrogate clashes.

    A surrogate stays with the value of the lowest attempt, then the smallest; the others, and (before attempt
    ``WIDE``) those whose surrogate is a real value, go on.  Ends when a round finds no clash.  Names are left
    out: their surrogates are distinct by construction.
    """
    state = values.withColumn("kind", kind_of(F.col("value"))).where("kind <> 'person'").withColumn("attempt", F.lit(0))
    state = materialize(state.withColumn("surrogate", surrogate(F.col("value"), F.col("kind"), key, F.col("attempt"))), "pii-values")
    for _ in range(MAX_ATTEMPTS):
        # a surrogate and the real value that it may be meet under one text
        real = state.select(F.col("value").alias("surrogate"), "value", "kind", F.lit(-1).alias("attempt"))
        met = Window.partitionBy("surrogate")
        place, first = F.row_number().over(met.orderBy("attempt", "value")), F.min("attempt").over(met)
        rows = state.select("surrogate", "value", "kind", "attempt").unionByName(real).withColumns({"place": place, "first": first}).where("attempt >= 0")
        taken = F.col("place") - F.when(F.col("first") < 0, 1).otherwise(0) > 1
        clash = taken | ((F.col("first") < 0) & (F.col("attempt") < WIDE)) | (F.col("surrogate") == F.col("value"))
        checked = materialize(rows.withColumn("clash", clash).drop("place", "first"), "pii-clashes")
        if checked.where("clash").isEmpty():
            return checked.where("attempt > 0").select("value", "kind", "attempt")
        state = checked.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        state = state.withColumn("surrogate", F.when(F.col("clash"), surrogate(F.col("value"), F.col("kind"), key, F.col("attempt"))).otherwise(F.col("surrogate"))).drop("clash")
        state = materialize(state, "pii-values")
    raise ValueError(f"surrogates still clash after {MAX_ATTEMPTS} attempts: a kind has more values than its format has surrogates")


def _rewritten(text: Column, attempt_of: Callable[[Column], Column], key: str) -> Column:
    """``struct(kinds, text)``: each entity and its kind are found once."""

    def body(found_: Column) -> Column:
        new = F.transform(found_, lambda x: F.coalesce(surrogate(x["value"], x["kind"], key, attempt_of(x["value"])), x["value"]))
        pieces = F.zip_with(F.split(text, UNION, -1), new, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
        kinds = F.filter(F.transform(found_, lambda x: x["kind"]), lambda k: k.isNotNull())
        return F.struct(kinds.alias("kinds"), F.when(F.size(kinds) > 0, F.array_join(pieces, "")).otherwise(text).alias("text"))

    entities = F.coalesce(found(text), F.array().cast("array<string>"))
    return _let(F.transform(entities, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))), body)


def replace_pii(docs: DataFrame, key: str = DEFAULT_KEY, map_limit: int = MAP_LIMIT, text_col: str = "text") -> DataFrame:
    """``docs`` with entities of ``text_col`` replaced, and the column ``pii_kinds`` (of each entity, in order).

    Null text stays null and has no kinds; a text without entities stays as it is.  All rows and columns
    stay, repeated rows too, whatever their names; only a column of ``docs`` named ``pii_kinds`` gives way to the
    new one.  An empty table gives no rows.  Another ``key`` gives other surrogates.
    """
    require(docs, text_col)
    docs = docs.drop("pii_kinds")
    text = F.col(text_col)
    attempts_of, own, digest_of = free_names(docs, 3)
    values = docs.select(F.explode(found(text)).alias("value")).distinct()
    late = materialize(attempts(values, key), "pii-attempts")
    as_map = F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias(attempts_of)
    n = late.limit(map_limit + 1).count()
    if n == 0:
        joined, attempt = docs, lambda v: F.lit(0)
    else:
        if n <= map_limit:
            joined = docs.crossJoin(F.broadcast(late.agg(as_map)))  # one row of at most map_limit entries
        else:
            digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
            where = docs.select(digest.alias(digest_of), F.explode(F.array_distinct(found(text))).alias("value")).distinct()
            maps = where.join(late, "value").groupBy(digest_of).agg(as_map)
            joined = docs.withColumn(digest_of, digest).join(maps, digest_of, "left").drop(digest_of)
        attempt = lambda v: F.coalesce(F.try_element_at(F.col(attempts_of), v), F.lit(0))
    out = joined.withColumn(own, _rewritten(text, attempt, key))
    return out.withColumns({"pii_kinds": F.col(f"{own}.kinds"), text_col: F.col(f"{own}.text")}).drop(attempts_of, own)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs).select("doc_id", "text", F.size("pii_kinds").alias("n_entities"), "pii_kinds")


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
