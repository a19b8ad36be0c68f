"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found, validated, and permuted within their own format by a keyed
Feistel network, so a pseudonym is again a valid value of its kind, equal values get equal
pseudonyms in every document, and the holder of the key can go back. Kinds:

card     13 to 19 digits, or groups of four (4-6-5), with a valid Luhn digit: all but the first and the Luhn digit are
         permuted, the Luhn digit is computed anew
iban     country, two check digits, 11 to 30 capitals and digits, valid modulo 97, in one piece or printed in
         groups of four: the part after the check digits is permuted, these are computed anew
ssn      ddd-dd-dddd with an assigned area (not 000, 666, 9xx), group and serial: permuted
         within those
phone    +c (ddd) ddd-dddd and like forms of 7 to 15 digits: the digits after the country code are
         permuted; the code is read off the digits, so a number has one pseudonym in all its forms
ipv4     four numbers up to 255: the last three are permuted
date     a valid day from 1900 to 2099, yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy: permuted
         within those 73,049 days
email    the part before the @ is permuted, letters to letters and digits to digits

A round of the network adds to each character of one half a number drawn from SHA-256 of
key, kind, round and the other half, modulo the size of the character's class (10 digits,
26 small or capital letters, 256 values of an octet); a date or social security number is
a pair of numbers with the two moduli whose product is the size of its domain, so no value
falls outside and no cycle is walked. Built from DataFrame functions only.

Values are told apart by what they say, not by how they are written: spaces, dashes and
brackets of a card, IBAN or phone number stay where they are and do not count. Rows are
treated one by one: a repeated row is repeated with the same pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise.llm.spans import let

ROUNDS = 8
#: Only for tests and examples; production jobs pass their own.
EXAMPLE_KEY = "example key"

_FREE = "(?<![0-9A-Za-z])"
_END = "(?![0-9A-Za-z])"

# Lengths of IBANs by country, as the registry of ISO 13616 states them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# Country codes of E.164 of one and two digits; all others have three.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _grouped(length: int, countries: str) -> str:
    full, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{full}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")


#: IBANs in groups of four; the country tells where they end, so that a word after them stays out.
_PRINTED_IBAN = "(?=[A-Z]{2}[0-9]{2} )(?:" + "|".join(_grouped(n, c) for n, c in IBAN_LENGTHS.items()) + ")"

#: kind -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)+[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "iban": _FREE + "(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + _PRINTED_IBAN + ")" + _END,
    "date": _FREE + r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})" + r"(?![0-9A-Za-z]|[.\-/][0-9])",
    "ssn": r"(?<![0-9A-Za-z]|[0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}" + r"(?![0-9A-Za-z]|-[0-9])",
    "ipv4": r"(?<![0-9A-Za-z]|[0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + r"(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z]|[0-9]-)(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + r"(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}" + r"(?![0-9A-Za-z]|[.-][0-9])"
             + r"|(?<![0-9A-Za-z+])\+(?:[0-9]{8,15}|[0-9]{1,3}(?:[ .-][0-9]{1,4}){2,5})" + r"(?![0-9A-Za-z]|[.-][0-9])",
}
KINDS = ("card", "iban", "ssn", "phone", "ipv4", "date", "email")
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())

_FIRST_DAY, _DAYS = "1900-01-01", 17 * 4297     # 1900-01-01 to 2099-12-31


# --- Feistel networks ----------------------------------------------------------------

def _hash(key: str, kind: str, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other), 256)


def _number(digest: Column, at: Column, width: int = 8) -> Column:
    return F.conv(F.substring(digest, at, F.lit(width)), 16, 10).cast("bigint")


def permuted_symbols(values: Column, sizes: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """``values`` (array of ints, each below its entry of ``sizes``) permuted: the halves
    take turns in adding numbers drawn from the other one."""
    sign = -1 if inverse else 1

    def rounds(half: Column, sizes: Column) -> Column:
        def step(a: Column, r: Column) -> Column:
            left = r % 2 == 0
            mine, other = F.when(left, a["l"]).otherwise(a["r"]), F.when(left, a["r"]).otherwise(a["l"])
            shift = F.when(left, F.lit(0)).otherwise(half)

            def moved(mine: Column, other: Column) -> Column:
                # one digest serves eight symbols; a longer half takes as many as it needs
                said = F.array_join(F.transform(other, lambda x: x.cast("string")), ",")
                blocks = F.sequence(F.lit(0), F.floor(F.size(mine) / 8).cast("int"))
                return let(F.transform(blocks, lambda b: _hash(key, kind, r, F.concat_ws("/", F.concat(F.size(mine).cast("string"), F.lit(":"), said), b.cast("string")))),
                           lambda digests: F.transform(mine, lambda x, i: F.pmod(
                               x + sign * _number(F.get(digests, F.floor(i / 8).cast("int")), (i % 8) * 8 + 1),
                               F.get(sizes, shift + i)).cast("int")))

            new = let(mine, lambda m: let(other, lambda o: moved(m, o)))
            return F.struct(F.when(left, new).otherwise(a["l"]).alias("l"), F.when(left, a["r"]).otherwise(new).alias("r"))

        start = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, F.size(values)).alias("r"))
        return F.aggregate(_turns(inverse), start, step, lambda a: F.concat(a["l"], a["r"]))

    return let(F.floor(F.size(values) / 2).cast("int"), lambda half: let(sizes, lambda z: rounds(half, z)))


def permuted_pair(left: Column, right: Column, size_l: int, size_r: int, key: str, kind: str, inverse: bool = False) -> Column:
    """(left, right) permuted in Z(size_l) x Z(size_r): ``struct<l, r>``."""
    sign = -1 if inverse else 1

    def step(a: Column, r: Column) -> Column:
        left = r % 2 == 0
        drawn = sign * _number(_hash(key, kind, r, F.when(left, a["r"]).otherwise(a["l"]).cast("string")), F.lit(1), 13)
        return F.struct(F.when(left, F.pmod(a["l"] + drawn, F.lit(size_l))).otherwise(a["l"]).alias("l"),
                        F.when(left, a["r"]).otherwise(F.pmod(a["r"] + drawn, F.lit(size_r))).alias("r"))

    return F.aggregate(_turns(inverse), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _turns(inverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])


def permuted_string(s: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """``s`` with its digits, small and capital ASCII letters permuted within their class;
    other characters stay where they are and do not count."""
    def built(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.ascii(c))
        size = F.transform(codes, lambda a: F.when(a.between(48, 57), 10).when(a.between(65, 90) | a.between(97, 122), 26).otherwise(0))
        base = F.transform(codes, lambda a: F.when(a.between(48, 57), 48).when(a.between(65, 90), 65).when(a.between(97, 122), 97).otherwise(0))

        def put(codes: Column, size: Column, base: Column) -> Column:
            moving = F.filter(F.transform(size, lambda z, i: F.when(z > 0, i)), lambda i: i.isNotNull())
            return let(moving, lambda at: let(
                permuted_symbols(F.transform(at, lambda i: F.get(codes, i) - F.get(base, i)), F.transform(at, lambda i: F.get(size, i)), key, kind, inverse),
                lambda new: F.array_join(F.transform(chars, lambda c, i: F.when(F.get(size, i) == 0, c).otherwise(
                    F.char(F.get(base, i) + F.get(new, (F.array_position(at, i) - 1).cast("int"))))), "")))

        return let(codes, lambda c: let(size, lambda z: let(base, lambda b: put(c, z, b))))

    return let(F.filter(F.split(s, ""), lambda c: c != ""), built)


# --- kinds ---------------------------------------------------------------------------

def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The digit that completes a digit string by the Luhn rule."""
    n = F.length(payload)
    weighed = F.transform(F.sequence(F.lit(1), n), lambda i: let(
        F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1),
        lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(weighed, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN."""
    letters = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != "")
    value = F.aggregate(letters, F.lit(0), lambda a, c: let(F.ascii(c), lambda x: F.when(
        x >= 65, (a * 100 + x - 55) % 97).otherwise((a * 10 + x - 48) % 97)))
    return F.lpad((98 - value).cast("string"), 2, "0")


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))
    return F.aggregate(chars, state, lambda a, c: F.when(c.between("0", "9"), F.struct((a["n"] + 1).alias("n"), F.concat(a["s"], F.substring(digits, a["n"] + 1, F.lit(1))).alias("s")))
                       .otherwise(F.struct(a["n"].alias("n"), F.concat(a["s"], c).alias("s"))), lambda a: a["s"])


def _card(s: Column, key: str, inverse: bool) -> Column:
    def made(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        head, body = F.substring(d, 1, 1), F.substring(d, F.lit(2), F.length(d) - 2)
        valid = F.length(d).between(13, 19) & (luhn_digit(payload) == F.substring(d, F.length(d), F.lit(1)))
        new = let(F.concat(head, permuted_string(body, key, "card", inverse)), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(valid, _fill(s, new))
    return let(_digits(s), made)


def _iban(s: Column, key: str, inverse: bool) -> Column:
    def made(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        new = let(permuted_string(rest, key, "iban", inverse), lambda r: F.concat(country, iban_check(country, r), r))
        return F.when(iban_check(country, rest) == F.substring(plain, 3, 2),
                      F.when(F.contains(s, F.lit(" ")), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new))
    return let(F.replace(s, F.lit(" "), F.lit("")), made)


def _ssn(s: Column, key: str, inverse: bool) -> Column:
    area, group, serial = F.substring(s, 1, 3).cast("int"), F.substring(s, 5, 2).cast("int"), F.substring(s, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)                      # 0 to 897
    pair = permuted_pair(index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", inverse)
    new = let(pair, lambda p: F.concat_ws(
        "-", F.lpad(F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1).cast("string"), 3, "0"),
        F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(valid, new)


def _phone(s: Column, key: str, inverse: bool) -> Column:
    def made(d: Column) -> Column:
        code = F.when(F.startswith(s, F.lit("+")), F.regexp_extract(d, f"^(?:{COUNTRY_CODES}|[0-9]{{3}})", 0)).otherwise("")
        new = let(code, lambda c: F.concat(c, permuted_string(F.substring(d, F.length(c) + 1, F.length(d)), key, "phone", inverse)))
        return F.when(F.length(d).between(7, 15), _fill(s, new))
    return let(_digits(s), made)


def _ipv4(s: Column, key: str, inverse: bool) -> Column:
    def made(o: Column) -> Column:
        valid = ~F.exists(o, lambda x: x > 255)
        new = permuted_symbols(F.slice(o, F.lit(2), F.lit(3)), F.array(*[F.lit(256)] * 3), key, "ipv4", inverse)
        return F.when(valid, F.array_join(F.transform(F.concat(F.slice(o, F.lit(1), F.lit(1)), new), lambda x: x.cast("string")), "."))
    return let(F.transform(F.split(s, r"\."), lambda x: x.cast("int")), made)


def _date(s: Column, key: str, inverse: bool) -> Column:
    form = F.when(F.substring(s, 5, 1) == "-", "yyyy-MM-dd").when(F.substring(s, 3, 1) == ".", "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    iso = F.when(F.substring(s, 5, 1) == "-", s) \
        .when(F.substring(s, 3, 1) == ".", F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2))) \
        .otherwise(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 1, 2), F.substring(s, 4, 2)))
    first = F.lit(_FIRST_DAY).cast("date")

    def made(day: Column) -> Column:
        n = F.datediff(day, first)
        pair = permuted_pair(F.floor(n / 4297), n % 4297, 17, 4297, key, "date", inverse)
        return let(pair, lambda p: let(F.date_add(first, (p["l"] * 4297 + p["r"]).cast("int")), lambda d: F.when(
            form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy"))
            .otherwise(F.date_format(d, "MM/dd/yyyy"))))

    return let(F.try_to_date(iso, "yyyy-MM-dd"), lambda day: F.when(day.isNotNull() & F.datediff(day, first).between(0, _DAYS - 1), made(day)))


def _email(s: Column, key: str, inverse: bool) -> Column:
    local = F.substring_index(s, "@", 1)
    return F.concat(permuted_string(local, key, "email", inverse), F.substring(s, F.length(local) + 1, F.length(s)))


_MAKE = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """``struct<kind, value>`` of one match: the kind that it is valid as and its pseudonym;
    kind null and the value itself if it is valid as none."""
    tried = [F.when(value.rlike(f"^(?:{pattern})$"), _as(kind, _MAKE[kind](value, key, inverse))) for kind, pattern in PATTERNS.items()]
    return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value")))


def _as(kind: str, made: Column) -> Column:
    return let(made, lambda new: F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("value"))))


def pseudonymised(text: Column, key: str, inverse: bool = False) -> Column:
    """``struct<text, kinds>`` of a text: the text with all valid values replaced, and the
    kinds of these in order of their places. Null stays null, with no kinds."""
    none = F.array().cast("array<string>")

    def replaced(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key, inverse))
        return let(new, lambda n: F.struct(
            F.array_join(F.zip_with(F.split(text, _ALL, -1), n, lambda gap, x: F.concat(gap, F.coalesce(x["value"], F.lit("")))), "").alias("text"),
            F.filter(F.transform(n, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))

    return let(F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(none),
               lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) > 0, replaced(found))
               .otherwise(F.struct(text.alias("text"), none.alias("kinds"))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced and a column ``pii`` of the kinds
    replaced, in order (an existing column of that name gives way; all others keep their
    values). Row-local: no shuffle."""
    names = [c for c in docs.columns if c.lower() not in (text.lower(), "pii")]
    made = "_made" + "_" * max([len(c) for c in docs.columns])          # no column's name
    return docs.withColumn(made, pseudonymised(F.col(text), key, inverse)) \
        .select(*names, F.col(f"{made}.text").alias(text), F.col(f"{made}.kinds").alias("pii"))
