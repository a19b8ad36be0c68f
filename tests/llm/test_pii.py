import datetime
import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from tagwise.llm import pii
from tests.llm.fixtures import awkward_rows, clashing, documents

KEY = "k1"
VALUES = {
    "card": ["4207051279108084", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606",
             "DE89 3704 0044 0532 0130 00", "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"],
    "ssn": ["123-45-6789", "665-01-0001", "667-99-9999", "899-12-3456"],
    "phone": ["+1 (887) 555-1668", "(212) 555-0100", "212-555-0199", "+33 1 42 68 53 00", "+18875551668", "+420 601 123 456"],
    "ipv4": ["42.144.35.254", "10.0.0.1", "255.255.255.255"],
    "date": ["1900-01-01", "2099-12-31", "29.02.2024", "12/31/1999"],
    "email": ["glaotlg.19@mail9.example.com", "A.b+c@x-y.org"],
}
INVALID = ["4207051279108085", "DE88370400440532013000", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "256.1.1.1",
           "2023-02-29", "31.04.2024", "13/01/2000", "12345", "1.2.3", "v1.2.3.4.5", "no@domain", "3.14159265358979"]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def valid(kind, s):
    if kind == "card":
        return luhn(s) % 10 == 0
    if kind == "iban":
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "ssn":
        a, g, n = map(int, s.split("-"))
        return 0 < a < 900 and a != 666 and g > 0 and n > 0
    if kind == "ipv4":
        return all(int(x) < 256 and str(int(x)) == x for x in s.split("."))
    if kind == "date":
        form = "%Y-%m-%d" if s[4] == "-" else "%d.%m.%Y" if s[2] == "." else "%m/%d/%Y"
        return 1900 <= datetime.datetime.strptime(s, form).year <= 2099
    return True


def run(spark, texts, inverse=False, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(df, key, inverse=inverse).orderBy("doc_id").collect()]


def test_pseudonyms_are_valid_linked_and_reversible(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    out = run(spark, [f"see {v}, and again {v}." for _, v in flat])
    back = run(spark, [r.text for r in out], inverse=True)
    other = run(spark, [f"see {v}, and again {v}." for _, v in flat], key="k2")
    changed = 0
    for (kind, v), r, b, o in zip(flat, out, back, other):
        assert r.pii == [kind, kind], (v, r)
        first, second = re.fullmatch(r"see (.*), and again (.*)\.", r.text).groups()
        assert first == second and valid(kind, first), (v, first)
        if kind not in ("ipv4",):
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", first))) == \
                re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))
        assert b.text == f"see {v}, and again {v}."
        changed += (first != v) + (o.text != r.text)
    assert changed >= 2 * len(flat) - 2


def test_invalid_values_stay(spark):
    out = run(spark, [f"a {v} b" for v in INVALID])
    assert [(r.text, r.pii) for r in out] == [(f"a {v} b", []) for v in INVALID]


def test_it_is_a_permutation(spark):
    days = spark.range(0, pii._DAYS).select(F.date_add(F.lit(pii._FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("d"))
    made = days.select(pii._date(F.date_format("d", "yyyy-MM-dd"), KEY, False).alias("p"))
    assert made.distinct().count() == pii._DAYS == days.count()
    two = spark.range(100).select(pii.permuted_string(F.lpad(F.col("id").cast("string"), 2, "0"), KEY, "x").alias("p"))
    assert two.distinct().count() == 100


@pytest.mark.parametrize("text", [None, "", " ", "x" * 50_000, "4111 1111 1111 1111 " * 2000])
def test_odd_texts(spark, text):
    (r,) = run(spark, [text])
    assert len(r.pii) == (2000 if text and "4111" in text else 0)
    assert (r.text is None) == (text is None) and (r.pii or r.text == text)


def test_rows_and_columns_stay(spark):
    docs = clashing(documents(spark))
    out = pii.pseudonymise(docs, KEY)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(awkward_rows())
    assert pii.pseudonymise(documents(spark, []), KEY).collect() == []


# --- the same by plain Python ------------------------------------------------------------

def symbols(values, sizes, kind):
    half = len(values) // 2
    parts, limits = [list(values[:half]), list(values[half:])], [sizes[:half], sizes[half:]]
    for turn in range(pii.ROUNDS):
        mine, other = parts[turn % 2], parts[1 - turn % 2]
        said = f"{len(mine)}:{','.join(map(str, other))}"
        hashed = [hashlib.sha256(f"{KEY}|{kind}|{turn}|{said}/{b}".encode()).hexdigest() for b in range(len(mine) // 8 + 1)]
        parts[turn % 2] = [(x + int(hashed[i // 8][i % 8 * 8:i % 8 * 8 + 8], 16)) % limits[turn % 2][i] for i, x in enumerate(mine)]
    return parts[0] + parts[1]


def pair(left, right, size_l, size_r, kind):
    at, sizes = [left, right], [size_l, size_r]
    for turn in range(pii.ROUNDS):
        drawn = int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{at[1 - turn % 2]}".encode()).hexdigest()[:13], 16)
        at[turn % 2] = (at[turn % 2] + drawn) % sizes[turn % 2]
    return at


def string(s, kind):
    base = {**{c: "0" for c in "0123456789"}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}}
    at = [i for i, c in enumerate(s) if c in base]
    new = symbols([ord(s[i]) - ord(base[s[i]]) for i in at], [10 if base[s[i]] == "0" else 26 for i in at], kind)
    out = list(s)
    for i, x in zip(at, new):
        out[i] = chr(ord(base[s[i]]) + x)
    return "".join(out)


def refilled(form, chars):
    chars = iter(chars)
    return "".join(next(chars) if c.isalnum() else c for c in form)


def brute(kind, s):
    plain = re.sub("[^0-9A-Za-z]", "", s)
    if kind == "card":
        body = plain[0] + string(plain[1:-1], kind)
        return refilled(s, next(body + c for c in "0123456789" if luhn(body + c) % 10 == 0))
    if kind == "iban":
        rest = string(plain[4:], kind)
        return refilled(s, next(t for n in range(2, 99) for t in [f"{plain[:2]}{n:02d}{rest}"] if valid(kind, t)))
    if kind == "ssn":
        area, group, serial = map(int, s.split("-"))
        left, right = pair(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, kind)
        return f"{left + (2 if left >= 665 else 1):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if kind == "phone":
        two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
        code = 0 if s[0] != "+" else 1 if plain[0] in "17" else 2 if plain[:2] in two else 3
        return refilled(s, plain[:code] + string(plain[code:], kind))
    if kind == "ipv4":
        octets = list(map(int, s.split(".")))
        return ".".join(map(str, octets[:1] + symbols(octets[1:], [256] * 3, kind)))
    if kind == "date":
        form = "%Y-%m-%d" if s[4] == "-" else "%d.%m.%Y" if s[2] == "." else "%m/%d/%Y"
        first = datetime.date(1900, 1, 1)
        left, right = pair(*divmod((datetime.datetime.strptime(s, form).date() - first).days, 4297), 17, 4297, kind)
        return (first + datetime.timedelta(left * 4297 + right)).strftime(form)
    local, host = s.split("@")
    return string(local, kind) + "@" + host


def test_equals_plain_python(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    out = run(spark, [f"see {v}, and again" for _, v in flat])
    assert [r.text for r in out] == [f"see {brute(k, v)}, and again" for k, v in flat]


def test_queries_rows_equal_plain_python(spark):
    """Every value that occurs in the whole table, found by the kinds' patterns one at a time."""
    from tagwise.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_pseudonyms"](spark, d).collect()
    assert len(rows) == len(texts)
    global KEY
    before, KEY = KEY, pii.EXAMPLE_KEY
    try:
        for r in rows:
            old, at, new = texts[r.doc_id], 0, []
            for m in regex.finditer(pii._ALL, old):
                kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m[0]))
                ok = valid(kind, m[0]) if kind != "phone" else 7 <= len(re.sub("[^0-9]", "", m[0])) <= 15
                new += [old[at:m.start()], brute(kind, m[0]) if ok else m[0]]
                at = m.end()
            assert r.text == "".join(new) + old[at:], r.doc_id
    finally:
        KEY = before


def test_equal_values_are_linked_in_all_their_forms(spark):
    plain = lambda s: re.sub("[^0-9A-Z]", "", s)
    for forms in (["+1 (887) 555-1668", "+18875551668", "+1-887-555-1668", "+1 887 555 1668"],
                  ["+442079460958", "+44 20 7946 0958"], ["+420601123456", "+420 601 123 456"],
                  ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
                  ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332"],
                  ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"]):
        out = [r.text for r in run(spark, forms)]
        assert len({plain(t) for t in out}) == 1 and plain(out[0]) != plain(forms[0]), out
        code = next((c for c in ("+420", "+44", "+1") if forms[0].startswith(c)), "")
        assert all(t.startswith(code) for t in out)
    national = [plain(r.text) for r in run(spark, ["(887) 555-1668", "+1 887 555 1668"])]
    assert national[1] == "1" + national[0]


def test_words_after_a_printed_iban_stay(spark):
    first, second = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"
    (r,) = run(spark, [f"{first} PAID {second} {first} NOTE"])
    got = re.fullmatch("(ES.{27}) PAID (DE.{25}) (ES.{27}) NOTE", r.text)
    assert r.pii == ["iban"] * 3 and got[1] == got[3] == brute("iban", first) and got[2] == brute("iban", second)
    (r,) = run(spark, ["DE88 3704 0044 0532 0130 00 stays"])
    assert r.pii == [] and r.text == "DE88 3704 0044 0532 0130 00 stays"


def test_a_column_of_any_name_keeps_its_values(spark):
    df = spark.createDataFrame([(1, "call 212-555-0199", 7, 8), (1, "call 212-555-0199", 7, 8)], "doc_id long, text string, _pii long, _made long")
    out = pii.pseudonymise(df, KEY).collect()
    assert [(r["_pii"], r["_made"], r["pii"]) for r in out] == [(7, 8, ["phone"])] * 2 and out[0].text == out[1].text
