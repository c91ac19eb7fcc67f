import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from segmill.llm import pii


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(df, count="n").collect()}


def feistel(a, b, ma, mb, tweak, key="a key for tests"):
    for i in range(1, pii.ROUNDS + 1):
        f = int(hashlib.sha256(f"{key}|{tweak}|{i}|{b}".encode()).hexdigest()[:15], 16)
        a, b, ma, mb = b, (a + f % ma) % ma, mb, ma
    return a, b


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_feistel_permutes(spark):
    pairs = spark.range(147 * 13).select((F.col("id") / 13).cast("long").alias("a"), (F.col("id") % 13).alias("b"))
    got = pairs.select("a", "b", pii.feistel(F.col("a"), F.col("b"), F.lit(147), F.lit(13), F.lit("t"), "a key for tests").alias("p")).collect()
    assert len({(r.p.a, r.p.b) for r in got}) == len(got) == 147 * 13
    assert all((r.p.a, r.p.b) == feistel(r.a, r.b, 147, 13, "t") for r in got)


VALID = [
    ("Karte 4111 1111 1111 1111.", r"Karte 4\d{3} \d{4} \d{4} \d{4}\."),
    ("4111111111111111 123 Euro", r"4\d{15} 123 Euro"),
    ("3782-822463-10005", r"3\d{3}-\d{6}-\d{5}"),
    ("ip 10.0.0.1 und", r"ip \d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3} und"),
    ("ssn 078-05-1120", r"ssn \d{3}-\d{2}-\d{4}"),
    ("+1 (564) 555-4526 11.123.15.12", r"\+1 \(\d{3}\) \d{3}-\d{4} \d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("+49 30 1234567 ok", r"\+49 \d\d \d{7} ok"),
    ("geb. 1987-05-12,", r"geb\. \d{4}-\d\d-\d\d,"),
    ("am 29.02.2000", r"am \d\d\.\d\d\.\d{4}"),
    ("on 05/12/1987", r"on \d\d/\d\d/\d{4}"),
    ("DE89 3704 0044 0532 0130 00 THE END", r"DE\d\d( \d{4}){4} \d\d THE END"),
    ("GB82WEST12345698765432", r"GB\d\dWEST\d{14}"),
    ("an tom.smith01@mail.example.com &&&", r"an [a-z]{3}\.[a-z]{5}\d\d@mail\.example\.com &&&"),
    ("nur anna@example.org", r"nur [a-z]{4}@example\.org"),
]
INVALID = ["4111111111111112", "1234567890123456789012", "999.1.1.1", "1.2.3.4.5", "000-12-1234", "666-12-1234", "2021-02-30", "1899-01-01", "31.04.2000", "13/13/2000", "DE89370400440532013001", "x@y", "a@b.c", "v1.2.3.4x", "0000000000000000"]


@pytest.fixture(scope="module")
def made(spark):
    return run(spark, [t for t, _ in VALID] + INVALID + [None, "", "ohne alles", "x" * 100_000 + " 10.0.0.1"])


@pytest.mark.parametrize("i", range(len(VALID)))
def test_valid(made, i):
    text, shape = VALID[i]
    new, n = made[i]
    assert re.fullmatch(shape, new) and new != text and n == 1 + ("11.123.15.12" in text)
    digits = re.sub(r"\D", "", new.split(".")[0].replace(" 123 Euro", "")) if "4111" in text or "3782" in text else ""
    assert not digits or luhn(digits)
    if text[:2] in ("DE", "GB"):
        assert mod97(new.replace(" THE END", "")) == 1
    for f, p in (("%Y-%m-%d", r"\d{4}-\d\d-\d\d"), ("%d.%m.%Y", r"\d\d\.\d\d\.\d{4}"), ("%m/%d/%Y", r"\d\d/\d\d/\d{4}")):
        if m := re.search(p, new):
            assert 1901 <= datetime.datetime.strptime(m.group(), f).year <= 2096
    if "ssn" in text:
        a, g, s = map(int, new[4:].split("-"))
        assert 0 < a < 900 and a != 666 and g and s


def test_invalid_stay(made):
    for k, text in enumerate(INVALID, len(VALID)):
        assert made[k] == (text, 0)
    assert [made[len(VALID) + len(INVALID) + k] for k in range(3)] == [(None, 0), ("", 0), ("ohne alles", 0)]
    assert made[len(VALID) + len(INVALID) + 3][1] == 1


def test_equal_values_stay_linked(spark):
    got = run(spark, ["A@x.de, a@x.de", "a@x.de 4111-1111-1111-1111", "4111 1111 1111 1111", "1987-05-12 12.05.1987 05/12/1987"])
    first, second = got[0][0].split(", ")
    assert first == second == got[1][0].split(" ")[0]
    assert re.sub(r"\D", "", got[1][0].split("@")[1][4:]) == re.sub(r"\D", "", got[2][0])
    y, d, m = got[3][0].split(" ")
    assert y.split("-") == d.split(".")[::-1] == [m.split("/")[2], m.split("/")[0], m.split("/")[1]]
    other = spark.createDataFrame([(1, "10.0.0.1")], "doc_id long, text string")
    assert pii.pseudonymise(other, key="k").first().text != pii.pseudonymise(other).first().text
    a, b = feistel(10 * 256, 1, 65536, 65536, "ip")
    assert pii.pseudonymise(other).first().text == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def test_day_first_dates(spark):
    days = [datetime.date(1901, 1, 1) + datetime.timedelta(i) for i in range(71589)]
    late = [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    got = spark.createDataFrame([(t,) for t in late], "t string").select(pii.pseudonym(F.col("t"), "a key for tests").alias("p")).collect()
    assert sorted(r.p for r in got) == sorted(late) and sum(r.p == t for r, t in zip(got, late)) < 10
    assert run(spark, ["le 31/12/1999, 31/02/2000 und 31/12/1899"])[0][1] == 1


def test_national_phones(spark):
    texts = ["call (743) 555-3824 now", "743-555-3824", "Tel. 743.555.3824,", "911-555-3824", "(743) 911-3824", "143-555-3824", "030 1234567", "743 555 3824", "1-743-555-3824-9"]
    got = run(spark, texts)
    assert [n for _, n in (got[i] for i in range(len(texts)))] == [1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert re.fullmatch(r"call \([2-9]\d\d\) [2-9]\d\d-\d{4} now", got[0][0])
    assert len({re.sub(r"\D", "", got[i][0]) for i in range(3)}) == 1
    numbers = [f"{a}-{a}-0{a}" for a in range(200, 1000) if a % 100 != 11]
    made = [t for t, _ in run(spark, numbers).values()]
    assert len(set(made)) == len(numbers) and all(re.fullmatch(r"(?!.11)[2-9]\d\d-(?!.11)[2-9]\d\d-\d{4}", t) for t in made)


def test_columns_and_plan(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "t", "f", 2)], "doc_id long, text string, row string, found string, gaps int")
    out = pii.pseudonymise(df, count="gaps")
    assert out.columns == ["doc_id", "text", "row", "found", "gaps"] and out.first().gaps == 1
    plan = pii.pseudonymise(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_a_key_is_needed(spark):
    df = spark.createDataFrame([(1, "10.0.0.1")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.pseudonymise(df.sparkSession.newSession().createDataFrame([(1, "10.0.0.1")], "doc_id long, text string"))
    assert pii.pseudonymise(df, key="x").first().text != pii.pseudonymise(df, key="y").first().text


def test_dates_of_timestamps(spark):
    got = run(spark, ["um 1987-05-12T10:30:00Z", "am 1987-05-12", "1987-05-12Tag"])
    assert got[0][0] == f"um {got[1][0][3:]}T10:30:00Z" and got[1][0] != "am 1987-05-12" and got[2] == ("1987-05-12Tag", 0)
