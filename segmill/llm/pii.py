"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn and mod-97 check digits, octet and
calendar ranges, assigned number areas) and, if valid, permuted by a keyed eight-round
Feistel network within its own format: as many digits in the same places, check digits
made right again, dates stay real dates of 1901 to 2096. The permutation depends only on
the key, the kind and the value, so equal values stay linked across documents and
different ones stay different. Candidates that don't validate are left as they are.

E-mail addresses that differ in case alone are one and get one pseudonym, in lower case.
Dates are yyyy-mm-dd (of a timestamp too), dd.mm.yyyy, mm/dd/yyyy, and dd/mm/yyyy where that is no mm/dd/yyyy.
Phone numbers are international ones with a plus, and North American ones without
(with parentheses, hyphens or dots), whose area and exchange are 200 to 999 and don't end
in 11; other national forms have no check that tells them from other numbers and are left
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Name of the session setting with the key; whoever has the key can undo every pseudonym.
SETTING = "spark.segmill.pseudonyms.key"

_EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])"
_IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
_DATE = r"(?<![\w.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?:(?=T[0-9]{2}:)|(?![\w-]))"
_IP = r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"
_SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
_CARD = r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-]|\.[0-9])"
_PHONE = r"(?<!\w)\+(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[2-9](?:[ -]?\(?[0-9]\)?){7,14})(?!\w)"
_NATIONAL = r"(?<![\w.+-])(?:\([2-9][0-9]{2}\)[ -]?[2-9][0-9]{2}[ .-][0-9]{4}|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4})(?![\w-]|\.[0-9])"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {"email": _EMAIL, "iban": _IBAN, "date": _DATE, "ip": _IP, "ssn": _SSN, "phone": _PHONE, "card": _CARD, "national": _NATIONAL}
#: 196 years of 365.25 days: 71,589 = 147 * 487 days from this one on.
_EPOCH = "1901-01-01"
_SPAN = (147, 487)
#: The 43,365 of them after the 12th of their month, and how many of a common year's lie before each month.
_LATE = (177, 245)
_LATE_BEFORE = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def feistel(left: Column, right: Column, m_left: Column, m_right: Column, tweak: Column, key: str) -> Column:
    """Keyed permutation of the pairs in [0, m_left) x [0, m_right): a struct of a and b."""

    def step(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i, s["b"]).cast("binary"), 256)
        f = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), ((s["a"] + F.pmod(f, s["m"])) % s["m"]).alias("b"), s["k"].alias("m"), s["m"].alias("k"))

    start = F.struct(_long(left).alias("a"), _long(right).alias("b"), _long(m_left).alias("m"), _long(m_right).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(13 if base > 10 else 17)]), n + 1)


def _digits(text: Column, tweak: Column, key: str) -> Column:
    """A string of up to 30 digits, permuted among those of its length."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    v = n - u
    read = lambda a, b: F.coalesce(F.when(b > 0, F.substring(text, a, b).cast("long")), _long(0))
    p = feistel(read(F.lit(1), u), read(u + 1, v), _power(10, u), _power(10, v), F.concat_ws("|", tweak, n), key)
    write = lambda x, w: F.when(w > 0, F.lpad(x.cast("string"), w, F.lit("0"))).otherwise("")
    return F.aggregate(F.array(p), F.lit(""), lambda s, x: F.concat(write(x["a"], u), write(x["b"], v)))


def _letters(text: Column, tweak: Column, key: str) -> Column:
    """A string of up to 24 letters a-z, permuted among those of its length."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    chars = F.split(text, "")
    value = lambda xs: F.aggregate(xs, _long(0), lambda s, c: s * 26 + F.ascii(c) - 97)
    p = feistel(value(F.slice(chars, F.lit(1), u)), value(F.slice(chars, u + 1, n - u)), _power(26, u), _power(26, n - u), F.concat_ws("|", tweak, n), key)

    def write(x: Column, w: Column) -> Column:
        digits = F.when(w > 0, F.sequence(w - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(digits, lambda i: F.char(F.lit(97) + F.floor(x / _power(26, i)) % 26)), "")

    return F.aggregate(F.array(p), F.lit(""), lambda s, x: F.concat(write(x["a"], u), write(x["b"], n - u)))


def _in_parts(text: Column, size: int, one, tweak: str, key: str) -> Column:
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: one(F.substring(text, i * size + 1, F.lit(size)), F.concat_ws("|", F.lit(tweak), i), key)), "")


def _fill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits (and letters) replaced in order by those given."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        is_letter = c.rlike("[A-Za-z]") if letters is not None else F.lit(False)
        put = F.when(is_digit, F.substring(digits, s["d"], F.lit(1)))
        if letters is not None:
            put = put.when(is_letter, F.substring(letters, s["l"], F.lit(1)))
        return F.struct(F.concat(s["t"], put.otherwise(c)).alias("t"), (s["d"] + is_digit.cast("int")).alias("d"), (s["l"] + is_letter.cast("int")).alias("l"))

    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("l"))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["t"])


def _only(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, f"[^{kind}]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one taken as the check digit."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """An IBAN without spaces, its first four characters moved to the end, modulo 97."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(F.split(moved, ""), _long(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _email(x: Column, key: str) -> Column:
    local = F.lower(F.substring_index(x, "@", 1))
    new = _fill(local, _in_parts(_only(local, "0-9"), 30, _digits, "email", key), _in_parts(_only(local, "a-z"), 24, _letters, "email", key))
    return F.concat(new, F.lit("@"), F.substring_index(x, "@", -1))


def _card(x: Column, key: str) -> Column:
    d = _only(x, "0-9")
    body = F.concat(F.substring(d, 1, 1), _digits(F.substring(d, F.lit(2), F.length(d) - 2), F.lit("card"), key))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when((_luhn(d) % 10 == 0) & d.rlike("[1-9]"), _fill(x, F.concat(body, check.cast("string")))).otherwise(x)


def _iban_core(x: Column, key: str) -> Column:
    """The pseudonym of a valid IBAN, null for any other text."""
    flat = F.replace(x, F.lit(" "), F.lit(""))
    rest = F.substring(flat, F.lit(5), F.length(flat))
    shape = F.concat(F.lit("iban"), F.regexp_replace(rest, "[0-9]", "0"), F.substring(flat, 1, 2))
    new = _fill(rest, _digits(_only(rest, "0-9"), shape, key))
    check = F.lpad((98 - _mod97(F.concat(F.substring(flat, 1, 2), F.lit("00"), new))).cast("string"), 2, "0")
    made = F.concat(F.substring(x, 1, 2), _fill(F.substring(x, F.lit(3), F.length(x)), _only(F.concat(check, new), "0-9")))
    return F.when((F.length(flat) >= 15) & (_mod97(flat) == 1) & rest.rlike("[0-9]"), made)


def _iban(x: Column, key: str) -> Column:
    # A capitalised word after a spaced number can look like its last group.
    short = F.regexp_replace(x, " [A-Z0-9]+$", "")
    return F.coalesce(_iban_core(x, key), F.concat(_iban_core(short, key), F.substring(x, F.length(short) + 1, F.length(x))), x)


def _ip(x: Column, key: str) -> Column:
    o = F.transform(F.split(x, r"\."), lambda c: c.cast("long"))
    p = feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    new = F.aggregate(F.array(p), F.lit(""), lambda s, q: F.concat_ws(".", *[y.cast("long").cast("string") for half in ("a", "b") for y in (F.floor(q[half] / 256), q[half] % 256)]))
    return F.when(F.array_max(o) <= 255, new).otherwise(x)


def _ssn(x: Column, key: str) -> Column:
    part = lambda a, n: F.substring(x, a, n).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    dense = area - 1 - F.when(area > 666, 1).otherwise(0)
    p = feistel(dense * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def write(s: Column, q: Column) -> Column:
        a = F.floor(q["a"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        pad = lambda y, n: F.lpad(y.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(q["a"] % 99 + 1, 2), pad(q["b"] + 1, 4))

    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), F.aggregate(F.array(p), F.lit(""), write)).otherwise(x)


def _phone(x: Column, key: str) -> Column:
    code = F.regexp_extract(x, r"^\+1|^\+[0-9]{1,3}(?=[ (-])|^\+[0-9]{2}", 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    d = _only(rest, "0-9")
    n = F.length(_only(x, "0-9"))
    return F.when((n >= 8) & (n <= 15), F.concat(code, _fill(rest, _digits(d, F.concat(F.lit("phone"), code), key)))).otherwise(x)


def _national(x: Column, key: str) -> Column:
    d = _only(x, "0-9")
    part = lambda a, n: F.substring(d, a, n).cast("long")
    dense = lambda v: F.floor(v / 100 - 2) * 99 + v % 100 - F.when(v % 100 > 11, 1).otherwise(0)
    area, exchange = part(1, 3), part(4, 3)
    p = feistel(dense(area), dense(exchange) * 10000 + part(7, 4), F.lit(792), F.lit(7_920_000), F.lit("national"), key)
    wide = lambda i: (F.floor(i / 99) + 2) * 100 + i % 99 + F.when(i % 99 >= 11, 1).otherwise(0)

    def write(s: Column, q: Column) -> Column:
        last = F.lpad((q["b"] % 10000).cast("string"), 4, "0")
        return F.concat(wide(q["a"]).cast("long").cast("string"), wide(F.floor(q["b"] / 10000)).cast("long").cast("string"), last)

    return F.when((area % 100 != 11) & (exchange % 100 != 11), _fill(x, F.aggregate(F.array(p), F.lit(""), write))).otherwise(x)


def _day_first(x: Column, key: str) -> Column:
    """The pseudonym of a date dd/mm/yyyy after the 12th, null for any other text: again such a date, so never one of a date mm/dd/yyyy."""
    part = lambda a, n: F.substring(x, a, n).cast("int")
    d, m, y = part(1, 2), part(4, 2), part(7, 4)
    real = y.between(1901, 2096) & m.between(1, 12) & (d > 12) & (d <= _month_days(y, m))
    n = F.datediff(F.make_date(y, m, F.lit(1)), F.lit(_EPOCH).cast("date")) + d - 1 - 12 * ((y - 1901) * 12 + m)
    p = feistel(F.floor(n / _LATE[1]), n % _LATE[1], F.lit(_LATE[0]), F.lit(_LATE[1]), F.lit("day first"), key)

    def write(s: Column, q: Column) -> Column:
        i = (q["a"] * _LATE[1] + q["b"]).cast("int")  # four years have 885
        k = F.least(F.floor(i % 885 / 221), F.lit(3)).cast("int")
        left, leap = i % 885 - 221 * k, (k == 3).cast("int")
        starts = F.array(*[F.lit(b) + (leap if j > 1 else 0) for j, b in enumerate(_LATE_BEFORE)])
        month = F.size(F.filter(starts, lambda b: b <= left))
        pad = lambda v, w: F.lpad(v.cast("string"), w, "0")
        return F.concat_ws("/", pad(left - F.element_at(starts, month) + 13, 2), pad(month, 2), pad(F.floor(i / 885).cast("int") * 4 + k + 1901, 4))

    return F.when(real, F.aggregate(F.array(p), F.lit(""), write))


def _month_days(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, 28 + leap.cast("int")).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _date(x: Column, key: str) -> Column:
    iso, dotted = x.contains("-"), x.contains(".")
    part = lambda a, n: F.substring(x, a, n).cast("int")
    y = F.when(iso, part(1, 4)).otherwise(part(7, 4))
    m = F.when(iso, part(6, 2)).when(dotted, part(4, 2)).otherwise(part(1, 2))
    d = F.when(iso, part(9, 2)).when(dotted, part(1, 2)).otherwise(part(4, 2))
    real = y.between(1901, 2096) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m))
    n = F.datediff(F.make_date(y, m, d), F.lit(_EPOCH).cast("date"))
    p = feistel(F.floor(n / _SPAN[1]), n % _SPAN[1], F.lit(_SPAN[0]), F.lit(_SPAN[1]), F.lit("date"), key)

    def write(s: Column, q: Column) -> Column:
        new = F.date_add(F.lit(_EPOCH).cast("date"), (q["a"] * _SPAN[1] + q["b"]).cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(dotted, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))

    return F.when(real, F.aggregate(F.array(p), F.lit(""), write)).otherwise(F.coalesce(F.when(~iso & ~dotted, _day_first(x, key)), x))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card, "national": _national}


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one candidate; itself if it doesn't validate."""
    out = None
    for kind, p in PATTERNS.items():
        cond, value = x.rlike(f"^(?:{p})$"), _MAKERS[kind](x, key)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(x)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with valid personal data in ``text`` replaced by pseudonyms; ``count`` names a column for their number.

    Without ``key`` the session setting ``SETTING`` must name one, else ValueError. Null
    texts stay null with a count of 0; texts without a candidate, of any length, pass
    unchanged, and so do all other columns. Repeated rows are replaced alike. An empty
    table gives no rows.
    """
    key = key or docs.sparkSession.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key, as an argument or in {SETTING}")
    pattern = "|".join(PATTERNS.values())
    names = docs.columns
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("t"))
    some = F.col("t").rlike("[0-9@]") & F.col("t").rlike(pattern)
    none = F.array().cast("array<string>")
    t = t.withColumn("found", F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    t = t.withColumn("made", F.transform("found", lambda x: pseudonym(x, key)))
    t = t.withColumn("gaps", F.when(F.size("found") > 0, F.split("t", pattern, -1)).otherwise(none))
    new = F.when(F.size("found") > 0, F.array_join(F.flatten(F.transform("gaps", lambda g, i: F.array(g, F.coalesce(F.get("made", i), F.lit(""))))), "")).otherwise(F.col("t"))
    columns = [(new if c == text else F.col("row").getField(c)).alias(c) for c in names if c != count]
    if count:
        columns.append(F.coalesce(F.size(F.filter(F.arrays_zip("found", "made"), lambda z: z["found"] != z["made"])), F.lit(0)).cast("long").alias(count))
    return t.select(*columns)
