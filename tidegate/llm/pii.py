"""Format-preserving pseudonyms by keyed Feistel permutations, in SQL expressions.

A value that is found and proves valid is permuted within its format, so the text keeps its shape, the
pseudonym is valid too and equal values get equal pseudonyms in every document:

- payment card, 13 to 19 digits with a right Luhn digit, as whole groups among other digits too: the first digit stays, the check digit is made anew
- IBAN with right check digits: country and letters stay, check digits are made anew
- North American phone number, with or without +1: area and exchange codes stay valid; with +1 or brackets any three digits
  are taken as codes, and a number whose codes aren't valid is permuted among such numbers
- other phone number, as + and 8 to 15 digits: + and country code stay
- IPv4 address: any other address
- social security number (area not 000, 666 or 9xx, group not 00, serial not 0000)
- date from 1900-01-01 to 2099-04-30, as y-m-d, d.m.y or m/d/y (d/m/y where that is no date): the same date in any notation
  becomes the same other date. Days up to the 12th are permuted among such days and later ones among later ones, so that
  what is read as d/m/y stays so
- e-mail address: letters and digits of the local part, the domain stays

Two halves take turns: each is shifted, within its range, by a SHA-256 of the key and the other half. That
is a permutation whatever the ranges; small formats have few values, so one may map to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.quality import let

ROUNDS = 8
#: The shapes looked for. A number must not touch a letter or a digit. What repeats without bound is possessive,
#: or each repetition would take a frame of the JVM's stack, whose overflow ends an executor.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FROM, _TO = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
SHAPES = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": _FROM + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _TO,
    "phone": r"(?:(?<![\p{L}\p{N}+])\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}|(?<![\p{L}\p{N}+(]|\d[ .-])(?:\(\d{3}\) ?\d{3}|[2-9]\d{2}[ .-][2-9]\d{2})[ .-]\d{4})(?![\p{L}\p{N}]|-\d)",
    "abroad": r"(?<![\p{L}\p{N}+])\+[2-9](?:[ .-]?(?:\(\d{1,4}\)|\d)){7,14}(?![\p{L}\p{N}]|[ .-]?\d)",
    "date": r"(?<![\p{L}\p{N}]|\d[./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\p{L}\p{N}]|[./-]\d)",
    "ssn": r"(?<![\p{L}\p{N}]|\d-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "ip": r"(?<![\p{L}\p{N}]|\d\.)" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)",
}
#: Groups of digits, 13 digits or more from the first on, as far as none of the other shapes begins.
SHAPES["card"] = _FROM + r"(?=\d(?:[ -]?\d){12})\d++" + _TO + "(?:[ -](?!" + "|".join(SHAPES[k] for k in ("email", "date", "ssn", "ip")) + r")\d++" + _TO + ")*+"
#: No shape begins after an ASCII letter or digit, nor with another character than these: most places are told by that alone.
ANY = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9._%+(-])(?:" + "|".join(SHAPES.values()) + ")"
#: Months from 1900-01 whose dates are permuted; halves of their days up to the 12th, and of the later ones.
_MONTHS, _EARLY, _LATE = 2392, (156, 184), (210, 210)
#: Country codes of one and of two digits; the others have three.
_CODES = r"7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _long(x: Column) -> Column:
    return x.cast("long")


def _hash(key: Column, *parts: Column) -> Column:
    return _long(F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10))


def _pair(x: Column, y: Column, a: int, b: int, key: Column, kind: str) -> Column:
    """struct(x, y) permuted within a * b values."""

    def turn(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 1, F.struct(((s["x"] + _hash(key, F.lit(kind), r, s["y"])) % a).alias("x"), s["y"].alias("y"))).otherwise(
            F.struct(s["x"].alias("x"), ((s["y"] + _hash(key, F.lit(kind), r, s["x"])) % b).alias("y"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(_long(x).alias("x"), _long(y).alias("y")), turn)


def _chars(s: Column, key: Column, kind: str, letters: bool = True) -> Column:
    """A string with its digits, and letters if asked, permuted; other characters stay."""

    def shifted(c: Column, by: Column) -> Column:
        def within(low: int, n: int) -> Column:
            return F.char(low + (F.ascii(c) - low + by) % n)

        out = F.when(c.rlike("[0-9]"), within(48, 10))
        return (out.when(c.rlike("[a-z]"), within(97, 26)).when(c.rlike("[A-Z]"), within(65, 26)) if letters else out).otherwise(c)

    def turn(s: Column, r: Column) -> Column:
        n = F.length(s)
        half = F.floor(n / 2).cast("int")
        first = r % 2 == 1
        other = F.when(first, F.substring(s, half + 1, n)).otherwise(F.substring(s, F.lit(1), half))
        return let(other, lambda o: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(s, i, F.lit(1)), lambda c: F.when((i <= half) == first, shifted(c, _hash(key, F.lit(kind), r, i, o))).otherwise(c))), ""))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), s, turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, new: Column, fixed: str = "[^0-9]") -> Column:
    """m with the characters that aren't ``fixed`` replaced by those of new, in order."""
    at = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), fixed, ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: let(F.substring(m, i, F.lit(1)), lambda c: F.when(c.rlike(fixed), c).otherwise(F.substring(new, at(i), F.lit(1))))), "")


def _luhn(d: Column) -> Column:
    """Sum of a digit string, the last digit counting once."""

    def add(a: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return a + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _card(m: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _chars(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    def length(rest: Column) -> Column:
        """Of the longest card that rest begins with and that ends with a group; null if there is none."""
        near = F.substring(rest, 1, 38)  # 19 digits, each a group, and what parts them
        ends = F.array_distinct(F.transform(F.sequence(F.lit(19), F.lit(1)), lambda g: F.length(F.call_function("substring_index", F.translate(near, "-", " "), F.lit(" "), g))))
        valid = lambda e: let(_digits(F.substring(near, F.lit(1), e)), lambda d: F.length(d).between(13, 19) & (_luhn(d) % 10 == 0))
        return F.get(F.filter(ends, valid), 0)

    def step(s: Column, _: Column) -> Column:
        def taken(n: Column) -> Column:
            end = F.coalesce(n, F.length(F.regexp_extract(s["rest"], "^[0-9]*", 0)))
            own = F.substring(s["rest"], F.lit(1), end)
            made = F.when(n.isNotNull(), _refill(own, new(_digits(own)))).otherwise(own)
            return F.struct(F.concat(s["out"], made, F.substring(s["rest"], end + 1, F.lit(1))).alias("out"), F.substring(s["rest"], end + 2, F.length(s["rest"])).alias("rest"), (s["n"] + (made != own).cast("int")).alias("n"))

        return F.when(s["rest"] == "", s).otherwise(let(length(s["rest"]), taken))

    groups = F.size(F.split(m, "[ -]"))
    return F.aggregate(F.sequence(F.lit(1), groups), F.struct(F.lit("").alias("out"), m.alias("rest"), F.lit(0).alias("n")), step, lambda s: F.struct(s["out"].alias("new"), s["n"].alias("n")))


def _mod97(s: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(m: Column, key: Column) -> Column:
    """New text and number of values of what looks like an IBAN: the longest valid one that ends with a group, and cards in
    what is left."""

    def new(s: Column) -> Column:
        rest = _chars(F.substring(s, F.lit(5), F.length(s)), key, "iban", letters=False)
        return let(rest, lambda b: F.concat(F.substring(s, 1, 2), F.lpad((98 - _mod97(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))

    def cards(s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(SHAPES["card"]), F.lit(0)), lambda c: _card(c, key))
        text = lambda f: F.array_join(F.transform(F.split(s, SHAPES["card"]), lambda g, i: F.concat(g, F.coalesce(F.get(f, i)["new"], F.lit("")))), "")
        return let(found, lambda f: F.struct(text(f).alias("new"), F.aggregate(f, F.lit(0), lambda a, c: a + c["n"]).alias("n")))

    def parted(p: Column) -> Column:
        head = F.concat(_refill(p, new(F.regexp_replace(p, " ", "")), " "))
        tail = cards(F.substring(m, F.length(p) + 1, F.length(m)))
        return let(head, lambda h: let(tail, lambda t: F.struct(F.concat(h, t["new"]).alias("new"), ((h != p).cast("int") + t["n"]).alias("n"))))

    valid = lambda s: _mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1
    parts = F.transform(F.sequence(F.size(F.split(m, " ")), F.lit(1)), lambda g: F.call_function("substring_index", m, F.lit(" "), g))
    longest = F.get(F.filter(parts, lambda p: let(F.regexp_replace(p, " ", ""), lambda s: (F.length(s) >= 12) & valid(s))), 0)
    return let(longest, lambda p: F.when(p.isNotNull(), parted(p)).otherwise(cards(m)))


def _abroad(m: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        code = F.regexp_extract(d, f"^(?:{_CODES}|...)", 0)
        return let(code, lambda c: F.concat(c, _chars(F.substring(d, F.length(c) + 1, F.length(d)), key, "abroad")))

    return let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _refill(m, new(d))).otherwise(m))


def _phone(m: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        area, exchange, line = (_long(F.substring(d, at, n)) for at, n in ((-10, 3), (-7, 3), (-4, 4)))
        head, pad = F.substring(d, F.lit(1), F.length(d) - 10), lambda x, n: F.lpad(x.cast("string"), n, "0")
        p = _pair(area - 200, (exchange - 200) * 10_000 + line, 800, 8_000_000, key, "phone")
        good = let(p, lambda q: F.concat(head, (q["x"] + 200).cast("string"), (F.floor(q["y"] / 10_000) + 200).cast("string"), pad(q["y"] % 10_000, 4)))
        # the others in order: areas below 200 with any exchange, then areas from 200 with an exchange below 200
        n = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        p = _pair(n, line, 360_000, 10_000, key, "phone other")
        low = lambda q: q["x"] < 200_000
        code = lambda q: F.when(low(q), q["x"]).otherwise((F.floor((q["x"] - 200_000) / 200) + 200) * 1000 + (q["x"] - 200_000) % 200)
        return F.when((area >= 200) & (exchange >= 200), good).otherwise(let(p, lambda q: F.concat(head, pad(code(q), 6), pad(q["y"], 4))))

    return let(_digits(m), lambda d: _refill(m, new(d)))


def _ip(m: Column, key: Column) -> Column:
    def new(o: Column) -> Column:
        n = [_long(F.get(o, i)) for i in range(4)]
        p = _pair(n[0] * 256 + n[1], n[2] * 256 + n[3], 65_536, 65_536, key, "ip")
        return let(p, lambda q: F.concat_ws(".", *[F.floor(q[s] / 256).cast("string") if k == 0 else (q[s] % 256).cast("string") for s in "xy" for k in (0, 1)]))

    return let(F.split(m, r"\."), new)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = _long(F.substring(m, 1, 3)), _long(F.substring(m, 5, 2)), _long(F.substring(m, 8, 4))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    p = _pair(place, (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    made = let(p, lambda q: F.concat_ws("-", pad(q["x"] + F.when(q["x"] >= 665, 2).otherwise(1), 3), pad(F.floor(q["y"] / 9_999) + 1, 2), pad(q["y"] % 9_999 + 1, 4)))
    return F.when(valid, made).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    start = F.lit("1900-01-01").cast("date")
    first = lambda month: F.add_months(start, month.cast("int"))  # noqa: E731  of a month counted from 1900-01
    later = lambda month: F.datediff(first(month), start) - 12 * month  # noqa: E731  days after a 12th before that month

    def permuted(month: Column, day: Column) -> Column:
        """struct(month, day) of the other date."""

        def early(p: Column) -> Column:
            r = p["x"] * _EARLY[1] + p["y"]
            return F.struct(F.floor(r / 12).alias("month"), (r % 12 + 1).alias("day"))

        def late(p: Column) -> Column:
            r = p["x"] * _LATE[1] + p["y"]
            near = F.floor(r * _MONTHS / (_LATE[0] * _LATE[1]))  # a month off at most
            month = F.get(F.filter(F.array(near + 1, near, near - 1), lambda c: later(c) <= r), 0)
            return let(month, lambda c: F.struct(c.alias("month"), (r - later(c) + 13).alias("day")))

        def halves(r: Column, sizes: tuple[int, int], kind: str) -> Column:
            return _pair(F.floor(r / sizes[1]), r % sizes[1], *sizes, key, kind)

        return F.when(day <= 12, let(halves(month * 12 + day - 1, _EARLY, "date"), early)).otherwise(let(halves(later(month) + day - 13, _LATE, "date late"), late))

    def new(parts: Column, order: str, sep: str) -> Column:
        at = {c: F.get(parts, i) for i, c in enumerate(order)}
        year, month, day = (_long(at[c]) for c in "ymd")
        known = year.between(1900, 2099) & month.between(1, 12)
        # two digits where both day and month had two
        wide = (F.length(at["m"]) == 2) & (F.length(at["d"]) == 2)
        put = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        shown = lambda e: F.concat_ws(sep, *[(F.floor(e["month"] / 12) + 1900).cast("string") if c == "y" else put(e["month"] % 12 + 1 if c == "m" else e["day"]) for c in order])
        n = (year - 1900) * 12 + month - 1
        made = let(n, lambda k: F.when((k < _MONTHS) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first(k)))), let(permuted(k, day), shown)))
        return F.when(known, made)

    return F.coalesce(
        F.when(m.contains("-"), let(F.split(m, "-"), lambda x: new(x, "ymd", "-"))).when(m.contains("."), let(F.split(m, r"\."), lambda x: new(x, "dmy", "."))).otherwise(let(F.split(m, "/"), lambda x: F.coalesce(new(x, "mdy", "/"), new(x, "dmy", "/")))),
        m,
    )


def _email(m: Column, key: Column) -> Column:
    return F.concat(_chars(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: Column) -> Column:
    """What one found value becomes (new) and how many values in it were replaced (n); one that doesn't prove valid stays."""
    one = lambda x: let(x, lambda v: F.struct(v.alias("new"), (v != m).cast("int").alias("n")))
    whole = lambda kind: m.rlike(f"^(?:{SHAPES[kind]})$")
    return (
        F.when(m.contains("@"), one(_email(m, key))).when(m.rlike("^[A-Z]"), _iban(m, key)).when(whole("phone"), one(_phone(m, key))).when(m.startswith("+"), one(_abroad(m, key))).when(whole("date"), one(_date(m, key)))
        .when(whole("ssn"), one(_ssn(m, key))).when(whole("ip"), one(_ip(m, key))).otherwise(_card(m, key))
    )


def pseudonymised(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with the personal values in ``text`` replaced; the rest of a text stays byte for byte.

    ``count`` names a column to add with the number of values replaced. A null text stays null, with 0
    replaced; every row is handled alone and whole, so ties, repeated rows and other columns change nothing and an empty
    table gives an empty table. The key is a secret of the caller: the same key links the same values across documents
    and runs, and whoever has it can turn them back.
    """
    if not key:
        raise ValueError("a key is needed")
    own = "__found"
    found = df.withColumn(own, F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, F.lit(key))))
    gaps = F.split(F.col(text), ANY)
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(own), i)["new"], F.lit("")))), "")
    new = F.when(F.size(own) > 0, whole).otherwise(F.col(text)).alias(text)
    out = [new if c == text else F.col(f"`{c}`") for c in df.columns]
    if count:
        out.append(F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long").alias(count))
    return found.select(out)
