import datetime
import hashlib
import random
import re

import pytest

import corpus_pipeline
from tidegate.llm import pii, queries

KEY = "k"
SF = "/root/testdata/sf0.001"


def h(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:12], 16)


def pair(x, y, a, b, kind):
    for r in range(1, 9):
        x, y = ((x + h(kind, r, y)) % a, y) if r % 2 else (x, (y + h(kind, r, x)) % b)
    return x, y


def chars(s, kind, letters=True):
    for r in range(1, 9):
        n, half = len(s), len(s) // 2
        other = s[half:] if r % 2 else s[:half]
        out = ""
        for i, c in enumerate(s, 1):
            if (i <= half) == (r % 2 == 1):
                by = h(kind, r, i, other)
                for low, m in ((48, 10), (97, 26), (65, 26)):
                    if low <= ord(c) < low + m and (letters or m == 10):
                        c = chr(low + (ord(c) - low + by) % m)
                        break
            out += c
        s = out
    return s


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t


def card(d):
    b = d[0] + chars(d[1:-1], "card")
    return b + str((10 - luhn(b + "0") % 10) % 10)


def phone(d):
    x, y = pair(int(d[-10:-7]) - 200, (int(d[-7:-4]) - 200) * 10000 + int(d[-4:]), 800, 8_000_000, "phone")
    return f"{x + 200}{y // 10000 + 200}{y % 10000:04}"


def ip(m):
    a, b, c, d = map(int, m.split("."))
    x, y = pair(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def _months():
    day, out = datetime.date(1900, 1, 1), []
    while len(out) < 2392:
        out.append(day)
        day = (day + datetime.timedelta(31)).replace(day=1)
    return out


MONTHS = _months()
LATE = [m + datetime.timedelta(d) for m in MONTHS for d in range(12, 31) if (m + datetime.timedelta(d)).month == m.month]
PLACE = {d: i for i, d in enumerate(LATE)}


def other_day(day):
    if day.day <= 12:
        n = ((day.year - 1900) * 12 + day.month - 1) * 12 + day.day - 1
        x, y = pair(n // 184, n % 184, 156, 184, "date")
        return MONTHS[(x * 184 + y) // 12].replace(day=(x * 184 + y) % 12 + 1)
    x, y = pair(PLACE[day] // 210, PLACE[day] % 210, 210, 210, "date late")
    return LATE[x * 210 + y]


def iso(m):
    return other_day(datetime.date.fromisoformat(m)).isoformat()


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, old string")
    return {r.doc_id: (r.text, r.n) for r in pii.pseudonymised(df, key=KEY, count="n").collect()}


def with_luhn(rng, n):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c) % 10 == 0)


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts, want = [None, "", "nothing here 12 and 2.0.", "a\x01b \\0 $1"], [(None, 0), ("", 0), ("nothing here 12 and 2.0.", 0), ("a\x01b \\0 $1", 0)]
    for _ in range(30):
        c, p, a = with_luhn(rng, rng.choice([13, 16, 19])), f"{rng.randint(200, 999)}{rng.randint(200, 999)}{rng.randint(0, 9999):04}", ".".join(str(rng.randint(0, 255)) for _ in range(4))
        d = (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(72700))).isoformat()
        local = "".join(rng.choice("abcXYZ019._") for _ in range(rng.randint(2, 12))) + "q"
        q = phone(p)
        texts.append(f"é {c}, +1 ({p[:3]}) {p[3:6]}-{p[6:]} und\n{a}. {d}; {local}@Mail7.example.com")
        want.append((f"é {card(c)}, +1 ({q[:3]}) {q[3:6]}-{q[6:]} und\n{ip(a)}. {iso(d)}; {chars(local, 'email')}@Mail7.example.com", 5))
    got = run(spark, texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]


def test_formats_stay_valid_and_linked(spark):
    rng = random.Random(6)
    c = with_luhn(rng, 16)
    spaced = " ".join(c[i : i + 4] for i in range(0, 16, 4))
    got = run(spark, [spaced, c, "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "219-09-9999", "24.12.2001", "1/2/2003", "13/01/2020", "29.02.2001", "1234567812345678", "900-12-1234", "DE88 3704 0044 0532 0130 00", "v1.2.3.4.5", "x1.2.3.4"])
    assert re.sub(" ", "", got[0][0]) == got[1][0] and luhn(got[1][0]) % 10 == 0 and got[1][0] != c and got[1][0][0] == "4"
    for k in (2, 3):
        s = got[k][0].replace(" ", "")
        assert int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1 and got[k][1] == 1
    assert got[3][0].startswith("GB") and got[3][0][4:8] == "WEST"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[4][0]) and got[4][1] == 1
    assert datetime.datetime.strptime(got[5][0], "%d.%m.%Y") and got[5][1] == 1
    assert re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", got[6][0]) and got[6][1] == 1 and got[7][1] == 1
    assert [got[k] for k in range(8, 14)] == [("29.02.2001", 0), ("1234567812345678", 0), ("900-12-1234", 0), ("DE88 3704 0044 0532 0130 00", 0), ("v1.2.3.4.5", 0), ("x1.2.3.4", 0)]


def test_phones_of_any_code(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 171 555 2028", "(017) 055-1234", "+1 (217) 055-1234", "call +10175557713."]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][1] == 1 and got[i][0] != t and re.sub(r"\d", "0", got[i][0]) == re.sub(r"\d", "0", t), t
        assert got[i][0].startswith("+1") == t.startswith("+1")
    same = {re.sub(r"\D", "", got[i][0])[-10:] for i in (0, 5)}
    assert len(same) == 1 and not all(re.fullmatch(r"[2-9]..[2-9].*", x) for x in same)
    lines = run(spark, [f"+1 (017) 555-{i:04}" for i in range(3000)])
    assert len({t for t, _ in lines.values()}) == 3000
    assert run(spark, ["017-555-7713", "132 555 1352", "217 055 1234"]) == {0: ("017-555-7713", 0), 1: ("132 555 1352", 0), 2: ("217 055 1234", 0)}


def test_cards_and_ibans_beside_other_groups(spark):
    a, b = "7536784127813050", "4845168114407329"
    other = lambda d: next(x for x in range(100, 999) if luhn(f"{d}{x}") % 10)
    texts = [f"{a} {b}", f"{a} {other(a)}", f"{b} 12/27", f"7 {a}", f"{a} 219-09-9999", f"{b} 10.0.0.1", "DE89 3704 0044 0532 0130 00 BIC", "GB82WEST12345698765432 2024", "1 2 3 " * 40]
    got = run(spark, texts)
    assert [got[i] for i in range(4)] == [(f"{card(a)} {card(b)}", 2), (f"{card(a)} {other(a)}", 1), (f"{card(b)} 12/27", 1), (f"7 {card(a)}", 1)]
    assert got[4][0].startswith(card(a) + " ") and got[4][1] == 2 and got[5][0] == f"{card(b)} {ip('10.0.0.1')}"
    for i, tail in ((6, " BIC"), (7, " 2024")):
        assert got[i][1] == 1 and got[i][0].endswith(tail) and got[i][0] != texts[i]


def test_permutation(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(3000)]
    got = run(spark, days)
    assert len({t for t, _ in got.values()}) == 3000


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, `a.b` string")
    assert pii.pseudonymised(df, KEY).columns == df.columns and pii.pseudonymised(df, KEY).collect() == []
    with pytest.raises(ValueError):
        pii.pseudonymised(df, "")


def test_a_date_in_any_notation(spark):
    rng = random.Random(8)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(72_000)) for _ in range(150)]
    forms = ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"]
    texts = [(d, f) for d in days for f in forms if f != "%d/%m/%Y" or d.day > 12]
    got = run(spark, [d.strftime(f) for d, f in texts])
    for i, (d, f) in enumerate(texts):
        assert got[i][0] == other_day(d).strftime(f), (d, f)
    slashed = sorted({d.strftime(f) for d, f in texts if "/" in f})
    assert len({t for t, _ in run(spark, slashed).values()}) == len(slashed)
    assert run(spark, ["2099-05-01", "1899-12-31", "31/04/2020", "0/0/2000"]) == {0: ("2099-05-01", 0), 1: ("1899-12-31", 0), 2: ("31/04/2020", 0), 3: ("0/0/2000", 0)}


def test_late_days_are_permuted(spark):
    some = LATE[:1500] + LATE[-1500:]
    got = run(spark, [d.isoformat() for d in some])
    assert [got[i][0] for i in range(len(some))] == [other_day(d).isoformat() for d in some] and len({t for t, _ in got.values()}) == len(some)


def test_phones_abroad_and_cards_after_letters(spark):
    c = "7536784127813050"
    texts = ["+44 20 7946 0958", "+442079460958", "+49 (30) 123-4567", "+352 621 123 456", "+44 20 79", "+4420794609581234567", f"AB15 {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"DE89 3704 0044 0532 0130 00 {c}"]
    got = run(spark, texts)
    for i, head in ((0, "+44 "), (1, "+44"), (2, "+49 ("), (3, "+352 ")):
        assert got[i][1] == 1 and got[i][0].startswith(head) and re.sub(r"\d", "0", got[i][0]) == re.sub(r"\d", "0", texts[i]), texts[i]
    assert got[0][0].replace(" ", "") == got[1][0]
    assert got[4] == (texts[4], 0) and got[5] == (texts[5], 0)
    new = card(c)
    assert got[6] == (f"AB15 {new[:4]} {new[4:8]} {new[8:12]} {new[12:]}", 1)
    assert got[7][1] == 2 and got[7][0].endswith(new)


def _dates(m):
    for sep, orders in (("-", ["ymd"]), (".", ["dmy"]), ("/", ["mdy", "dmy"])):
        if sep in m:
            for order in orders:
                parts = dict(zip(order, m.split(sep), strict=True))
                try:
                    day = datetime.date(*(int(parts[c]) for c in "ymd"))
                except ValueError:
                    continue
                if datetime.date(1900, 1, 1) <= day < datetime.date(2099, 5, 1):
                    new, wide = other_day(day), len(parts["m"]) == len(parts["d"]) == 2
                    put = lambda x: f"{x:02}" if wide else str(x)
                    return sep.join({"y": str(new.year), "m": put(new.month), "d": put(new.day)}[c] for c in order)
    return m


def replaced(text):
    """(text, values replaced), for the kinds of value in the table: e-mails, phones with +1, cards, SSNs, addresses, dates."""
    refill = lambda m, d: re.sub(r"\d", lambda _, it=iter(d): next(it), m)

    def one(m):
        v = m[0]
        if "@" in v:
            local, _, domain = v.partition("@")
            return chars(local, "email") + "@" + domain
        digits = re.sub(r"\D", "", v)
        if v.startswith(("+1", "(")):
            area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
            if area >= 200 and exchange >= 200:
                return refill(v, digits[:-10] + phone(digits))
            x, y = pair(area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange, line, 360_000, 10_000, "phone other")
            code = x if x < 200_000 else ((x - 200_000) // 200 + 200) * 1000 + (x - 200_000) % 200
            return refill(v, digits[:-10] + f"{code:06}{y:04}")
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", v):
            a, g, n = (int(p) for p in v.split("-"))
            if not a or a == 666 or a >= 900 or not g or not n:
                return v
            x, y = pair(a - (2 if a > 666 else 1), (g - 1) * 9999 + n - 1, 898, 99 * 9999, "ssn")
            return f"{x + (2 if x >= 665 else 1):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
        if v.count(".") == 3:
            return ip(v) if all(int(p) < 256 and str(int(p)) == p for p in v.split(".")) else v
        if re.fullmatch(r"\d{16}", v):
            return card(v) if luhn(v) % 10 == 0 else v
        return _dates(v)

    kinds = [
        r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\w|-\d)", r"(?<![\w./-])\d{4}-\d{2}-\d{2}(?![\w/]|[.-]\d)",
        r"(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)", r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?!\w|/\d)", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", r"(?<!\w)\d{16}(?!\w)",
    ]
    n = 0

    def counted(m):
        nonlocal n
        new = one(m)
        n += new != m[0]
        return new

    return re.sub("|".join(kinds), counted, text), n


def test_query_against_plain_python(spark):
    spark.conf.set("spark.tidegate.pseudonym.key", KEY)
    try:
        got = {r.doc_id: (r.text, r.n_replaced) for r in queries.QUERIES["op5_pii"](spark, SF).collect()}
    finally:
        spark.conf.unset("spark.tidegate.pseudonym.key")
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows) and sum(n for _, n in got.values()) > 20
    for r in rows:
        assert got[r.doc_id] == replaced(r.text), r.doc_id


class _Session:
    """What pseudonym_key reads of a session."""

    def __init__(self, master, key=None):
        self.conf, self.sparkContext, self.master, self.key = self, self, master, key

    def get(self, name, default):
        return self.key if self.key is not None else default


def test_the_public_key_is_for_local_mode_alone():
    assert queries.pseudonym_key(_Session("local[4]")) == "not a secret" and queries.pseudonym_key(_Session("yarn", "x")) == "x"
    for master in ("yarn", "spark://h:7077", "k8s://h"):
        with pytest.raises(ValueError):
            queries.pseudonym_key(_Session(master))


@pytest.mark.filterwarnings("ignore:spark.tidegate.pseudonym.key")
def test_on_a_cluster_without_a_key_the_queries_draw_one_for_the_application(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "write to ann.lee@example.org", "en", "web", 28)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(queries, "_table", lambda *_: rows)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://h:7077")
    first, again = (queries.QUERIES["op5_pii"](spark, "").collect()[0] for _ in range(2))
    assert first.n_replaced == 1 and first.text.endswith("@example.org") and first == again
    assert corpus_pipeline.personal(spark, rows, "").collect()[0].text == first.text != _text(rows, "not a secret")


def _text(rows, key):
    return pii.pseudonymised(rows, key).collect()[0].text


def test_a_domain_of_very_many_parts(spark):
    text = "x1@a" + ".b" * 20_000
    got = pii.pseudonymised(spark.createDataFrame([(1, f"to {text}, so")], "doc_id long, text string"), KEY, count="n").collect()[0]
    assert got.n == 1 and got.text == f"to {chars('x1', 'email')}@{text[3:]}, so"
