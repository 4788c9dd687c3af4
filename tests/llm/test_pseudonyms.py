import datetime
import hashlib
import random
import re

import pytest

from lodequery.llm import pseudonyms as P

TEXTS = [
    "call +1 (988) 555-2485 now, or (212) 555-0100.", "card 4111 1111 1111 1111, or 4111111111111111; bad 4111111111111112", "ip 42.144.35.254 and 999.1.1.1 v 1.2.3.4.5 01.2.3.4", "bosbt.42@mail8.example.com ok 42@mail8.example.com",
    "born 1987-03-04 or 04.03.1987, 03/04/1987; 2023-02-30 1850-01-01 31.12.2099", "ssn 123-45-6789 000-12-3456 899-99-9999", None, "", "nothing here", "4111111111111111 " * 40, "ñ é 日本 +44 20 7946 0958 ü",
]


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def feistel(value, kind, key, rounds=8):
    """The same permutation of a string, by itself."""
    half = len(value) // 2
    l, r = value[:half], value[half:]  # noqa: E741

    def shift(x, k, other):
        h = hashlib.sha256(f"{key}|{kind}|{k}|{other.lower()}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(x):
            by = int(h[(2 * i) % 62 : (2 * i) % 62 + 2], 16)
            for base, n in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + n:
                    c = chr((ord(c) - base + by) % n + base)
                    break
            out += c
        return out

    for k in range(rounds):
        if k % 2:
            l = shift(l, k, r)  # noqa: E741
        else:
            r = shift(r, k, l)
    return l + r


@pytest.fixture(scope="module")
def made(spark):
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x"), (1, TEXTS[1], "x")], "doc_id long, text string, n_card string")
    out = P.pseudonymise(d, "key").collect()
    return d, out


def test_formats_links_and_counts(spark, made):
    d, out = made
    assert len(out) == len(TEXTS) + 2
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    same = re.sub(r"[0-9]", "9", by[0].text)
    assert same == re.sub(r"[0-9]", "9", TEXTS[0]) and by[0].text != TEXTS[0] and by[0].text.startswith("call +1 (") and by[0].n_phone == 2
    a, b, bad = re.findall(r"[0-9](?: ?[0-9]){15}", by[1].text)
    assert luhn(a) and a.replace(" ", "") == b and bad == "4111111111111112" and (by[1].n_found, by[1].n_replaced, by[1].n_card) == (3, 2, 2)
    assert by[2].n_ip == 1 and "999.1.1.1 v 1.2.3.4.5 01.2.3.4" in by[2].text and all(int(x) < 256 for x in by[2].text.split()[1].split("."))
    assert by[3].n_email == 2 and by[3].text == f"{feistel('bosbt.42', 'email', 'key')}@mail8.example.com ok {feistel('42', 'email', 'key')}@mail8.example.com"
    days = re.findall(r"\d{4}-\d{2}-\d{2}", by[4].text)
    assert by[4].n_date == 4 and days[1:] == ["2023-02-30", "1850-01-01"] and datetime.date.fromisoformat(days[0]) == datetime.datetime.strptime(re.search(r"\d\d\.\d\d\.\d{4}", by[4].text)[0], "%d.%m.%Y").date()
    assert by[5].n_ssn == 2 and "000-12-3456" in by[5].text
    assert by[6].text is None and by[7].text == "" and by[8].text == TEXTS[8] and by[6].n_found == by[7].n_found == 0
    assert set(by[9].text.split()) == {b} and by[9].n_card == 40
    assert by[10].n_phone == 1 and by[10].text.startswith("ñ é 日本 +44 ") and by[10].text.endswith(" ü")
    assert [r.text for r in out if r.doc_id is None] == [by[0].text]
    other = P.pseudonymise(d.where("doc_id = 1"), "another key").first().text
    assert other != by[1].text
    assert P.pseudonymise(d.limit(0), "key").collect() == []
    with pytest.raises(ValueError):
        P.pseudonymise(d, "key", rounds=3)


def test_undo_gives_back_every_text(spark, made):
    d, out = made
    df = spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id long, text string")
    assert sorted(str(r.text) for r in P.pseudonymise(df, "key", undo=True).collect()) == sorted(str(r.text) for r in d.collect())


def test_number_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    n = spark.range(0, 7 * 11).select(P.feistel_number(F.col("id"), 7, 11, "k", "x", 8, False).alias("y")).collect()
    assert sorted(r.y for r in n) == list(range(77))


# Every kind again in plain Python, over whole documents.


def feistel_number(value, high, low, kind, key, rounds=8):
    left, right = divmod(value, low)
    by = lambda k, other: int(hashlib.sha256(f"{key}|{kind}|{k}|{other}".encode()).hexdigest()[:12], 16)
    for k in range(rounds):
        if k % 2:
            left = (left + by(k, right)) % high
        else:
            right = (right + by(k, left)) % low
    return left * low + right


def plain_card(m, key):
    digits = re.sub(r"\D", "", m)
    if not luhn(digits):
        return None
    body = feistel(digits[:-1], "card", key)
    new = iter(body + next(c for c in "0123456789" if luhn(body + c)))
    return "".join(next(new) if c.isdigit() else c for c in m)


TWO = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}


def plain_phone(m, key):
    digits = re.sub(r"\D", "", m)
    code = 0 if m[0] != "+" else 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO else 3
    new = iter(digits[:code] + feistel(digits[code:], "phone", key))
    return "".join(next(new) if c.isdigit() else c for c in m)


def plain_ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = feistel_number((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn", key)
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def plain_ip(m, key):
    parts = m.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    n = feistel_number(int.from_bytes(map(int, parts), "big"), 1 << 16, 1 << 16, "ip", key)
    return ".".join(map(str, n.to_bytes(4, "big")))


def plain_email(m, key):
    local, domain = m.split("@", 1)
    return f"{feistel(local, 'email', key)}@{domain}"


def plain_date(m, key):
    shape = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y"
    first = datetime.date(1900, 1, 1)
    try:
        day = (datetime.datetime.strptime(m, shape).date() - first).days
    except ValueError:
        return None
    if not 0 <= day < 73_049:
        return None
    return (first + datetime.timedelta(feistel_number(day, 229, 319, "date", key))).strftime(shape)


PLAIN = {"email": plain_email, "ip": plain_ip, "date": plain_date, "ssn": plain_ssn, "phone": plain_phone, "card": plain_card}


def plain(text, key):
    counts = dict.fromkeys([*PLAIN, "found"], 0)

    def new(match):
        m = match[0]
        kind = next(k for k, p in P.PATTERNS.items() if re.fullmatch(p, m))
        counts["found"] += 1
        made = PLAIN[kind](m, key)
        counts[kind] += made is not None
        return m if made is None else made

    return text and re.sub(P.ANY, new, text), counts


def test_every_kind_against_plain_python(spark):
    r = random.Random(6)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = [d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS
    for _ in range(60):
        card = digits(r.randrange(12, 19))
        card += next(c for c in "0123456789" if luhn(card + c)) if r.random() < 0.8 else "0"
        day = datetime.date(1890, 1, 1) + datetime.timedelta(r.randrange(80_000))
        values = [
            card, "-".join([card[:4], card[4:8], card[8:12], card[12:]]) if len(card) > 12 else card, f"{digits(3)}-{digits(2)}-{digits(4)}", ".".join(str(r.randrange(300)) for _ in range(4)), f"a{digits(2)}.B@x{digits(1)}.org",
            day.isoformat(), day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), day.strftime("%d/%m/%Y"), f"+{r.randrange(1, 400)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+4420{digits(8)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"not {digits(3)}-{digits(3)}-{digits(4)}-{digits(2)}",
        ]
        r.shuffle(values)
        texts.append(r.choice([", ", "; x ", "\n"]).join(values))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen = dict.fromkeys(PLAIN, 0)
    for row in P.pseudonymise(d, "secret").collect():
        want, counts = plain(texts[row.doc_id], "secret")
        assert row.text == want
        assert row.n_found == counts["found"] and row.n_replaced == sum(counts[k] for k in PLAIN)
        for k in PLAIN:
            assert row[f"n_{k}"] == counts[k]
            seen[k] += counts[k]
    assert min(seen.values()) > 20


def test_one_value_has_one_pseudonym(spark):
    notations = ["+1 555 123 4567", "+1-555-123-4567", "+1.555.123.4567", "+1 (555) 123-4567", "+15551234567", "(555) 123-4567", "555-123-4567", "555.123.4567"]
    mails = ["A.Bc7@x.org", "a.bc7@x.org", "a.BC7@x.org"]
    other = ["+44 20 7946 0958", "+44-20-7946-0958", "+44 (20) 7946 0958"]
    texts = [f"call {x}, or write" for x in notations + mails + other]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.pseudonymise(d, "k").collect()}
    assert all(r.n_replaced == r.n_found == 1 for r in got.values())
    new = [re.sub(r"\D", "", got[k].text)[-10:] for k in range(8)]
    assert set(new) == {feistel("5551234567", "phone", "k")} and new[0] != "5551234567"
    for k, x in enumerate(texts):  # signs stay where they were, and so does the country's code
        assert re.sub(r"[0-9A-Za-z]", "x", got[k].text) == re.sub(r"[0-9A-Za-z]", "x", x) and (not x.startswith("call +1") or got[k].text.startswith("call +1"))
    assert len({got[k].text.lower() for k in range(8, 11)}) == 1 and got[8].text != got[9].text
    assert len({re.sub(r"\D", "", got[k].text) for k in range(11, 14)}) == 1 and got[11].text.startswith("call +44 ")
    back = P.pseudonymise(spark.createDataFrame([(k, r.text) for k, r in got.items()], "doc_id long, text string"), "k", undo=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
