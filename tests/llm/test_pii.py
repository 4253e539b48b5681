import datetime
import hashlib
import re

from colloquy.llm.pii import FOUND, ROUNDS, pseudonymise

from .conftest import by_id

KEY = "test key"
VALUES = [
    "4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795", "79927398713999996", "4041894974608796",
    "(988) 555-2485", "+1 (988) 555-2485", "988-555-2485", "988.555.2485", "123-45-6789", "666-45-6789", "900-11-1111",
    "70.123.182.155", "1.2.3.4", "256.1.1.1", "01.2.3.4", "2024-02-29", "2023-02-29", "29.02.2024", "02/29/2024",
    "1799-12-31", "1800-01-01", "2199-12-31", "12345", "1.2.3.4.5", "v1.2.3.4", "id-123-45-6789", "2024-02-291",
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def feistel(a, b, p, q, kind):
    def f(x, i):
        text = "|".join(map(str, (KEY, kind, p, q, i, x)))
        return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)

    for i in range(ROUNDS):
        if i % 2 == 0:
            a = (a + f(b, i) % p) % p
        else:
            b = (b + f(a, i) % q) % q
    return a, b


def digits_of(d, kind):
    h = len(d) // 2
    a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), kind)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def refill(old, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in old)


def brute(m):
    d = re.sub(r"\D", "", m)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
            return m
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for pattern, form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y"), (r"\d\d/\d\d/\d{4}", "%m/%d/%Y")):
        if re.fullmatch(pattern, m):
            try:
                day = (datetime.datetime.strptime(m, form).date() - datetime.date(1800, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= day < 146097:
                return m
            a, b = feistel(day // 773, day % 773, 189, 773, "date")
            return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).strftime(form)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = (int(x) for x in m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return m
        a, b = feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if re.fullmatch(r"(\+1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", m):
        return refill(m, d[:-10] + digits_of(d[-10:], "phone"))
    if not luhn(d):
        return m
    body = digits_of(d[:-1], "card")
    return refill(m, next(body + c for c in "0123456789" if luhn(body + c)))


def rows_of(odd_rows):
    return odd_rows + [(100 + k, f"{v} in é, ({v}); and {w}") for k, (v, w) in enumerate(zip(VALUES, VALUES[::-1]))] + [
        (500, "(269) 555-3296 4524132264652876"), (501, "38.253.197.126 4880761348116108"), (502, VALUES[0]),
    ]


def test_against_brute_force(make_docs, odd_rows):
    rows = rows_of(odd_rows)
    got = by_id(pseudonymise(make_docs(rows), KEY))
    want = []
    for doc, text in rows:
        found = re.findall(FOUND, text, re.ASCII) if text else []
        want.append({
            "doc_id": doc, "n_found": len(found), "n_replaced": sum(brute(m) is not m for m in found),
            "text": None if text is None else re.sub(FOUND, lambda m: brute(m[0]), text, flags=re.ASCII),
        })
    assert got == sorted(want, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))
    assert sum(r["n_replaced"] for r in got) > 40


def test_round_trip(make_docs, odd_rows):
    rows = rows_of(odd_rows)
    made = pseudonymise(make_docs(rows), KEY).select("doc_id", "text")
    back = by_id(pseudonymise(made, KEY, undo=True))
    assert [(r["doc_id"], r["text"]) for r in back] == [
        (r["doc_id"], r["text"]) for r in by_id(make_docs(rows).select("doc_id", "text"))
    ] or {(r["doc_id"], r["text"]) for r in back} == set(rows)


def test_equal_values_stay_linked(make_docs):
    rows = [(1, "4041894974608795"), (2, "card 4041 8949 7460 8795."), (3, "2024-02-29"), (4, "29.02.2024")]
    t = [r["text"] for r in by_id(pseudonymise(make_docs(rows), KEY))]
    assert re.sub(r"\D", "", t[0]) == re.sub(r"\D", "", t[1]) != "4041894974608795"
    assert t[2].split("-") == t[3].split(".")[::-1]


def test_values_beside_others(make_docs):
    """Addresses in URLs, times after dates, days first."""
    rows = [
        (100, "http://192.168.1.5/x"), (101, "10.1.2.3/24"), (102, "2024-02-29T12:00:00Z"), (103, "25/12/1999"), (104, "31/02/1999"),
    ] + [(1000 + k, (datetime.date(1800, 1, 13) + datetime.timedelta(4870 * k)).strftime("%d/%m/%Y")) for k in range(30)]
    made = pseudonymise(make_docs(rows), KEY)
    got = {r["doc_id"]: r for r in by_id(made)}
    assert re.fullmatch(r"http://\d+\.\d+\.\d+\.\d+/x", got[100]["text"]) and "192.168.1.5" not in got[100]["text"]
    assert got[101]["text"].endswith("/24") and "10.1.2.3" not in got[101]["text"]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT12:00:00Z", got[102]["text"]) and got[102]["n_replaced"] == 1
    assert got[103]["n_replaced"] == 1 and got[103]["text"] != "25/12/1999" and got[104]["n_replaced"] == 0
    for doc, text in rows[5:]:
        assert got[doc]["n_replaced"] == 1
        if int(text[:2]) > 12:
            assert datetime.datetime.strptime(got[doc]["text"], "%d/%m/%Y").day > 12
    back = by_id(pseudonymise(made.select("doc_id", "text"), KEY, undo=True))
    assert {(r["doc_id"], r["text"]) for r in back} == set(rows)


def test_no_documents(make_docs):
    assert pseudonymise(make_docs([]), KEY).collect() == []
