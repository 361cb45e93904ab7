import datetime
import hashlib
import random
import re

import pytest

from notewarp.llm import pii

VALID = [
    "a.b+42@mail8.example.com", "+1 (743) 555-3824", "227.5.221.1", "4041894974608795", "4242 4242 4242 4242", "378282246310005", "123-45-6789", "2024-02-29",
    "31/12/1999", "1.5.2001", "743-555-3824", "+49 30 1234567", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
]
INVALID = ["999.1.1.1", "1.2.3.4.5", "666-45-6789", "000-12-3456", "2024-02-30", "GB82WEST12345698765433", "4041894974608796", "12345", "143-555-3824", "no digits"]


@pytest.fixture(scope="module")
def done(spark):
    rows = [(i, f"start {v} mid ({v}), {v}.", "p") for i, v in enumerate(VALID + INVALID)] + [(90, None, "p"), (91, "", "p"), (92, " ".join(VALID), "p"), (93, "x " * 50000 + VALID[2], "p"), (0, f"start {VALID[0]} mid ({VALID[0]}), {VALID[0]}.", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_found string")
    out = pii.pseudonymise(df, "key").cache()
    back = pii.pseudonymise(out.drop("n_values"), "key", invert=True)
    return rows, {r["doc_id"]: r for r in out.collect()}, {r["doc_id"]: r["text"] for r in back.collect()}, out.count()


def test_valid_values_change_and_come_back(done):
    rows, out, back, n = done
    assert n == len(rows)
    for i, v in enumerate(VALID):
        assert out[i]["n_values"] == 3 and v not in out[i]["text"], v
        new = re.match(r"start (.*) mid \((.*)\), (.*)\.$", out[i]["text"]).groups()
        assert len(set(new)) == 1  # equal values stay equal
        if v != "227.5.221.1":
            assert re.sub(r"[a-z]", "a", re.sub(r"\d", "9", new[0]))[:2] == re.sub(r"[a-z]", "a", re.sub(r"\d", "9", v))[:2]
    assert all(back[i] == x for i, x, _ in rows)


def test_values_are_linked_across_documents(done):
    _, out, _, _ = done
    singles = [re.match(r"start (.*) mid", out[i]["text"]).group(1) for i in range(len(VALID))]
    assert out[92]["text"] == " ".join(singles) and out[92]["n_values"] == len(VALID)
    assert out[93]["text"].endswith(singles[2])


def test_invalid_values_stay(done):
    rows, out, _, _ = done
    for i in range(len(VALID), len(VALID) + len(INVALID)):
        assert out[i]["text"] == rows[i][1] and out[i]["n_values"] == 0
    assert out[90]["text"] is None and out[91]["text"] == "" and out[90]["n_values"] == 0


def test_checks_hold_and_keys_matter(done, spark):
    _, out, _, _ = done
    card = re.match(r"start (\d+)", out[3]["text"]).group(1)
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card)))
    assert total % 10 == 0 and card[0] == "4"
    iban = re.match(r"start (.*) mid", out[12]["text"]).group(1).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    other = pii.pseudonymise(spark.createDataFrame([(1, VALID[3])], "doc_id long, text string"), "other").first()["text"]
    assert other not in (card, VALID[3])


def test_permutation(spark):
    f = pii.Feistel("k")
    df = spark.range(189 * 773).selectExpr("id div 773 a", "id % 773 b")
    assert df.select(f.pair("date", df.a, df.b, 189, 773).alias("p")).distinct().count() == 189 * 773


def test_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []


def brute_pair(key, kind, a, b, size_a, size_b):
    """The Feistel network of a pair of numbers in plain Python."""

    def digest(i, x):
        return int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)

    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = (a + digest(i, b) % size_a) % size_a
        else:
            b = (b + digest(i, a) % size_b) % size_b
    return a, b


def brute_number(key, kind, digits):
    low = len(digits) // 2
    high = len(digits) - low
    a, b = brute_pair(key, kind, int(digits[:high]), int(digits[high:] or 0), 10**high, 10**low)
    return f"{a:0{high}}" + (f"{b:0{low}}" if low else "")


def brute_date(key, value):
    parts = re.split(r"([-/.])", value)
    n, sep, wide = [int(x) for x in parts[::2]], parts[1], not re.search(r"(^|\D)\d(\D|$)", value)
    first, (y, m, d) = ("y", n) if len(parts[0]) == 4 else ("d", n[::-1]) if n[1] <= 12 else ("m", (n[2], n[0], n[1]))
    epoch = datetime.date(1800, 1, 1)
    at = (datetime.date(y, m, d) - epoch).days
    while True:
        a, b = brute_pair(key, "date", at // 773, at % 773, 189, 773)
        at = a * 773 + b
        t = epoch + datetime.timedelta(days=at)
        if (first != "m" or t.day > 12) and (wide or t.month < 10 or t.day < 10):
            break
    two = (lambda x: f"{x:02}") if wide else str
    y, m, d = str(t.year), two(t.month), two(t.day)
    return sep.join({"y": [y, m, d], "d": [d, m, y], "m": [m, d, y]}[first])


def refill(pattern, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), pattern)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def brute(key, kind, v):
    d = re.sub(r"\D", "", v)
    if kind == "date":
        return brute_date(key, v)
    if kind == "abroad":
        n = 1 if d[0] in "17" else 2 if int(d[:2]) in pii.TWO_DIGITS else 3
        return refill(v, d[:n] + brute_number(key, "abroad", d[n:]))
    if kind == "nanp":
        a, b = brute_pair(key, "phone", int(d[-10:-7]) - 200, int(d[-7:]) - 2_000_000, 800, 8_000_000)
        return refill(v, d[:-10] + f"{a + 200}{b + 2_000_000}")
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        a, b = brute_pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    body = d[0] + brute_number(key, "card", d[1:-1])
    return refill(v, body + str((10 - luhn(body + "0")) % 10))


def test_against_plain_python(spark):
    rng, days = random.Random(3), datetime.date(1800, 1, 1)
    some = []
    for i in range(120):
        t = days + datetime.timedelta(days=rng.randrange(146_097))
        form = ["{y}-{m:02}-{d:02}", "{d:02}/{m:02}/{y}", "{m:02}/{d:02}/{y}", "{d}.{m}.{y}", "{y}/{m}/{d}"][i % 5]
        some.append(("date", form.format(y=t.year, m=t.month, d=t.day)))
    some += [("abroad", x) for x in ("+33 1 23 45 67 89", "+33 6 12 34 56 78", "+49 151 23 45 67 89", "+353 1 234 5678", "+35312345678", "+7 495 123-45-67", "+44 (0)20 7946 0958")]
    some += [("nanp", x) for x in ("+1 (743) 555-3824", "743-555-3824")] + [("ip", "10.20.30.40"), ("card", "4242 4242 4242 4242"), ("card", "378282246310005")]
    df = spark.createDataFrame([(i, f"a {v} b", 7) for i, (_, v) in enumerate(some)], "doc_id long, text string, n_values long")
    out = pii.pseudonymise(df, "k").cache()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {i: f"a {brute('k', kind, v)} b" for i, (kind, v) in enumerate(some)}
    assert out.columns == ["doc_id", "text", "n_values", "n_values_"] and {(r["n_values"], r["n_values_"]) for r in out.collect()} == {(7, 1)}
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out.drop("n_values", "n_values_"), "k", invert=True).collect()}
    assert back == {i: f"a {v} b" for i, (_, v) in enumerate(some)}
    same = [re.sub(r"\D", "", got[i]) for i, (_, v) in enumerate(some) if v.startswith("+353")]
    assert same[0] == same[1] and same[0].startswith("353")
