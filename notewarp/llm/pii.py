"""PII: keyed format-preserving pseudonyms by Feistel permutations (native: DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The country codes of two digits; 1 and 7 have one, all others three (ITU-T E.164).
TWO_DIGITS = (
    20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66,
    81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98,
)
#: Permutations after which a date that has not come back to its form would stay as it is; that many are never needed.
WALK = 64
#: Days from 1800-01-01 on that a date can be: 400 years, 146,097 days, the product of these two.
EPOCH, DAYS = "1800-01-01", (189, 773)

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NANP_PLUS = r"(?<![\w+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
ABROAD = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{1,4}){2,6}(?!\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
YMD = r"(?<!\d)\d{4}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}(?!\d)"
DMY = r"(?<!\d)\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4}(?!\d)"
NANP = r"(?<!\d)(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19})(?!\d)"
CANDIDATES = "|".join((EMAIL, IBAN, NANP_PLUS, ABROAD, IP, SSN, YMD, DMY, NANP, CARD))


class Feistel:
    """Keyed permutations as column expressions; ``invert`` gives the inverse ones."""

    def __init__(self, key: str, invert: bool = False):
        self.key, self.invert = key, invert
        self.rounds = F.array(*[F.lit(i) for i in (range(ROUNDS, 0, -1) if invert else range(1, ROUNDS + 1))])

    def digest(self, kind: str, i: Column, x: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), i.cast("string"), x.cast("string")), 256)

    def pair(self, kind: str, a: Column, b: Column, size_a: Column | int, size_b: Column | int) -> Column:
        """(a, b) of Z_size_a x Z_size_b permuted: odd rounds add to a what b gives, even rounds to b what a gives."""
        size_a, size_b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (size_a, size_b))

        def moved(x: Column, other: Column, size: Column, i: Column) -> Column:
            add = F.conv(F.substr(self.digest(kind, i, other), F.lit(1), F.lit(15)), 16, 10).cast("long") % size
            return F.pmod(x - add if self.invert else x + add, size)

        def step(s: Column, i: Column) -> Column:
            odd = i % 2 == 1
            return F.struct(
                F.when(odd, moved(s["a"], s["b"], size_a, i)).otherwise(s["a"]).alias("a"),
                F.when(odd, s["b"]).otherwise(moved(s["b"], s["a"], size_b, i)).alias("b"),
            )

        return F.aggregate(self.rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)

    def number(self, kind: str, digits: Column) -> Column:
        """A string of up to 30 digits permuted among those of its length."""

        def permuted(x: Column) -> Column:
            low = F.floor(F.length(x) / 2).cast("int")
            high = F.length(x) - low
            left, right = F.substr(x, F.lit(1), high).cast("long"), F.substr(x, high + 1, low).try_cast("long")
            sizes = (F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long") for n in (high, low))
            out = self.pair(kind, left, F.coalesce(right, F.lit(0)), *sizes)
            return let(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), high, "0"), F.when(low > 0, F.lpad(o["b"].cast("string"), low, "0")).otherwise("")))

        return let(digits, permuted)

    def string(self, kind: str, x: Column) -> Column:
        """A string permuted among those of its pattern: digits stay digits, letters letters of their case, the rest as it is."""
        half = F.floor(F.length(x) / 2).cast("int")

        def moved(s: Column, other: Column, i: Column) -> Column:
            stream = self.digest(kind, i, other)

            def char(c: Column, at: Column) -> Column:
                add = F.conv(F.substr(stream, (at % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                add, code = (-add if self.invert else add), F.ascii(c)
                turned = [F.when(code.between(lo, hi), F.chr(F.pmod(code - lo + add, F.lit(hi - lo + 1)) + lo)) for lo, hi in ((48, 57), (65, 90), (97, 122))]
                return F.coalesce(*turned, c)

            return F.array_join(F.transform(F.split(s, ""), char), "")

        def step(s: Column, i: Column) -> Column:
            odd = i % 2 == 1
            return F.struct(
                F.when(odd, moved(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"),
                F.when(odd, s["b"]).otherwise(moved(s["b"], s["a"], i)).alias("b"),
            )

        start = F.struct(F.substr(x, F.lit(1), half).alias("a"), F.substr(x, half + 1, F.length(x) - half).alias("b"))
        return F.aggregate(self.rounds, start, step, lambda s: F.concat(s["a"], s["b"]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit as check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(x: Column) -> Column:
    """The remainder of a string of digits and capital letters (A is 10) by 97."""

    def add(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    return F.aggregate(F.split(x, ""), F.lit(0), add)


def refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced, one after the other, by those of ``digits``."""

    def put(s: Column, c: Column) -> Column:
        digit = F.ascii(c).between(48, 57)
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def date_parts(x: Column, p: Column) -> Column:
    """Year, month and day of a date that exists, day first where both can be, and which comes first; else null. p: its numbers."""

    def made(y: Column, m: Column, d: Column, first: str) -> Column:
        last = F.when(m == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        real = y.between(1800, 2199) & m.between(1, 12) & (d >= 1) & (d <= last)
        return F.when(real, F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(first).alias("first")))

    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    return F.when(x.rlike(r"^\d{4}"), made(a, b, c, "y")).otherwise(F.coalesce(made(c, b, a, "d"), made(c, a, b, "m")))


def candidate(x: Column) -> Column:
    """A match with what its tests need: x, its digits d, x without spaces, the numbers p that dots or such separate, its date."""
    p = F.transform(F.split(x, r"[\-/.]"), lambda s: s.try_cast("int"))
    is_date = x.rlike(r"^\d{1,4}([\-/.])\d{1,2}\1\d{1,4}$")
    made = F.struct(x.alias("x"), digits_of(x).alias("d"), F.replace(x, F.lit(" "), F.lit("")).alias("bare"), p.alias("p"))
    return let(made, lambda s: F.struct(s["x"], s["d"], s["bare"], s["p"], F.when(is_date, date_parts(s["x"], s["p"])).alias("date")))


def kind_of(s: Column) -> Column:
    """What a candidate is, if it is valid, else null."""
    x, d, bare = s["x"], s["d"], s["bare"]
    good_nanp = d.rlike(r"[2-9]\d\d[2-9]\d{6}$")
    area = F.substr(d, F.lit(1), F.lit(3)).try_cast("int")
    return (
        F.when(x.contains("@"), F.lit("email"))
        .when(x.rlike(r"^[A-Z]"), F.when(mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1, F.lit("iban")))
        .when(x.startswith("+"), F.when((F.length(d) == 11) & d.startswith("1") & good_nanp, F.lit("nanp")).when(F.length(d).between(7, 15), F.lit("abroad")))
        .when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(s["p"], lambda o: o <= 255), F.lit("ip")))
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(area.between(1, 899) & (area != 666) & ~x.rlike(r"-00-|-0000$"), F.lit("ssn")))
        .when(s["date"].isNotNull(), F.lit("date"))
        .when(F.length(d) == 10, F.when(good_nanp, F.lit("nanp")))
        .when(F.length(d) >= 13, F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), F.lit("card")))
    )


def pseudonym(f: Feistel, kind: Column, s: Column) -> Column:
    """The pseudonym of a valid value, of the same kind and pattern."""
    x, d, bare = s["x"], s["d"], s["bare"]

    def text(c: Column, width: int = 0) -> Column:
        return F.lpad(c.cast("string"), width, "0") if width else c.cast("string")

    def email() -> Column:
        return let(F.substring_index(x, "@", 1), lambda local: F.concat(f.string("email", local), F.substr(x, F.length(local) + 1)))

    def iban() -> Column:
        land = F.substr(bare, F.lit(1), F.lit(2))

        def whole(rest: Column) -> Column:
            return F.concat(land, text(98 - mod97(F.concat(rest, land, F.lit("00"))), 2), rest)

        def put(chars: Column) -> Column:
            def step(t: Column, c: Column) -> Column:
                gap = c == " "
                out = F.concat(t["out"], F.when(gap, c).otherwise(F.substr(chars, t["at"], F.lit(1))))
                return F.struct(out.alias("out"), (t["at"] + (~gap).cast("int")).alias("at"))

            return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda t: t["out"])

        return let(let(f.string("iban", F.substr(bare, F.lit(5))), whole), put)

    def nanp() -> Column:
        ten = F.right(d, F.lit(10))
        area, rest = F.substr(ten, F.lit(1), F.lit(3)).cast("long") - 200, F.substr(ten, F.lit(4)).cast("long") - 2_000_000
        out = f.pair("phone", area, rest, 800, 8_000_000)
        return let(out, lambda o: refill(x, F.concat(F.left(d, F.length(d) - 10), text(o["a"] + 200), text(o["b"] + 2_000_000))))

    def abroad() -> Column:
        size = F.when(d.rlike("^[17]"), 1).when(F.substr(d, F.lit(1), F.lit(2)).isin(*map(str, TWO_DIGITS)), 2).otherwise(3)
        return let(size, lambda n: refill(x, F.concat(F.substr(d, F.lit(1), n), f.number("abroad", F.substr(d, n + 1)))))

    def ip() -> Column:
        a, b, c, e = (F.get(s["p"], F.lit(i)).cast("long") for i in range(4))
        parts = lambda o: [F.floor(o["a"] / 256), o["a"] % 256, F.floor(o["b"] / 256), o["b"] % 256]
        return let(f.pair("ip", a * 256 + b, c * 256 + e, 65536, 65536), lambda o: F.concat_ws(".", *[text(p.cast("long")) for p in parts(o)]))

    def ssn() -> Column:
        area, group, serial = (F.substr(d, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
        out = f.pair("ssn", area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 989_901)
        back = lambda o: F.concat(
            text(o["a"] + 1 + (o["a"] >= 665).cast("long"), 3), text(F.floor(o["b"] / 9999) + 1, 2), text(o["b"] % 9999 + 1, 4)
        )
        return let(out, lambda o: refill(x, back(o)))

    def date() -> Column:
        p = s["date"]
        day = F.datediff(F.make_date(p["y"], p["m"], p["d"]), F.lit(EPOCH).cast("date")).cast("long")
        # two digits where the value itself pads its days and months
        wide = ~x.rlike(r"(^|\D)\d(\D|$)")
        pad = lambda c: F.when(wide & (F.length(c) == 1), F.concat(F.lit("0"), c)).otherwise(c)

        def written(new: Column) -> Column:
            y, m, dd = text(F.year(new)), pad(text(F.month(new))), pad(text(F.dayofmonth(new)))
            first = p["first"]
            order = F.when(first == "y", F.array(y, m, dd)).when(first == "d", F.array(dd, m, y)).otherwise(F.array(m, dd, y))
            sep = F.regexp_extract(x, r"[\-/.]", 0)
            return let(order, lambda o: F.concat(F.get(o, F.lit(0)), sep, F.get(o, F.lit(1)), sep, F.get(o, F.lit(2))))

        def ok(t: Column) -> Column:
            """Whether a date reads the same way: month first only where the day says so, without padding only where that shows."""
            return ((p["first"] != "m") | (F.dayofmonth(t) > 12)) & (wide | (F.month(t) < 10) | (F.dayofmonth(t) < 10))

        def step(at: Column, _: Column) -> Column:
            moved = lambda o: let(o["a"] * DAYS[1] + o["b"], lambda n: F.struct(n.alias("n"), ok(F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))).alias("done")))
            return F.when(at["done"], at).otherwise(let(f.pair("date", F.floor(at["n"] / DAYS[1]), at["n"] % DAYS[1], *DAYS), moved))

        # permuted until it has the form of the value (cycle walking), so that it is read back as what it is
        out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(day.alias("n"), F.lit(False).alias("done")), step, lambda at: F.when(at["done"], at["n"]))
        return let(F.coalesce(out, day), lambda n: written(F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))))

    def card() -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), f.number("card", F.substr(d, F.lit(2), F.length(d) - 2)))
        return let(body, lambda b: refill(x, F.concat(b, text((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10))))

    makers = {"email": email, "iban": iban, "nanp": nanp, "abroad": abroad, "ip": ip, "ssn": ssn, "date": date, "card": card}
    out = x
    for name, make in makers.items():
        out = F.when(kind == name, make()).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """``docs`` (text; more columns pass through) with values in ``text`` replaced, and ``n_values``, how many.

    Where ``docs`` has a column n_values of its own that one stays, and the new one is called n_values_.

    Values are e-mail addresses, phone numbers, IPv4 addresses, payment cards (Luhn), US social security numbers, IBANs
    (modulus 97) and dates of 1800 to 2199. What is not valid stays. A value becomes another valid value of its kind
    and pattern by a keyed permutation, a Feistel network over the numbers of the kind, so equal values have equal
    pseudonyms in all documents, different ones of a pattern different ones, and ``invert`` with the same key gives the
    values back. Of an address the domain stays, of a card the first digit, of a phone number the country's code, however
    the number is grouped (7 to 15 digits behind a plus sign in up to seven groups; groups that follow after one space are part of it), of an
    IBAN the country; check digits are made anew. IPv4 numbers lose leading zeros. A date in which day and month can be confused
    counts as day first; one that can be month first only stays so, and one without padding stays without.

    Row by row, without a shuffle. Null text: null, 0 values. Texts without a digit or @ pass as they are. Repeated rows become
    equal rows. Empty input: empty result.
    """
    f = Feistel(key, invert)
    some = F.col("text").rlike("[0-9@]")
    found = F.transform(F.regexp_extract_all(F.col("text"), F.lit(CANDIDATES), F.lit(0)), candidate)
    found = F.transform(found, lambda s: F.struct(s.alias("s"), kind_of(s).alias("kind")))
    gaps = F.split(F.col("text"), CANDIDATES, -1)
    names = [n + "_" * max(map(len, docs.columns)) for n in ("_found", "_gaps")]  # longer than any name there is
    out = docs.withColumns({names[0]: F.when(some, found), names[1]: F.when(some, gaps)})
    valid = F.filter(names[0], lambda x: x["kind"].isNotNull())
    new = F.transform(names[0], lambda x: F.when(x["kind"].isNull(), x["s"]["x"]).otherwise(pseudonym(f, x["kind"], x["s"])))
    joined = F.array_join(F.zip_with(names[1], new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    text = F.when(F.size(valid) > 0, joined).otherwise(F.col("text"))
    count = "n_values"
    while count in docs.columns:
        count += "_"
    return out.withColumns({"text": F.coalesce(text, F.col("text")), count: F.coalesce(F.greatest(F.size(valid), F.lit(0)), F.lit(0)).cast("long")}).drop(*names)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key="notewarp demonstration key")
