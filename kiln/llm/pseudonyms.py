"""Format-preserving pseudonyms by keyed Feistel permutations (DataFrame functions only).

Validated numbers and dates are found in whole texts and permuted within their
format: digits stay digits, separators stay, check digits stay valid, dates stay
dates.  The permutation depends on the key and the kind only, so equal values
get equal pseudonyms in all documents, and different values never meet.

Kinds: card (13 to 19 digits, Luhn), account (other numbers of 12 to 19
digits), iban (mod 97), ssn, phone, ipv4, date (ISO, or day and month first,
years 1900 to 2099) and email (its local part).

Cases: a null text stays null; empty texts and texts without a match stay as
they are; equal rows give equal rows; a match that fails its validation stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import let

ROUNDS = 10
DEMO_KEY = "kiln-demo-key"      # the registered query's key; a caller brings a secret one
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# fixed formats, in the order in which they are tried at one place
FORMATS = {
    "email": "[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63})+",
    "iban": "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "date": "(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4})",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": "(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "ipv4": f"(?:{_OCTET}\\.){{3}}{_OCTET}",
    "number": "[0-9](?:[ -]?[0-9]){11,18}",
}
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(FORMATS.values()) + ")(?![A-Za-z0-9])"
KINDS = ("account", "card", "date", "email", "iban", "ipv4", "phone", "ssn")
FIRST_DAY, DAYS = "1900-01-01", 73049                # up to 2099-12-31; 73049 = 17 * 4297


def _noise(key: str, tweak: Column, i: Column, value: Column) -> Column:
    """The round function: the first 60 bits of a keyed SHA-256."""
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, ma, mb, tweak: Column, key: str, inverse: bool = False) -> Column:
    """Permute the pair (a mod ma, b mod mb): each round shifts one half by a keyed function of the other."""
    def step(s, k):
        i = F.lit(ROUNDS - 1) - k if inverse else k
        sign = -1 if inverse else 1
        return F.when(i % 2 == 0, F.struct(
            F.pmod(s["a"] + sign * (_noise(key, tweak, i, s["b"]) % ma), ma).cast("long").alias("a"),
            s["b"].alias("b"))).otherwise(F.struct(
                s["a"].alias("a"),
                F.pmod(s["b"] + sign * (_noise(key, tweak, i, s["a"]) % mb), mb).cast("long").alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
                       F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits(d: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """Permute a string of 2 to 20 digits among the strings of its length."""
    def body(x):
        n, u = F.length(x), F.floor(F.length(x) / 2).cast("int")
        v = n - u
        pair = feistel(F.substring(x, F.lit(1), u).cast("long"), F.substring(x, u + 1, v).cast("long"),
                       _power(u), _power(v), F.concat(F.lit(kind), n.cast("string")), key, inverse)
        return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), v, "0")))

    return let(d, body)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, new: Column) -> Column:
    """Put the digits ``new`` in the places of the digits of ``m``."""
    def body(x):
        return F.aggregate(F.split(x["m"], ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("s")), lambda a, c: F.when(
            c.rlike("[0-9]"), F.struct((a["k"] + 1).alias("k"), F.concat(a["s"], F.substring(x["new"], a["k"], F.lit(1))).alias("s"))
        ).otherwise(F.struct(a["k"].alias("k"), F.concat(a["s"], c).alias("s"))), lambda a: a["s"])

    return let(F.struct(m.alias("m"), new.alias("new")), body)


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    return F.aggregate(F.transform(F.reverse(F.split(d, "")), lambda c, i: let(
        c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))), F.lit(0), lambda a, x: a + x)


def _walked(d: Column, kind: str, key: str, inverse: bool, valid) -> Column:
    """Permute again until the digits are valid for their kind, so that the kind's values stay among themselves.

    A tenth or less of all strings is invalid, so 24 steps end in an invalid one with probability below 1e-24.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(d.alias("d"), F.lit(False).alias("done")),
                       lambda s, _: F.when(s["done"], s).otherwise(let(
                           digits(s["d"], kind, key, inverse), lambda x: F.struct(x.alias("d"), valid(x).alias("done")))),
                       lambda s: s["d"])


def _ssn_ok(d: Column) -> Column:
    """Valid digits of a social security number: no zero part, no area 666 or 9xx."""
    return ~d.rlike("^(000|666|9|...00|.....0000)")


def _no_card(d: Column) -> Column:
    return (F.length(d) < 13) | (luhn_sum(d) % 10 != 0)


def _card(m: Column, key: str, inverse: bool) -> Column:
    def body(d):
        payload = digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, inverse)
        return let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))

    return _refill(m, let(_only_digits(m), body))


def mod97(iban: Column) -> Column:
    """Remainder of the IBAN (first four characters at the end, letters as 10 to 35) by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """Permute the digits after the check digits in two halves' worth of places; renew the check digits."""
    def body(x):
        rest = F.substring(x, F.lit(5), F.length(x))
        own = _only_digits(rest)
        # up to 18 digits at a time keep the halves within a long
        new = let(own, lambda d: F.concat(
            F.when(F.length(d) > 20, digits(F.substring(d, F.lit(1), F.length(d) - 16), "iban-a", key, inverse)).otherwise(""),
            F.when(F.length(d) > 20, digits(F.substring(d, F.length(d) - 15, F.lit(16)), "iban-b", key, inverse))
            .when(F.length(d) > 1, digits(d, "iban", key, inverse)).otherwise(d)))
        return let(F.concat(F.substring(x, 1, 2), F.lit("00"), _refill(rest, new)), lambda y: F.concat(
            F.substring(y, 1, 2), F.lpad((98 - mod97(y)).cast("string"), 2, "0"), F.substring(y, F.lit(5), F.length(y))))

    return let(m, body)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """The ten digits after the country code."""
    def body(x):
        code = F.regexp_extract(x, "^\\+[0-9]{1,3}(?=[ .(-])", 0)
        return let(code, lambda c: F.concat(c, let(F.substring(x, F.length(c) + 1, F.length(x)), lambda r: _refill(
            r, digits(_only_digits(r), "phone", key, inverse)))))

    return let(m, body)


def _ipv4(m: Column, key: str, inverse: bool) -> Column:
    o = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    pair = let(o, lambda x: feistel(F.get(x, 0) * 256 + F.get(x, 1), F.get(x, 2) * 256 + F.get(x, 3),
                                    F.lit(65536), F.lit(65536), F.lit("ipv4"), key, inverse))
    return let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))


def _date_of(m: Column) -> Column:
    """The date of a match: ISO, dd.mm.yyyy, mm/dd/yyyy, or dd/mm/yyyy where that is no date; null if none."""
    def at(y, mo, d):
        return F.try_to_date(F.concat_ws("-", *[F.substring(m, p, n) for p, n in ((y, 4), (mo, 2), (d, 2))]))

    parsed = F.when(F.substring(m, 5, 1) == "-", at(1, 6, 9)).when(F.substring(m, 3, 1) == ".", at(7, 4, 1)).otherwise(
        F.coalesce(at(7, 1, 4), at(7, 4, 1)))
    return F.when(parsed.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), parsed)


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Permute the day number; slash dates come back month first, whatever they were."""
    day = F.datediff(_date_of(m), F.lit(FIRST_DAY))
    pair = let(day, lambda d: feistel(F.floor(d / 4297), d % 4297, F.lit(17), F.lit(4297), F.lit("date"), key, inverse))
    new = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * 4297 + p["b"]).cast("int")))
    return let(F.struct(m.alias("m"), new.alias("d")), lambda x: F.when(
        F.substring(x["m"], 5, 1) == "-", F.date_format(x["d"], "yyyy-MM-dd")).when(
        F.substring(x["m"], 3, 1) == ".", F.date_format(x["d"], "dd.MM.yyyy")).otherwise(
        F.date_format(x["d"], "MM/dd/yyyy")))


def _shifted(half: Column, other: Column, i: Column, key: str, sign: int) -> Column:
    """Shift letters and digits of ``half`` within their class by a key stream that depends on ``other``."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other, F.lit(key)), 256)

    def one(c, j, s):
        amount = sign * F.conv(F.substring(s, 2 * (j % 32) + 1, F.lit(2)), 16, 10).cast("int")

        def turn(first, n):
            return F.char(F.pmod(F.ascii(c) - first + amount, F.lit(n)) + first)
        return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(
            c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

    return let(stream, lambda s: F.array_join(F.transform(F.split(half, ""), lambda c, j: one(c, j, s)), ""))


def _email(m: Column, key: str, inverse: bool) -> Column:
    local, rest = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def step(s, k):
        i = F.lit(ROUNDS - 1) - k if inverse else k
        sign = -1 if inverse else 1
        return F.when(i % 2 == 0, F.struct(_shifted(s["a"], s["b"], i, key, sign).alias("a"), s["b"].alias("b"))
                      ).otherwise(F.struct(s["a"].alias("a"), _shifted(s["b"], s["a"], i, key, sign).alias("b")))

    def body(x):
        u = F.ceil(F.length(x) / 2).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(
            F.substring(x, F.lit(1), u).alias("a"), F.substring(x, u + 1, F.length(x)).alias("b")), step,
            lambda s: F.concat(s["a"], s["b"]))

    return F.concat(let(local, body), F.lit("@"), rest)


def kind_of(m: Column) -> Column:
    """The validated kind of a match, or null."""
    def full(name):
        return m.rlike(f"^(?:{FORMATS[name]})$")

    number = _only_digits(m)
    return (F.when(full("email"), F.lit("email"))
            .when(full("iban"), F.when(mod97(m) == 1, "iban"))
            .when(full("date"), F.when(_date_of(m).isNotNull(), "date"))
            .when(full("ssn"), F.when(_ssn_ok(number), "ssn"))
            .when(full("phone"), F.lit("phone"))
            .when(full("ipv4"), F.lit("ipv4"))
            .when(full("number") & ~_no_card(number), F.lit("card"))
            .when(full("number"), F.lit("account")))


def pseudonym(m: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    out = F.when(kind == "email", _email(m, key, inverse))
    for name, make in (("card", _card), ("iban", _iban), ("date", _date), ("phone", _phone), ("ipv4", _ipv4)):
        out = out.when(kind == name, make(m, key, inverse))
    for name, valid in (("ssn", _ssn_ok), ("account", _no_card)):
        out = out.when(kind == name, _refill(m, _walked(_only_digits(m), name, key, inverse, valid)))
    return out.otherwise(m)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
                 inverse: bool = False) -> DataFrame:
    """doc_id, n_found, kinds (kind:count, comma-joined) and the text with pseudonyms.

    With ``inverse`` the original values come back (slash dates month first).
    """
    text = F.col(text_col).cast("string")

    def rewritten(x):
        swapped = let(F.transform(x["m"], lambda m: let(kind_of(m), lambda k: F.struct(
            k.alias("kind"), pseudonym(m, k, key, inverse).alias("new")))), lambda s: F.struct(
            F.filter(F.transform(s, lambda y: y["kind"]), lambda k: k.isNotNull()).alias("kinds"),
            # piece, match, piece, match, ..., piece
            F.array_join(F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.get(s, i)["new"], F.lit("")))), "").alias("text")))
        return swapped

    nothing = F.struct(F.array().cast("array<string>").alias("kinds"), text.alias("text"))
    parts = F.struct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("m"), F.split(text, PATTERN, -1).alias("p"))
    # every format has a digit or an @
    found = F.when(text.rlike("[0-9@]") & text.rlike(PATTERN), let(parts, rewritten)).otherwise(nothing)
    d = docs.select(F.col(id_col).alias("doc_id"), found.alias("f"))
    counts = F.filter(F.transform(F.array(*map(F.lit, KINDS)), lambda k: F.concat(
        k, F.lit(":"), (F.size("f.kinds") - F.size(F.array_remove("f.kinds", k))).cast("string"))),
        lambda s: ~s.endswith(":0"))
    return d.select("doc_id", F.size("f.kinds").cast("long").alias("n_found"), F.array_join(counts, ",").alias("kinds"),
                    F.col("f.text").alias("text"))
