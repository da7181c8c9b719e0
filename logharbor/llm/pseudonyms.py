r"""Format-preserving pseudonyms for numbers and dates in texts, in DataFrame functions only.

Candidates are found by one pattern and validated by their kind: payment cards by the Luhn sum, bank
accounts (IBAN) by their remainder, addresses of the Internet by range, telephone and social security
numbers by form, dates by the calendar; e-mail addresses by form. A valid value is permuted inside
its own format by a Feistel network whose round function is a keyed SHA-256, so the same value
becomes the same pseudonym in every document, different values stay different, and whoever holds the
key can go back. Signs that are no digits stay where they are; check digits are computed anew.

A permutation of digits could leave what is valid (a date, an address). So the place of a value in
the list of valid ones is permuted: days since a first day, card numbers without their check digit,
the numbers of an address among those of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROUNDS = 8

#: Lengths of IBANs by country (fixed values of the registry): where one ends when words in capitals follow.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
_IBANS = "|".join(
    rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}(?![A-Za-z0-9])" for size, names in _IBAN_LENGTHS.items()
)
#: Country codes of telephone numbers that have one or two digits; all others have three (fixed values).
_CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: One alternative for each kind, in the order in which they are tried at a place (fixed value).
KINDS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("iban", rf"(?<![A-Za-z0-9])(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?![A-Za-z0-9]))"),
    ("address", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"),
    ("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9+.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
)
FINDER = "(" + "|".join(pattern for _, pattern in KINDS) + ")"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _keyed(key: str, *parts: Column) -> Column:
    """A number below 2**60 that depends on the key and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *(part.cast("string") for part in parts)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds(left: Column, right: Column, step, back: bool) -> Column:
    """The struct (l, r) after all rounds; ``step(half, other, turn)`` renews the left half in even rounds, the
    right one in odd ones."""

    def turn_on(state: Column, turn: Column) -> Column:
        even = F.struct(step(state["l"], state["r"], turn, True).alias("l"), state["r"].alias("r"))
        odd = F.struct(state["l"].alias("l"), step(state["r"], state["l"], turn, False).alias("r"))
        return F.when(turn % 2 == 0, even).otherwise(odd)

    turns = list(range(_ROUNDS))
    order = F.array(*(F.lit(t) for t in (reversed(turns) if back else turns)))
    return F.aggregate(order, F.struct(left.alias("l"), right.alias("r")), turn_on)


def halves(size: int) -> tuple[int, int]:
    """The factors of ``size`` nearest to its root."""
    a = int(size**0.5)
    while size % a:
        a -= 1
    return a, size // a


def _permuted_halves(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, back: bool) -> Column:
    """The struct (l, r) of two halves below ``a`` and ``b``: each round adds a keyed function of one half to the
    other, modulo the number of values that half can take."""

    def step(half: Column, other: Column, turn: Column, first: bool) -> Column:
        wide = a if first else b
        add = F.pmod(_keyed(key, tweak, turn, other), wide)
        return F.pmod(half - add if back else half + add, wide)

    return _rounds(left, right, step, back)


def permuted(number: Column, size: int, key: str, tweak: str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. size - 1."""
    a, b = halves(size)
    left, right = F.floor(number / F.lit(b)).cast("long"), F.pmod(number, F.lit(b)).cast("long")
    state = _permuted_halves(left, right, F.lit(a).cast("long"), F.lit(b).cast("long"), key, F.lit(tweak), back)
    return F.transform(F.array(state), lambda s: s["l"] * F.lit(b) + s["r"])[0]


def permuted_digits(digits: Column, key: str, tweak: str, back: bool = False) -> Column:
    """Strings of 1 to 36 digits permuted among those of the same length."""
    size = F.length(digits)
    cut = F.floor(size / 2).cast("int")
    left = F.coalesce(F.substring(digits, F.lit(1), cut).try_cast("long"), F.lit(0))
    right = F.coalesce(F.substring(digits, cut + 1, size - cut).try_cast("long"), F.lit(0))

    a, b = F.pow(F.lit(10.0), cut).cast("long"), F.pow(F.lit(10.0), size - cut).cast("long")
    tweak = F.concat_ws("|", F.lit(tweak), size.cast("string"))

    def shown(state: Column) -> Column:
        head = F.when(cut > 0, F.lpad(state["l"].cast("string"), cut, F.lit("0"))).otherwise("")
        return F.concat(head, F.lpad(state["r"].cast("string"), size - cut, F.lit("0")))

    return F.transform(F.array(_permuted_halves(left, right, a, b, key, tweak, back)), shown)[0]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string whose last digit is the check digit, modulo 10."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10


def _remainder(text: Column) -> Column:
    """An IBAN, letters as numbers, modulo 97 (1 when it is valid)."""
    turned = F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))
    numbers = F.transform(
        F.split(turned, ""),
        lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(-1))),
    )
    return F.aggregate(
        numbers, F.lit(0), lambda total, n: F.when(n < 0, total).when(n > 9, (total * 100 + n) % 97).otherwise((total * 10 + n) % 97)
    )


def _refilled(shape: Column, digits: Column, places: str = "^[0-9]$") -> Column:
    """``shape`` with its digits (or the signs of ``places``) replaced, in order, by those of ``digits``."""
    filled = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("next")),
        lambda done, c: F.when(
            c.rlike(places),
            F.struct(F.concat(done["text"], F.substring(digits, done["next"], F.lit(1))).alias("text"), (done["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(done["text"], c).alias("text"), done["next"].alias("next"))),
    )
    return filled["text"]


def kind_of(found: Column) -> Column:
    """The kind of a candidate, null if it is not valid for any."""
    digits = _digits(found)
    octets = F.transform(F.split(found, r"\."), lambda part: part.try_cast("int"))
    day = F.try_to_timestamp(found, F.lit("yyyy-MM-dd"))
    valid = {
        "email": F.lit(True),
        "iban": _remainder(found) == 1,
        "address": F.forall(octets, lambda part: part.between(0, 255)) & ~found.rlike(r"(^|\.)0[0-9]"),
        "date": day.isNotNull() & day.between(F.lit("1900-01-01").cast("timestamp"), F.lit("2099-12-31").cast("timestamp")),
        "social": ~F.substring(found, 1, 3).isin("000", "666") & (F.substring(found, 1, 1) != "9") & (F.substring(found, 5, 2) != "00") & (F.substring(found, 8, 4) != "0000"),
        "card": F.length(digits).between(13, 19) & (luhn_sum(digits) == 0) & ~digits.rlike("^0+$"),
        "phone": F.length(digits).between(8, 15),
    }
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        # A candidate stands alone here, so what may not surround it needs no second look.
        kind = F.when(found.rlike(rf"^(?:{pattern})$") & valid[name], name).otherwise(kind)
    return kind


_FIRST_DAY, _DAYS = "1900-01-01", 73_049  # to 2099-12-31


def pseudonym(found: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a valid value (or, ``back``, the value of a pseudonym), same form and length."""
    digits = _digits(found)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    # The first digit names the network of a card; it stays, the check digit follows from the others.
    inner = permuted_digits(F.substring(body, 2, 40), key, "card", back)
    card = F.concat(F.substring(body, 1, 1), inner)
    check = (10 - luhn_sum(F.concat(card, F.lit("0")))) % 10
    card = _refilled(found, F.concat(card, check.cast("string")))

    # Letters and digits of an account stay such; blanks between groups do not count.
    plain = F.replace(found, F.lit(" "), F.lit(""))
    country, inside = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
    inside = F.when(inside.rlike("^[0-9]+$"), permuted_digits(inside, key, "iban", back)).otherwise(
        _letters(inside, F.concat(F.lit("iban|"), country), key, back)
    )
    account = F.concat(country, F.lit("00"), inside)
    account = F.concat(country, F.lpad((98 - _remainder(account)).cast("string"), 2, "0"), inside)
    account = _refilled(found, account, "^[A-Z0-9]$")

    days = F.datediff(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).cast("date"), F.lit(_FIRST_DAY).cast("date")).cast("long")
    day = F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), permuted(days, _DAYS, key, "date", back).cast("int")), "yyyy-MM-dd")

    parts = F.split(found, r"\.")
    # Numbers of one, two and three digits stay such: 0-9, 10-99, 100-255.
    lowest = lambda part: F.when(F.length(part) == 1, 0).when(F.length(part) == 2, 10).otherwise(100).cast("long")
    room = lambda part: F.when(F.length(part) == 1, 10).when(F.length(part) == 2, 90).otherwise(156).cast("long")
    part = [F.coalesce(F.get(parts, F.lit(i)), F.lit("0")) for i in range(4)]
    place = [F.coalesce(p.try_cast("long"), F.lit(0)) - lowest(p) for p in part]
    state = _permuted_halves(
        place[0] * room(part[1]) + place[1],
        place[2] * room(part[3]) + place[3],
        room(part[0]) * room(part[1]),
        room(part[2]) * room(part[3]),
        key,
        F.concat_ws("|", F.lit("address"), F.regexp_replace(found, "[0-9]", "9")),
        back,
    )
    split_again = lambda half, i: [
        (F.floor(half / room(part[i + 1])) + lowest(part[i])).cast("string"),
        (F.pmod(half, room(part[i + 1])) + lowest(part[i + 1])).cast("string"),
    ]
    address = F.transform(F.array(state), lambda s: F.concat_ws(".", *split_again(s["l"], 0), *split_again(s["r"], 2)))[0]

    # Valid numbers by their place in the list: 898 areas, 99 groups, 9999 series.
    three, two, four = (F.substring(found, a, n).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    area = three - F.when(three > 666, 2).otherwise(1)
    serial = permuted((area * 99 + two - 1) * 9999 + four - 1, 898 * 99 * 9999, key, "social", back)
    new_area = F.floor(serial / (99 * 9999)) + 1
    social = F.format_string(
        "%03d-%02d-%04d",
        F.when(new_area >= 666, new_area + 1).otherwise(new_area).cast("int"),
        (F.pmod(F.floor(serial / 9999), F.lit(99)) + 1).cast("int"),
        (F.pmod(serial, F.lit(9999)) + 1).cast("int"),
    )

    # A telephone number keeps its country code; the rest is permuted without regard to how it is written.
    code = F.when(found.startswith("+"), F.regexp_extract(digits, f"^({_CALLING})", 1)).otherwise("")
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    phone = _refilled(found, F.concat(code, permuted_digits(rest, key, "phone", back)))

    # The name of a mailbox: letters and digits by the place in their alphabet, with the domain kept.
    name, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    email = F.concat(_letters(name, domain, key, back), F.lit("@"), domain)

    made = {"card": card, "iban": account, "date": day, "address": address, "social": social, "phone": phone, "email": email}
    result = found
    for name_, value in made.items():
        result = F.when(kind == name_, value).otherwise(result)
    return result


def _letters(name: Column, domain: Column, key: str, back: bool) -> Column:
    """A mailbox name permuted sign by sign: letters and digits move inside their alphabets by steps that depend
    on the other half of the name."""
    cut = F.floor(F.length(name) / 2).cast("int")

    def step(half: Column, other: Column, turn: Column, first: bool) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), domain, turn.cast("string"), F.length(name).cast("string"), other), 512)

        def move(sign: Column, i: Column) -> Column:
            by = F.conv(F.substring(digest, F.pmod(i, F.lit(60)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
            turned = sign
            for low, high in ((48, 57), (65, 90), (97, 122)):
                new = F.pmod(F.ascii(sign) - low + (-by if back else by), F.lit(high - low + 1)) + low
                turned = F.when((sign != "") & F.ascii(sign).between(low, high), F.chr(new.cast("long"))).otherwise(turned)
            return turned

        return F.array_join(F.transform(F.split(half, ""), move), "")

    start, rest = F.substring(name, F.lit(1), cut), F.substring(name, cut + 1, F.length(name))
    return F.transform(F.array(_rounds(start, rest, step, back)), lambda s: F.concat(s["l"], s["r"]))[0]


def with_pseudonyms(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms, and ``found``: array of (kind, start, length, pseudonym).

    ``start`` counts code points from 0; a pseudonym is as long as its value, so it holds for both
    texts. Null texts count as empty. Candidates that fail validation stay as they are. Repeated rows and
    rows without an id give a row each; other columns are not read. With ``back`` and the same key
    the values come back. No shuffle, and nothing but the row at hand is looked at.
    """
    text = F.coalesce("text", F.lit(""))
    some = text.rlike("[0-9@]")
    rows = docs.select(
        "doc_id",
        text.alias("text"),
        F.when(some, F.split(text, F.lit(FINDER), F.lit(-1))).otherwise(F.array(text)).alias("between"),
        F.when(some, F.regexp_extract_all(text, F.lit(FINDER), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("values"),
    )
    told = F.transform("values", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    made = F.transform(
        "told",
        lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["value"]).otherwise(pseudonym(x["value"], x["kind"], key, back)).alias("shown")),
    )
    rows = rows.withColumn("told", told).withColumn("made", made)
    # Places: the lengths of all pieces and values before.
    placed = F.aggregate(
        F.zip_with(F.slice("between", F.lit(1), F.size("made")), "made", lambda piece, m: F.struct(F.length(piece).alias("gap"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,length:int,pseudonym:string>>").alias("list")),
        lambda done, x: F.struct(
            (done["at"] + x["gap"] + F.length(x["m"]["shown"])).alias("at"),
            F.concat(
                done["list"],
                F.array(
                    F.struct(
                        x["m"]["kind"].alias("kind"),
                        (done["at"] + x["gap"]).alias("start"),
                        F.length(x["m"]["shown"]).alias("length"),
                        x["m"]["shown"].alias("pseudonym"),
                    )
                ),
            ).alias("list"),
        ),
    )
    joined = F.array_join(
        F.zip_with("between", F.concat(F.transform("made", lambda m: m["shown"]), F.array(F.lit(""))), lambda piece, shown: F.concat(piece, shown)), ""
    )
    return rows.select(
        "doc_id",
        F.when(F.size("made") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.filter(placed["list"], lambda x: x["kind"].isNotNull()).alias("found"),
    )
