"""Format-preserving Feistel pseudonyms for personal values (DataFrame functions only).

A value is found by pattern, validated, mapped to a point (x, y) of a product of two ranges that has exactly one point
for each valid value of its format, permuted there by a keyed Feistel network over those two ranges, and written back
in its own format.  So a pseudonym is valid where the value was, different values stay different, and equal values stay
linked across documents.  The formats:

========  =======================================  =====================================================
kind      validation                               ranges
========  =======================================  =====================================================
card      13 to 19 digits, Luhn                    10**u x 10**v over all but the check digit, then the new one
ssn       area, group and serial in use            (898 * 99) x 9999
date      a day of 1800 to 2199, in any order      189 x 773: the 146,097 days of a Gregorian cycle
phone     + country code, 7 to 12 digits           10**u x 10**v over the digits after the country code
ip        four numbers up to 255                   65536 x 65536
email     local part and domain                    2**32 x 2**32 over a digest; the domain stays
========  =======================================  =====================================================

A card may stand beside other numbers: valid ones in the usual groups are taken first, then the longest valid run from the
first number on.  Dates with the year last put the month first after a slash where that is a month; days over 12 there are
permuted among themselves (9 x 9833), so that different dates stay different.  Phones are known by + or as 3-3-4 digits; a
country code is read from the digits alone, however they are grouped, and stays.

Text without a digit or @ is passed through untouched; others are split at the values and joined with the pseudonyms in
their places, in one linear pass.

Defined cases: null text stays null with counts of 0; empty text stays empty; values that fail validation stay as
they are; repeated rows get equal results; the order of rows does not matter; extra columns pass through, whatever their
names, but that ``n_values`` and ``kinds`` give way to the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "ssn", "date", "phone", "ip", "email")

_EDGE, _END = r"(?<![\w.+\-@/])", r"(?![\w@])"
_IP = r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\w\-@])"
_TIME = r"(?:(?![\w\-/@])|(?=[Tt]\d{2}:?\d{2}))"
_DATE = r"\d{4}(?:-\d{2}-\d{2}|/\d{2}/\d{2})" + _TIME
_DAY = r"\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/|-\d{1,2}-)\d{4}(?![\w\-/@]|\.\d)"
_NATIONAL = r"(?:\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4})(?![\w\-@]|\.\d)"
_OTHER = "|".join((_IP, _SSN, _DATE, _DAY, _NATIONAL))
#: Groups of digits that may hold cards; a value of another format ends them.
_RUN = r"(?=\d(?:[ \-]?\d){12})\d+(?:(?:-| (?!" + _OTHER + r"))\d+)*" + _END
PATTERN = "|".join((
    r"(?<![\p{L}\p{N}_.%+\-])[\p{L}\p{N}_.%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    _EDGE + _IP,
    r"(?<![\w+])\+\d{1,3}[ \-]?\(?\d{2,4}\)?(?:[ \-]?\d{2,4}){1,3}" + _END,
    _EDGE + _SSN,
    _EDGE + _DATE,
    _EDGE + _DAY,
    _EDGE + _NATIONAL,
    _EDGE + _RUN,
))
# Country codes of one and of two digits; all others have three.
_CODES_1 = ("1", "7")
_CODES_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
_IS_DAY, _IS_NATIONAL = r"^\d{1,2}([./\-])\d{1,2}\1\d{4}$", r"^(\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}([.\-])\d{3}\2\d{4})$"
#: The usual groups of a card: unbroken, 4-4-4-4 (and up to 3 more), 4-6-5, 4-6-4.
_GROUPED = r"^(\d{13,19}|\d{4}([ \-])\d{4}\2\d{4}\2\d{4}(\2\d{1,3})?|\d{4}([ \-])\d{6}\4\d{4,5})$"


def feistel(x: Column, y: Column, a: Column, b: Column, kind: str, key: str) -> tuple[Column, Column]:
    """A keyed permutation of range(a) x range(b)."""

    def mixed(turn: Column, value: Column, most: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), most.cast("string"), value.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % most

    def one(state: Column, turn: Column) -> Column:
        left = F.struct(((state["x"] + mixed(turn, state["y"], a)) % a).alias("x"), state["y"].alias("y"))
        right = F.struct(state["x"].alias("x"), ((state["y"] + mixed(turn, state["x"], b)) % b).alias("y"))
        return F.when(turn % 2 == 0, left).otherwise(right)

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), one)
    return out["x"], out["y"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _permuted(digits: Column, kind: str, key: str) -> Column:
    """Decimal digits (2 to 36) permuted among all strings of their length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    x, y = feistel(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, n - u).cast("long"), size(u), size(n - u), kind, key)
    return F.concat(_padded(x, u), _padded(y, n - u))


def _in_mask(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))

    def one(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(state["done"], F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("done"), (state["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), start, one)["done"]


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    double = lambda c: c * 2 - F.when(c > 4, 9).otherwise(0)
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(double(c.cast("int"))))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x) % 10


def _kind(value: Column) -> Column:
    """The kind of a matched value, null if it is not valid."""
    digits = _digits(value)
    part = lambda k: F.try_element_at(F.split(value, r"[.\-/]"), F.lit(k)).try_cast("int")
    octets = F.forall(F.split(value, r"\."), lambda o: o.try_cast("int") <= 255)
    area, group, serial = part(1), part(2), part(3)
    valid_ssn = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    day = F.try_to_timestamp(F.translate(value, "/", "-"), F.lit("yyyy-MM-dd"))
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(F.startswith(value, F.lit("+")), F.when(F.length(_national(value)).between(7, 12), F.lit("phone")))
        .when(F.regexp_like(value, F.lit(_IS_NATIONAL)), F.lit("phone"))
        .when(F.regexp_like(value, F.lit(_IS_DAY)), F.when(F.year(_day(value)).between(1800, 2199), F.lit("date")))
        .when(F.contains(value, F.lit(".")), F.when(octets, F.lit("ip")))
        .when(F.regexp_like(value, F.lit(r"^\d{3}-\d{2}-\d{4}$")), F.when(valid_ssn, F.lit("ssn")))
        .when(F.regexp_like(value, F.lit(r"^\d{4}[-/]\d{2}[-/]\d{2}$")), F.when(day.isNotNull() & F.year(day).between(1800, 2199), F.lit("date")))
        .when(F.length(digits).between(13, 19) & (luhn(digits) == 0), F.lit("card"))
    )


def _month_first(value: Column) -> Column:
    """Slashes put the month first wherever that is a month."""
    return F.contains(value, F.lit("/")) & (F.split(value, "/")[0].try_cast("int") <= 12)


def _day(value: Column) -> Column:
    """The date of a value with the year last, null if there is none."""
    part = lambda k: F.lpad(F.try_element_at(F.split(value, r"[./\-]"), F.lit(k)), 2, "0")
    month, day = F.when(_month_first(value), part(1)).otherwise(part(2)), F.when(_month_first(value), part(2)).otherwise(part(1))
    return F.try_to_timestamp(F.concat_ws("-", F.substring(value, -4, 4), month, day), F.lit("yyyy-MM-dd")).cast("date")


def _new_day(value: Column, key: str) -> Column:
    """Year-last dates: all days of a Gregorian cycle, or, after a slash-date whose day can't be a month, the 9 x 9833 such days."""
    first = F.lit("1800-01-01").cast("date")

    def any_day(rank: Column) -> Column:
        x, y = feistel(F.floor(rank / 773), rank % 773, F.lit(189), F.lit(773), "date", key)
        return F.date_add(first, (x * 773 + y).cast("int"))

    def late_day(late: Column) -> Column:
        x, y = feistel(F.floor(late / 9833), late % 9833, F.lit(9), F.lit(9833), "day", key)
        return _let((x * 9833 + y).cast("int"), at_place)

    def at_place(place: Column) -> Column:
        before = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k
        near = F.floor(place * F.lit(4800.0) / 88497).cast("int")
        months = F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, F.lit(4799))), lambda k: before(k) <= place)
        return _let(F.array_max(months), lambda month: F.date_add(F.add_months(first, month), place - before(month) + 12))

    def moved(old: Column) -> Column:
        rank = F.datediff(old, first).cast("long")
        late = rank - 12 * ((F.year(old) - 1800) * 12 + F.month(old))
        return F.when(F.contains(value, F.lit("/")) & ~_month_first(value), _let(late, late_day)).otherwise(_let(rank, any_day))

    def written(new: Column) -> Column:
        mark = F.regexp_extract(value, r"[./\-]", 0)
        short = F.regexp_like(value, F.lit(r"^\d[./\-]|[./\-]\d[./\-]"))
        text = lambda n: F.when(short, n.cast("string")).otherwise(_padded(n, 2))
        a, b = F.month(new), F.dayofmonth(new)
        head = F.when(_month_first(value), F.concat(text(a), mark, text(b))).otherwise(F.concat(text(b), mark, text(a)))
        return F.concat(head, mark, _padded(F.year(new), 4))

    return _let(_let(_day(value), moved), written)


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.transform(F.array(value), of)[0]


def _is_run(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^\d[\d \-]*$")) & (F.length(_digits(value)) >= 13)


def _parts(value: Column) -> Column:
    """A run of digit groups -> its pieces in order as (value, kind): cards, and what is between them.

    Valid cards in the usual groups come first, from the left; then the longest valid run of whole groups, however
    they are grouped, from the first group on, if it meets none of those.
    """

    def of(groups: Column) -> Column:
        bare = lambda i, k: F.regexp_replace(F.array_join(F.slice(groups, i + 1, k), ""), r"[ \-]$", "")
        size = lambda i: F.least(F.size(groups) - i, F.when(i == 0, 19).otherwise(5))
        windows = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.transform(F.sequence(F.lit(1), size(i)), lambda k: F.struct(i.alias("i"), k.alias("k"), bare(i, k).alias("v")))))
        ranked = F.transform(F.filter(windows, lambda w: F.length(_digits(w["v"])).between(13, 19)), lambda w: F.struct(F.when(F.regexp_like(w["v"], F.lit(_GROUPED)), 0).otherwise(1).alias("rank"), w["i"].alias("i"), w["k"].alias("k"), w["v"].alias("v")))
        valid = F.filter(ranked, lambda w: ((w["rank"] == 0) | (w["i"] == 0)) & (luhn(_digits(w["v"])) == 0))
        order = F.array_sort(F.transform(valid, lambda w: F.struct(w["rank"].alias("rank"), w["i"].alias("i"), F.when(w["rank"] == 0, w["k"]).otherwise(-w["k"]).alias("by"), w["k"].alias("k"), w["v"].alias("v"))))
        chosen = F.aggregate(order, F.array().cast("array<struct<rank:int,i:int,by:int,k:int,v:string>>"), lambda had, w: F.when(F.exists(had, lambda h: (h["i"] < w["i"] + w["k"]) & (w["i"] < h["i"] + h["k"])), had).otherwise(F.concat(had, F.array(w))))
        return _let(chosen, lambda cards: F.flatten(F.transform(groups, lambda g, i: pieces(cards, g, i))))

    def pieces(cards: Column, g: Column, i: Column) -> Column:
        piece = lambda v, kind: F.struct(v.alias("value"), F.lit(kind).cast("string").alias("kind"))
        card = F.transform(F.filter(cards, lambda c: c["i"] == i), lambda c: piece(c["v"], "card"))
        blank = piece(F.regexp_extract(g, r"[ \-]?$", 0), None)
        # A card stands at its first group, the blank after it at its last.
        last = F.exists(cards, lambda c: c["i"] + c["k"] - 1 == i)
        inside = F.exists(cards, lambda c: (c["i"] <= i) & (i < c["i"] + c["k"]))
        return F.when(inside, F.concat(card, F.when(last, F.array(blank)).otherwise(F.slice(F.array(blank), 1, 0)))).otherwise(F.array(piece(g, None)))

    return _let(F.regexp_extract_all(value, F.lit(r"\d+[ \-]?"), F.lit(0)), of)


def _code(value: Column) -> Column:
    """The country code of a phone that begins with +; empty for a national one."""
    digits = _digits(value)
    n = F.when(F.substring(digits, 1, 1).isin(*_CODES_1), 1).when(F.substring(digits, 1, 2).isin(*_CODES_2), 2).otherwise(3)
    return F.when(F.startswith(value, F.lit("+")), F.substring(digits, F.lit(1), n)).otherwise("")


def _national(value: Column) -> Column:
    """The digits after the country code."""
    return F.substring(_digits(value), F.length(_code(value)) + 1, F.lit(99))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    digits = _digits(value)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new_body = _permuted(body, "card", key)
    card = _in_mask(value, F.concat(new_body, ((10 - luhn(F.concat(new_body, F.lit("0")))) % 10).cast("string")))
    area = F.substring(digits, 1, 3).cast("long")
    place = (area - 1 - (area > 666).cast("int")) * 99 + F.substring(digits, 4, 2).cast("long") - 1
    x, y = feistel(place, F.substring(digits, 6, 4).cast("long") - 1, F.lit(898 * 99), F.lit(9999), "ssn", key)
    new_area = F.floor(x / 99) + 1
    ssn = _in_mask(value, F.concat(_padded(new_area + (new_area >= 666).cast("int"), 3), _padded(x % 99 + 1, 2), _padded(y + 1, 4)))
    first = F.lit("1800-01-01").cast("date")
    day = F.datediff(F.try_to_timestamp(F.translate(value, "/", "-"), F.lit("yyyy-MM-dd")).cast("date"), first).cast("long")
    x, y = feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), "date", key)
    date = _in_mask(value, F.date_format(F.date_add(first, (x * 773 + y).cast("int")), "yyyyMMdd"))
    date = F.when(F.regexp_like(value, F.lit(_IS_DAY)), _new_day(value, key)).otherwise(date)
    phone = _in_mask(value, F.concat(_code(value), _permuted(_national(value), "phone", key)))
    octet = lambda k: F.try_element_at(F.split(value, r"\."), F.lit(k)).try_cast("long")
    x, y = feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), "ip", key)
    ip = F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"), F.floor(y / 256).cast("string"), (y % 256).cast("string"))
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lower(value)), 256)
    word = lambda k: F.conv(F.substring(digest, k, 8), 16, 10).cast("long")
    x, y = feistel(word(1), word(9), F.lit(1 << 32), F.lit(1 << 32), "email", key)
    email = F.concat(F.lit("u"), F.lower(F.lpad(F.hex(x), 8, "0")), F.lower(F.lpad(F.hex(y), 8, "0")), F.lit("@"), F.substring_index(value, "@", -1))
    out = F.when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "date", date).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "email", email)
    return F.coalesce(out, value)


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the values in ``column`` replaced, and ``n_values`` and ``kinds`` (a count for each kind) added.

    ``key`` is the secret: without it pseudonyms can't be undone or made.
    """
    rest = [c for c in docs.columns if c not in ("n_values", "kinds")]
    text = F.col(f"_kept.`{column}`")
    suspect = F.regexp_like(text, F.lit("[0-9@]"))
    values = F.when(suspect, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    found = F.transform(values, lambda v: F.when(_is_run(v), _parts(v)).otherwise(F.array(F.struct(v.alias("value"), _kind(v).alias("kind")))))
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_kept")).withColumn("_found", found)
    pieces = F.split(text, PATTERN, -1)
    written = lambda f: F.when(f["kind"].isNull(), f["value"]).otherwise(pseudonym(f["value"], f["kind"], key))
    new = F.transform(F.col("_found"), lambda parts: F.array_join(F.transform(parts, written), ""))
    joined = F.array_join(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, v: F.concat(p, v)), "")
    count = lambda kind: F.size(F.filter(F.coalesce(F.flatten("_found"), F.array().cast("array<struct<value:string,kind:string>>")), lambda f: f["kind"] == kind))
    kinds = F.struct(*[count(k).alias(k) for k in KINDS])
    out = at.select("_kept", F.when(F.size("_found") > 0, joined).otherwise(text).alias("_new"), kinds.alias("_kinds"))
    kept = [F.col("_new").alias(c) if c == column else F.col(f"_kept.`{c}`").alias(c) for c in rest]
    return out.select(*kept, F.col("_kinds").alias("kinds"), sum((F.col("_kinds")[k] for k in KINDS), F.lit(0)).cast("long").alias("n_values"))
