"""Format-preserving pseudonyms for personal data, in SQL functions only.

A value is found by pattern, validated (check digits, ranges, calendar), and replaced by a keyed
permutation of its own format: a Feistel network over the value's characters, where every digit stays a
digit and every letter a letter, or over the number itself where the format is a range (addresses, social
security numbers, days). Check digits are computed anew. A permutation maps equal values to equal
pseudonyms and different values to different ones, so documents stay linked by a value that nobody can
read without the key. Separators do not count: a card number maps to the same digits however it is
grouped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrank.llm.base import id_text

ROUNDS = 8

# The patterns of each kind, tried in this order at every position.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9])(?!\.[0-9])"
DATE = (
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?!(?!T[0-9])[0-9A-Za-z])"  # a time of day may follow
)
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?<![0-9A-Za-z:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)"
    r"(?![0-9A-Za-z:])"
)
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
KEYWORD = r"(?i:password|passwd|secret|api_key|token)"
# keys that tell their maker by how they begin
PREFIX = r"AKIA|gh[opsu]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza"
SECRET = (
    r"(?<![0-9A-Za-z])AKIA[A-Z0-9]{16}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?:gh[opsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,82}|glpat-[A-Za-z0-9_-]{20}|AIza[A-Za-z0-9_-]{35}"
    r"|sk-(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,80}|xox[abprs]-(?=[A-Za-z-]*[0-9])[A-Za-z0-9-]{10,72})(?![0-9A-Za-z])"
    # after the separator, which blanks and quotes may stand around; a bare word after a colon and blanks
    # may be prose, and counts if it has a digit
    r"|(?<=[=:\"' \t])(?<=[=:][ \t]{0,4}[\"']?)"  # few places get past this, which is cheap
    rf"(?:(?<={KEYWORD}[\"']?[ \t]{{0,4}}=[ \t]{{0,4}}[\"']?)|(?<={KEYWORD}[\"']?[ \t]{{0,4}}:[ \t]{{0,4}}[\"'])"
    rf"|(?<={KEYWORD}[\"']?[ \t]{{0,4}}:)|(?<={KEYWORD}[\"']?[ \t]{{0,4}}:[ \t]{{1,4}})(?=[A-Za-z+/_-]*[0-9]))"
    r"[A-Za-z0-9+/_-]{6,64}"
)
CARD = r"(?<![0-9A-Za-z])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])"
PHONE = (
    r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z-]|[0-9][ .-])[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9A-Za-z-]| [0-9])"
)
KINDS = {"email": EMAIL, "ip": IP, "ipv6": IPV6, "date": DATE, "ssn": SSN, "hex": HEX, "iban": IBAN, "secret": SECRET, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
POSSIBLE = rf"[0-9@]|{KEYWORD}[\"']?[ \t]{{0,4}}[=:]"


def _digest(key: str, kind: str, nth: Column, of: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), nth.cast("string"), of), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def _shifted(text: Column, digest: Column, letters: int) -> Column:
    """Each digit and letter of ``text`` moved within its class by its part of the digest."""

    def one(text: Column, digest: Column, i: Column) -> Column:
        by = _hex(F.substr(digest, F.lit(1) + (i - 1) % 16 * 4, F.lit(4)))

        def move(s: Column) -> Column:
            within = lambda base, size: F.char(base + (s["code"] - base + s["by"]) % size)
            return (
                F.when(s["code"].between(48, 57), within(48, 10))
                .when(s["code"].between(97, 122), within(97, letters))
                .when(s["code"].between(65, 90), within(65, 26))
                .otherwise(F.char(s["code"]))
            )

        return let(F.struct(F.ascii(F.substr(text, i, F.lit(1))).cast("bigint").alias("code"), by.alias("by")), move)

    each = lambda s: F.transform(
        F.sequence(F.lit(1), F.length(s["text"])), lambda i: one(s["text"], s["digest"], i)
    )
    return F.array_join(let(F.struct(text.alias("text"), digest.alias("digest")), each), "")


def permuted(text: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Feistel permutation of a string of two characters or more: classes of characters keep their places.
    ``letters`` limits lower case letters to the alphabet's first ones (6 for hexadecimal)."""

    def network(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        done = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            F.struct(F.substr(t, F.lit(1), half).alias("a"), F.substr(t, half + 1, F.length(t)).alias("b")),
            lambda s, n: F.struct(s["b"].alias("a"), _shifted(s["a"], _digest(key, kind, n, s["b"]), letters).alias("b")),
            lambda s: F.concat(s["a"], s["b"]),
        )
        return F.when(F.length(t) >= 2, done).otherwise(t)

    return let(text, network)


def permuted_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Feistel permutation of the whole numbers from 0 to a * b - 1: parts modulo ``a`` and ``b`` in turn."""
    part = lambda n, of: _hex(F.substr(_digest(key, kind, n, of.cast("string")), F.lit(1), F.lit(12)))

    def turn(s: Column, n: Column) -> Column:
        left = F.when(n % 2 == 1, (s["l"] + part(n, s["r"])) % a).otherwise(s["l"])
        right = F.when(n % 2 == 0, (s["r"] + part(n, s["l"])) % b).otherwise(s["r"])
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def network(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("bigint").alias("l"), (v % b).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])

    return let(value, network)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(body: Column) -> Column:
    """Check digit of a string of digits."""

    def add(total: Column, s: Column) -> Column:
        doubled = s["d"] * 2 - F.when(s["d"] > 4, 9).otherwise(0)
        return total + F.when(s["odd"], doubled).otherwise(s["d"])

    def total(text: Column) -> Column:
        places = F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.struct(
                F.substr(text, F.length(text) - i + 1, F.lit(1)).cast("int").alias("d"), (i % 2 == 1).alias("odd")
            ),
        )
        return F.aggregate(places, F.lit(0), add)

    return ((10 - let(body, total) % 10) % 10).cast("string")


def _refill(shape: Column, values: Column, pattern: str) -> Column:
    """``shape`` with its characters of class ``pattern`` replaced by those of ``values`` in order."""

    def fill(s: Column) -> Column:
        def at(i: Column) -> Column:
            c = F.substr(s["shape"], i, F.lit(1))
            nth = F.length(F.regexp_replace(F.substr(s["shape"], F.lit(1), i), f"[^{pattern}]", ""))
            return F.when(c.rlike(f"^[{pattern}]$"), F.substr(s["values"], nth, F.lit(1))).otherwise(c)

        return F.transform(F.sequence(F.lit(1), F.length(s["shape"])), at)

    return F.array_join(let(F.struct(shape.alias("shape"), values.alias("values")), fill), "")


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals (A = 10, ...) by 97."""

    def add(rest: Column, code: Column) -> Column:
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    codes = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substr(t, i, F.lit(1))))
    return F.aggregate(let(text, codes), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def valid(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        new = let(permuted(body, key, "card"), lambda p: F.concat(p, _luhn(p)))
        return F.when((F.substr(digits, F.length(digits), F.lit(1)) == _luhn(body)) & digits.rlike("[1-9]"), _refill(m, new, "0-9"))

    return let(_digits(m), valid)


def _iban(m: Column, key: str) -> Column:
    def valid(packed: Column) -> Column:
        country, body = F.substr(packed, F.lit(1), F.lit(2)), F.substr(packed, F.lit(5), F.length(packed))
        check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        new = let(permuted(body, key, "iban"), lambda p: F.concat(country, check(p), p))
        return F.when(_mod97(F.concat(body, F.substr(packed, F.lit(1), F.lit(4)))) == 1, _refill(m, new, "0-9A-Z"))

    return let(F.regexp_replace(m, " ", ""), valid)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999: 898 * 99 * 9999 numbers."""
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    area = area - F.when(area > 666, 2).otherwise(1)
    pad = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")

    def shown(new: Column) -> Column:
        front = F.floor(new / 9999)
        place = F.floor(front / 99)
        return F.concat_ws("-", pad(place + F.when(place >= 665, 2).otherwise(1), 3), pad(front % 99 + 1, 2), pad(new % 9999 + 1, 4))

    return let(permuted_number((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"), shown)


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda v, p: v * 256 + p.cast("bigint"))
    octet = lambda new, by: (F.floor(new / by) % 256).cast("bigint").cast("string")
    return let(
        permuted_number(value, 65536, 65536, key, "ip"),
        lambda new: F.concat_ws(".", *[octet(new, 1 << by) for by in (24, 16, 8, 0)]),
    )


def _ipv6(m: Column, key: str) -> Column:
    """All 32 hexadecimal digits, written in full: the same address links however its zeros were left out."""
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")

    def whole(s: Column) -> Column:
        given = F.size(s["l"]) + F.size(s["r"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given))
        full = F.transform(F.concat(s["l"], zeros, s["r"]), lambda g: F.lpad(F.lower(g), 4, "0"))
        ok = m.rlike("[0-9]") & F.when(m.contains("::"), given.between(2, 7)).otherwise(given == 8)
        new = let(permuted(F.array_join(full, ""), key, "ipv6", 6), lambda t: F.regexp_replace(t, "(....)(?=.)", "$1:"))
        return F.when(ok, new)

    sides = F.struct(groups(F.substring_index(m, "::", 1)).alias("l"), F.when(m.contains("::"), groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>")).alias("r"))
    return let(sides, whole)


def _date(m: Column, key: str) -> Column:
    """Days from 1800-01-01 to 2199-12-31: 146,097 = 189 * 773 of them. The order of the parts follows
    the separator: year first, else month/day/year where that is a date, else day before month."""
    epoch = F.lit("1800-01-01").cast("date")
    wide = lambda v, was: F.lpad(v.cast("string"), F.greatest(F.length(was), F.length(v.cast("string"))), F.lit("0"))

    def parsed(p: Column) -> Column:
        month_first = (F.length(p[0]) < 3) & m.contains("/") & (p[0].cast("int") <= 12)
        layout = F.when(F.length(p[0]) == 4, "ymd").when(month_first, "mdy").otherwise("dmy")
        return let(
            layout,
            lambda of: F.struct(
                of.alias("layout"),
                F.when(of == "ymd", p[0]).otherwise(p[2]).alias("y"),
                F.when(of == "mdy", p[0]).otherwise(p[1]).alias("m"),
                F.when(of == "ymd", p[2]).when(of == "mdy", p[1]).otherwise(p[0]).alias("d"),
            ),
        )

    def moved(s: Column) -> Column:
        day = F.try_to_date(F.concat_ws("-", s["y"], F.lpad(s["m"], 2, "0"), F.lpad(s["d"], 2, "0")), "yyyy-MM-dd")
        nth = F.datediff(day, epoch).cast("bigint")
        new = lambda n: F.date_add(epoch, permuted_number(n, 189, 773, key, "date").cast("int"))
        return let(nth, lambda n: F.when(n.between(0, 146096), let(new(n), lambda t: shown(s, t))))

    def shown(s: Column, t: Column) -> Column:
        sep = F.substr(F.regexp_replace(m, "[0-9]", ""), F.lit(1), F.lit(1))
        y, mo, d = F.lpad(F.year(t).cast("string"), 4, "0"), wide(F.month(t), s["m"]), wide(F.day(t), s["d"])
        join = lambda *p: F.concat(p[0], sep, p[1], sep, p[2])
        return F.when(s["layout"] == "ymd", join(y, mo, d)).when(s["layout"] == "mdy", join(mo, d, y)).otherwise(join(d, mo, y))

    return let(let(F.split(m, "[-/.]"), parsed), moved)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; seven to fifteen digits in all."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+)", 1)
    rest = lambda c: _refill(F.substr(m, F.length(c) + 1, F.length(m)), permuted(_digits(F.substr(m, F.length(c) + 1, F.length(m))), key, "phone"), "0-9")
    return F.when(F.length(_digits(m)).between(7, 15), let(code, lambda c: F.concat(c, rest(c))))


def _recased(new: Column, was: Column) -> Column:
    """``new`` with capitals where ``was`` has them."""

    def each(s: Column) -> Column:
        at = lambda text, i: F.substr(s[text], i, F.lit(1))
        one = lambda i: F.when(at("was", i).rlike("[A-Z]"), F.upper(at("new", i))).otherwise(at("new", i))
        return F.transform(F.sequence(F.lit(1), F.length(s["was"])), one)

    mixed = F.array_join(let(F.struct(new.alias("new"), was.alias("was")), each), "")
    return F.when(was.rlike("[A-Z]"), mixed).otherwise(new)


def _email(m: Column, key: str) -> Column:
    """Local part and domain labels are permuted apart, in lower case, so an address stays linked however it is
    capitalised; the local part's capitals are put back. The last label stays, so a domain stays linked."""
    host = F.lower(F.substring_index(m, "@", -1))
    top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    alone = lambda c, kind: _shifted(c, _digest(key, kind, F.lit(0), F.lit("")), 26)
    one = lambda c, kind: let(c, lambda t: F.when(F.length(t) >= 2, permuted(t, key, kind)).otherwise(alone(t, kind)))
    label = F.substr(host, F.lit(1), F.length(host) - F.length(top))
    local = F.substring_index(m, "@", 1)
    return F.concat(_recased(one(F.lower(local), "local"), local), F.lit("@"), one(label, "host"), top)


def _secret(m: Column, key: str) -> Column:
    """The beginning of a key that names its maker stays."""
    front = F.regexp_extract(m, f"^(?:{PREFIX})", 0)
    named = let(front, lambda f: F.when(F.length(f) > 0, F.concat(f, permuted(F.substr(m, F.length(f) + 1, F.length(m)), key, "secret"))))
    return F.coalesce(
        named,
        F.when(m.rlike("^[0-9a-f]+$"), permuted(m, key, "secret", 6))
        .when(m.rlike("^[0-9A-F]{32,64}$"), F.upper(permuted(F.lower(m), key, "secret", 6)))
        .otherwise(permuted(m, key, "secret")),
    )


MAKE = {"email": _email, "ip": _ip, "ipv6": _ipv6, "date": _date, "ssn": _ssn, "iban": _iban, "secret": _secret, "card": _card, "phone": _phone}
# The shape of a match tells its kind; kinds are tried in this order.
SHAPES = {
    "email": "@",
    "ip": rf"^(?:{OCTET}\.){{3}}{OCTET}$",
    "ipv6": r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$",
    "date": r"^(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^(?![0-9A-F]{32,64}$)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,30}$",
    "card": r"^(?:[0-9][ -]?){12,18}[0-9]$",
    "phone": r"^(?:\+|\([0-9]{3}\)|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)",
    "secret": r"^(?!(?![0-9A-F]{32,64}$)[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$)(?=.*[A-Za-z])[A-Za-z0-9+/_-]{6,96}$",
}


def _replacement(m: Column, key: str) -> Column:
    """Replacement struct(kind, new) of the first kind whose shape fits and that validates, else NULL."""


    def made(kind: str) -> Column:
        named = lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("new")))
        return let(F.when(m.rlike(SHAPES[kind]), MAKE[kind](m, key)), named)

    return F.coalesce(*[made(kind) for kind in SHAPES])


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_found, kinds array<string>, text) per input row: ``text`` with every validated value
    replaced by its pseudonym, the number of replacements and their distinct kinds, sorted.

    Empty texts stay, NULL becomes empty; values that do not validate stay as they are. Only SQL functions:
    the pattern splits a text into the pieces between its values, and pieces and pseudonyms are joined."""
    new = F.filter("found", lambda f: f["made"].isNotNull())
    return _found(id_text(docs), F.col("text"), key).select(
        "doc_id",
        F.size(new).cast("bigint").alias("n_found"),
        F.array_sort(F.array_distinct(F.transform(new, lambda f: f["made"]["kind"]))).alias("kinds"),
        _joined().alias("text"),
    )


def _found(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """``rows`` with ``pieces`` (the text between matches) and ``found`` (each match and its replacement)."""
    possible = text.rlike(POSSIBLE)
    none = F.array().cast("array<string>")
    split = rows.select(
        "*",
        F.when(possible, F.split(text, ANY, -1)).otherwise(F.array(text)).alias("pieces"),
        F.when(possible, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none).alias("matches"),
    )
    each = F.transform("matches", lambda m: F.struct(m.alias("match"), _replacement(m, key).alias("made")))
    return split.select("*", each.alias("found"))


def _joined() -> Column:
    """Pieces with each match's pseudonym, or the match itself, after the piece before it."""
    one = lambda p, f: F.concat(p, F.coalesce(f["made"]["new"], f["match"], F.lit("")))
    return F.array_join(F.zip_with("pieces", "found", one), "")


def pseudonymise_text(docs: DataFrame, key: str) -> DataFrame:
    """The columns and rows of ``docs`` with ``text`` pseudonymised; a NULL text stays NULL."""
    whole = docs.select(F.struct("*").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    new = F.when(F.col("d.text").isNotNull(), _joined())
    return _found(whole, F.col("text"), key).select(F.col("d").withField("text", new).alias("d")).select("d.*")
