"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.llm.common import carried, col_of, returned

#: Rounds of a network; steps that a value walks at most until its pseudonym has the format that it needs.
ROUNDS, WALK = 8, 200
#: The dates that are permuted, and sides of the network that holds them all.
EPOCH, DAYS, DATE_SIDES = "1900-01-01", 73049, (271, 270)
#: The lengths of bank account numbers (ISO 13616) by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{1,20}}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Numbers beside one another on a line, up to where an e-mail address begins.
RUN = rf"[+(]{{0,2}}[0-9](?:[0-9 .()/+-]*[0-9])?(?!{_LOCAL}{{0,64}}@)"
ANY = f"{EMAIL}|{IBAN}|{RUN}"

KINDS = ("email", "iban", "date", "card", "ssn", "phone", "ip")
#: What may stand between the groups of a phone number.
_PHONE_GAPS = (" ", "-", ".", "/", " (", "(", "-(", ") ", ")", ")-")


# --- keyed permutations -------------------------------------------------------------------------------------------


def _random(key: str, *parts: Column | str) -> Column:
    """A keyed pseudo-random number below 2 ** 60: nested SHA-256 under two keys made of ``key``."""
    inner, outer = (hashlib.sha256(f"{name}\x00{key}".encode()).hexdigest() for name in ("inner", "outer"))
    message = F.concat_ws("\x00", F.lit(inner), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    digest = F.sha2(F.concat(F.lit(outer), F.sha2(message.cast("binary"), 256)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _networked(state: Column, even: Callable[[Column, Column], Column], odd: Callable[[Column, Column], Column], inverse: bool) -> Column:
    """ROUNDS rounds of a network over a state, even and odd ones in turn."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, state, lambda s, r: F.when(r % 2 == 0, even(s, r)).otherwise(odd(s, r)))


def _feistel(a: Column, b: Column, side_a: int, side_b: int, key: str, tweak: str, inverse: bool) -> Column:
    """struct(a, b): the network of ``permute_number`` on two columns."""
    sign = F.lit(-1 if inverse else 1)
    moved = lambda s, r, mine, other, side: F.pmod(s[mine] + sign * (_random(key, tweak, r, s[other]) % side), F.lit(side)).alias(mine)
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return _networked(start, lambda s, r: F.struct(moved(s, r, "a", "b", side_a), s["b"].alias("b")), lambda s, r: F.struct(s["a"].alias("a"), moved(s, r, "b", "a", side_b)), inverse)


def permute_number(left: Column, right: Column, side_left: int, side_right: int, key: str, tweak: str, inverse: bool = False) -> tuple[Column, Column]:
    """An alternating Feistel network on Z_left x Z_right: a keyed permutation of the pairs."""
    done = _feistel(left, right, side_left, side_right, key, tweak, inverse)
    return done["a"], done["b"]


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once."""
    return F.transform(F.array(value), of)[0]


def permute_digits(digits: Column, key: str, tweak: str, inverse: bool = False) -> Column:
    """Permute a string of up to 36 digits within its length: the halves are numbers of up to 18 digits each.

    Lengths vary by row, so the sides of the network are powers of ten of each half's length.
    """
    ten = lambda m: F.rpad(F.lit("1"), m + 1, "0").cast("long")
    n = F.length(digits)
    k = F.floor(n / 2).cast("int")
    number = lambda s: F.coalesce(s.try_cast("long"), F.lit(0))
    sign = F.lit(-1 if inverse else 1)
    fields = ("a", "b", "sa", "sb", "k", "m")

    def moved(s: Column, r: Column, mine: str, other: str) -> Column:
        new = F.pmod(s[mine] + sign * (_random(key, tweak, r, s["k"] + s["m"], s[other]) % s["s" + mine]), s["s" + mine])
        return F.struct(*[(new if f == mine else s[f]).alias(f) for f in fields])

    start = F.struct(number(F.substring(digits, F.lit(1), k)).alias("a"), number(F.substring(digits, k + 1, n - k)).alias("b"), ten(k).alias("sa"), ten(n - k).alias("sb"), k.alias("k"), (n - k).alias("m"))
    half = lambda v, m: F.when(m > 0, F.lpad(v.cast("string"), m, "0")).otherwise(F.lit(""))
    return _bound(_networked(start, lambda s, r: moved(s, r, "a", "b"), lambda s, r: moved(s, r, "b", "a"), inverse), lambda s: F.concat(half(s["a"], s["k"]), half(s["b"], s["m"])))


def _walked(value: Column, step: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """Permute a value until it fits (cycle walking): a permutation of the values that fit."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def once(s: Column, _: Column) -> Column:
        new = _bound(step(s["v"]), lambda v: F.struct(v.alias("v"), F.coalesce(fits(v), F.lit(False)).alias("done")))
        return F.when(s["done"], s).otherwise(new)

    return _bound(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, once), lambda s: F.when(s["done"], s["v"]))


# --- formats ------------------------------------------------------------------------------------------------------


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one undoubled."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x)


def _into_format(original: Column, digits: Column) -> Column:
    """The digits of ``original`` replaced by ``digits`` one by one, all else kept."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(original, ""), start, put)["out"]


def _year_like(digits: Column) -> Column:
    return F.substring(digits, 1, 4).between("1900", "2099")


def _card(digits: Column, key: str, inverse: bool, fits: Callable[[Column], Column]) -> Column:
    """A number with Luhn's check digit to another one that fits its format."""
    def step(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", inverse)
        return _bound(body, lambda b: F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _walked(digits, step, fits)


def _north_american(digits: Column) -> Column:
    """Area and exchange of a ten-digit number don't start with 0 or 1."""
    return (F.substring(digits, 1, 1) >= "2") & (F.substring(digits, 4, 1) >= "2")


def _phone(digits: Column, key: str, inverse: bool) -> Column:
    """Ten digits to ten digits; numbers of the North American plan stay in it, others out of it."""
    return _walked(digits, lambda d: permute_digits(d, key, "phone", inverse), lambda d: _north_american(d) == _north_american(digits))


def _ssn(area: Column, group: Column, serial: Column, sep: Column, key: str, inverse: bool) -> Column:
    """Valid areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999 map to valid ones; null for others."""
    area, group, serial = (c.cast("int") for c in (area, group, serial))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    number = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    def shown(s: Column) -> Column:
        new = F.floor(s["a"] / 99).cast("int") + 1
        new = F.when(new >= 666, new + 1).otherwise(new)
        part = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat(part(new, 3), sep, part(s["a"] % 99 + 1, 2), sep, part(s["b"] + 1, 4))

    return F.when(valid, _bound(_feistel(number, serial - 1, 898 * 99, 9999, key, "ssn", inverse), shown))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days since EPOCH of a calendar date of 1900 to 2099, else null."""
    date = F.concat_ws("-", year, month, day).try_cast("date")
    return F.when(year.between("1900", "2099"), F.datediff(date, F.lit(EPOCH).cast("date")).cast("long"))


def _date(day: Column, fits: Callable[[Column], Column], key: str, inverse: bool) -> Column:
    """A day number to that of another date which fits the format."""
    high, low = DATE_SIDES

    def step(t: Column) -> Column:
        return _bound(_feistel(F.floor(t / low), t % low, high, low, key, "date", inverse), lambda s: s["a"] * low + s["b"])

    return _walked(day, step, lambda t: (t < DAYS) & fits(F.date_add(F.lit(EPOCH).cast("date"), t.cast("int"))))


def _ip(octets: list[Column], key: str, inverse: bool) -> Column:
    o = [x.cast("long") for x in octets]
    shown = lambda s: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)])
    return _bound(_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", inverse), shown)


def _email(m: Column, key: str, inverse: bool) -> Column:
    """Letters and digits of the part before @ are shifted within their class by a Feistel network over its halves.

    The domain stays, and is part of the key; so do the part's case, dots and length.
    """
    local = F.substring_index(m, "@", 1)
    domain = F.substring(m, F.length(local) + 1, F.length(m))
    k = F.floor(F.length(local) / 2).cast("int")
    sign = -1 if inverse else 1
    start = F.struct(F.substring(local, F.lit(1), k).alias("a"), F.substring(local, k + 1, F.length(local) - k).alias("b"))

    def shifted(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            stream = _random(key, "email", r, i, F.length(half), domain, other)
            move = lambda base, size: F.chr(F.lit(base) + F.pmod(F.ascii(c) - base + sign * (stream % size), F.lit(size)))
            return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    even = lambda s, r: F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], r).alias("b"))
    odd = lambda s, r: F.struct(shifted(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))
    return _bound(_networked(start, even, odd, inverse), lambda s: F.concat(s["a"], s["b"], domain))


def _check_digits(country: Column, account: Column) -> Column:
    """The two check digits of a bank account number: 98 less the remainder of 97."""
    letters = lambda c: F.ascii(c) - 55
    left = F.aggregate(F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + letters(c)) % 97))
    return F.lpad((F.lit(98) - left).cast("string"), 2, "0")


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """struct(value, rest) of a match that starts with a valid account number, else null: its digits are permuted, its letters stay."""
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    n = F.try_element_at(lengths, F.substring(m, 1, 2))
    spaced = F.substring(m, 5, 1) == " "
    shown = F.when(spaced, n + F.floor((n - 1) / 4).cast("int")).otherwise(n)
    head = F.substring(m, F.lit(1), shown)
    plain = F.replace(head, F.lit(" "), F.lit(""))
    rest = F.substring(m, shown + 1, F.length(m))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), n - 4)
    valid = (F.length(plain) == n) & ((rest == "") | rest.startswith(" ")) & (F.substring(plain, 3, 2) == _check_digits(country, account))

    def made(account: Column) -> Column:
        new = _into_format(account, permute_digits(F.regexp_replace(account, "[^0-9]", ""), key, "iban", inverse))
        return _bound(new, lambda a: _into_format(head, F.concat(_check_digits(country, a), F.regexp_replace(a, "[^0-9]", ""))))

    return F.when(valid, F.struct(made(account).alias("value"), rest.alias("rest")))


# --- numbers beside one another -----------------------------------------------------------------------------------


def _found_at(x: Column, i: Column, key: str, inverse: bool) -> Column:
    """struct(at, n, kind, value) of what starts at group ``i`` of a run of numbers: the first format that fits and passes its check; else null.

    ``x`` has g, the groups of digits, s, what stands before each of them and after the last, and t, both in turn.  The value replaces n groups
    and what stands between them.
    """
    g = lambda k: F.get(x["g"], i + k)
    s = lambda k: F.get(x["s"], i + k)
    size = lambda k: F.coalesce(F.length(g(k)), F.lit(0))
    sizes = lambda *n: reduce(and_, [size(k) == m for k, m in enumerate(n)])
    gap = lambda k, *allowed: F.coalesce(s(k).isin(*allowed), F.lit(False))
    alike = lambda n, *allowed: reduce(and_, [s(k) == s(1) for k in range(2, n)], gap(1, *allowed))
    joined = lambda k: F.coalesce(s(k).endswith("-") if k == 0 else s(k).startswith("-") & (size(k) > 0), F.lit(False))
    digits = lambda n, skip=0: F.array_join(F.slice(x["g"], i + 1 + skip, n), "")
    shape = lambda name, n: F.struct(F.lit(name).alias("name"), (F.lit(n) if isinstance(n, int) else n).alias("n"))
    plus = F.coalesce(s(0).endswith("+"), F.lit(False))
    alone = ~joined(0) & ~joined(3)

    # dates: year first, or day and month (month and day) first
    day_first = (s(1) == ".") | (g(0).cast("int") > 12)
    dated = alike(3, "-", "/", ".") & alone
    iso_day, short_day = _day(g(0), g(1), g(2)), F.when(day_first, _day(g(2), g(1), g(0))).otherwise(_day(g(2), g(0), g(1)))
    # cards: in groups as printed, or in one; 4-4-4-4 goes before 4-4-4-4-3
    listed = lambda d: (s(1) == " ") & _year_like(d)
    fours = (size(1) == 4) & (size(2) == 4) & (size(3) == 4) & alike(4, " ", "-") & ~listed(g(0))
    card = (
        F.when(size(0).between(13, 19), F.array(F.lit(1))).when((size(0) == 4) & fours, F.when((size(4) == 3) & (s(4) == s(1)), F.array(F.lit(4), F.lit(5))).otherwise(F.array(F.lit(4))))
        .when((sizes(4, 6, 5) | sizes(4, 6, 4)) & alike(3, " ", "-"), F.array(F.lit(3)))
    )
    card = F.when(~plus & card.isNotNull(), F.get(F.filter(card, lambda n: luhn_sum(digits(n)) % 10 == 0), F.lit(0)))
    # phones: a plus, the country and ten digits; a plus and the most groups that fit; ten digits
    ten = lambda k: (size(k) == 3) & (size(k + 1) == 3) & (size(k + 2) == 4) & gap(k + 1, " ", "-", ".", ") ", ")", ")-") & gap(k + 2, " ", "-", ".")
    country = size(0).between(1, 3) & ten(1) & gap(1, " ", "-", ".", " (", "(", "-(")
    national = ten(0) & ((s(0).endswith("(") & gap(1, ") ", ")", ")-")) | gap(1, "-", ".") | (gap(1, " ") & gap(2, "-", ".")) | (gap(1, " ") & _north_american(digits(3))))
    abroad = F.lit(None).cast("int")
    for n in range(1, 8):
        fits = reduce(and_, [gap(k, *_PHONE_GAPS) & (size(k) > 0) for k in range(1, n)], reduce(add, [size(k) for k in range(n)]).between(8, 15))
        abroad = F.when(fits, F.lit(n)).otherwise(abroad)
    octet = lambda k: size(k).between(1, 3) & (g(k).cast("int") <= 255) & ((size(k) == 1) | ~g(k).startswith("0"))
    address = reduce(and_, [octet(k) for k in range(4)], alike(4, ".")) & ~F.coalesce((i > 0) & (s(0) == "."), F.lit(False)) & ~F.coalesce((s(4) == ".") & (size(4) > 0), F.lit(False))

    found = (
        F.when(sizes(4, 2, 2) & dated & iso_day.isNotNull(), shape("year first", 3)).when(size(0).between(1, 2) & size(1).between(1, 2) & (size(2) == 4) & dated & short_day.isNotNull(), shape("year last", 3))
        .when(card.isNotNull(), shape("card", card)).when(sizes(3, 2, 4) & alike(3, "-") & alone, shape("ssn", 3)).when(plus & country, shape("country", 4))
        .when(plus & abroad.isNotNull(), shape("abroad", abroad)).when(national, shape("national", 3)).when(address, shape("ip", 4))
    )

    def valued(f: Column) -> Column:
        n, text = f["n"], F.array_join(F.slice(x["t"], 2 * i + 2, 2 * f["n"] - 1), "")
        two = lambda c, width: F.lpad(c.cast("string"), width, "0")
        iso = f["name"] == "year first"
        first = lambda d: F.when(day_first, F.day(d)).otherwise(F.month(d))
        second = lambda d: F.when(day_first, F.month(d)).otherwise(F.day(d))
        keeps = lambda d: iso | (((size(0) == 2) | (first(d) <= 9)) & ((size(1) == 2) | (second(d) <= 9)) & ((s(1) == ".") | (day_first == (first(d) > 12))))
        day = _date(F.when(iso, iso_day).otherwise(short_day), keeps, key, inverse)
        shown = lambda d: F.when(iso, F.concat(F.year(d).cast("string"), s(1), two(F.month(d), 2), s(2), two(F.day(d), 2))).otherwise(F.concat(two(first(d), size(0)), s(1), two(second(d), size(1)), s(2), F.year(d).cast("string")))
        date = _bound(F.date_add(F.lit(EPOCH).cast("date"), day.cast("int")), shown)
        cards = lambda d: F.when(n == 4, ~listed(d)).when(n == 5, ~listed(d) & (luhn_sum(F.substring(d, 1, 16)) % 10 != 0)).otherwise(F.lit(True))
        skip = F.when(f["name"] == "country", 1).otherwise(0)
        ten_digits = _bound(digits(3, skip), lambda d: _phone(d, key, inverse))
        kept = F.when((n > 1) & (size(0) <= 3), size(0)).otherwise(F.lit(2))
        any_digits = _bound(digits(n), lambda d: F.concat(F.substring(d, F.lit(1), kept), permute_digits(F.substring(d, kept + 1, F.length(d)), key, "abroad", inverse)))
        name = f["name"]
        value = (
            F.when(name.isin("year first", "year last"), date).when(name == "card", _into_format(text, _card(digits(n), key, inverse, cards))).when(name == "ssn", _ssn(g(0), g(1), g(2), s(1), key, inverse))
            .when(name.isin("country", "national"), _into_format(text, F.concat(F.when(skip == 1, g(0)).otherwise(F.lit("")), ten_digits))).when(name == "abroad", _into_format(text, any_digits)).when(name == "ip", _ip([g(k) for k in range(4)], key, inverse))
        )
        kind = F.when(name.isin("year first", "year last"), "date").when(name.isin("country", "abroad", "national"), "phone").otherwise(name)
        return F.struct(i.alias("at"), n.alias("n"), kind.alias("kind"), value.alias("value"))

    done = _bound(found, lambda f: F.when(f.isNotNull(), valued(f)))
    return _bound(done, lambda c: F.when(c["value"].isNotNull(), c))


def _picked(found: Column) -> Column:
    """What is found, from the left on, without what overlaps something before it."""
    none = F.filter(found, lambda _: F.lit(False))
    start = F.struct(F.lit(0).alias("next"), none.alias("picks"))
    take = lambda a, c: F.when(c["at"] >= a["next"], F.struct((c["at"] + c["n"]).alias("next"), F.concat(a["picks"], F.array(c)).alias("picks"))).otherwise(a)
    return F.aggregate(found, start, take)["picks"]


def _assembled(x: Column) -> Column:
    """The run with its picks in place; all else as it was."""
    tokens, picks = x["t"], x["picks"]
    end = lambda k: F.when(k > 0, F.get(picks, k - 1)["at"] + F.get(picks, k - 1)["n"]).otherwise(F.lit(0))
    between = lambda a, b: F.array_join(F.slice(tokens, 2 * a + 1, 2 * (b - a) + 1), "")
    parts = F.transform(picks, lambda c, k: F.concat(between(end(k), c["at"]), c["value"]))
    return F.concat(x["head"], F.array_join(parts, ""), between(end(F.size(picks)), F.size(x["g"])))


def pseudonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str, inverse: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, n_<kind>, ``carry``.

    Values are found by their format and validated: e-mail addresses; bank accounts (check digits); dates of 1900 to 2099, year first or
    last, between dashes, slashes or dots; cards of 13 to 19 digits in one group or as printed (Luhn's check); social security numbers (areas);
    phones of ten digits with separators, and any after a plus; IPv4 addresses.  Numbers that stand side by side are searched from the left, group
    by group: what fails its check doesn't hide what begins inside it.  Each is permuted within its format by a keyed Feistel
    network, so equal values get equal pseudonyms in all documents and stay valid; with ``inverse`` pseudonyms are turned
    back.  Whoever has ``key`` can do that; it isn't part of the result, but keys made of it stand in Spark's query plans.

    All else is kept byte by byte.  Null text stays null with counts of 0; texts without a digit or @ aren't searched.  Very long texts are
    searched whole.  Repeated rows get equal results; an empty table gives an empty result.  Not found: phones without separators or plus, two-digit
    years, numbers in words.  Of groups of four side by side that could be read as several cards, the leftmost valid one counts; there the inverse may differ.
    """
    text = col_of(docs, text_col)
    d = docs.select(col_of(docs, id_col).alias("doc_id"), text.alias("text"), F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("m"), *carried(docs, carry))
    hit = F.size("m") > 0
    kept = [c for c in d.columns if c != "m"]
    # a match: what replaces its head (an address or account), and the rest, a run of numbers
    nothing = F.lit(None).cast("string")

    def parted(m: Column) -> Column:
        part = lambda head, kind, run: F.struct(head.alias("head"), kind.alias("kind"), run.alias("run"))
        account = F.when(~m.contains("@") & m.rlike("^[A-Z]"), _iban(m, key, inverse))
        address = part(_email(m, key, inverse), F.lit("email"), F.lit(""))
        return _bound(account, lambda a: F.when(m.contains("@"), address).when(a.isNotNull(), part(a["value"], F.lit("iban"), a["rest"])).otherwise(part(F.lit(""), nothing, m)))

    split = F.transform("m", parted)
    d = d.select(*kept, "m", F.when(hit, split).alias("h"))
    groups = F.transform("h", lambda h: F.struct(h["head"].alias("head"), h["kind"].alias("kind"), F.regexp_extract_all(h["run"], F.lit("[0-9]+"), F.lit(0)).alias("g"), F.split(h["run"], "[0-9]+", -1).alias("s")))
    d = d.select(*kept, "m", groups.alias("h"))
    tokens = lambda h: F.concat(F.flatten(F.transform(h["g"], lambda g, k: F.array(F.get(h["s"], k), g))), F.slice(h["s"], -1, 1))
    seen = lambda h: F.when(F.size(h["g"]) > 0, F.filter(F.transform(h["g"], lambda _, i: _found_at(h, i, key, inverse)), lambda c: c.isNotNull())).otherwise(F.array().cast("array<struct<at:int,n:int,kind:string,value:string>>"))
    d = d.select(*kept, "m", F.transform("h", lambda h: h.withField("t", tokens(h))).alias("h"))
    d = d.select(*kept, "m", F.transform("h", lambda h: h.withField("found", seen(h))).alias("h"))
    d = d.select(*kept, "m", F.transform("h", lambda h: F.struct(h["head"].alias("head"), h["kind"].alias("kind"), h["g"].alias("g"), h["t"].alias("t"), _picked(h["found"]).alias("picks"))).alias("h"))
    kinds = lambda h: F.concat(F.when(h["kind"].isNotNull(), F.array(h["kind"])).otherwise(F.array().cast("array<string>")), F.transform(h["picks"], lambda c: c["kind"]))
    d = d.select(*kept, "m", F.transform("h", _assembled).alias("new"), F.flatten(F.transform("h", kinds)).alias("kinds"))
    gaps = F.split("text", ANY, -1)
    body = F.zip_with(F.slice(gaps, 1, F.size("m")), "new", lambda g, v: F.concat(g, v))
    new = F.when(hit, F.concat(F.array_join(body, ""), F.get(gaps, F.size("m")))).otherwise(F.col("text"))
    count = lambda kind: F.coalesce(F.size(F.filter("kinds", lambda x: x == kind)), F.lit(0)).cast("long")
    total = F.coalesce(F.size("kinds"), F.lit(0)).cast("long")
    return d.select("doc_id", new.alias("text"), F.greatest(total, F.lit(0).cast("long")).alias("n_found"), *[F.greatest(count(kind), F.lit(0).cast("long")).alias(f"n_{kind}") for kind in KINDS], *returned(carry))


#: The key of the registered query, whose results must be the same in every run.  It is public: set spark.panellink.pii.key for other uses.
TEST_KEY = "public key of the registered query"


def op6_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=spark.conf.get("spark.panellink.pii.key", TEST_KEY))
