"""Keyed pseudonyms for numbers and dates, each a permutation of its own format (Feistel rounds over digits or days).

Column functions only. Equal values get equal pseudonyms wherever they stand, and a pseudonym is again valid.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 5
# Turns after which a month-first date has met one after the 12th (it fails with a probability of 0.4 ** WALK).
WALK = 100
# Days of 1900-01-01..2099-12-31 number 17 * 4297.
FIRST_DAY = (dt.date(1900, 1, 1) - dt.date(1970, 1, 1)).days
DAYS = (17, 4297)

_CARD = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
_ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_PHONE = r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
_ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_SLASHED = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
_DATE = f"{_ISO}|{_SLASHED}"
# Intervals, ranges and masks are one candidate of several values.
_DATES = f"{_ISO}(?:/{_ISO})*|{_SLASHED}(?:-{_SLASHED})*"
_ADDRESSES = rf"{_ADDRESS}(?:[/-]{_ADDRESS})*"
_SEVERAL = f"^{_ADDRESS}[/-]|^{_ISO}/|^{_SLASHED}-"
# A candidate neither continues nor begins a longer run of digits, nor a dotted or hyphened one. An address may go on with a
# slash and digits (prefix length, path), and a telephone number may stand behind a country code, which stays.
_FREE, _END = "(?<![0-9])(?<![0-9][./-])", "(?![0-9]|[./-][0-9])"
_CODES = [rf"\+[0-9]{{{n}}}" for n in (1, 2, 3)]
_TRUNKS = [f"{_FREE}{t}" for t in ("1", "00[0-9]{1}", "00[0-9]{2}", "00[0-9]{3}")]
_AFTER_CODE = "|".join(f"(?<={c}[.-])" for c in _CODES + _TRUNKS)
_AT_CODE = "|".join(f"(?<={c})" for c in _CODES)
CANDIDATE = (
    rf"{_FREE}(?:(?:{_DATES}|{_PHONE}|{_CARD}){_END}|{_ADDRESSES}(?![0-9]|[.-][0-9]))"
    rf"|(?:{_AFTER_CODE})(?:{_PHONE}){_END}|(?:{_AT_CODE})(?:[0-9]{{10}}|(?=\()(?:{_PHONE})){_END}"
)


def _digest(key: str, kind: str, turn: Column, other: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other).cast("binary"))


def _feistel(a: Column, b: Column, add_a, add_b) -> Column:
    """Struct (a, b) after ROUNDS double turns: each half is shifted by a keyed function of the other, so each turn can be
    undone and the whole is a permutation. The halves are bound anew in every turn, so the expression stays small."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.alias("a"), b.alias("b")),
        lambda s, turn: F.element_at(
            F.transform(F.array(add_a(s.a, s.b, turn)), lambda moved: F.struct(moved.alias("a"), add_b(s.b, moved, turn).alias("b"))), 1
        ),
    )


def permuted_number(n: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Another number in [0, sizes[0] * sizes[1])."""
    def step(size: int, side: str):
        def add(own: Column, other: Column, turn: Column) -> Column:
            shift = F.conv(F.substring(_digest(key, kind + side, turn, other.cast("string")), 1, 14), 16, 10).cast("bigint")
            return (own + F.pmod(shift, F.lit(size))) % size
        return add

    n = n.cast("bigint")
    halves = _feistel(F.floor(n / sizes[1]).cast("bigint"), n % sizes[1], step(sizes[0], "a"), step(sizes[1], "b"))
    return F.element_at(F.transform(F.array(halves), lambda h: h.a * sizes[1] + h.b), 1)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Another run of as many digits (at most 32), leading zeros included. A single digit shifts by a fixed amount."""
    def add(side: str):
        def shifted(own: Column, other: Column, turn: Column) -> Column:
            stream = _digest(key, kind + side, F.concat_ws(",", turn.cast("string"), F.length(own).cast("string")), other)
            return F.array_join(
                F.transform(
                    F.filter(F.split(own, ""), lambda c: c != ""),
                    lambda c, i: ((c.cast("int") + F.conv(F.substring(stream, i * 2 + 1, 2), 16, 10).cast("int")) % 10).cast("string"),
                ), "",
            )
        return shifted

    half = F.floor(F.length(digits) / 2).cast("int")
    halves = _feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, F.lit(32)), add("a"), add("b"))
    return F.element_at(F.transform(F.array(halves), lambda h: F.concat(h.a, h.b)), 1)


def check_digit(body: Column) -> Column:
    """The digit that makes ``body`` and it pass the Luhn test."""
    chars = F.reverse(F.filter(F.split(body, ""), lambda c: c != ""))
    weighed = F.transform(chars, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return ((10 - F.aggregate(weighed, F.lit(0), lambda s, x: s + x) % 10) % 10).cast("string")


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``value``."""
    place = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.lit(1)).otherwise(F.lit(0)))
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.element_at(
        F.transform(
            F.array(F.struct(place.alias("p"), chars.alias("c"), digits.alias("d"))),
            lambda s: F.array_join(
                F.transform(
                    s.c, lambda c, i: F.when(s.p[i] == 1, F.substring(s.d, F.aggregate(F.slice(s.p, 1, i + 1), F.lit(0), lambda x, y: x + y), F.lit(1))).otherwise(c)
                ), "",
            ),
        ), 1,
    )


def card(value: Column, key: str) -> Column:
    """A Luhn-valid number with the same first digit, length and separators."""
    digits = _only_digits(value)
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted_digits(F.substring(digits, F.lit(2), n - 2), key, "card"))
    return F.element_at(F.transform(F.array(body), lambda b: _laid_out(value, F.concat(b, check_digit(b)))), 1)


def is_card(value: Column) -> Column:
    digits = _only_digits(value)
    n = F.length(digits)
    return value.rlike(f"^(?:{_CARD})$") & (check_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)))


def phone(value: Column, key: str) -> Column:
    """A national number of ten digits in the same layout."""
    return _laid_out(value, permuted_digits(_only_digits(value), key, "phone"))


def address(value: Column, key: str) -> Column:
    """A network address; each part stays between 0 and 255."""
    parts = F.split(value, r"\.")
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 256 + p.cast("bigint"))
    moved = permuted_number(n, (65_536, 65_536), key, "address")
    return F.element_at(
        F.transform(F.array(moved), lambda m: F.concat_ws(".", *[(F.floor(m / F.lit(256**i)).cast("bigint") % 256).cast("string") for i in (3, 2, 1, 0)])), 1
    )


def is_address(value: Column) -> Column:
    return value.rlike(f"^{_ADDRESS}$") & F.forall(F.split(value, r"\."), lambda p: p.cast("int") <= 255)


def moved_day(day: Column, key: str) -> Column:
    """Another date between 1900 and 2099 for a date between them; other dates stay."""
    n = F.datediff(day, F.lit(dt.date(1900, 1, 1)))
    other = F.date_add(F.lit(dt.date(1900, 1, 1)), permuted_number(n, DAYS, key, "date").cast("int"))
    return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), other).otherwise(day)


def _month_first(value: Column) -> Column:
    """Month/day/year can only be meant where the second part is no month."""
    return value.rlike("^[0-9]{1,2}/(?:1[3-9]|[2-9][0-9])/")


def _day_of(value: Column) -> Column:
    iso = F.when(value.rlike(r"^[0-9]{4}-"), F.try_to_date(value, "yyyy-MM-dd"))
    slashed = F.when(_month_first(value), F.try_to_date(value, "M/d/yyyy")).otherwise(F.try_to_date(value, "d/M/yyyy"))
    return F.coalesce(iso, F.when(value.rlike(r"^[0-9]{1,2}/"), slashed))


def moved_late_day(day: Column, key: str) -> Column:
    """Another date after the 12th for one after the 12th: the permutation is followed until it comes to one (a turn fails for
    two days in five), so month-first pseudonyms stay recognisable and meet no day-first one."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), moved_day(day, key),
        lambda at, _: F.when(F.dayofmonth(at) > 12, at).otherwise(moved_day(at, key)),
    )


def date_text(value: Column, key: str) -> Column:
    """A date in the same form: ISO, or day/month/year (month/day/year if only that is a date) with as many digits as each part
    of the value has at least."""
    def slashed(day: Column, first: str, second: str) -> Column:
        padded = F.date_format(day, f"{first * 2}/{second * 2}/yyyy")
        return F.when(F.length(value) == 10, padded).otherwise(F.date_format(day, f"{first}/{second}/yyyy"))

    given = _day_of(value)
    day = moved_day(given, key)
    return (
        F.when(value.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd"))
        .when(_month_first(value), slashed(moved_late_day(given, key), "M", "d")).otherwise(slashed(day, "d", "M"))
    )


def is_date(value: Column) -> Column:
    day = _day_of(value)
    return value.rlike(f"^(?:{_DATE})$") & day.isNotNull() & F.year(day).between(1900, 2099)


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one value; one that fails its validation stays as it is."""
    return (
        F.when(is_date(value), date_text(value, key)).when(value.rlike(f"^(?:{_PHONE}|[0-9]{{10}})$"), phone(value, key))
        .when(is_address(value), address(value, key)).when(is_card(value), card(value, key)).otherwise(value)
    )


def _joined(gaps: Column, values: Column) -> Column:
    """Gaps and the values between them in turn; there is one gap more."""
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(values, F.array(F.lit(""))), lambda g, v: F.array(g, v))), "")


def pseudonyms(candidate: Column, key: str) -> Column:
    """Struct (text, n): the candidate with each of its values replaced, and how many were."""
    one = f"{_DATE}|{_ADDRESS}"
    several = candidate.rlike(_SEVERAL)
    values = F.when(several, F.regexp_extract_all(candidate, F.lit(one), F.lit(0))).otherwise(F.array(candidate))
    gaps = F.when(several, F.split(candidate, one, -1)).otherwise(F.array(F.lit(""), F.lit("")))
    made = F.struct(gaps.alias("g"), values.alias("v"), F.transform(values, lambda v: pseudonym(v, key)).alias("m"))
    return F.element_at(
        F.transform(F.array(made), lambda s: F.struct(
            _joined(s.g, s.m).alias("text"), F.size(F.filter(F.zip_with(s.v, s.m, lambda a, b: a != b), lambda x: x)).alias("n"),
        )), 1,
    )


def pseudonymise_pages(pages: DataFrame, key: str) -> DataFrame:
    """``tournament_id``, ``page_text`` with pseudonyms, and ``n_replaced`` for every page.

    Replaced are dates (ISO, day/month/year and month/day/year, real days of 1900..2099, also in intervals), telephone numbers of
    ten digits (a country code before them stays), network addresses (also in ranges and with a prefix length, which stays) and
    card numbers that pass the Luhn test. Anything else, such as a number that fails its test, stays letter for letter.
    A slashed date that is one in both orders counts as day/month/year.
    The same value under the same ``key`` becomes the same pseudonym on every page; different values never share one.

    Nothing moves: one row per row, NULL texts stay NULL with 0 replaced, repeats and NULL keys stay, further columns are
    not read.
    """
    text = F.col("page_text")
    rows = pages.select("tournament_id", "page_text", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    rows = rows.withColumn("made", F.transform("found", lambda v: pseudonyms(v, key)))
    whole = _joined(F.split(text, CANDIDATE, -1), F.col("made.text"))
    changed = F.aggregate("made.n", F.lit(0), lambda s, n: s + n)
    return rows.select(
        "tournament_id", F.when(F.size("found") > 0, whole).otherwise(text).alias("page_text"),
        F.when(F.size("found") > 0, changed).otherwise(0).cast("bigint").alias("n_replaced"),
    )


def pseudonymise_players(players: DataFrame, key: str) -> DataFrame:
    """Player records with ``date_of_birth`` and the outside ids replaced, all other columns as they are.

    ``transfermarkt_player_id`` (text) and ``sofifa_player_id`` keep their first digit and their length; ids that are not
    runs of 1 to 18 digits stay. Equal values agree with those of other tables under the same key.
    """
    def outside(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.when(v.rlike("^[0-9]{1,18}$"), F.concat(F.substring(v, 1, 1), permuted_digits(F.substring(v, 2, 32), key, "id"))).otherwise(v)

    return players.withColumns({
        "date_of_birth": moved_day(F.col("date_of_birth"), key), "transfermarkt_player_id": outside("transfermarkt_player_id"),
        "sofifa_player_id": outside("sofifa_player_id").cast(players.schema["sofifa_player_id"].dataType),
    })
