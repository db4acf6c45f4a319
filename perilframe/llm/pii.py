"""Format-preserving pseudonyms for personal data, with built-in functions only.

Each kind of value has a pattern, a validation and a permutation of its own valid values, made by a keyed Feistel
network: card numbers keep a valid check digit, dates stay calendar dates, account numbers keep valid check digits. A
permutation maps equal values to equal pseudonyms and different ones to different pseudonyms, so values stay linked
across documents; separators, letter case and lengths of fields stay as they are. Values are compared in canonical
form: the same card number or date in another notation gets the same pseudonym.

Text is cut at the matches of one combined pattern, matches are replaced in the array, and the parts are joined again:
one pass, no shuffle, no user function. Texts without a digit or one of ``@=:`` are passed through at once. No group of a
pattern repeats without bound in a way that the regular expressions of the JVM would recurse on, and values are bounded,
so texts of any length pass.

Found are: mail addresses; access keys of known prefixes, and what is assigned to a word like password if it holds a digit;
account numbers with valid check digits; dates of the years 1800 to 2199 as ``2021-03-04``, ``04.03.2021``, ``4.3.2021``,
``04/03/2021``, ``4 March 2021`` and ``March 4, 2021``; network addresses of both versions; social security numbers; phone
numbers with a country code, in the groupings of North America, or with a leading 0 behind a word like phone; card numbers
of known issuers with a valid check digit, unbroken or in the groups that cards show.

Defined results: a null text stays null, an empty one empty; a match that fails its validation stays as it is; a day and
month written without leading zeros may change their length, and network addresses of version 6 are written in full;
repeated rows give equal rows; an empty table gives an empty result; all other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Used when no key is given; a deployment passes its own secret.
KEY = "perilframe"
#: The dates that are permuted: the 189 * 773 days of the four centuries from here on.
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)
#: Valid social security numbers: areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def _hash(*parts: Column) -> Column:
    """A number of 60 bits from the key and all parts."""
    digest = F.sha2(F.concat_ws("|", *[part.cast("string") for part in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: functions of arrays hold it in a variable."""
    return F.get(F.transform(F.array(value), use), 0)


def feistel(left: Column, right: Column, a: int, b: int, key: Column, tweak: str) -> Column:
    """Struct (l, r): a permutation of [0, a) x [0, b); the halves are added to each other's keyed hash in turn."""

    def step(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        moved = [F.pmod(pair[own] + _hash(key, F.lit(tweak), turn, pair[other]), F.lit(size))
                 for own, other, size in (("l", "r", a), ("r", "l", b))]
        return F.struct(F.when(even, moved[0]).otherwise(pair["l"]).alias("l"),
                        F.when(even, pair["r"]).otherwise(moved[1]).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(turn) for turn in range(ROUNDS)]), start, step)


def characters(value: Column) -> Column:
    return F.split(value, "(?!^)(?!$)")


def _radix(character: Column) -> Column:
    return (F.when(character.rlike("^[0-9]$"), 10).when(character.rlike("^[A-Za-z]$"), 26).otherwise(1))


def _digit(character: Column) -> Column:
    return (F.when(character.rlike("^[0-9]$"), F.ascii(character) - 48)
            .when(character.rlike("^[A-Za-z]$"), F.ascii(F.lower(character)) - 97).otherwise(0))


def feistel_characters(value: Column, key: Column, tweak: Column) -> Column:
    """Permutes digits among digits and letters among letters; case and all other characters keep their place."""

    def moved(own: Column, radix: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", key, tweak, turn.cast("string"), F.array_join(other.cast("array<string>"), ","))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 32).cast("int")), lambda block: F.sha2(
            F.concat_ws("|", seed, block.cast("string")), 256))
        return let(F.array_join(blocks, ""), lambda stream: F.transform(own, lambda number, at: F.pmod(
            number + F.conv(F.substr(stream, 2 * at + 1, F.lit(2)), 16, 10).cast("int"), F.get(radix, at))))

    def step(pair: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(F.when(even, moved(pair["l"], pair["lr"], pair["r"], turn)).otherwise(pair["l"]).alias("l"),
                        F.when(even, pair["r"]).otherwise(moved(pair["r"], pair["rr"], pair["l"], turn)).alias("r"),
                        pair["lr"].alias("lr"), pair["rr"].alias("rr"))

    parts = characters(value)
    half = F.floor(F.length(value) / 2).cast("int")
    rest = F.length(value) - half
    numbers, radix = F.transform(parts, _digit), F.transform(parts, _radix)
    start = F.struct(F.slice(numbers, F.lit(1), half).alias("l"), F.slice(numbers, half + 1, rest).alias("r"),
                     F.slice(radix, F.lit(1), half).alias("lr"), F.slice(radix, half + 1, rest).alias("rr"))
    changed = F.aggregate(F.array(*[F.lit(turn) for turn in range(ROUNDS)]), start, step,
                          lambda pair: F.concat(pair["l"], pair["r"]))

    def written(character: Column, number: Column) -> Column:
        return (F.when(character.rlike("^[0-9]$"), F.char(number + 48)).when(character.rlike("^[a-z]$"), F.char(number + 97))
                .when(character.rlike("^[A-Z]$"), F.char(number + 65)).otherwise(character))

    made = F.array_join(F.zip_with(parts, changed, written), "")
    # A single character is moved on, by one place at least.
    radix_one = _radix(value)
    moved_on = F.pmod(_digit(value) + 1 + F.pmod(_hash(key, tweak), F.greatest(radix_one - 1, F.lit(1))), radix_one)
    return F.when(F.length(value) > 1, made).when(radix_one > 1, written(value, moved_on.cast("int"))).otherwise(value)


def in_place(value: Column, digits: Column) -> Column:
    """The characters of ``value`` with its digits replaced, in order, by ``digits``."""
    # Every digit is found by the number of digits before it.
    return let(digits, lambda held: F.array_join(F.transform(characters(value), lambda character, at: F.when(
        character.rlike("^[0-9]$"),
        F.substr(held, F.length(F.regexp_replace(F.substr(value, F.lit(1), at + 1), "[^0-9]", "")), F.lit(1))
    ).otherwise(character)), ""))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def check_digit(body: Column) -> Column:
    """The digit that makes ``body`` followed by it pass the card number check."""
    total = F.aggregate(F.transform(F.reverse(characters(body)), lambda digit, at: F.when(
        at % 2 == 0, F.floor(digit.try_cast("int") * 2 / 10) + digit.try_cast("int") * 2 % 10
    ).otherwise(digit.try_cast("int")).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """The number that ``text`` stands for, letters counting 10 to 35, modulo 97."""
    return F.aggregate(characters(text), F.lit(0).cast("long"), lambda rest, character: F.when(
        character.rlike("^[0-9]$"), (rest * 10 + (F.ascii(character) - 48)) % 97
    ).otherwise((rest * 100 + (F.ascii(character) - 55)) % 97).cast("long"))


def _is_card(value: Column) -> Column:
    return let(digits_of(value), lambda digits: F.length(digits).between(13, 19) & (
        check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1))))


def _one_card(value: Column, key: Column) -> Column:
    digits = digits_of(value)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    made = let(feistel_characters(body, key, F.lit("card")), lambda moved: F.concat(moved, check_digit(moved)))
    return in_place(value, made)


#: First digits of card issuers, and the lengths of their numbers.
ISSUERS = (
    ("4", (13, 16, 19)), ("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|220[0-4]", (16,)), ("3[47]", (15,)),
    ("30[0-5]|3095|3[689]", (14, 16, 17, 18, 19)), ("352[89]|35[3-8]|6011|64[4-9]|65|62|81", (16, 17, 18, 19)),
    ("50|5[6-8]|6304|67", (13, 14, 15, 16, 17, 18, 19)),
)
ISSUED = "^(?:" + "|".join("(?:" + "|".join(f"(?=[0-9]{{{length}}}$)" for length in lengths) + f")(?:{first})"
                           for first, lengths in ISSUERS) + ")"
#: Digits as cards show them: unbroken, in halves, or in the groups of the networks.
CARD_SHAPE = ("^(?:[0-9]{13,19}|[0-9]{8}[ -][0-9]{8}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?:\\1[0-9]{3})?"
              "|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{4,5})$")
#: Groups of a number of such a shape, at most.
CARD_GROUPS = 5


def cards(value: Column, key: Column) -> Column:
    """Struct (made, n): a run of digit groups with its card numbers replaced, from the left, the longest at each place."""
    return let(F.split(value, "(?<=[ -])"), lambda groups: _cards(groups, key))


def _cards(groups: Column, key: Column) -> Column:
    def shown(first: Column, last: Column) -> Column:
        return F.regexp_replace(F.array_join(F.slice(groups, first, last - first + 1), ""), "[ -]$", "")

    def valid(text: Column) -> Column:
        return text.rlike(CARD_SHAPE) & digits_of(text).rlike(ISSUED) & _is_card(text)

    size = F.size(groups)
    starts = F.filter(F.sequence(F.lit(1), size), lambda first: F.element_at(groups, first).rlike(
        "^(?:[0-9]{4}|[0-9]{8}|[0-9]{13,19})[ -]?$"))
    spans = F.transform(starts, lambda first: F.struct(first.alias("first"), F.array_max(F.filter(
        F.sequence(first, F.least(first + CARD_GROUPS - 1, size)), lambda last: valid(shown(first, last)))).alias("last")))
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, span: Column) -> Column:
        before = F.array_join(F.slice(groups, done["at"], span["first"] - done["at"]), "")
        mark = F.regexp_extract(F.element_at(groups, span["last"]), "[ -]$", 0)
        made = F.concat(before, _one_card(shown(span["first"], span["last"]), key), mark)
        return F.when(span["first"] < done["at"], done).otherwise(F.struct(
            (span["last"] + 1).alias("at"), F.array_append(done["parts"], made).alias("parts")))

    def finish(done: Column) -> Column:
        return F.struct(F.concat(F.array_join(done["parts"], ""), F.array_join(F.slice(groups, done["at"], size), "")).alias("made"),
                        F.size(done["parts"]).alias("n"))

    return F.aggregate(F.filter(spans, lambda span: span["last"].isNotNull()), none, step, finish)


#: Country calling codes. Those of one and two digits; all others have three.
CALLING = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def phone(value: Column, key: Column) -> Column:
    """Country code and trunk 0 stay; the national number is the same in every notation."""
    def moved(digits: Column) -> Column:
        kept = F.when(value.startswith("+"), F.regexp_extract(digits, CALLING, 0)).otherwise(F.regexp_extract(digits, "^0*", 0))
        national = F.substr(digits, F.length(kept) + 1, F.length(digits))
        return F.when(F.length(digits).between(7, 15) & (F.length(national) >= 5), in_place(
            value, F.concat(kept, feistel_characters(national, key, F.lit("phone")))))

    return let(digits_of(value), moved)


def social(value: Column, key: Column) -> Column:
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(part)).cast("long") for part in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(place * SSN_GROUPS + group - 1, serial - 1, SSN_AREAS * SSN_GROUPS, SSN_SERIALS, key, "social")
    made = let(pair, lambda p: F.concat_ws(
        "-", F.lpad(_area(F.floor(p["l"] / SSN_GROUPS)).cast("string"), 3, "0"),
        F.lpad((p["l"] % SSN_GROUPS + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0")))
    return F.when(valid, made)


def _area(place: Column) -> Column:
    return F.when(place >= 665, place + 2).otherwise(place + 1)


def address(value: Column, key: Column) -> Column:
    parts = [F.split_part(value, F.lit("."), F.lit(part)).cast("long") for part in (1, 2, 3, 4)]
    valid = (parts[0] <= 255) & (parts[1] <= 255) & (parts[2] <= 255) & (parts[3] <= 255)
    pair = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, key, "address")
    made = let(pair, lambda p: F.concat_ws(
        ".", *[number.cast("string") for half in ("l", "r") for number in (F.floor(p[half] / 256), p[half] % 256)]))
    return F.when(valid, made)


def address6(value: Column, key: Column) -> Column:
    """All eight groups, in full. The network part is permuted by itself, so machines of one network stay in one."""
    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda group: group != "")

    halves = F.split(F.lower(value), "::")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.when((missing == 0) | ((missing > 0) & value.contains("::")), F.concat(
        left, F.array_repeat(F.lit("0"), missing), right))

    def moved(all_groups: Column) -> Column:
        words = [F.conv(F.concat(*[F.lpad(F.get(all_groups, F.lit(2 * at + side)), 4, "0") for side in (0, 1)]), 16, 10).cast("long")
                 for at in range(4)]
        size = 1 << 32
        return let(feistel(words[0], words[1], size, size, key, "network"), lambda net: let(
            feistel(words[2], words[3], size, size, F.concat_ws("|", key, words[0].cast("string"), words[1].cast("string")), "machine"),
            lambda own: F.regexp_replace(F.concat(*[F.lower(F.lpad(F.hex(pair[half]), 8, "0")) for pair in (net, own) for half in ("l", "r")]),
                                         "(?<!^)(?=(?:[0-9a-f]{4})+$)", ":")))

    return F.when(whole.isNotNull(), let(whole, moved))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def date(value: Column, key: Column) -> Column:
    """Year first, or day first, or month first where that alone is a date."""
    marks = F.regexp_replace(value, "[./]", "-")
    # How a value may be read, and how its pseudonym is written.
    styles = (
        (value.rlike("^[0-9]{4}-"), value, "yyyy-MM-dd", "yyyy-MM-dd"),
        (value.rlike("^[A-Z]"), value, "MMMM d, yyyy", "MMMM d, yyyy"),
        (value.rlike("[A-Z]"), value, "d MMMM yyyy", "d MMMM yyyy"),
        (value.rlike(r"^[0-9]{2}\.[0-9]{2}\."), marks, "dd-MM-yyyy", "dd.MM.yyyy"),
        (value.rlike(r"\."), marks, "d-M-yyyy", "d.M.yyyy"),
        (F.try_to_date(marks, "dd-MM-yyyy").isNotNull(), marks, "dd-MM-yyyy", "dd/MM/yyyy"),
        (F.lit(True), marks, "MM-dd-yyyy", "MM/dd/yyyy"),
    )
    found, shown = F.lit(None).cast("date"), F.lit(None).cast("string")

    def made(day: Column) -> Column:
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = feistel(F.floor(number / DAYS[1]), number % DAYS[1], DAYS[0], DAYS[1], key, "date")
        return F.when(number.between(0, DAYS[0] * DAYS[1] - 1), let(pair, lambda p: let(F.date_add(
            F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")), written)))

    def written(day: Column) -> Column:
        text = shown
        for style, _, _, pattern in reversed(styles):
            text = F.when(style, F.date_format(day, pattern)).otherwise(text)
        return text

    for style, read, pattern, _ in reversed(styles):
        found = F.when(style, F.try_to_date(read, pattern)).otherwise(found)
    return let(found, made)


def account(value: Column, key: Column) -> Column:
    """The longest valid account number that ``value`` starts with and that ends with a group; what follows stays."""
    ends = F.filter(F.sequence(F.lit(15), F.greatest(F.length(value), F.lit(15))), lambda end: (
        F.substr(value, end + 1, F.lit(1)).isin("", " ") & (F.substr(value, end, F.lit(1)) != " ")
        & _is_account(F.substr(value, F.lit(1), end))))
    return let(F.array_max(ends), lambda end: F.when(end.isNotNull(), F.concat(
        _one_account(F.substr(value, F.lit(1), end), key), F.substr(value, end + 1, F.length(value)))))


def _is_account(value: Column) -> Column:
    return let(F.regexp_replace(value, " ", ""), lambda bare: F.length(bare).between(15, 34) & (
        mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))) == 1))


def _one_account(value: Column, key: Column) -> Column:
    """International account numbers: country stays, check digits are computed anew."""
    bare = F.regexp_replace(value, " ", "")
    country, body = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5), F.length(bare))
    moved = feistel_characters(body, key, F.concat(F.lit("account"), country))
    made = let(moved, lambda m: F.concat(country, F.lpad(
        (F.lit(98) - mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))
    spaced = let(made, lambda whole: F.array_join(F.transform(characters(value), lambda c, at: F.when(
        c == " ", " ").otherwise(F.substr(whole, F.length(F.regexp_replace(
            F.substr(value, F.lit(1), at + 1), " ", "")), F.lit(1)))), ""))
    return spaced


def email(value: Column, key: Column) -> Column:
    """The local part; the domain stays and takes part in the key."""
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    return F.concat_ws("@", feistel_characters(local, key, F.concat(F.lit("email"), F.lower(domain))), domain)


#: Prefixes of access keys that tell what they are.
KEY_PREFIXES = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|[sprk]k_(?:live|test)_|xox[abprs]-|AIza|sk-"
ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"


def credential(value: Column, key: Column) -> Column:
    """Keys and passwords: what follows the fixed prefix or the assignment sign."""
    prefix = F.regexp_extract(value, rf"^(?:{ASSIGNED}|{KEY_PREFIXES})", 0)
    rest = F.substr(value, F.length(prefix) + 1, F.length(value))
    return F.concat(prefix, feistel_characters(rest, key, F.lit("credential")))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: The replaced value, or null if it isn't valid; of cards, a struct of the run and how many it held.
    pseudonym: Callable[[Column, Column], Column]
    #: How a matched value is known again, where the pattern looks at what surrounds it.
    again: str | None = None


#: Lengths of account numbers, by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account_pattern() -> str:
    """By the length of the country, so that no match reaches into the next field; then of any length."""
    exact = "|".join(
        f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(length - 4) // 4}}}"
        + (f" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else "") + "(?![A-Za-z0-9])" for length, countries in ACCOUNT_LENGTHS.items())
    return (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{exact}"
            r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))")


_LABEL = "[0-9A-Fa-f]{1,4}"
#: In order of precedence, cards after these. Every pattern starts where no value is under way, and quantifiers give nothing
#: back or are bounded.
OTHERS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,128}+@[A-Za-z0-9-][A-Za-z0-9.-]{0,251}\.[A-Za-z]{2,63}", email),
    Kind("credential", rf"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{{16}}|(?!A[KS]IA)(?:{KEY_PREFIXES})[A-Za-z0-9_-]{{16,255}}+)(?![A-Za-z0-9])"
                       rf"|(?<![A-Za-z]){ASSIGNED}(?=[A-Za-z/+_-]{{0,255}}[0-9])[A-Za-z0-9/+_-]{{8,512}}+", credential),
    Kind("account", _account_pattern(), account),
    Kind("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
                 rf"(?![0-9]|[./-][0-9])|(?<![A-Za-z0-9.,-])(?:[0-9]{{1,2}} (?:{MONTHS})|(?:{MONTHS}) [0-9]{{1,2}},) [0-9]{{4}}(?![0-9])", date),
    Kind("address", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", address),
    Kind("address6", rf"(?<![0-9A-Za-z:.])(?:(?:{_LABEL}:){{7}}{_LABEL}|(?:{_LABEL}:){{2,6}}(?::{_LABEL}){{1,5}}|{_LABEL}:(?::{_LABEL}){{2,6}})"
                     r"(?![0-9A-Za-z:])", address6),
    Kind("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", social),
    Kind("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
                  r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9]|-[0-9])"
                  r"|(?<![A-Za-z])(?i:tel|telephone|telefon|phone|fon|fax|mobile?|handy)(?:[.:]|\.:)? ?0[0-9]{1,4}(?:[ /-]?[0-9]{2,8}){1,4}(?![0-9])",
         phone),
)
#: A run of digit groups with 13 digits at least. It ends before a value of another kind, and before a group that a letter or a
#: decimal follows. Possessive groups are matched in a loop, so a run may have any length.
_GROUP = r"[0-9]++(?![A-Za-z]|\.[0-9])"
_RUN = (rf"(?<![0-9A-Za-z.-])(?=[0-9](?:[ -]?[0-9]){{12}}){_GROUP}"
        rf"(?:[ -](?!{'|'.join(f'(?:{kind.pattern})' for kind in OTHERS)}){_GROUP})*+")
KINDS = (*OTHERS, Kind("card", _RUN, cards, again="[0-9][0-9 -]*"))


def _combined() -> str:
    return "|".join(f"(?:{kind.pattern})" for kind in KINDS)


PATTERN = _combined()


def pseudonym(value: Column, key: Column) -> Column:
    """Struct (made, n): what a match is replaced by, and how many valid values it held."""
    made = None
    for kind in KINDS:
        test = value.rlike(f"^(?:{kind.again or kind.pattern})$")
        found = kind.pseudonym(value, key)
        if kind.name != "card":
            found = let(found, lambda one: F.struct(F.coalesce(one, value).alias("made"), one.isNotNull().cast("int").alias("n")))
        made = F.when(test, found) if made is None else made.when(test, found)
    return F.coalesce(made, F.struct(value.alias("made"), F.lit(0).alias("n")))


def pseudonymised(df: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``df`` with the values in ``text`` replaced, ``n_chars`` (if there is one) counted anew."""
    columns = [F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row")]
    whole = df.select(*columns)
    source = F.col(f"row.{text}")
    cut = whole.withColumn("found", F.when(
        source.rlike("[0-9@=:]"), F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0))))
    some = F.coalesce(F.size("found") > 0, F.lit(False))
    parts = cut.withColumn("gaps", F.when(some, F.split(source, PATTERN, -1))).withColumn(
        "named", F.when(some, F.transform("found", lambda value: pseudonym(value, F.lit(key)))))
    joined = F.array_join(F.zip_with("gaps", "named", lambda gap, name: F.concat(gap, F.coalesce(name["made"], F.lit("")))), "")
    made = parts.select("row", F.when(some, joined).otherwise(source).alias("made"), F.coalesce(F.aggregate(
        "named", F.lit(0).cast("long"), lambda total, name: total + name["n"]), F.lit(0).cast("long")).alias("changed"))
    replaced = {text: F.col("made")}
    if "n_chars" in df.columns:
        replaced["n_chars"] = F.length("made").cast(df.schema["n_chars"].dataType)
    return made.select(*[replaced.get(name, F.col(f"row.`{name}`")).alias(name) for name in df.columns],
                       *([] if "n_replaced" in df.columns else [F.col("changed").alias("n_replaced")]))
