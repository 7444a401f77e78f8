"""Format-preserving Feistel pseudonyms for personal data, in built-in functions only.

One pattern finds candidates; each is validated by kind, and what passes is replaced
by a keyed permutation of its own format: digits stay digits, a card number keeps a
right check digit, an address of four octets stays one, a date stays a real date
written the same way. The permutation depends on the key and the value alone, so equal
values get equal pseudonyms in all documents, and no table of values is kept.

Kinds: payment cards (13 to 19 digits, Luhn), telephone numbers, IPv4 addresses
(octets up to 255), dates from 1900-01-01 to 2099-12-31 (Y-M-D, M/D/Y or else D/M/Y,
D.M.Y), social security numbers, e-mail addresses (the part before @) and access keys.
A run of numbers that is no card as a whole is searched again, cut at its separators:
cards first, longest from the left, then dates, telephones and social security numbers
between them. A candidate that fails its check is left as it is.

Defined results: a null text stays null with no pseudonyms; an empty text stays
empty; repeated rows stay repeated; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: Half sizes of the date permutation: 270 * 271 covers the 73,049 days of 1900 to 2099.
DATE_HALVES = (270, 271)
DATE_WALK = 12

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_KEY = r"\bAKIA[0-9A-Z]{16}\b"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
_PHONE = r"(?<![0-9.-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
# A run of numbers of any length: a card may stand anywhere in it. It stops before an
# address or a date with dots or slashes.
_NOT_CARD = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9]|[./-][0-9])"
_CARD = r"(?<![0-9])[0-9](?:(?:[ -](?!" + _NOT_CARD + r"))?[0-9]){12,}+"
#: What is looked for between the cards of a run.
_INSIDE = "|".join((_DATE, _PHONE, _SSN))
_MOST_GROUPS = 19
PATTERN = "|".join((_EMAIL, _KEY, _DATE, _PHONE, _SSN, _IP, _CARD))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2**48."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _shifted(half: Column, kinds: Column, digest: Column) -> Column:
    """Each character moved inside its own alphabet by an amount from ``digest``."""
    def one(c: Column, i: Column) -> Column:
        kind = kinds.substr(i + 1, F.lit(1))
        base = F.when(kind == "d", 48).when(kind == "n", 50).when(kind == "l", 97).when(kind == "u", 65)
        size = F.when(kind == "d", 10).when(kind == "n", 8).otherwise(26)
        step = F.conv(digest.substr((i * 3) % 60 + 1, F.lit(3)), 16, 10).cast("int")
        return F.when(base.isNull(), c).otherwise(F.char(base + (F.ascii(c) - base + step) % size))

    return F.when(F.length(half) == 0, half).otherwise(
        F.array_join(F.transform(F.split(half, ""), one), ""))


def permute_text(value: Column, kinds: Column, key: str) -> Column:
    """A keyed permutation of strings; every place keeps its alphabet.

    ``kinds`` has one letter per character: d (0-9), n (2-9), l (a-z), u (A-Z);
    anything else stays. The two halves move in turn, each by what the other says.
    """
    cut = F.ceil(F.length(value) / 2).cast("int")
    rest = F.length(value)
    start = F.struct(value.substr(F.lit(1), cut).alias("a"), value.substr(cut + 1, rest).alias("b"))
    ka, kb = kinds.substr(F.lit(1), cut), kinds.substr(cut + 1, rest)

    def turn(state: Column, r: Column) -> Column:
        def digest(other: Column) -> Column:
            return F.sha2(F.concat_ws(":", F.lit(key), r.cast("string"), kinds, other), 256)

        odd = r % 2 == 1
        return F.struct(
            F.when(odd, _let(digest(state["b"]), lambda d: _shifted(state["a"], ka, d)))
            .otherwise(state["a"]).alias("a"),
            F.when(odd, state["b"])
            .otherwise(_let(digest(state["a"]), lambda d: _shifted(state["b"], kb, d))).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn,
                       lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, halves: tuple[int, int], key: str) -> Column:
    """A keyed permutation of the numbers below ``halves[0] * halves[1]``."""
    size_a, size_b = halves
    start = F.struct(F.floor(value / size_b).cast("long").alias("a"), (value % size_b).cast("long").alias("b"))

    def turn(state: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, (state["a"] + _number(key, r, state["b"])) % size_a).otherwise(state["a"]).alias("a"),
            F.when(odd, state["b"]).otherwise((state["b"] + _number(key, r, state["a"])) % size_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn,
                       lambda s: s["a"] * size_b + s["b"])


def _kinds(value: Column) -> Column:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(value, "0123456789" + letters + letters.upper(), "d" * 10 + "l" * 26 + "u" * 26)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum when ``digits`` is followed by a check digit of zero."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
            i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, d: a + d)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _written_like(digits: Column, value: Column) -> Column:
    """``digits`` with the separators of ``value``."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), digits.substr(F.length(_digits(value.substr(F.lit(1), i + 1))), F.lit(1)))
        .otherwise(c)), "")


def _is_card(digits: Column) -> Column:
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    return F.length(digits).between(13, 19) & (_check_digit(body) == digits.substr(F.length(digits), F.lit(1)))


def _card(value: Column, key: str) -> Column:
    def by_digits(d: Column) -> Column:
        body = d.substr(F.lit(1), F.length(d) - 1)
        new = _let(permute_text(body, F.repeat(F.lit("d"), F.length(body)), f"{key}:card"),
                   lambda p: F.concat(p, _check_digit(p)))
        return F.when(_is_card(d), _let(new, lambda n: _written_like(n, value)))

    return _let(_digits(value), by_digits)


def _replaced(text: Column, pattern: str, new_of) -> Column:
    """``text, n``: what ``pattern`` finds replaced by ``new_of``, which gives ``text, n`` or null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda m: F.struct(m.alias("old"), new_of(m).alias("new")))
    return _let(found, lambda f: F.struct(
        F.array_join(F.flatten(F.zip_with(
            F.split(text, pattern), f,
            lambda piece, m: F.array(piece, F.coalesce(m["new"]["text"], m["old"], F.lit(""))))), "").alias("text"),
        F.aggregate(f, F.lit(0), lambda a, m: a + F.coalesce(m["new"]["n"], F.lit(0))).alias("n")))


def _one(new: Column) -> Column:
    return _let(new, lambda v: F.when(v.isNotNull(), F.struct(v.alias("text"), F.lit(1).alias("n"))))


def _run(value: Column, key: str) -> Column:
    """``text, n`` of a run of numbers that is no card as a whole."""
    def glue(groups: Column, start: Column, count: Column) -> Column:
        return F.array_join(F.slice(groups, start + 1, count), "")

    def cards(groups: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,n:int>>").alias("cuts"))

        def longest(at: Column) -> Column:
            some = F.slice(groups, at + 1, F.lit(_MOST_GROUPS))
            return _let(some, lambda w: F.array_max(F.filter(
                F.sequence(F.lit(1), F.size(w)), lambda k: _is_card(_digits(glue(w, F.lit(0), k))))))

        def step(state: Column, at: Column) -> Column:
            found = F.when(at >= state["next"], longest(at))
            return _let(found, lambda k: F.when(k.isNull(), state).otherwise(F.struct(
                (at + k).alias("next"),
                F.concat(state["cuts"], F.array(F.struct(at.alias("at"), k.alias("n")))).alias("cuts"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda s: s["cuts"])

    def gap(text: Column) -> Column:
        lead = F.regexp_extract(text, "^[ -]?", 0)
        rest = text.substr(F.length(lead) + 1, F.length(text))
        inside = _replaced(rest, _INSIDE, lambda m: _one(
            F.when(m.rlike(f"^(?:{_DATE})$"), _date(m, key))
            .when(m.rlike(f"^(?:{_SSN})$"), _written(m, key)).otherwise(_phone(m, key))))
        return _let(inside, lambda i: F.struct(F.concat(lead, i["text"]).alias("text"), i["n"].alias("n")))

    def card(text: Column) -> Column:
        return F.struct(_card(text, key).alias("text"), F.lit(1).alias("n"))

    def rebuilt(groups: Column, cuts: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["at"] + c["n"]))
        parts = F.flatten(F.transform(F.arrays_zip(ends.alias("end"), cuts.alias("cut")), lambda p: F.array(
            gap(glue(groups, p["end"], F.coalesce(p["cut"]["at"], F.size(groups)) - p["end"])),
            F.when(p["cut"].isNotNull(), card(glue(groups, p["cut"]["at"], p["cut"]["n"]))))))
        return _let(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.struct(
            F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"),
            F.aggregate(p, F.lit(0), lambda a, x: a + x["n"]).alias("n")))

    # Each group with the separator before it.
    groups = F.regexp_extract_all(value, F.lit("[ -]?[0-9]+"), F.lit(0))
    return _let(groups, lambda g: _let(cards(g), lambda c: rebuilt(g, c)))


def _phone(value: Column, key: str) -> Column:
    def by_digits(all_digits: Column) -> Column:
        country = all_digits.substr(F.lit(1), F.length(all_digits) - 10)
        local = all_digits.substr(F.length(all_digits) - 9, F.lit(10))
        kinds = F.concat(
            F.when(local.substr(1, 1) >= "2", "n").otherwise("d"), F.lit("dd"),
            F.when(local.substr(4, 1) >= "2", "n").otherwise("d"), F.lit("dddddd"))
        new = F.concat(country, permute_text(local, kinds, f"{key}:phone"))
        return _let(new, lambda n: _written_like(n, value))

    return _let(_digits(value), by_digits)


def _ip(value: Column, key: str) -> Column:
    def by_octets(o: Column) -> Column:
        fits = F.forall(o, lambda x: x <= 255)
        number = F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        new = permute_number(number, (65536, 65536), f"{key}:ip")
        return F.when(fits, _let(new, lambda n: F.concat_ws(
            ".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))))

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), by_octets)


def _date(value: Column, key: str) -> Column:
    iso, us = value.rlike("^[0-9]{4}-"), value.contains("/")

    def written(day_: Column) -> Column:
        return F.when(iso, F.date_format(day_, "yyyy-MM-dd")).when(
            day_first, F.date_format(day_, "dd/MM/yyyy")).when(
            us, F.date_format(day_, "MM/dd/yyyy")).otherwise(F.date_format(day_, "dd.MM.yyyy"))

    year = F.when(iso, value.substr(1, 4)).otherwise(value.substr(7, 4))
    month = F.when(iso, value.substr(6, 2)).when(us, value.substr(1, 2)).otherwise(value.substr(4, 2))
    day = F.when(iso, value.substr(9, 2)).when(us, value.substr(4, 2)).otherwise(value.substr(1, 2))
    epoch, last = F.lit("1900-01-01").cast("date"), 73048

    def permuted(index: Column) -> Column:
        # Walk the cycle until the number is a day again; the domain is 99.8 % days.
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(DATE_WALK)),
            permute_number(index, DATE_HALVES, f"{key}:date"),
            lambda x, _: F.when(x > last, permute_number(x, DATE_HALVES, f"{key}:date")).otherwise(x))
        return F.when(index.between(0, last), _let(walked, lambda w: F.when(
            w <= last, written(F.date_add(epoch, w.cast("int"))))))

    parsed = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    other = F.when(us, F.try_to_date(F.concat_ws("-", year, day, month), "yyyy-MM-dd"))
    day_first = us & parsed.isNull()
    parsed = F.coalesce(parsed, other)
    return _let(F.datediff(parsed, epoch).cast("long"), permuted)


def _written(value: Column, key: str) -> Column:
    return permute_text(value, _kinds(value), f"{key}:text")


def kind(value: Column) -> Column:
    """The kind of a candidate by its shape."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (F.when(value.contains("@"), "email").when(value.startswith("AKIA"), "key")
            .when(whole(_DATE), "date").when(whole(_SSN), "ssn").when(whole(_IP), "ip")
            .when(whole(_PHONE), "phone").otherwise("card"))


def pseudonym(value: Column, key: str) -> Column:
    """``text, n`` of one candidate: its pseudonym and how many values it held; null when nothing passed."""
    def of(k: Column) -> Column:
        single = (
            F.when(k == "email", F.concat(_written(F.substring_index(value, "@", 1), key),
                                          F.lit("@"), F.substring_index(value, "@", -1)))
            .when(k == "key", F.concat(F.lit("AKIA"), _written(value.substr(5, 16), key)))
            .when(k == "date", _date(value, key))
            .when(k == "ssn", _written(value, key))
            .when(k == "ip", _ip(value, key))
            .when(k == "phone", _phone(value, key))
            .otherwise(_card(value, key)))
        # A run without a separator has nothing to search inside.
        inside = F.when((k == "card") & value.rlike("[ -]"), _run(value, key))
        return _let(_one(single), lambda one: F.coalesce(one, inside))

    return _let(kind(value), of)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text",
                 count_col: str | None = "n_pseudonyms") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised, and in ``count_col`` how many values were replaced.

    A column of that name must not be there already; None leaves the count out.

    Texts without a digit or @ are passed on after one cheap look. Pieces between
    candidates and their replacements are joined in order, so a pseudonym is never
    taken for a value again.
    """
    if count_col in docs.columns:
        raise ValueError(f"a column {count_col} is there already: name another count_col")
    text = F.col(text_col)
    made = F.when(text.rlike("[0-9@]"), _replaced(text, PATTERN, lambda m: pseudonym(m, key)))
    # The row travels as one struct: no name of its columns can clash with ours.
    made = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        made.alias("made"))
    text = F.coalesce("made.text", F.col(f"row.`{text_col}`"))
    count = [] if count_col is None else [F.coalesce("made.n", F.lit(0)).cast("long").alias(count_col)]
    return made.select(
        *[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *count)
