"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and digit counts confirm them, and words nearby raise or lower
the score.  A column function finds the gaps (``split``) and the matches (``regexp_extract_all``) of a pattern; their
lengths give the places.  The patterns are written so that one pass over a text is linear: runs are possessive and start
where a run starts, or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns.  Those of cards and phones contain the bound on digits, so that other runs are no matches at all:
# a run is maximal, and one that fails would be dropped without a retry.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])"
# The method's own: shapes that the base patterns run past because of digits next to them, account numbers, secrets.
CARD_ALONE = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
PHONE_ALONE = r"\+[0-9]{1,3}[\x20-]?\([0-9]{2,4}\)[\x20-]?[0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = (r"(?i)(?:(?<=password[=:])|(?<=passwd[=:])|(?<=token=)|(?<=token[=:]\x20?[\x22'])|(?<=token\x20[=:]\x20[\x22'])"
          r"|(?<=secret[=:])|(?<=api_key[=:]))[A-Za-z0-9_+/=-]{8,}+|(?<![A-Za-z0-9])(?-i:AKIA[0-9A-Z]{16})(?![A-Za-z0-9])")

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")
CONTEXT_CHARS = 48
ACCEPTED = 0.5
_SUMS_APART = 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """True if the digits of ``text`` pass Luhn's checksum."""
    backwards = F.reverse(digits(text))
    figures = F.transform(F.split(backwards, ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(F.filter(figures, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """True if ``text``, an account number, has the check digits of ISO 13616: 15 to 34 characters, remainder 1."""
    plain = F.regexp_replace(text, "[^A-Z0-9]", "")
    turned = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    remainder = F.aggregate(turned, F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (remainder == 1)


def octets(text: Column) -> Column:
    """True if no part is above 255; leading zeros do not count."""
    return F.forall(F.split(text, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike(
        "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


@dataclass(frozen=True)
class Finder:
    """One way to find a kind: what must be in a text at all, the pattern, the validator and the score of a valid match."""

    kind: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float = 1.0
    words: str = ""
    against: str = r"(?i)\b(?:isbn|version|build|order|serial|sku)\b"


def _always(_: Column) -> Column:
    return F.lit(True)


BASE = (
    Finder("email", EMAIL, lambda t: t.contains("@"), _always),
    Finder("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), octets),
    Finder("card", CARD, lambda t: t.rlike("[0-9][0-9 -]{11}"), luhn),
    Finder("phone", PHONE, lambda t: t.rlike(r"\+[0-9]"), _always),
)
ADDED = (
    Finder("card", CARD_ALONE, lambda t: t.rlike("[0-9]{4}[ -]?[0-9]{4}"), luhn, 0.6, r"(?i)\b(?:card|visa|credit|debit|pan)\b"),
    Finder("phone", PHONE_ALONE, lambda t: t.rlike(r"\+[0-9]"), _always, 0.6, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Finder("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), mod97, 0.8, r"(?i)\b(?:iban|account|konto|bank)\b"),
    Finder("secret", SECRET, lambda t: t.rlike("(?i)passw|token|secret|api_key|AKIA"), _always, 0.5,
           r"(?i)(?:password|token|secret|key)"),
)


def matches(text: Column, finder: Finder) -> Column:
    """Array of ``(start, end, value)``, in code points, of the valid matches, in order of place."""
    pattern = F.lit(finder.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, finder.pattern, -1)
    zero, apart = F.lit(0), F.lit(_SUMS_APART)

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, zero, lambda a, x: a + x)

    def place(lengths: Column, sums: Column, value: Column, i: Column) -> Column:
        # Blocks are summed apart, so that a text of many matches does not take quadratic time.
        block = F.floor(i / apart).cast("int")
        end = total(F.slice(sums, 1, block)) + total(F.slice(lengths, block * apart + 1, i - block * apart + 1))
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

    def placed(values: Column, pieces: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda g, v: F.length(g) + F.length(v))
        sums = F.transform(F.sequence(zero, F.floor((F.size(values) - 1) / apart).cast("int")),
                           lambda b: total(F.slice(lengths, b * apart + 1, apart)))
        return _with(lengths, lambda l: _with(sums, lambda s: F.transform(values, lambda v, i: place(l, s, v, i))))

    every = _with(found, lambda values: F.when(F.size(values) > 0, placed(values, gaps)))
    chosen = F.filter(every, lambda m: finder.valid(m["value"]))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(finder.hint(text), F.coalesce(chosen, none)).otherwise(none)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column) -> Column:
    """Array of ``(rank, start, end, kind, value, score, base)`` of every span, ordered by kind and place.

    Base spans all stay.  The method adds spans of its own finders that touch no other span and whose score, the
    finder's and what the words around it add or take, reaches 0.5.
    """
    shape = "array<struct<rank:int,start:int,end:int,kind:string,value:string,score:double,base:boolean>>"

    def named(found: Column, kind: str, score: Callable[[Column], Column], base: bool) -> Column:
        return F.transform(found, lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            m["value"].alias("value"), score(m).alias("score"), F.lit(base).alias("base")))

    spans = F.concat(*(named(matches(text, f), f.kind, lambda _: F.lit(1.0), True) for f in BASE)).cast(shape)
    for finder in ADDED:
        def scored(m: Column) -> Column:
            before = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
            near = F.concat(F.substring(text, before + 1, m["start"] - before), F.lit(" "),
                            F.substring(text, m["end"] + 1, F.lit(CONTEXT_CHARS)))
            return F.lit(finder.score) + F.when(near.rlike(finder.words), 0.3).otherwise(0.0) - F.when(
                near.rlike(finder.against), 0.3).otherwise(0.0)

        more = named(matches(text, finder), finder.kind, scored, False).cast(shape)
        spans = _with(F.struct(spans.alias("a"), more.alias("b")), lambda pair: F.concat(pair["a"], F.filter(
            pair["b"], lambda m: (m["score"] >= ACCEPTED) & ~F.exists(
                pair["a"], lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"])))))
    return F.array_sort(spans)


def find_pii(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` and ``pii``, the spans of every whole text.

    Null and empty texts have none.  Rows are judged one by one, so repeated rows and ties need no rule, and an empty table
    gives an empty result.  ``columns`` must not be called ``pii``.
    """
    return docs.select(*columns, spans_of(F.coalesce(text, F.lit(""))).alias("pii"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of spans that overlap, the one that starts first.

    Null texts stay null, and all other columns as they are.
    """
    whole = F.col(text)
    spans = spans_of(F.coalesce(whole, F.lit("")))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def replaced(done: Column, span: Column) -> Column:
        inside = F.struct(done["parts"].alias("parts"), F.greatest(done["at"], span["end"]).alias("at"))
        gap = F.substring(whole, done["at"] + 1, span["start"] - done["at"])
        label = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        after = F.struct(F.concat(done["parts"], F.array(gap, label)).alias("parts"), span["end"].alias("at"))
        return F.when(span["start"] < done["at"], inside).otherwise(after)

    def rest(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(whole, done["at"] + 1, F.length(whole)))

    marked = docs.withColumn("_pii", by_place)
    folded = F.aggregate("_pii", start, replaced, rest)
    return marked.withColumn(text, F.when(F.size("_pii") > 0, folded).otherwise(whole)).drop("_pii")
