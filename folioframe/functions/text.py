"""Column functions on printed text: shapes, words, labels and titles.

All stay in the JVM. Unicode white space is matched with ``(?U)``; texts are
taken to be in NFC. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

SEPARATORS = r"[.,'\u00A0\u202F\u2009 ]"
# codes by first letter, so that a text tries some of them only
CODES = "|".join(f"{first}(?:{'|'.join(c[1:] for c in X.CURRENCY_CODES if c[0] == first)})" for first in sorted({c[0] for c in X.CURRENCY_CODES}))
CURRENCY = rf"(?:[A-Z]{{1,2}}\p{{Sc}}|\p{{Sc}}|(?:{CODES}))"
# possessive: what follows a number never begins with what the loop would give back, and a long text takes no stack
DIGITS = rf"[0-9]++(?:{SEPARATORS}[0-9]++)*+"
WHOLE_NUMBER = rf"^\(?[+\-\u2212]?(?:{CURRENCY}\s?)?{DIGITS}(?:\s?(?:{CURRENCY}|%))?\)?$"
NUMBER_FIRST = rf"^[+\-\u2212]?(?:{CURRENCY}\s?)?{DIGITS}"
UNIT_LENGTH, UNIT_WORDS = 10, 2
PERCENTAGE = r"[0-9]+(?:[.,][0-9]+)?(?U:\s?)%"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    A fold over nothing that ends in ``body``: taking an item out of a mapped
    array would work out the body's type and nullability anew for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, body)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    """Trimmed, each run of white space one space."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def cell_shape(text: Column) -> Column:
    """NUM for a number, NUMX for a number and a short unit, else TEXT."""

    def shape(cell: Column) -> Column:
        def with_unit(rest: Column) -> Column:
            return (rest != "") & (F.length(rest) <= UNIT_LENGTH) & (F.size(F.split(rest, " ")) <= UNIT_WORDS)

        unit = let(stripped(F.regexp_replace(cell, NUMBER_FIRST, "")), with_unit)
        return F.when(cell.rlike(WHOLE_NUMBER), "NUM").when(cell.rlike(NUMBER_FIRST) & unit, "NUMX").otherwise("TEXT")

    return let(squeezed(text), shape)


def is_separator(text: Column) -> Column:
    """Three or more marks and nothing else, no currency sign among them: a drawn line."""
    return let(stripped(text), lambda t: t.rlike(r"(?U)^[\p{P}\p{S}\s]{3,}$") & ~t.rlike(r"\p{Sc}"))


def broken_share(text: Column) -> Column:
    """Share of replacement and private-use characters among those that are no white space."""
    return let(F.regexp_replace(text, r"(?U)\s+", ""), lambda t: F.when(F.length(t) > 0, F.regexp_count(t, F.lit(r"[\uFFFD\p{Co}]")) / F.length(t)).otherwise(0.0))


def matching(text: Column) -> Column:
    """The form in which words are looked for: lower case, squeezed, without closing dots and colons."""
    return stripped(F.regexp_replace(squeezed(F.lower(text)), r"[.:]+$", ""))


def _whole(word: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}s?(?![\p{{L}}\p{{N}}])"


def _longest_first(words: Iterable[str]) -> list[str]:
    return sorted(words, key=lambda w: -len(w))


def has_word(text: Column, words: Iterable[str]) -> Column:
    """Whether one of the words (or its plural) stands in the text."""
    return matching(text).rlike("|".join(map(_whole, words)))


def found_word(text: Column, words: Iterable[str]) -> Column:
    """The longest of the words that stands in the text."""

    def which(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for word in reversed(_longest_first(words)):
            out = F.when(t.rlike(_whole(word)), word).otherwise(out)
        return out

    return let(matching(text), which)


def starts_with(text: Column, words: Iterable[str]) -> Column:
    """Whether the text begins with one of the words, or its plural, and a boundary."""
    return matching(text).rlike("^(?:" + "|".join(re.escape(w) for w in _longest_first(words)) + r")s?(?![\p{L}\p{N}-])")


def starts_with_total(text: Column) -> Column:
    return starts_with(text, [w for words in X.TOTAL_LABELS.values() for w in words])


def _every_header_word() -> list[str]:
    return [word for words in X.HEADER_WORDS.values() for word in words]


def _longer(word: str) -> list[str]:
    """The other heading words that hold the word."""
    return [o for o in _every_header_word() if o != word and re.search(rf"(?<!\w){re.escape(word)}s?(?!\w)", o)]


def _plain_headings() -> dict[str, str]:
    """The headings that are one heading word, or its plural, and what each names; none that names two."""
    out = {}
    for text in (word + s for word in _every_header_word() for s in ("", "s")):
        there = {w for w in _every_header_word() if re.search(rf"(?<![^\W_]){re.escape(w)}s?(?![^\W_])", text)}
        named = [role for role, words in X.HEADER_WORDS.items() if any(w in there and not there.intersection(_longer(w)) for w in words)]
        if len(named) == 1:
            out[text] = named[0]
    return out


def heading_words(header: Column) -> Column:
    """struct(role, tie, lone): the role a heading's words name, and whether they are "item" alone; a word inside a longer word that is also there has no say."""
    said_of = lambda role, tie, lone: F.struct(role.alias("role"), tie.alias("tie"), lone.alias("lone"))
    plain = F.create_map(*[F.lit(x) for pair in _plain_headings().items() for x in pair])

    def searched(t: Column) -> Column:
        there = {word: t.rlike(_whole(word)) for word in _every_header_word()}
        flags = {}
        for role, words in X.HEADER_WORDS.items():
            said = F.lit(False)
            for word in words:
                own = there[word]
                for other in _longer(word):
                    own = own & ~there[other]
                said = said | own
            flags[role] = said
        roles = F.filter(F.array(*(F.when(flag, F.lit(role)) for role, flag in flags.items())), lambda r: r.isNotNull())
        return let(roles, lambda found: said_of(F.when(F.size(found) == 1, F.get(found, F.lit(0))), F.size(found) > 1, F.lit(False)))

    def opinion(t: Column) -> Column:
        none = said_of(F.lit(None).cast("string"), F.lit(False), F.lit(False))
        known = lambda role: F.when(role.isNotNull(), said_of(role, F.lit(False), t.isin("item", "items"))).when(~t.rlike("|".join(map(_whole, _every_header_word()))), none).otherwise(searched(t))
        return let(F.try_element_at(plain, t), known)

    return F.when(header.isNotNull(), let(matching(header), opinion))


def opinion_beside(words: Column, beside_description: Column) -> Column:
    """struct(role, tie) of ``heading_words``: "item" alone means the description where no other column is one."""
    role = F.when(words["lone"] & ~beside_description, "description").otherwise(words["role"])
    return F.when(words.isNotNull(), F.struct(role.alias("role"), words["tie"].alias("tie")))


def header_opinion(header: Column, beside_description: Column) -> Column:
    """struct(role, tie): the role a heading names."""
    return let(heading_words(header), lambda words: opinion_beside(words, beside_description))


def tidy_label(text: Column) -> Column:
    """A label without percentages and marks; a hyphen between letters parts words."""
    bare = F.regexp_replace(matching(text), PERCENTAGE, " ")
    apart = F.regexp_replace(bare, r"(?<=\p{L})-(?=\p{L})", " ")
    return squeezed(F.regexp_replace(apart, r"(?U)[^\p{L}\p{N}#\s]", " "))


def _tidy(word: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w#\s]", " ", word.lower())).strip()


def totals_kind(text: Column) -> Column:
    """subtotal, gst, total or amount_due, when the whole label is one, or one with a tax basis; else null."""

    def kind(label: Column) -> Column:
        out = F.lit(None).cast("string")
        basis = {b: f"(?:(?:{'|'.join(words)}) (?:of )?(?:{'|'.join(X.TAX_WORDS)})|(?:{'|'.join(X.TAX_WORDS)}) (?:{'|'.join(words)}))" for b, words in X.BASIS_WORDS.items()}
        for name, words in reversed(X.TOTAL_LABELS.items()):
            phrases = "|".join(re.escape(_tidy(w)) for w in words)
            for b in ("inclusive", "exclusive"):
                says = "subtotal" if name == "total" and b == "exclusive" else name
                out = F.when(label.rlike(f"^(?:{phrases}) {basis[b]}$"), says).otherwise(out)
        for name, words in reversed(X.TOTAL_LABELS.items()):
            phrases = "|".join(re.escape(_tidy(w)) for w in words)
            out = F.when(label.rlike(f"^(?:{phrases})s?$"), name).otherwise(out)
        return out

    return let(tidy_label(text), kind)


def gst_basis(text: Column) -> Column:
    """inclusive or exclusive, when a tax word and a basis word stand in the text."""
    basis = F.when(has_word(text, X.BASIS_WORDS["inclusive"]), "inclusive").when(has_word(text, X.BASIS_WORDS["exclusive"]), "exclusive")
    return F.when(has_word(text, X.TAX_WORDS), basis)


LABEL_LINE = r"(?U)^\s*([^\s:]+(?:\s+[^\s:]+){0,2})(\s*):(.?)"


def label_part(line: Column) -> Column:
    """One to three words before a colon, unless the colon stands between digits as in a time; else null."""
    time = F.regexp_extract(line, LABEL_LINE, 1).rlike(r"\p{N}$") & (F.regexp_extract(line, LABEL_LINE, 2) == "") & F.regexp_extract(line, LABEL_LINE, 3).rlike(r"^\p{N}$")
    return F.when(line.rlike(LABEL_LINE) & ~time, F.regexp_extract(line, LABEL_LINE, 1))


def quoted_part(line: Column, words: Iterable[str]) -> Column:
    """The first part of a title, parted by dashes or bars, that has one of the words; else all of it."""
    words = tuple(words)
    parts = F.filter(F.split(line, r" (?:-|–|\|) "), lambda part: has_word(part, words))
    return stripped(F.coalesce(F.get(parts, F.lit(0)), line))


def singular(word: Column) -> Column:
    return let(
        F.lower(word),
        lambda w: F.when((F.length(w) > 3) & w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:ches|shes|xes|sses)$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", ""))
        .otherwise(w),
    )


def plain_number(value: Column) -> Column:
    """A number as text, without an exponent or closing zeros; null where it has more than 28 digits before the point."""
    return let(value.try_cast("decimal(38,10)"), lambda d: F.when(d == 0, "0").otherwise(F.regexp_replace(d.cast("string"), r"\.?0+$", "")))


def printed_value(number: Column) -> Column:
    """A printed count as a plain number, as text: thousands marks out, a single mark as the decimal mark."""
    marks = F.regexp_count(number, F.lit("[.,]"))
    value = F.when(marks == 0, plain_number(number)).when(number.rlike(r"^[0-9]{1,3}(?:[.,][0-9]{3})+$"), plain_number(F.regexp_replace(number, "[.,]", ""))).when(marks == 1, plain_number(F.replace(number, F.lit(","), F.lit("."))))
    return F.coalesce(value, number)


def column_key(header: Column, position: Column) -> Column:
    """The heading's words run together, each after the first with a capital; col1, col2, ... where there is none."""
    words = F.filter(F.split(F.lower(F.coalesce(header, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100000)))), "")
    return F.when(F.size(words) > 0, joined).otherwise(F.concat(F.lit("col"), (position + 1).cast("string")))


def listed(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def pages_text(pages: Column) -> Column:
    """'page 2', 'pages 1 to 4' or 'pages 1 and 3'."""

    def say(p: Column) -> Column:
        n = F.size(p)
        run = (n >= 3) & (F.element_at(p, -1) - F.get(p, F.lit(0)) == n - 1)
        first = F.get(p, F.lit(0)).cast("string")
        return (
            F.when(n == 0, "the document")
            .when(n == 1, F.concat(F.lit("page "), first))
            .when(run, F.concat(F.lit("pages "), first, F.lit(" to "), F.get(p, n - 1).cast("string")))
            .otherwise(F.concat(F.lit("pages "), listed(F.transform(p, lambda x: x.cast("string")))))
        )

    return let(F.array_sort(F.array_distinct(pages)), say)
