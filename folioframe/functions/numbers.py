"""Column functions that take printed numbers apart and read them.

A number is read under conventions, pairs of a decimal and a grouping mark. A
set of conventions is a bit mask over ``lexicon.CONVENTIONS``, so votes are
sums of bits and intersections are ``bit_and``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X
from .text import CODES, let, stripped

ALL = (1 << len(X.CONVENTIONS)) - 1
SPACES = ("\u00a0\u202f\u2009", "   ")
PER_UNIT = r"(?U)\s*/\s*([\p{L}.]+)\s*$"
MARK_FIRST = rf"(?U)^([A-Z]{{1,2}}\p{{Sc}}|\p{{Sc}}|(?:{CODES})(?=[\s0-9]))\s*"
MARK_LAST = rf"(?U)\s*([A-Z]{{1,2}}\p{{Sc}}|\p{{Sc}}|(?<=[0-9\s])(?:{CODES}))$"
# most cells: a number with at most a currency sign before it, and words without capitals inside, among them plain numbers
SIMPLE = r"^(\p{Sc})?([0-9]++(?:[.,][0-9]++)*+)$"
WORDY = r"^\p{L}?\p{Ll}++(?: (?:\p{L}?\p{Ll}++|[0-9]++))*+$"
#: Shapes of a core that need no trial of each convention, with the conventions that they fit.
SHAPES = ((r"^[0-9]+$", (1 << len(X.CONVENTIONS)) - 1), (r"^[0-9]+\.(?:[0-9]{1,2}|[0-9]{4,})$", 0b1111), (r"^[1-9][0-9]{0,2}(?:,[0-9]{3})+\.[0-9]+$", 0b1))
CORE = r"^[0-9](?:[0-9.,' ]*[0-9])?$"


def _without(text: Column, pattern: str) -> Column:
    return stripped(F.regexp_replace(text, pattern, ""))


def _signed(text: Column) -> Column:
    return text.rlike(r"^[-\u2212]")


def _unsigned(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"^[-\u2212]", ""))


def _mark(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def analyse(text: Column, joins: Column | None = None) -> Column:
    """struct(core, marker, percent, per, negative, space_at_join) of a printed cell.

    Stripped from the outside in: a unit after a slash, a percent sign,
    parentheses, a sign, one currency marker, CR, a second sign. ``core`` is
    what is printed from the first digit to the last when only digits and
    single marks are left and at most one thing said minus. ``joins`` are
    offsets where pieces were joined by a space.
    """
    joins = F.array().cast("array<int>") if joins is None else joins
    first = F.regexp_instr(text, F.lit("[0-9]")) - 1
    whole = F.regexp_extract(text, r"(?s)[0-9](?:.*[0-9])?", 0)

    def outer(t: Column) -> Column:
        return let(F.when(t.rlike(PER_UNIT), _without(t, PER_UNIT)).otherwise(t), lambda a: percented(t, a))

    def percented(t: Column, a: Column) -> Column:
        return let(_without(a, r"(?U)\s*%$"), lambda b: bracketed(t, a, b))

    def bracketed(t: Column, a: Column, b: Column) -> Column:
        paren = b.rlike(r"^\(.*\)$")
        return let(F.when(paren, stripped(F.regexp_replace(b, r"^\(|\)$", ""))).otherwise(b), lambda c: let(_unsigned(c), lambda d: marked(t, a, b, c, d)))

    def marked(t: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
        return let(_mark(d, MARK_FIRST), lambda m1: let(F.when(m1.isNotNull(), _without(d, MARK_FIRST)).otherwise(d), lambda e: ended(t, a, b, c, m1, e)))

    def ended(t: Column, a: Column, b: Column, c: Column, m1: Column, e: Column) -> Column:
        return let(F.when(m1.isNull(), _mark(e, MARK_LAST)), lambda m2: let(F.when(m2.isNotNull(), _without(e, MARK_LAST)).otherwise(e), lambda f: credited(t, a, b, c, F.coalesce(m1, m2), f)))

    def credited(t: Column, a: Column, b: Column, c: Column, m: Column, f: Column) -> Column:
        cr = f.rlike(r"(?U)\s*CR$")
        return let(
            _without(f, r"(?U)\s*CR$"),
            lambda g: let(F.when(m.isNull() & cr, _mark(g, MARK_LAST)), lambda m3: let(F.when(m3.isNotNull(), _without(g, MARK_LAST)).otherwise(g), lambda h: finished(t, a, b, c, cr, F.coalesce(m, m3), h))),
        )

    def finished(t: Column, a: Column, b: Column, c: Column, cr: Column, m: Column, h: Column) -> Column:
        signs = b.rlike(r"^\(.*\)$").cast("int") + _signed(c).cast("int") + cr.cast("int") + _signed(h).cast("int")
        good = let(_unsigned(h), lambda i: i.rlike(CORE) & ~i.rlike("[.,' ]{2}"))
        return F.struct(
            F.when((signs <= 1) & good, whole).alias("core"),
            m.alias("marker"),
            a.rlike(r"%$").alias("percent"),
            _mark(t, PER_UNIT).alias("per"),
            (signs > 0).alias("negative"),
            F.coalesce((first >= 0) & F.exists(joins, lambda o: (o > first) & (o < first + F.length(whole) - 1)), F.lit(False)).alias("space_at_join"),
        )

    def quick(t: Column) -> Column:
        plain = lambda core, marker: F.struct(core.alias("core"), marker.alias("marker"), F.lit(False).alias("percent"), F.lit(None).cast("string").alias("per"), F.lit(False).alias("negative"), F.lit(False).alias("space_at_join"))
        none = F.lit(None).cast("string")
        return F.when(t.rlike(SIMPLE), plain(F.regexp_extract(t, SIMPLE, 2), F.nullif(F.regexp_extract(t, SIMPLE, 1), F.lit("")))).when(t.rlike(WORDY), plain(none, none)).otherwise(outer(t))

    return let(stripped(F.translate(text, *SPACES)), quick)


def _pattern(decimal: str, grouping: str) -> str:
    grouped = rf"|[1-9][0-9]{{0,2}}(?:{re.escape(grouping)}[0-9]{{3}})+" if grouping else ""
    return rf"^([0-9]+{grouped})(?:{re.escape(decimal)}([0-9]+))?$"


def valid_mask(parts: Column) -> Column:
    """The conventions under which the core is a number; a space made by joining pieces groups nothing."""

    def mask(core: Column) -> Column:
        total = F.lit(0)
        for k, (decimal, grouping) in enumerate(X.CONVENTIONS):
            good = core.rlike(_pattern(decimal, grouping))
            if grouping == " ":
                good = good & ~parts["space_at_join"]
            total = total + F.when(good, 1 << k).otherwise(0)
        known = F.when(core.isNull(), 0)
        for pattern, fits in SHAPES:
            known = known.when(core.rlike(pattern), fits)
        return known.otherwise(total)

    return let(F.translate(parts["core"], *SPACES), mask)


def read(parts: Column, mask: Column) -> Column:
    """struct(status, value, dp, grouped, other) under a set of conventions.

    status is ok (one value), ambiguous (value and other differ), unreadable
    (a core that fits no convention of the set) or text (no core).
    """

    def sign(v: Column) -> Column:
        return F.when(parts["negative"] & (v != 0), -v).otherwise(v)

    def readings(core: Column) -> Column:
        under = []
        for k, (decimal, grouping) in enumerate(X.CONVENTIONS):
            pattern = _pattern(decimal, grouping)
            allowed = (mask.bitwiseAND(F.lit(1 << k)) != 0) & core.rlike(pattern)
            if grouping == " ":
                allowed = allowed & ~parts["space_at_join"]
            digits = F.regexp_extract(core, pattern, 1)
            plain = F.replace(digits, F.lit(grouping), F.lit("")) if grouping else digits
            fraction = F.regexp_extract(core, pattern, 2)
            one = F.struct(F.concat(plain, F.lit("."), fraction, F.lit("0")).cast("double").alias("value"), F.length(fraction).alias("dp"), (plain != digits).alias("grouped"))
            under.append(F.when(allowed, one))
        return F.filter(F.array(*under), lambda r: r.isNotNull())

    def decide(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        other = F.get(F.filter(found, lambda r: r["value"] != first["value"]), F.lit(0))
        status = F.when(parts["core"].isNull(), "text").when(F.size(found) == 0, "unreadable").when(other.isNotNull(), "ambiguous").otherwise("ok")
        return F.struct(
            status.alias("status"),
            F.when(parts["core"].isNotNull(), sign(first["value"])).alias("value"),
            first["dp"].alias("dp"),
            first["grouped"].alias("grouped"),
            sign(other["value"]).alias("other"),
        )

    def one(core: Column, fits: int) -> Column:
        """The reading of a core that has one value under each convention that it fits."""
        allowed = mask.bitwiseAND(F.lit(fits)) != 0
        fraction = F.when(F.contains(core, F.lit(".")), F.length(F.substring_index(core, ".", -1))).otherwise(0)
        value = sign(F.replace(core, F.lit(","), F.lit("")).cast("double"))
        made = (F.when(allowed, "ok").otherwise("unreadable"), F.when(allowed, value), F.when(allowed, fraction), F.when(allowed, F.contains(core, F.lit(","))), F.lit(None).cast("double"))
        return F.struct(*(c.alias(n) for c, n in zip(made, ("status", "value", "dp", "grouped", "other"), strict=True)))

    def quick(core: Column) -> Column:
        nothing = (F.lit("text"), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("double"))
        known = F.when(core == "", F.struct(*(c.alias(n) for c, n in zip(nothing, ("status", "value", "dp", "grouped", "other"), strict=True))))
        for pattern, fits in SHAPES:
            known = known.when(core.rlike(pattern), one(core, fits))
        return known.otherwise(let(F.coalesce(readings(core), F.array()), decide))

    return let(F.translate(F.coalesce(parts["core"], F.lit("")), *SPACES), quick)


def currency_code(marker: Column) -> Column:
    """The ISO code of a marker that names one currency; else null."""
    trimmed = F.trim(marker)
    symbols = F.create_map(*[F.lit(x) for pair in X.CURRENCY_SYMBOLS.items() for x in pair])
    return F.when(trimmed.isin(*X.CURRENCY_CODES), trimmed).otherwise(F.try_element_at(symbols, trimmed))


def vote_bits(mask: Column) -> list[Column]:
    """For an aggregate: how many masks hold each convention."""
    return [F.sum(F.shiftright(mask, k).bitwiseAND(F.lit(1))).alias(f"v{k}") for k in range(len(X.CONVENTIONS))]


def voted_mask(prefix: str = "v") -> Column:
    """The conventions with most votes, ties kept; all of them where there is no vote."""
    most = F.greatest(*(F.col(f"{prefix}{k}") for k in range(len(X.CONVENTIONS))))
    kept = sum((F.when(F.col(f"{prefix}{k}") == most, 1 << k).otherwise(0) for k in range(len(X.CONVENTIONS))), F.lit(0))
    return F.when(F.coalesce(most, F.lit(0)) > 0, kept).otherwise(ALL)


def marks_of(mask: Column) -> Column:
    """struct(decimal, grouping): the marks that all conventions of the set share; null where they differ."""

    def shared(i: int) -> Column:
        values = F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, F.lit(pair[i])) for k, pair in enumerate(X.CONVENTIONS))), lambda v: v.isNotNull())
        return F.when(F.size(F.array_distinct(values)) == 1, F.get(values, F.lit(0)))

    return F.struct(shared(0).alias("decimal"), shared(1).alias("grouping"))


def written(value: Column, dp: Column, mask: Column, marker: Column, after: Column) -> Column:
    """A calculated value in the style of the page: its marks, decimals, currency marker and side.

    ``dp`` is kept within 0 and 10; the value is rounded half away from zero.
    """
    places = F.least(F.greatest(dp, F.lit(0)), F.lit(X.MAX_DP))
    digits = F.lit(None).cast("string")
    for k in range(X.MAX_DP, -1, -1):
        digits = F.when(places == k, F.replace(F.format_number(F.abs(value).try_cast("decimal(38,15)").cast("decimal(38,14)").cast(f"decimal(38,{k})"), k), F.lit(","), F.lit(""))).otherwise(digits)

    def style(text: Column) -> Column:
        marks = marks_of(mask)
        grouping, decimal = F.coalesce(marks["grouping"], F.lit("")), F.coalesce(marks["decimal"], F.lit("."))
        whole, fraction = F.substring_index(text, ".", 1), F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1))
        grouped = F.when(grouping == "", whole).otherwise(F.replace(F.regexp_replace(whole, r"\B(?=([0-9]{3})+$)", "\u0001"), F.lit("\u0001"), grouping))
        number = F.concat(grouped, F.coalesce(F.concat(decimal, fraction), F.lit("")))
        spaced = F.when(marker.rlike(r"\p{L}$"), F.concat(marker, F.lit(" "), number)).otherwise(F.concat(marker, number))
        dressed = F.when(F.coalesce(marker, F.lit("")) == "", number).when(after, F.concat(number, F.lit(" "), marker)).otherwise(spaced)
        return F.when((value < 0) & text.rlike("[1-9]"), F.concat(F.lit("-"), dressed)).otherwise(dressed)

    return let(digits, style)


def marker_after(text: Column, marker: Column) -> Column:
    """Whether the marker's last place is after the first digit."""
    behind = F.length(F.call_function("substring_index", text, marker, F.lit(-1)))
    return F.coalesce(F.length(text) - behind - F.length(marker) + 1 > F.regexp_instr(text, F.lit("[0-9]")), F.lit(False))
