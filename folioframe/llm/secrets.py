"""Secret scans with multipart credential linking.

Three strong kinds (assign, access, hex) are found by pattern alone. Three
weak kinds, an account identifier, a bare random-looking token and a service
endpoint, are far too common to report by themselves. Each text is cut into
scopes (paragraphs ended by an empty line); within a scope the parts'
intervals are joined, and a weak part is reported only when it meets a
complementary part, anywhere in the scope or, if ``reach`` is given, at most
so many code points away:

* a token meets an identifier or an endpoint,
* an identifier meets a token or a strong assign or hex secret,
* an endpoint meets both an identifier and a secret.

The interval join runs on sorted starts inside one text, so it needs no
shuffle, and its work grows with the parts that overlap.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table

KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
STRONG = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")  # a value: what stands before an = is a name
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])([0-9+.-]*)[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+""")  # from the first letter of a run on
ASSIGN_HINTS = ("passw", "secret", "token", "key")
IDENTIFIER_HINTS = ("user", "login", "_id", "-id", "keyid", "clientid", "accountid")
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """The strong spans, by start and then kind: each kind leftmost and non-overlapping."""
    found: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(token: str) -> bool:
    """Letters and digits, mixed case or digits throughout, and at least 3.2 bits a character."""
    kinds = (any(c.isdigit() for c in token), any(c.islower() for c in token), any(c.isupper() for c in token))
    if not kinds[0] or sum(kinds) < 2:
        return False
    n = len(token)
    return -sum(k / n * log2(k / n) for k in Counter(token).values()) >= 3.2


class Cover:
    """Intervals by start, with the furthest end so far: whether any meets a given one is a binary search."""

    def __init__(self, spans: list[Span]) -> None:
        spans = sorted(spans)
        self.starts = [start for start, _, _ in spans]
        self.reach = list(accumulate((end for _, _, end in spans), max))

    def meets(self, low: int, high: int) -> bool:
        """Whether an interval starts below ``high`` and ends above ``low``."""
        n = bisect.bisect_left(self.starts, high)
        return n > 0 and self.reach[n - 1] > low


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak spans that overlap no strong one; none are looked for where no link is possible."""
    low = text.lower()
    named = any(hint in low for hint in IDENTIFIER_HINTS)
    endpoints = [(m.end(1), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not (named or endpoints or any(kind == 1 for _, kind, _ in base)):
        return []
    found = endpoints + ([(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if named else [])
    told = Cover(found)
    found += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if looks_random(m[0]) and not told.meets(m.start(), m.end())]
    strong = Cover(base)
    return [span for span in found if not strong.meets(span[0], span[2])]


def linked(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """The weak spans that meet complementary parts within their scope."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    # no part holds a line feed, so none reaches into another scope
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    secrets, names, endpoints = (Cover([span for span in base + weak if span[1] in kinds]) for kinds in ((0, 2, 4), (1, 3), (5,)))
    kept = []
    for span in weak:
        start, kind, end = span
        scope = bisect.bisect_right(ends, start)
        low = ends[scope - 1] if scope else -1
        high = ends[scope] if scope < len(ends) else len(text) + 1
        if reach is not None:
            low, high = max(start - reach - 1, low), min(end + reach + 1, high)
        secret, who, where = (cover.meets(low, high) for cover in (secrets, names, endpoints))
        if (kind == 4 and (who or where)) or (kind == 3 and secret) or (kind == 5 and who and secret):
            kept.append(span)
    return kept


def scan(text: str | None, reach: int | None = None) -> tuple[list[Span], list[Span]]:
    """All strong spans, and strong and linked weak spans together, both in order. Null is an empty text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + linked(text, base, reach))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the strong kinds, their digest, and all spans.

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans (the digest of an empty string), spans of equal start are in the
    order of KINDS, repeated rows are each scanned, a text of any length is
    scanned whole in time proportional to it, an empty table gives no rows,
    and other columns are not looked at whatever their names.
    """
    frame = pick(docs, "doc_id", "text")
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            digests, spans = [], []
            for text in batch.column(1):
                base, both = scan(text.as_py(), reach)
                for kind in range(STRONG):
                    counts[kind].append(sum(1 for _, k, _ in base if k == kind))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return frame.mapInArrow(run, schema)


def redacted(text: str | None, reach: int | None = None) -> str | None:
    """The text with every reported span but endpoints replaced by its kind in brackets; overlaps become one."""
    spans = [span for span in scan(text, reach)[1] if span[1] != 5]
    if not spans:
        return text
    out, at = [], 0
    end = kind = -1
    for start, k, stop in [*spans, (len(text) + 1, -1, 0)]:
        if start >= end:
            if kind >= 0:
                out += [f"[{KINDS[kind]}]"]
                at = end
            if k >= 0:
                out.append(text[at:start])
                kind, end, at = k, stop, start
        else:
            end = max(end, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """The same rows and columns with redacted texts; ``n_chars``, where there is one, counts the new text.

    Null texts stay null, with a null n_chars. Other cases are as in ``find_secrets``.
    """
    columns = docs.columns
    text_at = columns.index("text")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None
    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(text.as_py(), reach) for text in batch.column(text_at)]
            arrays = list(batch.columns)
            arrays[text_at] = pa.array(texts, batch.column(text_at).type)
            if chars_at is not None:
                arrays[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.column(chars_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*columns)


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
