"""Rows, cells and tables of a page: the one operator that needs the order of things on the page.

A table grows row by row, and its columns learn their edges from each row
taken in, so no window or join states it. Pages are gathered by an aggregation
and folded one at a time; a partition holds one page in Python memory.
"""

from __future__ import annotations

import bisect
import functools
import gc
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

CELL = "text:string,x0:double,x1:double,joins:array<int>,shape:string,start:int,stop:int"
LAYOUT = (
    "lines array<struct<row:int,y:double,font_size:double,text:string,cells:array<struct<" + CELL + ">>>>,"
    "columns array<struct<position:int,header:string,kind:string,x0:double,x1:double>>, header_rows array<int>,"
    "body array<struct<n:int,row:int,label:string,more:array<int>,cells:array<struct<position:int," + CELL + ">>>>,"
    "above array<int>, below array<int>, others array<int>, notes array<struct<code:string,text:string>>, problem string"
)

WHOLE = regex.compile(T.WHOLE_NUMBER)
FIRST = regex.compile(T.NUMBER_FIRST)
DRAWN = regex.compile(r"[\p{P}\p{S}\s]{3,}")
MONEY = regex.compile(r"\p{Sc}")


@functools.lru_cache(maxsize=50_000)
def shape_of(text: str) -> str:
    cell = " ".join(text.split())
    if WHOLE.fullmatch(cell):
        return "NUM"
    lead = FIRST.match(cell)
    rest = cell[lead.end() :].strip() if lead else ""
    return "NUMX" if rest and len(rest) <= T.UNIT_LENGTH and len(rest.split(" ")) <= T.UNIT_WORDS else "TEXT"


def is_drawn(text: str) -> bool:
    if text[:1].isalpha() or text[:1].isdecimal():
        return False
    cell = text.strip()
    return bool(DRAWN.fullmatch(cell)) and not MONEY.search(cell)


def matching(text: str) -> str:
    return " ".join(text.lower().split()).rstrip(".:").strip()


def word_pattern(words: tuple[str, ...]) -> regex.Pattern:
    return regex.compile("|".join(rf"(?<![\p{{L}}\p{{N}}]){re.escape(w)}s?(?![\p{{L}}\p{{N}}])" for w in words))


CARRIED = word_pattern(X.CARRIED_FORWARD)
TOTAL_FIRST = regex.compile("(?:" + "|".join(re.escape(w) for words in X.TOTAL_LABELS.values() for w in sorted(words, key=len, reverse=True)) + r")s?(?![\p{L}\p{N}-])")


@dataclass(eq=False)
class Cell:
    text: str
    x0: float
    x1: float
    joins: list[int] = field(default_factory=list)
    shape: str = "TEXT"
    start: int = 0
    stop: int = 0

    @property
    def centre(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def is_number(self) -> bool:
        return self.shape != "TEXT"

    def row(self) -> dict:
        return {"text": self.text, "x0": self.x0, "x1": self.x1, "joins": self.joins, "shape": self.shape, "start": self.start, "stop": self.stop}


@dataclass(eq=False)
class Line:
    row: int
    y: float
    font_size: float
    cells: list[Cell]
    text: str

    @property
    def has_number(self) -> bool:
        return any(c.is_number for c in self.cells)


# ---- pieces to lines


def cells_of(pieces: list[tuple[str, float, float, float]]) -> list[Cell]:
    """Pieces (text, x, width, font size) of one line, left to right, merged where they nearly touch."""
    cells: list[Cell] = []
    spaced = False
    for text, x, width, size in sorted(pieces, key=lambda p: p[1]):
        word = text.strip()
        if not word:
            continue
        gap = x - cells[-1].x1 if cells else 0.0
        if cells and gap < X.MERGE_GAP * size:
            last = cells[-1]
            if gap > X.SPACE_GAP * size or spaced or text[0].isspace():
                last.joins.append(len(last.text))
                last.text += " "
            last.text += word
            last.x1 = max(last.x1, x + width)
        else:
            cells.append(Cell(word, x, x + width))
        spaced = text[-1].isspace()
    for cell in cells:
        cell.shape = shape_of(cell.text)
    return cells


def lines_of(pieces: list[tuple[str, float, float, float, float]], tick: Callable[[], None] = lambda: None) -> list[Line]:
    """Pieces (text, x, y, width, font size) of a page, as numbered lines from the top; drawn lines are left out.

    A piece joins the first line whose baseline (that of its first piece) is
    near enough for the smaller of the two fonts.
    """
    baselines: list[float] = []
    sizes: list[float] = []
    members: list[list[tuple[str, float, float, float]]] = []
    for text, x, y, width, size in sorted(pieces, key=lambda p: (p[2], p[1])):
        tick()
        at = bisect.bisect_left(baselines, y - X.ROW_TOLERANCE * size)
        while at < len(baselines) and abs(baselines[at] - y) > X.ROW_TOLERANCE * min(sizes[at], size):
            at += 1
        if at == len(baselines):
            baselines.append(y)
            sizes.append(size)
            members.append([])
        sizes[at] = max(sizes[at], size)
        members[at].append((text, x, width, size))
    lines: list[Line] = []
    for y, size, own in zip(baselines, sizes, members, strict=True):
        cells = cells_of(own)
        if not cells or all(is_drawn(c.text) for c in cells):
            continue
        at = 0
        for cell in cells:
            cell.start, cell.stop = at, at + len(cell.text)
            at = cell.stop + 1
        lines.append(Line(len(lines), y, size, cells, " ".join(c.text for c in cells)))
    return lines


# ---- lines to a table


class Track:
    """A column as it is learned: the sorted edges of its cells."""

    def __init__(self, *cells: Cell) -> None:
        self.cells: list[Cell] = []
        self.edges: tuple[list[float], list[float], list[float]] = ([], [], [])
        for cell in cells:
            self.add(cell)

    def add(self, cell: Cell) -> None:
        self.cells.append(cell)
        for known, value in zip(self.edges, (cell.x0, cell.x1, cell.centre), strict=True):
            bisect.insort(known, value)

    @property
    def low(self) -> float:
        return self.edges[0][0]

    @property
    def high(self) -> float:
        return self.edges[1][-1]

    @property
    def numeric(self) -> bool:
        return bool(self.cells) and sum(c.is_number for c in self.cells) >= X.NUMERIC_KIND_SHARE * len(self.cells)

    def distance(self, cell: Cell) -> float:
        """From the nearest of the cell's left, right and middle to the column's (upper) median of it."""
        lefts, rights, middles = self.edges
        at = len(lefts) // 2
        left, right = abs(cell.x0 - lefts[at]), abs(cell.x1 - rights[at])
        if not left or not right:
            return 0.0
        return min(left, right, abs((cell.x0 + cell.x1) / 2 - middles[at]))

    def shared(self, cell: Cell) -> float:
        return min(cell.x1, self.high) - max(cell.x0, self.low)


def aligned(line: Line, tracks: list[Track], tolerance: float) -> list[Track | None] | None:
    """The column of each cell, None for one new column at most; no answer if the line can't be a row of the table."""
    found: list[Track | None] = []
    for cell in line.cells:
        near, best = float("inf"), None
        for track in tracks:
            away = track.distance(cell)
            if away < near:
                near, best = away, track
                if not away:
                    break
        if near <= tolerance:
            if best in found:
                return None
            found.append(best)
        elif any(t.shared(cell) > 0 for t in tracks):
            return None
        else:
            found.append(None)
    return found if found.count(None) <= 1 else None


@dataclass(eq=False)
class BodyRow:
    line: Line
    cells: dict[Track, Cell]
    more: list[Line] = field(default_factory=list)

    @property
    def last_y(self) -> float:
        return self.more[-1].y if self.more else self.line.y


@dataclass(eq=False)
class Run:
    """Consecutive lines that share columns; first and last are places among the searched lines."""

    first: int
    last: int
    tracks: list[Track]
    body: list[BodyRow]
    pitches: list[float]

    @property
    def pitch(self) -> float | None:
        return self.pitches[len(self.pitches) // 2] if self.pitches else None

    @property
    def tolerance(self) -> float:
        return X.ALIGN_TOLERANCE * self.body[0].line.font_size

    @property
    def numeric_columns(self) -> int:
        return sum(t.numeric for t in self.tracks)

    @property
    def is_totals_box(self) -> bool:
        return all(TOTAL_FIRST.match(matching(row.line.text)) for row in self.body)

    def take(self, line: Line) -> bool:
        """Add the line as a row or as a continuation of the last row, if it is either."""
        found = aligned(line, self.tracks, self.tolerance)
        if found is None:
            return False
        last = self.body[-1]
        known = [t for t in found if t is not None]
        if len(line.cells) >= X.MIN_CELLS and len(known) >= X.MIN_CELLS - 1 and line.has_number:
            cells = {}
            for cell, track in zip(line.cells, found, strict=True):
                if track is None:
                    track = Track()
                    self.tracks.append(track)
                track.add(cell)
                cells[track] = cell
            bisect.insort(self.pitches, line.y - last.line.y)
            self.body.append(BodyRow(line, cells))
            return True
        reach = X.CONTINUATION_GAP * self.pitch if self.pitches else X.HEADER_LINE_GAP * last.line.font_size
        if len(known) == len(found) and not any(t.numeric for t in known) and line.y - last.last_y < reach:
            last.more.append(line)
            return True
        return False


def starts_body(line: Line) -> bool:
    return len(line.cells) >= X.MIN_CELLS and line.has_number


def grown(lines: list[Line], at: int) -> Run:
    tracks = [Track(cell) for cell in lines[at].cells]
    run = Run(at, at, tracks, [BodyRow(lines[at], dict(zip(tracks, lines[at].cells, strict=True)))], [])
    while run.last + 1 < len(lines) and run.take(lines[run.last + 1]):
        run.last += 1
    run.tracks.sort(key=lambda t: t.low)
    return run


@dataclass(eq=False)
class Column:
    """A column with its heading; ``track`` is None for a heading that stands over no cells."""

    track: Track | None
    upper: list[Cell] = field(default_factory=list)
    main: list[Cell] = field(default_factory=list)

    @property
    def left(self) -> float:
        return self.track.low if self.track else min(c.x0 for c in self.upper + self.main)

    @property
    def extent(self) -> tuple[float, float]:
        heads = self.upper + self.main
        lows = [c.x0 for c in heads] + ([self.track.low] if self.track else [])
        highs = [c.x1 for c in heads] + ([self.track.high] if self.track else [])
        return min(lows), max(highs)

    @property
    def header(self) -> str | None:
        return " ".join(c.text for c in self.upper + self.main) or None


def shared(a: Cell, b: Cell) -> float:
    return min(a.x1, b.x1) - max(a.x0, b.x0)


def headed(lines: list[Line], run: Run, carried: list[Line]) -> tuple[list[Line], list[Column]] | None:
    """The heading lines right above a run and the columns with their headings, or nothing."""
    if not run.first:
        return None
    line, first = lines[run.first - 1], run.body[0].line
    top = min([first.y, *(c.y for c in carried if line.y < c.y < first.y)])
    if len(line.cells) < 2 or line.has_number or top - line.y > max(X.HEADER_MAX_PITCHES * (run.pitch or 0), X.HEADER_MAX_FONT_SIZES * first.font_size):
        return None
    columns = [Column(t) for t in run.tracks]
    owner: dict[Cell, Column] = {}
    floating = []
    for cell in line.cells:
        best = max(columns, key=lambda c: c.track.shared(cell))
        if best.track.shared(cell) > 0:
            best.main.append(cell)
            owner[cell] = best
        else:
            floating.append(cell)
    for cell in floating:
        with_body = [c for c in columns if c.track]
        left = max((c for c in with_body if c.track.high <= cell.x0), key=lambda c: c.track.high, default=None)
        right = min((c for c in with_body if c.track.low >= cell.x1), key=lambda c: c.track.low, default=None)
        free = [c for c in (left, right) if c and not c.main]
        if free:
            best = min(free, key=lambda c: max(0.0, c.track.low - cell.x1, cell.x0 - c.track.high))
        else:
            best = Column(None)
            columns.append(best)
        best.main.append(cell)
        owner[cell] = best
    heads = [line]
    if run.first > 1:
        upper = lines[run.first - 2]
        under = [max(line.cells, key=lambda c, cell=cell: shared(cell, c)) for cell in upper.cells]
        if not upper.has_number and line.y - upper.y < X.HEADER_LINE_GAP * line.font_size and all(shared(a, b) > 0 for a, b in zip(upper.cells, under, strict=True)):
            for cell, below in zip(upper.cells, under, strict=True):
                owner[below].upper.append(cell)
            heads.insert(0, upper)
    return heads, columns


def is_table(run: Run, head: tuple[list[Line], list[Column]] | None) -> bool:
    return run.numeric_columns > 0 and len(run.body) >= (1 if head else 2)


def joins_on(between: list[Line], later: Run, table: Run) -> bool:
    """Whether lines between two runs don't part them: without numbers, or in line with the table and close enough."""
    numbered = [line for line in between if line.has_number]
    if not numbered:
        return True
    for line in numbered:
        found = aligned(line, table.tracks, table.tolerance)
        if found is None or None in found:
            return False
    pitch = table.pitch if table.pitch is not None else later.pitch
    return pitch is not None and later.body[0].line.y - table.body[-1].last_y <= (len(between) + 1) * X.JOIN_MAX_PITCHES * pitch


def unspaced(columns: list[Column], cells: list[list[Cell | None]]) -> None:
    """A number with a space that reaches into the numbers of another column may be two numbers: its spaces group nothing."""
    bands = []
    for column in columns:
        clean = [c for c in (column.track.cells if column.track else []) if c.is_number and len(c.text.split()) == 1]
        bands.append((min(c.x0 for c in clean), max(c.x1 for c in clean)) if clean else None)
    for row in cells:
        for p, cell in enumerate(row):
            if cell and cell.is_number and len(cell.text.split()) > 1 and any(b and q != p and min(cell.x1, b[1]) > max(cell.x0, b[0]) for q, b in enumerate(bands)):
                row[p] = Cell(cell.text, cell.x0, cell.x1, [i for i, ch in enumerate(cell.text) if ch.isspace()], cell.shape, cell.start, cell.stop)


def page_layout(lines: list[Line], tick: Callable[[], None] = lambda: None) -> dict:
    """The table of a page and what lies around it; see LAYOUT for the parts."""
    carried = [line for line in lines if line.has_number and CARRIED.search(matching(line.cells[0].text))]
    notes = [("carriedForwardSkipped", line.text) for line in carried]
    searched = [line for line in lines if line not in carried]
    out = {
        "lines": [{"row": l.row, "y": l.y, "font_size": l.font_size, "text": l.text, "cells": [c.row() for c in l.cells]} for l in lines],  # noqa: E741
        "columns": None, "header_rows": [], "body": [], "above": [line.row for line in searched], "below": [], "others": [], "notes": [], "problem": None,
    }
    found, at = [], 0
    while at < len(searched):
        if starts_body(searched[at]):
            tick()
            run = grown(searched, at)
            head = headed(searched, run, carried)
            if is_table(run, head):
                found.append((run, head))
                at = run.last
        at += 1
    if found:
        table, head = max(found, key=lambda f: f[0].numeric_columns)
        first_of = lambda run, head: run.first - (len(head[0]) if head else 0)
        passed: set[int] = set()

        def pass_over(run: Run, head: tuple[list[Line], list[Column]] | None) -> None:
            if not run.is_totals_box:
                notes.append(("otherTableNotRead", run.body[0].line.text))
            passed.update(line.row for line in searched[first_of(run, head) : run.last + 1])

        for run, its_head in found[: [f[0] for f in found].index(table)]:
            pass_over(run, its_head)
        at = table.last + 1
        while at < len(searched):
            if starts_body(searched[at]):
                tick()
                later = grown(searched, at)
                between = searched[table.last + 1 : at]
                fits = [aligned(row.line, table.tracks, table.tolerance) for row in later.body] if joins_on(between, later, table) else [None]
                if all(fit is not None and None not in fit for fit in fits):
                    notes += [("shortLineInTable" if line.has_number else "sectionHeading", line.text) for line in between]
                    for row, fit in zip(later.body, fits, strict=True):
                        cells = dict(zip(fit, row.line.cells, strict=True))
                        for track, cell in cells.items():
                            track.add(cell)
                        table.body.append(BodyRow(row.line, cells, row.more))
                    table.last = at = later.last
                else:
                    its_head = headed(searched, later, carried)
                    if is_table(later, its_head):
                        pass_over(later, its_head)
                        at = later.last
            at += 1
        columns = sorted(head[1] if head else [Column(t) for t in table.tracks], key=lambda c: c.left)
        extents = [c.extent for c in columns]
        borders = [extents[0][0], *((a[1] + b[0]) / 2 for a, b in zip(extents, extents[1:], strict=False)), extents[-1][1]]
        cells = [[row.cells.get(c.track) if c.track else None for c in columns] for row in table.body]
        unspaced(columns, cells)
        out["columns"] = [{"position": p, "header": c.header, "kind": "numeric" if c.track and c.track.numeric else "text", "x0": borders[p], "x1": borders[p + 1]} for p, c in enumerate(columns)]
        out["header_rows"] = [line.row for line in head[0]] if head else []
        out["body"] = [
            {"n": n, "row": row.line.row, "label": row.line.cells[0].text, "more": [line.row for line in row.more], "cells": [{"position": p, **c.row()} for p, c in enumerate(own) if c]}
            for n, (row, own) in enumerate(zip(table.body, cells, strict=True))
        ]
        out["above"] = [line.row for line in searched[: first_of(table, head)] if line.row not in passed]
        out["below"] = [line.row for line in searched[table.last + 1 :]]
        out["others"] = sorted(passed)
    out["notes"] = [{"code": code, "text": text} for code, text in notes]
    return out


class Overtime(Exception):
    """A page took longer than it may."""


def contained_layout(pieces: list[tuple], seconds: float = X.PAGE_SECONDS, clock: Callable[[], float] = time.monotonic) -> dict:
    """The layout of a page, or what went wrong on it: an error or too long a time refuses its own page and no other.

    The clock is read for each piece and before each run of rows is grown.
    """
    until = clock() + seconds

    def tick() -> None:
        if clock() > until:
            raise Overtime(f"over {seconds:g} seconds")

    try:
        return page_layout(lines_of(pieces, tick), tick)
    except (ArithmeticError, AttributeError, LookupError, Overtime, TypeError, ValueError) as error:
        return {**page_layout([]), "problem": f"{type(error).__name__}: {error}"[:200]}


# ---- in Spark


def lay_out(pieces: DataFrame) -> DataFrame:
    """One row for each (doc_id, page) of the upright pieces: its lines, table and surroundings.

    Input: doc_id, page, ord, str, x, y, width, font_size. An aggregation
    brings a page together: a repartition before a Python map is no promise,
    as Spark drops it after a join on the same columns and may then deal out
    that join's sides anew, in parts of a page.
    """
    return lay_out_pages(pieces.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "str", "x", "y", "width", "font_size"))).alias("pieces")))


def lay_out_pages(pages: DataFrame) -> DataFrame:
    """The same from one row for each page: doc_id, page and its upright pieces in order.

    A page's pieces follow each other in its task; a batch may end inside a
    page, so the last page of each batch waits for the next.
    """
    frame = pages.select("doc_id", "page", F.explode("pieces").alias("p")).select("doc_id", "page", "p.ord", "p.str", "p.x", "p.y", "p.width", "p.font_size")
    doc_type = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, page int, {LAYOUT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a page makes has no cycles: looking for them among its many small objects at each turn is time lost
        usual = gc.get_threshold()
        gc.set_threshold(200_000, 50, 50)
        target: pa.Schema | None = None
        key: tuple | None = None
        own: list[tuple] = []
        ready: list[dict] = []

        def close() -> None:
            if key is not None:
                ready.append({"doc_id": key[0], "page": key[1], **contained_layout(own)})

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(ready, schema=target)
            ready.clear()
            return out

        for batch in batches:
            if target is None:
                target = arrow_layout(batch.schema.field(0).type)
            doc, page, _, *values = map(values_of, batch.columns)
            for d, p, piece in zip(doc, page, zip(*values, strict=True), strict=True):
                if (d, p) != key:
                    close()
                    key, own = (d, p), []
                own.append(piece)
            if len(ready) >= 500:
                yield flush()
        close()
        if ready:
            yield flush()
        gc.set_threshold(*usual)

    return frame.mapInArrow(run, schema)


def values_of(column: pa.Array) -> list:
    """The column as Python values; by way of numpy where that says the same, as it takes a tenth of the time."""
    plain = not column.null_count and (pa.types.is_floating(column.type) or pa.types.is_integer(column.type) or pa.types.is_string(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def arrow_layout(doc: pa.DataType) -> pa.Schema:
    cell = [("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64()), ("joins", pa.list_(pa.int32())), ("shape", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
    rows = pa.list_(pa.int32())
    return pa.schema(
        [
            ("doc_id", doc),
            ("page", pa.int32()),
            ("lines", pa.list_(pa.struct([("row", pa.int32()), ("y", pa.float64()), ("font_size", pa.float64()), ("text", pa.string()), ("cells", pa.list_(pa.struct(cell)))]))),
            ("columns", pa.list_(pa.struct([("position", pa.int32()), ("header", pa.string()), ("kind", pa.string()), ("x0", pa.float64()), ("x1", pa.float64())]))),
            ("header_rows", rows),
            ("body", pa.list_(pa.struct([("n", pa.int32()), ("row", pa.int32()), ("label", pa.string()), ("more", rows), ("cells", pa.list_(pa.struct([("position", pa.int32()), *cell])))]))),
            ("above", rows),
            ("below", rows),
            ("others", rows),
            ("notes", pa.list_(pa.struct([("code", pa.string()), ("text", pa.string())]))),
            ("problem", pa.string()),
        ]
    )
