"""Line items: cells by role, refused rows, rows that are totals, and the notes on a table.

A page's table and its column roles meet once, by page. A body row is then
one row of the frame, with an array of its cells in column order, and what it
becomes is an expression over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import messages as M
from ..functions import numbers as N
from ..functions import text as T
from ..plans.store import written

KEYS = ["doc_id", "page"]


def _line(row: Column) -> Column:
    return F.get(F.filter("lines", lambda x: x["row"] == row), F.lit(0))


def _column_at(columns: Column, centre: Column) -> Column:
    """The position of the column band that holds an x; the first band is open to the left, the last to the right."""
    last = F.size(columns) - 1
    holds = F.filter(columns, lambda c, i: ((i == 0) | (centre >= c["x0"])) & ((i == last) | (centre < c["x1"])))
    return F.get(holds, F.lit(0))["position"]


def body_rows(layout: DataFrame, roles: DataFrame) -> DataFrame:
    """One row for each body row of a page whose columns are clear enough: its source text and its cells with their roles.

    On a page where no number column is known, number roles are taken away
    and no number is read (``reads_numbers``).
    """
    decided = roles.filter("refusal is null or refusal <> 'AMBIGUOUS_COLUMNS'").select(*KEYS, "conventions", F.col("columns").alias("roles"), F.coalesce(F.col("refusal") != "COLUMN_MEANING_UNKNOWN", F.lit(True)).alias("reads_numbers"))
    pages = layout.filter("columns is not null").join(decided, KEYS)

    def whole(b: Column) -> Column:
        """A body row with its text and its wrapped lines, so that the page's lines need not go with each row."""
        more = F.transform(b["more"], _line)
        wraps = F.transform(more, lambda line: F.struct(line["text"].alias("text"), F.transform(line["cells"], lambda c: _column_at(F.col("columns"), (c["x0"] + c["x1"]) / 2)).alias("at")))
        return F.struct(b["n"].alias("n"), b["row"].alias("row"), b["label"].alias("label"), b["cells"].alias("own"), _line(b["row"])["text"].alias("row_text"), wraps.alias("wraps"))

    rows = pages.withColumn("rows", F.transform("body", whole)).select(*KEYS, "conventions", "reads_numbers", "roles", F.explode("rows").alias("b")).select(*KEYS, "conventions", "reads_numbers", "roles", "b.*")

    def taken(c: Column) -> Column:
        cell = F.get(F.filter("own", lambda x: x["position"] == c["position"]), F.lit(0))
        number = F.coalesce(c["role"].isin(*X.NUMBER_ROLES), F.lit(False))
        return F.struct(c["position"].alias("position"), c["header"].alias("header"), c["key"].alias("key"), F.when(~number | F.col("reads_numbers"), c["role"]).alias("role"), cell.alias("cell"))

    return rows.select(
        *KEYS,
        "conventions",
        "reads_numbers",
        "n",
        "row",
        "label",
        "row_text",
        F.array_join(F.concat(F.array("row_text"), F.transform("wraps", lambda w: w["text"])), "\n").alias("source_text"),
        "wraps",
        F.transform("roles", taken).alias("cells"),
    )


def read_rows(rows: DataFrame) -> DataFrame:
    """Adds to each cell what it reads as and what is wrong with it, and the row's numbers.

    A description at the end of its row takes in the wrapped lines that stay
    in its column, up to the first that doesn't.
    """

    def analysed(c: Column) -> Column:
        number = F.coalesce(c["role"].isin(*X.NUMBER_ROLES), F.lit(False)) & c["cell"].isNotNull()
        parts = F.when(number, N.analyse(c["cell"]["text"], c["cell"]["joins"]))
        return F.struct(c["position"].alias("position"), c["header"].alias("header"), c["key"].alias("key"), c["role"].alias("role"), c["cell"].alias("cell"), parts.alias("parts"))

    def judged(c: Column) -> Column:
        parts, role = c["parts"], c["role"]
        reading = F.when(parts.isNotNull(), N.read(parts, F.col("conventions")))

        def problem(r: Column) -> Column:
            wrong = parts["percent"] | (parts["per"].isNotNull() & (role != "unitPrice")) | F.coalesce((role == "quantity") & parts["marker"].rlike(r"\p{Sc}"), F.lit(False))
            return F.when(
                parts.isNotNull(),
                F.when(wrong, "UNPARSEABLE_NUMBER").when(r["status"] == "ambiguous", "AMBIGUOUS_NUMBER_FORMAT").when((r["status"] == "unreadable") & (N.valid_mask(parts) > 0), "UNPARSEABLE_NUMBER.otherFormat").when(r["status"] != "ok", "UNPARSEABLE_NUMBER"),
            )

        def ends(end: Column, n: Column) -> Column:
            inside = F.aggregate("wraps", F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), lambda acc, w: F.struct((acc["go"] & F.forall(w["at"], lambda p: p == c["position"])).alias("go"), (acc["n"] + F.when(acc["go"] & F.forall(w["at"], lambda p: p == c["position"]), F.length(w["text"]) + 1).otherwise(0)).alias("n")))
            return F.when((role == "description") & (end == n), end + inside["n"]).otherwise(end)

        return T.let(
            reading,
            lambda r: F.struct(
                c["position"].alias("position"),
                c["header"].alias("header"),
                c["key"].alias("key"),
                role.alias("role"),
                c["cell"]["text"].alias("text"),
                c["cell"]["start"].alias("start"),
                ends(c["cell"]["stop"], F.length("row_text")).alias("stop"),
                F.when(parts.isNotNull(), F.struct(parts["marker"].alias("marker"), parts["per"].alias("per"))).alias("parts"),
                F.when(r.isNotNull(), F.struct(*(r[x].alias(x) for x in ("status", "value", "dp", "other")))).alias("reading"),
                problem(r).alias("problem"),
            ),
        )

    read = rows.withColumn("cells", F.transform("cells", analysed)).withColumn("cells", F.transform("cells", judged))
    by_role = lambda role: F.get(F.filter("cells", lambda c: (c["role"] == role) & c["text"].isNotNull()), F.lit(0))
    clean = lambda role: F.get(F.filter("cells", lambda c: (c["role"] == role) & c["text"].isNotNull() & c["problem"].isNull()), F.lit(0))
    return (
        read.withColumn("problem", F.get(F.filter("cells", lambda c: c["problem"].isNotNull()), F.lit(0)))
        .withColumn("quantity", clean("quantity"))
        .withColumn("price", clean("unitPrice"))
        .withColumn("total", clean("lineTotal"))
        .withColumn("description", by_role("description"))
        .withColumn("has_price_column", F.exists("cells", lambda c: c["role"] == "unitPrice"))
        .withColumn("price_cell", by_role("unitPrice"))
        .withColumn("total_cell", by_role("lineTotal"))
        .withColumn("has_total_column", F.exists("cells", lambda c: F.coalesce(c["role"] == "lineTotal", F.lit(False))))
    )


def _used() -> list[Column]:
    """Of the cells that a row is judged by, what is read later on: they stand whole among its cells already."""
    reading = lambda name, *of: F.struct(*(F.col(f"{name}.reading.{x}").alias(x) for x in of)).alias("reading")
    parts = {
        "problem": (*(F.col(f"problem.{x}").alias(x) for x in ("text", "problem")), reading("problem", "value", "other")),
        "quantity": (F.col("quantity.text").alias("text"), reading("quantity", "value")),
        "price": (*(F.col(f"price.{x}").alias(x) for x in ("position", "text")), reading("price", "value")),
        "total": (*(F.col(f"total.{x}").alias(x) for x in ("position", "text")), reading("total", "value", "dp"), F.struct(F.col("total.parts.marker").alias("marker")).alias("parts")),
        "description": tuple(F.col(f"description.{x}").alias(x) for x in ("position", "stop")),
        "total_cell": tuple(F.col(f"total_cell.{x}").alias(x) for x in ("start", "text")),
    }
    return [F.when(F.col(name).isNotNull(), F.struct(*fields)).alias(name) for name, fields in parts.items()]


def judge_rows(read: DataFrame) -> DataFrame:
    """Adds ``outcome``: labelled (a total by its label), running (a running total), item, or the code that refuses the row.

    A running total has no price, and its total is the sum of two or more
    complete items since the last total; each hit starts a new sum, so a
    page's rows are folded in order.
    """
    labelled = T.starts_with_total(F.col("label")) & F.col("price_cell").isNull()
    has_number = F.coalesce(F.exists("cells", lambda c: c["reading"]["status"] == "ok"), F.lit(False))
    off = F.abs(F.col("quantity.reading.value") * F.col("price.reading.value") - F.col("total.reading.value")) > F.greatest(F.lit(0.01), 0.005 * F.abs(F.col("quantity.reading.value"))) + 0.005
    first = (
        F.when(labelled, "labelled")
        .when(F.col("problem").isNotNull(), F.col("problem.problem"))
        .when(F.col("reads_numbers") & has_number & F.col("description").isNull(), "NO_DESCRIPTION")
        .when(F.coalesce(off, F.lit(False)), "ARITHMETIC_MISMATCH")
        .otherwise("item")
    )
    told = written(read.withColumn("outcome", first).select(*KEYS, "conventions", "n", "row", "label", "row_text", "source_text", "wraps", "cells", "has_total_column", "outcome", *_used()), "told")
    ordered = F.sort_array(F.collect_list(F.struct("n", "outcome", F.col("total.reading.value").alias("total"), F.col("price").isNotNull().alias("priced"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("count"), F.lit(True).alias("complete"), F.array().cast("array<int>").alias("hits"))

    def fold(acc: Column, r: Column) -> Column:
        hit = F.coalesce((r["outcome"] == "item") & ~r["priced"] & acc["complete"] & (acc["count"] >= 2) & (F.abs(r["total"] - acc["sum"]) < X.SUM_ROUNDING), F.lit(False))
        fresh = hit | (r["outcome"] == "labelled")
        adds = (r["outcome"] == "item") & r["total"].isNotNull()
        return F.struct(
            F.when(fresh, 0.0).when(adds, acc["sum"] + r["total"]).otherwise(acc["sum"]).alias("sum"),
            F.when(fresh, 0).when(adds, acc["count"] + 1).otherwise(acc["count"]).alias("count"),
            (fresh | (adds & acc["complete"])).alias("complete"),
            F.when(hit, F.concat(acc["hits"], F.array(r["n"]))).otherwise(acc["hits"]).alias("hits"),
        )

    hits = told.groupBy(*KEYS).agg(F.aggregate(ordered, start, fold, lambda acc: acc["hits"]).alias("hits"))
    # running totals are rare: their row numbers go to the rows, not the rows to them, unless there are very many
    found = written(hits.select(*KEYS, F.explode("hits").alias("n")).withColumn("hit", F.lit(True)), "running")
    return told.join(found, [*KEYS, "n"], "left").withColumn("outcome", F.when(F.col("hit"), "running").otherwise(F.col("outcome"))).drop("hit")


def _field(c: Column) -> Column:
    money = c["role"].isin("unitPrice", "lineTotal")
    return F.struct(
        c["role"].alias("role"),
        c["header"].alias("header"),
        F.when(c["parts"].isNull(), F.substring(F.col("source_text"), c["start"] + 1, c["stop"] - c["start"])).otherwise(c["text"]).alias("raw"),
        c["reading"]["value"].alias("value"),
        c["reading"]["dp"].alias("dp"),
        F.when(c["role"] == "unitPrice", c["parts"]["per"]).alias("per"),
        F.when(money, N.currency_code(c["parts"]["marker"])).alias("currency"),
        c["start"].alias("start"),
        c["stop"].alias("stop"),
    )


def line_items(judged: DataFrame) -> DataFrame:
    """doc_id, page, row, id, source_text, fields (by role), other_cells, missing, and the values by themselves."""
    has = lambda c: c["role"].isNotNull() & c["text"].isNotNull()
    return judged.filter("outcome = 'item'").select(
        *KEYS,
        F.col("row").alias("row"),
        F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-r"), F.col("row").cast("string")).alias("id"),
        "source_text",
        F.transform(F.filter("cells", has), _field).alias("fields"),
        F.transform(F.filter("cells", lambda c: c["role"].isNull()), lambda c: F.struct(c["header"].alias("header"), c["key"].alias("key"), F.coalesce(c["text"], F.lit("")).alias("raw"))).alias("other_cells"),
        F.transform(F.filter("cells", lambda c: c["role"].isNotNull() & c["text"].isNull()), lambda c: c["role"]).alias("missing"),
        F.col("quantity.reading.value").alias("quantity"),
        F.col("price.reading.value").alias("unit_price"),
        F.col("total.reading.value").alias("line_total"),
        F.col("total.reading.dp").alias("total_dp"),
        "conventions",
    )


def row_refusals(judged: DataFrame) -> DataFrame:
    """doc_id, page, row, code, message and source_text of each row that is left out."""
    page, problem = F.col("page"), F.col("problem")
    low, high = F.least("price.position", "total.position"), F.greatest("price.position", "total.position")
    between = F.get(F.filter("cells", lambda c: (c["position"] > low) & (c["position"] < high) & c["role"].isNull() & c["header"].isNotNull()), F.lit(0))["header"]
    expected = N.written(F.col("quantity.reading.value") * F.col("price.reading.value"), F.col("total.reading.dp"), F.col("conventions"), F.col("total.parts.marker"), N.marker_after(F.col("total.text"), F.col("total.parts.marker")))
    mismatch = M.refusal("ARITHMETIC_MISMATCH", page=page, quantity=F.col("quantity.text"), price=F.col("price.text"), expected=expected, total=F.col("total.text"))
    plain = T.plain_number
    message = (
        F.when(F.col("outcome") == "NO_DESCRIPTION", M.refusal("NO_DESCRIPTION", page=page, row=F.col("row_text")))
        .when(F.col("outcome") == "ARITHMETIC_MISMATCH", F.concat(mismatch, F.coalesce(F.when(between.isNotNull(), M.refusal("ARITHMETIC_MISMATCH.between", between=between)), F.lit(""))))
        .when(F.col("outcome") == "AMBIGUOUS_NUMBER_FORMAT", M.refusal("AMBIGUOUS_NUMBER_FORMAT.line", page=page, raw=problem["text"], first=plain(problem["reading"]["value"]), second=plain(problem["reading"]["other"])))
        .when(F.col("outcome") == "UNPARSEABLE_NUMBER.otherFormat", M.refusal("UNPARSEABLE_NUMBER.otherFormat", page=page, raw=problem["text"]))
        .otherwise(M.refusal("UNPARSEABLE_NUMBER", page=page, raw=problem["text"]))
    )
    return judged.filter(~F.col("outcome").isin("item", "labelled", "running")).select(*KEYS, "row", F.substring_index("outcome", ".", 1).alias("code"), message.alias("message"), "source_text")


def totals_rows(judged: DataFrame) -> DataFrame:
    """Rows moved out of the table because they are totals, with their amount cell."""
    return judged.filter(F.col("outcome").isin("labelled", "running")).select(*KEYS, "row", "row_text", "label", F.col("total_cell").alias("amount"), "has_total_column")


def table_notes(judged: DataFrame) -> DataFrame:
    """doc_id, page, rank, ord and the notes that the rows of a table give: totals skipped, mixed wording, wrapped descriptions."""
    page = F.col("page")
    skipped = judged.filter(F.col("outcome").isin("labelled", "running")).select(*KEYS, F.lit(0).alias("rank"), F.col("n").alias("ord"), M.note("totalsRowSkipped", page=page, text=F.col("row_text")).alias("note"))
    kept = judged.filter(~F.col("outcome").isin("labelled", "running"))
    loose = kept.select(*KEYS, "n", F.explode("cells").alias("c")).filter("c.role is null and c.header is not null and c.text is not null")
    says = T.has_word(F.col("c.text"), X.TOTAL_WORD)
    mixed = loose.groupBy(*KEYS, F.col("c.position").alias("ord")).agg(F.first("c.header").alias("header"), F.min(F.when(says, F.struct("n", F.col("c.text").alias("t")))).alias("a"), F.min(F.when(~says, F.struct("n", F.col("c.text").alias("t")))).alias("b")).filter("a is not null and b is not null")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    examples = F.when(F.col("a.n") < F.col("b.n"), T.listed(F.array(quoted(F.col("a.t")), quoted(F.col("b.t"))))).otherwise(T.listed(F.array(quoted(F.col("b.t")), quoted(F.col("a.t")))))
    wording = mixed.select(*KEYS, F.lit(1).alias("rank"), "ord", M.note("mixedTotalWording", page=page, text=F.col("header"), examples=examples).alias("note"))
    short = (F.col("outcome") == "item") & (F.col("description.stop") <= F.length("row_text")) & F.exists("wraps", lambda w: F.array_contains(w["at"], F.col("description.position")))
    wrapped = judged.filter(short).groupBy(*KEYS).agg(F.lit(2).alias("rank"), F.lit(0).alias("ord")).select(*KEYS, "rank", "ord", M.note("descriptionWraps", page=page).alias("note"))
    return skipped.unionByName(wording).unionByName(wrapped)
