"""Printed totals: finding them, reading them, and checking the lines against them.

Money is compared in whole units of the smallest printed decimal, as big
integers. A document's candidates and pages are gathered into one row
(bounded by its pages), and the verdict is one ordered CASE over flags, so
each rule can be read, and counted, by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import messages as M
from ..functions import numbers as N
from ..functions import text as T
from ..plans.store import written

KEYS = ["doc_id", "page"]


def is_label(text: Column) -> Column:
    """A letter and no digit, percentages aside."""
    return T.let(F.regexp_replace(text, T.PERCENTAGE, ""), lambda t: t.rlike(r"\p{L}") & ~t.rlike("[0-9]"))


def has_percentage(text: Column) -> Column:
    return text.rlike(T.PERCENTAGE)


def groups_by_space(conventions: Column) -> Column:
    """Whether a space may group digits on the page: all its conventions group so, or all have a decimal comma."""
    spaces = sum(1 << k for k, c in enumerate(X.CONVENTIONS) if c[1] == " ")
    commas = sum(1 << k for k, c in enumerate(X.CONVENTIONS) if c[0] == ",")
    return (conventions != 0) & ((conventions.bitwiseAND(F.lit(~spaces & N.ALL)) == 0) | (conventions.bitwiseAND(F.lit(~commas & N.ALL)) == 0))


def _candidates(rows: DataFrame) -> DataFrame:
    """From page, row, row_text, label, start, stop, joins (offsets in the amount), conventions: the amounts that can be read."""
    raw = F.substring(F.col("row_text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    spaces = F.filter(F.sequence(F.lit(0), F.greatest(F.length("raw") - 1, F.lit(0))), lambda i: F.substring(F.col("raw"), i + 1, F.lit(1)).rlike(r"(?U)\s"))
    parts = rows.withColumn("raw", raw).withColumn("parts", N.analyse(F.col("raw"), F.when(groups_by_space(F.col("conventions")), F.col("joins")).otherwise(spaces)))
    # written, or each use of a part would bring its whole analysis into the plan again
    read = written(parts, "totals-parts").filter("parts.core is not null and not parts.percent and parts.per is null").withColumn("reading", N.read(F.col("parts"), F.col("conventions")))
    read = written(read, "totals-readings").filter("reading.status in ('ok', 'ambiguous')")
    return read.select(
        *KEYS,
        "row",
        "row_text",
        "label",
        F.when(F.col("label") != "", T.totals_kind(F.col("label"))).alias("kind"),
        "raw",
        "start",
        "stop",
        F.when(F.col("reading.status") == "ok", F.col("reading.value")).alias("value"),
        F.col("reading.dp").alias("dp"),
        F.col("reading.status").alias("status"),
        F.col("reading.value").alias("first"),
        F.col("reading.other").alias("second"),
        F.col("parts.marker").alias("marker"),
        N.currency_code(F.col("parts.marker")).alias("currency"),
        N.marker_after(F.col("raw"), F.col("parts.marker")).alias("after"),
        N.valid_mask(F.col("parts")).alias("fits"),
        "conventions",
    )


def _amount_start(text: Column) -> Column:
    """Where the longest number at the end of a line begins, at a word's start after the first; null where there is none."""
    at = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))),
        lambda i: F.substring(text, i - 1, F.lit(1)).rlike(r"(?U)\s") & F.substring(text, i, F.lit(1)).rlike(r"(?U)\S") & N.analyse(F.substring(text, i, F.lit(1 << 20)))["core"].isNotNull(),
    )
    return F.get(at, F.lit(0)) - 1


def totals_candidates(layout: DataFrame, roles: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, notes): amounts with a label below the tables and in rows moved out of them.

    Notes are of lines that begin as a total but give no amount; they have
    doc_id, page, ord, note and unread.
    """
    pages = roles.select(*KEYS, "conventions")
    below = F.filter("lines", lambda x: F.array_contains("below", x["row"]))
    lines = layout.filter("columns is not null").select(*KEYS, "others", F.explode(below).alias("x")).join(pages, KEYS)
    told = written(lines.withColumn("labelled", T.starts_with_total(F.col("x.text"))), "totals-lines").filter(F.col("labelled") | ~F.array_contains("others", F.col("x.row")))
    offsets = F.concat(F.transform(F.filter("x.cells", lambda c: c["start"] > 0), lambda c: c["start"] - 1), F.flatten(F.transform("x.cells", lambda c: F.transform(c["joins"], lambda j: c["start"] + j))))
    placed = written(told.select(*KEYS, "conventions", "labelled", F.col("x.row").alias("row"), F.col("x.text").alias("row_text"), offsets.alias("offsets"), _amount_start(F.col("x.text")).alias("start")), "totals-starts").withColumn("label", T.stripped(F.substring(F.col("row_text"), F.lit(1), F.col("start"))))
    from_lines = placed.filter(F.col("start").isNotNull() & is_label(F.col("label"))).withColumn("stop", F.length("row_text")).withColumn("joins", F.transform(F.filter("offsets", lambda o: o >= F.col("start")), lambda o: o - F.col("start")))
    columns = [*KEYS, "row", "row_text", "label", "start", "stop", "joins", "conventions"]
    rows = moved.join(pages, KEYS)
    cells = layout.filter("columns is not null").select(*KEYS, F.explode("body").alias("b")).select(*KEYS, F.col("b.row").alias("row"), F.col("b.cells").alias("own"))
    with_amount = rows.filter("amount is not null").join(cells, [*KEYS, "row"])
    from_cells = with_amount.select(*KEYS, "row", "row_text", F.when(F.col("amount.start") == 0, "").otherwise(F.col("label")).alias("label"), F.col("amount.start").alias("start"), (F.col("amount.start") + F.length("amount.text")).alias("stop"), F.get(F.filter("own", lambda c: c["start"] == F.col("amount.start")), F.lit(0))["joins"].alias("joins"), "conventions")
    bare = rows.filter("amount is null and not has_total_column").withColumn("start", _amount_start(F.col("row_text")))
    bare = written(bare, "totals-bare").filter("start is not null").withColumn("label", T.stripped(F.substring(F.col("row_text"), F.lit(1), F.col("start")))).filter(is_label(F.col("label")))
    from_bare = bare.withColumn("stop", F.length("row_text")).withColumn("joins", F.array().cast("array<int>"))
    found = _candidates(from_lines.select(columns).unionByName(from_cells.select(columns)).unionByName(from_bare.select(columns)))
    missed = placed.filter("labelled").join(found.select(*KEYS, "row"), [*KEYS, "row"], "left_anti")
    digits = F.col("row_text").rlike("[0-9]")
    note = F.when(digits, M.note("totalAmountNotRead", page=F.col("page"), text=F.col("row_text"))).otherwise(M.note("totalLabelNoAmount", page=F.col("page"), text=F.col("row_text")))
    return found, missed.select(*KEYS, F.col("row").alias("ord"), note.alias("note"), digits.alias("unread"))


def gate_totals(found: DataFrame, streams: DataFrame) -> DataFrame:
    """Adds ``proved``: whether the amount can be traced to the page's text; ambiguous amounts need no proof yet."""
    from .evidence import field_fails, words_in

    field = F.struct(F.col("raw").alias("raw"), F.col("value").alias("value"), F.col("currency").alias("currency"), F.lit(None).cast("string").alias("per"), F.col("start").alias("start"), F.col("stop").alias("stop"))
    joined = found.join(streams.select(*KEYS, "stream_text"), KEYS, "left")
    fails = field_fails(field, F.col("row_text"), words_in(F.col("row_text"), F.col("stream_text")), F.col("conventions"), F.lit(True), F.lit(False))
    return joined.withColumn("proved", F.col("stream_text").isNotNull() & ~fails).drop("stream_text")


def _units(value: Column, dp: Column) -> Column:
    """A printed amount in its smallest unit; exact for every amount that a double holds exactly."""
    return (value * F.pow(F.lit(10.0), dp)).try_cast("decimal(38,0)")


def check_totals(pages: DataFrame, items: DataFrame, candidates: DataFrame, unread: DataFrame) -> DataFrame:
    """One row for each document: name, outcome, reason, derived value, pages covered, stated totals, refusals and notes.

    ``pages`` has doc_id, page, status, item_count and no_table; ``candidates``
    comes from ``gate_totals``; ``unread`` has doc_id and unread (a count).
    """
    doc = Window.partitionBy("doc_id")
    state = pages.withColumn("lines_here", (F.col("item_count") > 0) | (F.col("status") == "partial") | ((F.col("status") == "refused") & ~F.col("no_table")))
    documents = state.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("lines_here"), F.col("page"))), F.lit(0)).alias("last_page"), F.sort_array(F.collect_list(F.struct("page", "status", "no_table"))).alias("pages"))
    dp = F.coalesce(F.max("total_dp"), F.lit(0))
    facts = items.groupBy("doc_id").agg(
        dp.alias("lines_dp"),
        (F.count_if(F.col("line_total").isNotNull()) > 0).alias("any_total"),
        F.min(F.when(F.col("line_total").isNotNull(), F.col("total_dp") > 0)).alias("decimals_only"),
        F.sort_array(F.collect_list(F.struct("page", "row", F.col("line_total").alias("value"), F.col("total_dp").alias("dp"), "id"))).alias("items"),
    )
    base = documents.join(facts, "doc_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<page:int,row:int,value:double,dp:int,id:string>>"))).withColumn("lines_dp", F.coalesce("lines_dp", F.lit(0)))
    base = base.withColumn("sum_units", F.aggregate(F.filter("items", lambda i: i["value"].isNotNull()), F.lit(0).cast("decimal(38,0)"), lambda acc, i: F.try_add(acc, _units(i["value"], F.col("lines_dp")))))
    listed = candidates.join(base.select("doc_id", "last_page", "lines_dp", "decimals_only", "any_total", "sum_units"), "doc_id")
    count_like = (F.col("status") == "ok") & F.col("kind").isNotNull() & F.col("marker").isNull() & (F.col("dp") == 0) & F.coalesce(F.col("decimals_only") & F.col("any_total"), F.lit(False)) & (_units(F.col("value"), F.col("lines_dp")) != F.col("sum_units"))
    told = listed.withColumn("set_aside", F.coalesce(F.col("proved") & count_like, F.lit(False))).withColumn("covers", F.col("page") >= F.col("last_page"))
    printed = ~F.col("set_aside")
    flags = told.withColumn("sub", F.max((printed & (F.col("kind") == "subtotal") & F.col("covers")).cast("int")).over(doc) == 1).withColumn("wanted", F.when(F.coalesce("sub", F.lit(False)), "subtotal").otherwise("total"))
    read = F.col("proved") & (F.col("status") == "ok") & printed
    hits = F.coalesce((F.col("kind") == F.col("wanted")) & F.col("covers"), F.lit(False))
    entry = F.struct("page", "row", "row_text", "label", "kind", "raw", "value", "dp", "status", "first", "second", "marker", "currency", "after", "fits", "conventions", "covers", "proved", "set_aside", (read & hits).alias("target"), (F.col("proved") & (F.col("status") == "ambiguous") & hits).alias("unclear"), (~F.col("proved") & hits).alias("rejected"), (read & F.col("kind").isNull()).alias("unknown"), "start", "stop")
    gathered = flags.groupBy("doc_id").agg(F.max("sub").alias("sub"), F.sort_array(F.collect_list(entry)).alias("all"))
    whole = base.join(gathered, "doc_id", "left").join(unread, "doc_id", "left").withColumn("unread", F.coalesce("unread", F.lit(0))).withColumn("sub", F.coalesce("sub", F.lit(False)))
    whole = written(whole.withColumn("all", F.coalesce("all", F.array().cast(gathered.schema["all"].dataType))), "totals-gathered")
    pick = lambda name: F.filter("all", lambda c: c[name])
    tax = F.exists("all", lambda c: ~c["set_aside"] & ((F.coalesce(c["kind"], F.lit("")) == "gst") | (c["kind"].isNull() & has_percentage(c["label"]))))
    early = F.exists("all", lambda c: c["proved"] & (c["status"] == "ok") & ~c["set_aside"] & F.coalesce(c["kind"].isin("subtotal", "total"), F.lit(False)) & ~c["covers"])
    known = (
        whole.withColumn("targets", pick("target"))
        .withColumn("unclear", F.get(pick("unclear"), F.lit(0)))
        .withColumn("rejected", F.size(pick("rejected")) > 0)
        .withColumn("tax", tax)
        .withColumn("early", early)
        .withColumn("covering", F.filter("all", lambda c: c["unknown"] & c["covers"]))
        .withColumn("aside", F.exists("all", lambda c: c["set_aside"]))
    )

    def added(c: Column) -> Column:
        """What adding up the lines to a figure's page gives: the first thing in the way, or the sum."""
        upto = F.filter("items", lambda i: i["page"] <= c["page"])
        blocked = F.get(F.filter("pages", lambda p: (p["page"] <= c["page"]) & (p["status"] != "extracted")), F.lit(0))
        bare = F.get(F.filter(upto, lambda i: i["value"].isNull()), F.lit(0))
        dp_ = F.greatest(c["dp"], F.coalesce(F.array_max(F.transform(upto, lambda i: i["dp"])), F.lit(0)))
        total = F.aggregate(upto, F.lit(0).cast("decimal(38,0)"), lambda acc, i: F.try_add(acc, _units(F.coalesce(i["value"], F.lit(0.0)), dp_)))
        gap = F.abs(F.try_subtract(total, _units(c["value"], dp_)))
        kind = F.when(blocked.isNotNull(), "pageNotRead").when(bare.isNotNull(), "missingLineTotal").when(F.size(upto) == 0, "noLines").otherwise("added")
        scale = F.pow(F.lit(10.0), dp_)
        return F.struct(c.alias("c"), kind.alias("kind"), F.coalesce(blocked["page"], bare["page"]).alias("page"), blocked["status"].alias("status"), blocked["no_table"].alias("no_table"), (total / scale).alias("value"), (gap / scale).alias("gap"), (gap <= F.floor(F.size(upto) * scale / 100)).alias("matches"), dp_.alias("dp"), F.transform(upto, lambda i: i["id"]).alias("ids"))

    summed = known.withColumn("sums", F.transform("covering", added)).withColumn("goal", F.when(F.size("targets") > 0, added(F.element_at("targets", -1))))
    matching = F.filter("sums", lambda s: (s["kind"] == "added") & s["matches"])
    chosen = summed.withColumn("chosen", F.when(F.size(matching) > 0, F.element_at(matching, -1))).withColumn("amounts", F.size(F.array_distinct(F.transform("targets", lambda c: c["value"]))))
    none = F.size("targets") == 0
    rule = (
        F.when(F.col("unclear").isNotNull(), "unclear")
        .when(none & F.col("rejected"), "totalNotProved")
        .when(~F.col("sub") & ~none & F.col("tax"), "gstNoSubtotal")
        .when(none & F.col("tax") & (F.size("covering") > 0), "gstNoSubtotalUnknown")
        .when(none & F.col("chosen").isNotNull(), "unknownUsed")
        .when(none & F.col("early"), "earlyTotal")
        .when(none & F.exists("sums", lambda s: s["kind"] == "added"), "unknownFigure")
        .when(none & (F.size("sums") > 0), "unknownNotCompared")
        .when(none & (F.col("unread") > 0), "totalNotRead")
        .when(none & F.col("aside"), "totalLooksLikeCount")
        .when(none, "nothingStated")
        .when(F.col("amounts") > 1, "twoAmounts")
        .when(F.col("goal.kind") != "added", F.col("goal.kind"))
        .when(F.col("goal.matches"), "pass")
        .otherwise("fail")
    )
    ruled = written(chosen.withColumn("rule", rule), "totals-ruled")
    wanted = F.when(F.col("sub"), "subtotal").otherwise("total")
    word, goal = M.total_word(wanted), F.col("goal")
    status_words = F.when(goal["no_table"], "has no table we could read, so it may hold lines we didn't see").when(goal["status"] == "partial", "was only partly read").when(goal["status"] == "blank", "is blank").otherwise("couldn't be read")
    distinct = F.filter("targets", lambda c, i: ~F.exists(F.slice(F.col("targets"), F.lit(1), F.greatest(i, F.lit(1))), lambda o: (i > 0) & (o["value"] == c["value"])))
    style = F.when(goal["c"]["fits"].bitwiseAND(goal["c"]["conventions"]) != 0, goal["c"]["fits"].bitwiseAND(goal["c"]["conventions"])).otherwise(goal["c"]["conventions"])
    dressed = lambda v: N.written(v, goal["dp"], style, goal["c"]["marker"], goal["c"]["after"])
    pages_upto = F.sequence(F.lit(1), F.greatest(goal["c"]["page"], F.lit(1)))
    message = (
        F.when(F.col("rule") == "twoAmounts", M.refusal("TOTALS_UNVERIFIABLE.twoAmounts", count=M.count_word(F.size(distinct)), label=word, list=T.listed(F.transform(distinct, lambda c: F.concat(c["raw"], F.lit(" on page "), c["page"].cast("string"))))))
        .when(F.col("rule") == "pageNotRead", M.refusal("TOTALS_UNVERIFIABLE.pageNotRead", label=word, at=goal["c"]["page"], page=goal["page"], what=status_words))
        .when(F.col("rule") == "missingLineTotal", M.refusal("TOTALS_UNVERIFIABLE.missingLineTotal", label=word, at=goal["c"]["page"], page=goal["page"]))
        .when(F.col("rule") == "fail", M.refusal("TOTALS_DISAGREE", pages=T.pages_text(pages_upto), sum=dressed(goal["value"]), label=word, stated=goal["c"]["raw"], difference=dressed(goal["gap"])))
    )
    code = F.when(F.col("rule") == "fail", "TOTALS_DISAGREE").when(F.col("rule").isin("twoAmounts", "pageNotRead", "missingLineTotal"), "TOTALS_UNVERIFIABLE")
    reasons = F.try_element_at(F.create_map(*[F.lit(x) for pair in M.REASONS.items() for x in pair]), F.when(F.col("rule") == "gstNoSubtotalUnknown", "gstNoSubtotal").otherwise(F.col("rule")))
    plain = T.plain_number
    two = lambda c: M.refusal("AMBIGUOUS_NUMBER_FORMAT.total", page=c["page"], raw=c["raw"], first=plain(c["first"]), second=plain(c["second"]))
    at_row = lambda c, tail: F.concat(F.lit("totals-p"), c["page"].cast("string"), F.lit("-r"), c["row"].cast("string"), F.lit(tail))
    refusal = lambda id_, code_, page, text, c: F.struct(id_.alias("id"), code_.alias("code"), page.cast("int").alias("page"), text.alias("message"), F.array(F.struct(c["page"].alias("page"), c["row_text"].alias("source_text"))).alias("evidence"))
    unproved = F.transform(F.filter("all", lambda c: ~c["proved"]), lambda c: refusal(at_row(c, "-EVIDENCE_CHECK_FAILED"), F.lit("EVIDENCE_CHECK_FAILED"), c["page"], M.refusal("EVIDENCE_CHECK_FAILED", page=c["page"], what=F.concat(F.lit("'"), c["raw"], F.lit("'"))), c))
    unclear = F.transform(F.filter("all", lambda c: c["proved"] & (c["status"] == "ambiguous")), lambda c: refusal(at_row(c, "-AMBIGUOUS_NUMBER_FORMAT"), F.lit("AMBIGUOUS_NUMBER_FORMAT"), c["page"], two(c), c))
    name = F.when(F.col("sub"), "lines_vs_subtotal").otherwise("lines_vs_total")
    final = F.when(code.isNotNull(), F.array(refusal(F.concat(F.lit("totals-"), name), code, F.element_at("targets", -1)["page"], message, F.element_at("targets", -1))))
    some_target = ~none | F.col("unclear").isNotNull() | F.col("rejected")
    looks = (~F.col("rule").isin("unclear", "totalNotProved")) & none
    said = lambda note_code, c: F.struct(c["page"].alias("page"), c["row"].alias("row"), M.note(note_code, page=c["page"], text=c["row_text"]).alias("note"))
    empty = F.array().cast("array<struct<page:int,row:int,note:struct<code:string,level:string,text:string>>>")
    notes = F.concat(
        F.transform(F.filter("all", lambda c: c["set_aside"]), lambda c: said("totalNotMoney", c)),
        F.when(some_target, F.transform(pick("unknown"), lambda c: said("unknownFigureIgnored", c))).otherwise(empty),
        F.when(looks, F.transform(F.filter("all", lambda c: c["unknown"] & ~c["covers"]), lambda c: said("figureBeforeLines", c))).otherwise(empty),
        F.when(F.col("rule") == "gstNoSubtotalUnknown", F.transform("covering", lambda c: said("unknownFigureIgnoredTax", c)))
        .when(
            looks,
            F.transform(
                F.filter("sums", lambda s: ~(s["c"]["page"].eqNullSafe(F.col("chosen.c.page")) & s["c"]["row"].eqNullSafe(F.col("chosen.c.row")))),
                lambda s: F.when((s["kind"] == "added") & s["matches"], said("unknownFigureAlsoMatches", s["c"])).when(s["kind"] == "added", said("unknownFigureNotPlaced", s["c"])).otherwise(said("unknownFigureNotCompared", s["c"])),
            ),
        )
        .otherwise(empty),
        F.when(F.col("rule") == "unknownUsed", F.array(said("unknownLabelTotalUsed", F.col("chosen.c")))).otherwise(empty),
    )
    used = F.coalesce(F.when(F.col("rule") == "unknownUsed", F.col("chosen")), goal)
    stated = F.array_sort(
        F.concat(
            F.transform(F.filter("all", lambda c: c["proved"] & (c["status"] == "ok") & ~c["set_aside"] & c["kind"].isNotNull()), lambda c: _stated(c, c["kind"], F.lit(True))),
            F.when(F.col("rule") == "unknownUsed", F.array(_stated(F.col("chosen.c"), F.lit("total"), F.lit(False)))).otherwise(F.array().cast("array<struct<page:int,row:int,label:string,label_known:boolean,source_text:string,raw:string,value:double,currency:string,start:int,stop:int>>")),
        )
    )
    passes = F.col("rule").isin("pass", "unknownUsed")
    return ruled.select(
        "doc_id",
        F.when(F.col("rule") == "unknownUsed", "lines_vs_total").otherwise(name).alias("name"),
        F.when(passes, "pass").when(F.col("rule") == "fail", "fail").otherwise("not_checked").alias("outcome"),
        "rule",
        F.when(~passes & (F.col("rule") != "fail"), F.coalesce(F.when(F.col("rule") == "unclear", two(F.col("unclear"))), message, reasons)).alias("reason"),
        F.when(passes | (F.col("rule") == "fail"), used["value"]).alias("derived"),
        F.when(passes | (F.col("rule") == "fail"), used["ids"]).alias("from_items"),
        F.when(passes | F.col("rule").isin("fail", "pageNotRead", "missingLineTotal", "noLines"), F.sequence(F.lit(1), F.greatest(used["c"]["page"], F.lit(1)))).otherwise(F.array().cast("array<int>")).alias("pages_covered"),
        F.when(passes, used["c"]["label"]).alias("checked_label"),
        stated.alias("stated"),
        F.concat(unproved, unclear, F.coalesce(final, F.array().cast("array<struct<id:string,code:string,page:int,message:string,evidence:array<struct<page:int,source_text:string>>>>"))).alias("refusals"),
        notes.alias("notes"),
        (F.size(unclear) > 0).alias("ambiguous"),
    )


def _stated(c: Column, label: Column, known: Column) -> Column:
    return F.struct(c["page"].alias("page"), c["row"].alias("row"), label.alias("label"), known.alias("label_known"), c["row_text"].alias("source_text"), c["raw"].alias("raw"), c["value"].alias("value"), c["currency"].alias("currency"), c["start"].alias("start"), c["stop"].alias("stop"))
