"""The whole way from positioned text to a reply: every stage a DataFrame.

Each stage is written once to the shared folder: it cuts the lineage, keeps
plans small, and a later stage reads only the columns that it names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import messages as M
from ..functions import numbers as N
from ..functions import text as T
from ..operators import classify, conflicts, evidence, items, layout, roles, titles, totals
from .store import written

KEYS = ["doc_id", "page"]
NOTE = "struct<code:string,level:string,text:string>"


@dataclass
class DocumentPlan:
    """``pages`` has doc_id, page, image_count, drawing_count; ``pieces`` the drawn texts.

    Each property is one table of the result, planned when asked for.
    """

    pages: DataFrame
    pieces: DataFrame

    @cached_property
    def classified(self) -> DataFrame:
        return written(classify.classify_pages(self.pages, self.pieces), "classified")

    @cached_property
    def streams(self) -> DataFrame:
        return self.classified.select(*KEYS, "stream_text")

    @cached_property
    def layouts(self) -> DataFrame:
        return written(layout.lay_out_pages(classify.upright_pieces(self.classified)), "layouts")

    @cached_property
    def titles(self) -> DataFrame:
        return written(titles.page_titles(self.layouts), "titles")

    @cached_property
    def tables(self) -> DataFrame:
        """The layouts that are read on: with a table, and not of a credit or return page."""
        credit = self.titles.filter("credit_title is not null").select(*KEYS)
        return written(self.layouts.filter("columns is not null").join(credit, KEYS, "left_anti"), "tables")

    @cached_property
    def grid(self) -> DataFrame:
        return written(roles.grid(self.tables), "grid")

    @cached_property
    def conventions(self) -> DataFrame:
        return roles.page_conventions(self.grid)

    @cached_property
    def facts(self) -> DataFrame:
        return written(roles.column_facts(self.grid, self.conventions), "facts")

    @cached_property
    def roles(self) -> DataFrame:
        inferred = roles.infer_from_numbers(self.facts, roles.product_triples(self.facts))
        return written(roles.decide_roles(inferred, self.tables), "roles")

    @cached_property
    def judged(self) -> DataFrame:
        return items.judge_rows(items.read_rows(items.body_rows(self.tables, self.roles)))

    @cached_property
    def gated(self) -> tuple[DataFrame, DataFrame]:
        return evidence.evidence_gate(written(items.line_items(self.judged), "items"), self.streams)

    @cached_property
    def line_items(self) -> DataFrame:
        return self.gated[0]

    @cached_property
    def row_refusals(self) -> DataFrame:
        return written(items.row_refusals(self.judged).unionByName(self.gated[1]), "row-refusals")

    @cached_property
    def page_refusals(self) -> DataFrame:
        """doc_id, page, code, message and evidence of pages that are refused, or read in part."""
        page = F.col("page")
        form = F.concat_ws(".", "code", F.when(F.col("code").isin("NO_TEXT_LAYER", "ROTATED_TEXT"), F.col("form")))
        said = {key: M.refusal(key, page=page) for key in ("NO_TEXT_LAYER.scan", "NO_TEXT_LAYER.shapes", "GARBLED_TEXT", "ROTATED_TEXT.numbers", "ROTATED_TEXT.all", "PAGE_LOAD_FAILED")}
        message = F.lit(None).cast("string")
        for key, text in said.items():
            message = F.when(form == key, text).otherwise(message)
        none = F.array().cast("array<struct<page:int,source_text:string>>")
        unread = self.classified.filter("kind = 'refused'").select(*KEYS, "code", message.alias("message"), none.alias("evidence"))
        quoted = lambda lines: F.transform(lines, lambda x: F.struct(page.alias("page"), x["text"].alias("source_text")))
        late = F.when(F.col("problem").startswith("Overtime:"), M.refusal("PAGE_LOAD_FAILED.timeout", page=page)).otherwise(said["PAGE_LOAD_FAILED"])
        broken = self.layouts.filter("problem is not null").select(*KEYS, F.lit("PAGE_LOAD_FAILED").alias("code"), late.alias("message"), none.alias("evidence"))
        bare = self.layouts.filter("columns is null and problem is null").join(self.classified.select(*KEYS, "image_count", "piece_count"), KEYS)
        scan = (F.col("image_count") > 0) & (F.col("piece_count") < X.MOSTLY_SCAN_PIECES)
        untabled = bare.select(
            *KEYS,
            F.when(scan, "NO_TEXT_LAYER").otherwise("NO_TABLE_FOUND").alias("code"),
            F.when(scan, M.refusal("NO_TEXT_LAYER.mostlyScan", page=page)).otherwise(M.refusal("NO_TABLE_FOUND", page=page)).alias("message"),
            F.when(scan, none).otherwise(quoted(F.slice("lines", 1, X.NO_TABLE_EVIDENCE_ROWS))).alias("evidence"),
        )
        rows = F.concat("header_rows", F.flatten(F.transform("body", lambda b: F.concat(F.array(b["row"]), b["more"]))))
        credit = self.layouts.join(self.titles.filter("credit_title is not null").select(*KEYS, "credit_title", "credit_row"), KEYS)
        shown = F.transform(F.concat(F.array("credit_row"), rows), lambda r: F.get(F.filter("lines", lambda x: x["row"] == r), F.lit(0)))
        credits = credit.select(*KEYS, F.lit("CREDIT_OR_RETURN_PAGE").alias("code"), M.refusal("CREDIT_OR_RETURN_PAGE", page=page, title=F.col("credit_title")).alias("message"), quoted(shown).alias("evidence"))
        heads = F.concat("header_rows", F.transform("body", lambda b: b["row"]))
        unclear = self.tables.join(self.roles.filter("refusal is not null").select(*KEYS, F.col("refusal").alias("code"), "message"), KEYS)
        columns = unclear.select(*KEYS, "code", "message", quoted(F.transform(heads, lambda r: F.get(F.filter("lines", lambda x: x["row"] == r), F.lit(0)))).alias("evidence"))
        return written(unread.unionByName(broken).unionByName(untabled).unionByName(credits).unionByName(columns), "page-refusals")

    @cached_property
    def diagnostics(self) -> DataFrame:
        """doc_id, page, stage, cause, error_name and error_message of pages that failed: for the log, never for the reply."""
        name, said = F.substring_index("problem", ":", 1), F.regexp_replace("problem", r"^[^:]*:\s*", "")
        laid = self.layouts.filter("problem is not null").select(*KEYS, F.lit("layout").alias("stage"), F.when(name == "Overtime", "timeout").otherwise("error").alias("cause"), name.alias("error_name"), said.alias("error_message"))
        none = F.lit(None).cast("string")
        read = self.classified.filter("code = 'PAGE_LOAD_FAILED'").select(*KEYS, F.lit("read").alias("stage"), F.lit("error").alias("cause"), none.alias("error_name"), none.alias("error_message"))
        return laid.unionByName(read)

    @cached_property
    def page_status(self) -> DataFrame:
        """doc_id, page, status, item_count and no_table of every page."""
        counted = self.line_items.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("item_count"))
        refused = self.row_refusals.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("left_out"))
        whole = self.page_refusals.select(*KEYS, F.col("code").alias("page_code"))
        joined = self.classified.select(*KEYS, "kind").join(counted, KEYS, "left").join(refused, KEYS, "left").join(whole, KEYS, "left")
        items_ = F.coalesce("item_count", F.lit(0))
        status = (
            F.when(F.col("kind") == "blank", "blank")
            .when(F.col("page_code").isin(*X.PARTIAL_CODES), "partial")
            .when(F.col("page_code").isNotNull(), "refused")
            .when(F.col("left_out") > 0, F.when(items_ > 0, "partial").otherwise("refused"))
            .otherwise("extracted")
        )
        return written(joined.select(*KEYS, status.alias("status"), items_.cast("long").alias("item_count"), F.coalesce("left_out", F.lit(0)).cast("long").alias("left_out"), "page_code", F.coalesce(F.col("page_code") == "NO_TABLE_FOUND", F.lit(False)).alias("no_table")), "page-status")

    @cached_property
    def totals_found(self) -> tuple[DataFrame, DataFrame]:
        found, missed = totals.totals_candidates(self.tables, self.roles, items.totals_rows(self.judged))
        return written(totals.gate_totals(found, self.streams), "totals"), missed

    @cached_property
    def checks(self) -> DataFrame:
        unread = self.totals_found[1].groupBy("doc_id").agg(F.count_if("unread").alias("unread"))
        return written(totals.check_totals(self.page_status, self.line_items, self.totals_found[0], unread), "checks")

    @cached_property
    def gst_basis(self) -> DataFrame:
        """doc_id and basis: what the line total's heading says, else the label of the total that was matched."""
        heads = self.roles.select(*KEYS, F.explode("columns").alias("c")).filter("c.role = 'lineTotal' and c.header is not null").select("doc_id", F.struct("page", "c.position").alias("place"), T.gst_basis(F.col("c.header")).alias("basis"))
        labels = self.checks.filter("checked_label is not null").select("doc_id", F.struct(F.lit(1 << 30).alias("page"), F.lit(0).alias("position")).alias("place"), T.gst_basis(F.col("checked_label")).alias("basis"))
        first = heads.unionByName(labels).filter("basis is not null").groupBy("doc_id").agg(F.min_by("basis", "place").alias("basis"))
        return self.pages.select("doc_id").distinct().join(first, "doc_id", "left").select("doc_id", F.coalesce("basis", F.lit("unstated")).alias("basis"))

    @cached_property
    def conflicts(self) -> DataFrame:
        withheld = self.titles.filter("credit_title is not null").select(*KEYS)
        scans = self.page_refusals.filter("code = 'NO_TEXT_LAYER'").select(*KEYS)
        texts = conflicts.outside_texts(self.layouts, self.totals_found[0], withheld.unionByName(scans))
        return conflicts.conflicting_figures(conflicts.mentions(texts))

    @cached_property
    def number_format(self) -> DataFrame:
        """doc_id, decimal, grouping and settled: the marks that all pages share."""
        ambiguous = self.judged.filter("outcome = 'AMBIGUOUS_NUMBER_FORMAT'").select("doc_id").distinct().withColumn("open", F.lit(True))
        every = self.pages.select(*KEYS).join(self.roles.select(*KEYS, "conventions"), KEYS, "left")
        shared = every.groupBy("doc_id").agg(F.bit_and(F.coalesce("conventions", F.lit(N.ALL))).alias("mask"))
        joined = shared.join(ambiguous, "doc_id", "left").join(self.checks.select("doc_id", "ambiguous"), "doc_id", "left")
        marks = N.marks_of(F.col("mask"))
        settled = (F.col("mask") != 0) & ~F.coalesce("open", F.lit(False)) & ~F.coalesce("ambiguous", F.lit(False))
        return joined.select("doc_id", marks["decimal"].alias("decimal"), F.when(marks["grouping"] == "", "none").otherwise(marks["grouping"]).alias("grouping"), settled.alias("settled"))

    @cached_property
    def page_notes(self) -> DataFrame:
        """doc_id, page and the distinct notes of each page, in the order in which they arise."""
        page = F.col("page")
        told = lambda df, rank, ord_, note: df.select(*KEYS, F.lit(rank).alias("rank"), ord_.cast("int").alias("ord"), note.alias("note"))
        blank = told(self.classified.filter("kind = 'blank'"), 0, F.lit(0), M.note("blankPage", page=page))
        turned = told(self.classified.filter("kind = 'text' and sideways"), 1, F.lit(0), M.note("rotatedTextIgnored", page=page))
        mostly = self.page_refusals.filter("code = 'NO_TEXT_LAYER'").select(*KEYS)
        images = told(self.classified.filter("kind = 'text' and image_count > 0").join(mostly, KEYS, "left_anti"), 2, F.lit(0), M.note("imagesNotRead", page=page))
        placed = self.layouts.select(*KEYS, F.posexplode("notes").alias("ord", "n"))
        around = told(placed, 3, F.col("ord"), M.note_of(F.col("n.code"), ("carriedForwardSkipped", "otherTableNotRead", "shortLineInTable", "sectionHeading"), page, F.col("n.text")))
        headed = self.roles.select(*KEYS, F.posexplode("notes").alias("ord", "n"))
        columns = told(headed, 4, F.col("ord"), F.col("n"))
        rows = items.table_notes(self.judged).select(*KEYS, (F.col("rank") + 5).alias("rank"), F.col("ord").cast("int").alias("ord"), "note")
        missed = told(self.totals_found[1], 8, F.col("ord"), F.col("note"))
        summary = told(self.titles.filter("summary_title is not null"), 9, F.lit(0), M.note("summaryPage", page=page, text=F.col("summary_title")))
        sums = self.checks.select("doc_id", F.posexplode("notes").alias("ord", "n")).select("doc_id", F.col("n.page").alias("page"), F.lit(10).alias("rank"), F.col("ord").cast("int").alias("ord"), F.col("n.note").alias("note"))
        every = blank
        for more in (turned, images, around, columns, rows, missed, summary, sums):
            every = every.unionByName(more)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "ord", F.col("note.text").alias("text"), "note"))), lambda x: x["note"])
        return every.filter("note is not null").groupBy(*KEYS).agg(F.array_distinct(ordered).alias("notes"))

    @cached_property
    def page_reports(self) -> DataFrame:
        heads = self.titles.select(*KEYS, "title_lines")
        columns = self.roles.select(*KEYS, "columns")
        joined = self.page_status.join(heads, KEYS, "left").join(columns, KEYS, "left").join(self.page_notes, KEYS, "left")
        return joined.select(
            *KEYS,
            "status",
            F.coalesce("title_lines", F.array().cast("array<string>")).alias("title_lines"),
            "item_count",
            F.coalesce("columns", F.array().cast(columns.schema["columns"].dataType)).alias("columns"),
            F.coalesce("notes", F.array().cast(f"array<{NOTE}>")).alias("notes"),
        )

    @cached_property
    def refusals(self) -> DataFrame:
        """doc_id, ord, id, code, scope, page, row, message and evidence of everything refused, in the reply's order."""
        page, none = F.col("page"), F.lit(None).cast("int")
        one = F.array(F.struct(page.alias("page"), F.col("source_text")))
        shape = lambda df, rank, place, id_, code, scope, page_, row, evidence_: df.select("doc_id", F.struct(F.lit(rank).alias("rank"), *place).alias("ord"), id_.alias("id"), code.alias("code"), F.lit(scope).alias("scope"), page_.cast("int").alias("page"), row.cast("int").alias("row"), "message", evidence_.alias("evidence"))
        seat = lambda p, r, k: (p.cast("int").alias("p"), r.cast("int").alias("r"), k.cast("int").alias("k"))
        found = shape(self.conflicts, 0, seat(F.col("place.page"), F.col("place.row"), F.col("place.part") * 1000 + F.col("place.k")), F.concat(F.lit("doc-CONFLICTING_FIGURES-"), F.col("word")), F.lit("CONFLICTING_FIGURES"), "document", none, none, F.transform("evidence", lambda e: F.struct(e["page"].alias("page"), e["line"].alias("source_text"))))
        whole = shape(self.page_refusals, 2, seat(page, F.lit(-1), F.lit(0)), F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.col("code")), F.col("code"), "page", page, none, F.col("evidence"))
        rows = shape(self.row_refusals, 2, seat(page, F.col("row"), F.lit(0)), F.concat(F.lit("p"), page.cast("string"), F.lit("-r"), F.col("row").cast("string"), F.lit("-"), F.col("code")), F.col("code"), "row", page, F.col("row"), one)
        sums = self.checks.select("doc_id", F.posexplode("refusals").alias("k", "t")).select("doc_id", "k", "t.*")
        totalled = shape(sums, 3, seat(F.lit(0), F.lit(0), F.col("k")), F.col("id"), F.col("code"), "totals", page, none, F.col("evidence"))
        busy = self.line_items.select("doc_id").unionByName(self.page_refusals.select("doc_id")).unionByName(self.row_refusals.select("doc_id")).distinct()
        empty = self.pages.select("doc_id").distinct().join(busy, "doc_id", "left_anti").withColumn("message", M.refusal("NO_LINE_ITEMS_FOUND"))
        nothing = shape(empty, 1, seat(F.lit(0), F.lit(0), F.lit(0)), F.lit("doc-NO_LINE_ITEMS_FOUND"), F.lit("NO_LINE_ITEMS_FOUND"), "document", none, none, F.array().cast("array<struct<page:int,source_text:string>>"))
        return found.unionByName(nothing).unionByName(whole).unionByName(rows).unionByName(totalled)

    @cached_property
    def replies(self) -> DataFrame:
        """One row for each document: the reply as a struct ``result`` and as JSON."""
        ordered = lambda df, name, *first: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*first, F.struct(*[c for c in df.columns if c not in ("doc_id", "ord")]).alias("x")))).alias("s")).select("doc_id", F.transform("s", lambda s: s["x"]).alias(name))
        pages = ordered(self.page_reports, "pages", "page")
        listed = self.line_items.select("doc_id", "page", "row", "id", F.col("source_text").alias("sourceText"), "fields", F.col("other_cells").alias("otherCells"), "missing")
        items_ = ordered(listed, "items", "page", "row")
        refused = ordered(self.refusals, "refusals", "ord")
        checks = self.checks.select("doc_id", F.struct("stated", F.struct("name", "outcome", F.col("pages_covered").alias("pagesCovered"), F.col("derived"), F.col("from_items").alias("fromItemIds"), "reason").alias("check")).alias("totals"))
        formats = self.number_format.select("doc_id", F.struct("decimal", "grouping", "settled").alias("numberFormat"))
        joined = pages.join(formats, "doc_id").join(items_, "doc_id", "left").join(refused, "doc_id", "left").join(checks, "doc_id", "left").join(self.gst_basis, "doc_id", "left")
        whole = F.struct(
            F.size("pages").alias("pageCount"),
            "numberFormat",
            "pages",
            F.coalesce("items", F.array().cast(items_.schema["items"].dataType)).alias("items"),
            F.coalesce("refusals", F.array().cast(refused.schema["refusals"].dataType)).alias("refusals"),
            "totals",
            F.col("basis").alias("gstBasis"),
        )
        return joined.select("doc_id", whole.alias("result")).withColumn("json", F.to_json("result"))


def within_page_limit(pages: DataFrame, pieces: DataFrame, limit: int = X.MAX_PAGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, pieces) of the documents that may be read, and doc_id, code and message of those with too many pages."""
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    over = written(counted.filter(F.col("n") > limit), "over-limit")
    refused = over.select("doc_id", F.lit("TOO_MANY_PAGES").alias("code"), M.refusal("TOO_MANY_PAGES", pages=F.col("n"), limit=F.lit(limit)).alias("message"))
    return pages.join(over, "doc_id", "left_anti"), pieces.join(over, "doc_id", "left_anti"), refused


def run_summary(plan: DocumentPlan) -> DataFrame:
    """doc_id, page_count, item_count and the histogram of refusal codes: the log line of a run, without document text."""
    pages = plan.page_status.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum("item_count").alias("item_count"))
    codes = plan.refusals.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("refusal_codes"))
    return pages.join(codes, "doc_id", "left")


def pages_per_part(sizes: DataFrame, limit: int) -> DataFrame:
    """doc_id and parts: the most consecutive pages whose share of a reply fits ``limit``; null where one page doesn't.

    ``sizes`` has doc_id, page, bytes and reply_bytes (of the whole reply).
    The choice of n tries every n below the page count (200 at most) and sums
    pages in buckets of n.
    """
    documents = sizes.groupBy("doc_id").agg(F.max("page").alias("pages"), F.sum("bytes").alias("own"), F.max("reply_bytes").alias("reply"))
    budget = documents.withColumn("budget", limit * F.lit(X.SPLIT_MARGIN) - F.greatest(F.col("reply") - F.col("own"), F.lit(0)))
    tried = budget.filter("pages > 1").select("doc_id", "budget", F.explode(F.sequence(F.lit(1), F.col("pages") - 1)).alias("n"))
    buckets = sizes.join(tried, "doc_id").groupBy("doc_id", "n", F.floor((F.col("page") - 1) / F.col("n")).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.first("budget").alias("budget"))
    fits = buckets.groupBy("doc_id", "n").agg(F.max("bytes").alias("largest"), F.first("budget").alias("budget")).filter("budget > 0 and largest <= budget")
    return documents.select("doc_id").join(fits.groupBy("doc_id").agg(F.max("n").alias("parts")), "doc_id", "left")


def reply_sizes(replies: DataFrame) -> DataFrame:
    """doc_id, page, bytes and reply_bytes: what each page adds to its document's reply, in UTF-8."""
    measure = lambda c: F.octet_length(F.to_json(c))
    base = replies.select("doc_id", F.octet_length("json").alias("reply_bytes"), "result")
    parts: list[Column] = [F.transform("result.pages", lambda p: F.struct(p["page"].alias("page"), measure(p).alias("bytes"))), F.transform("result.items", lambda p: F.struct(p["page"].alias("page"), measure(p).alias("bytes"))), F.transform(F.filter("result.refusals", lambda r: (r["scope"] != "document") & r["page"].isNotNull()), lambda p: F.struct(p["page"].alias("page"), measure(p).alias("bytes")))]
    return base.select("doc_id", "reply_bytes", F.explode(F.concat(*parts)).alias("p")).groupBy("doc_id", F.col("p.page").alias("page")).agg(F.sum("p.bytes").alias("bytes"), F.first("reply_bytes").alias("reply_bytes"))
