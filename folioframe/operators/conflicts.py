"""Contradictions: the same thing counted differently in two places outside the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import messages as M
from ..functions import text as T

PAIR = r"(?U)(?<!\S)([0-9][0-9.,]*)\s+([\p{L}\p{M}]+)"  # the number's marks are checked afterwards, without a nested loop


def _listed(word: Column, words: tuple[str, ...]) -> Column:
    return F.lower(word).isin(*words) | T.singular(word).isin(*words)


def mentions(texts: DataFrame) -> DataFrame:
    """doc_id, page, row, no, text, number, word (singular), value: number-word pairs that count something.

    ``texts`` has doc_id, page, row, part and text (a cell) and line (the row's
    text). Lines that begin with a document number's label, measures, months
    and postcodes give none.
    """
    plain = texts.filter(~T.starts_with(F.col("line"), X.DOCUMENT_NUMBER_LABELS))
    found = plain.select("doc_id", "page", "row", "line", "part", F.posexplode(F.regexp_extract_all("text", F.lit(PAIR), F.lit(0))).alias("k", "said"))
    split = found.withColumn("number", F.regexp_extract("said", PAIR, 1)).withColumn("unit", F.regexp_extract("said", PAIR, 2))
    postcode = F.col("number").rlike("^[0-9]{4,}$") & F.col("unit").rlike(r"^\p{Lu}")
    well_formed = F.col("number").rlike("[0-9]$") & ~F.col("number").rlike("[.,]{2}")
    kept = split.filter(well_formed).filter(~_listed(F.col("unit"), X.NOT_COUNT_WORDS) & ~_listed(F.col("unit"), X.MONTHS) & ~postcode)
    return kept.select("doc_id", "page", "row", "part", "k", "line", F.col("said").alias("text"), "number", T.singular(F.col("unit")).alias("word"), T.printed_value(F.col("number")).alias("value"))


def conflicting_figures(found: DataFrame) -> DataFrame:
    """doc_id, word, message, mentions and evidence of each word with two values on two rows.

    The first mention of each value is quoted, five at most, and up to five
    lines, those of the quoted mentions first, in document order. Values and
    lines are ranked before they are gathered, so that however often a word
    is counted, its row holds a few of them only.
    """
    word = Window.partitionBy("doc_id", "word")
    place = F.struct("page", "row", "part", "k")
    first = found.groupBy("doc_id", "word", "value").agg(F.min(F.struct(place.alias("place"), "text", "page", "row", "line")).alias("m"))
    values = first.select("doc_id", "word", "m", F.row_number().over(word.orderBy("m")).alias("rank"))
    counted = values.groupBy("doc_id", "word").agg(F.max("rank").alias("values"), F.sort_array(F.collect_list(F.when(F.col("rank") <= X.MAX_QUOTED, F.col("m")))).alias("ms"))
    rows = found.groupBy("doc_id", "word", "page", "row").agg(F.min(place).alias("place"), F.first("line").alias("line"))
    placed = rows.select("doc_id", "word", "page", "row", "line", F.row_number().over(word.orderBy("page", "row")).alias("rank")).filter(F.col("rank") <= 2 * X.MAX_QUOTED)
    lines = placed.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list(F.struct("page", "row", "line"))).alias("lines"))
    both = counted.filter("values >= 2").join(lines.filter("size(lines) >= 2"), ["doc_id", "word"]).withColumn("quoted", F.slice("ms", 1, X.MAX_QUOTED))
    told = F.array_distinct(F.transform("quoted", lambda m: F.struct(m["page"].alias("page"), m["row"].alias("row"), m["line"].alias("line"))))
    evidence = F.array_sort(F.slice(F.concat(told, F.filter("lines", lambda x: ~F.array_contains(told, x))), 1, X.MAX_QUOTED))
    q = lambda i: F.get("quoted", F.lit(i))
    listed = T.listed(F.transform("quoted", lambda m: F.concat(m["text"], F.lit(" (page "), m["page"].cast("string"), F.lit(")"))))
    two = M.refusal("CONFLICTING_FIGURES", first=q(0)["text"], page1=q(0)["page"], second=q(1)["text"], page2=q(1)["page"])
    message = F.when(F.size("quoted") == 2, two).otherwise(M.refusal("CONFLICTING_FIGURES.many", list=listed))
    return both.select("doc_id", "word", message.alias("message"), F.transform("quoted", lambda m: F.struct(m["text"].alias("text"), m["page"].alias("page"))).alias("mentions"), evidence.alias("evidence"), q(0)["place"].alias("place"))


def outside_texts(layout: DataFrame, used: DataFrame, withheld: DataFrame) -> DataFrame:
    """The cells outside the tables: above and below, without other tables, carried totals and rows used as totals.

    ``used`` has doc_id, page, row; pages in ``withheld`` (credit notes) say nothing.
    """
    around = F.filter("lines", lambda x: (F.array_contains("above", x["row"]) | F.array_contains("below", x["row"])) & ~F.array_contains("others", x["row"]))
    rows = layout.join(withheld, ["doc_id", "page"], "left_anti").select("doc_id", "page", F.explode(around).alias("x"))
    cells = rows.select("doc_id", "page", F.col("x.row").alias("row"), F.col("x.text").alias("line"), F.posexplode("x.cells").alias("part", "c"))
    return cells.join(used.select("doc_id", "page", "row").distinct(), ["doc_id", "page", "row"], "left_anti").select("doc_id", "page", "row", "line", "part", F.col("c.text").alias("text"))


