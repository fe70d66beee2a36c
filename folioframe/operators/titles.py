"""What the lines above a table say of the page: credit notes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

KEYS = ["doc_id", "page"]


def page_titles(layout: DataFrame) -> DataFrame:
    """doc_id, page, title_lines, credit_title, credit_row and summary_title of every page with a table.

    A line with a label and a colon is no title; a credit word counts in a
    title or a label, a summary word in a title only, and credit beats summary.
    """
    above = F.filter("lines", lambda x: F.array_contains("above", x["row"]))
    told = layout.filter("columns is not null").select(*KEYS, F.transform(above, lambda x: F.struct(x["row"].alias("row"), x["text"].alias("text"), T.label_part(x["text"]).alias("label"))).alias("top"))
    credit = F.get(F.filter("top", lambda x: T.has_word(F.coalesce(x["label"], x["text"]), X.CREDIT_WORDS)), F.lit(0))
    summary = F.get(F.filter("top", lambda x: x["label"].isNull() & T.has_word(x["text"], X.SUMMARY_WORDS)), F.lit(0))
    found = told.withColumn("credit", credit).withColumn("summary", summary)
    return found.select(
        *KEYS,
        F.transform(F.filter("top", lambda x: x["label"].isNull()), lambda x: x["text"]).alias("title_lines"),
        F.when(F.col("credit").isNotNull(), T.quoted_part(F.col("credit.text"), X.CREDIT_WORDS)).alias("credit_title"),
        F.col("credit.row").alias("credit_row"),
        F.when(F.col("credit").isNull() & F.col("summary").isNotNull(), T.quoted_part(F.col("summary.text"), X.SUMMARY_WORDS)).alias("summary_title"),
    )
