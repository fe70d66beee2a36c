"""The evidence gate: a number that can't be traced to the page's text is refused, never shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import numbers as N
from ..functions.text import let
from ..plans.store import written

KEYS = ["doc_id", "page"]


def words_in(source: Column, stream: Column) -> Column:
    """Whether every word of the source text stands in the page's stream."""
    return F.forall(F.filter(F.split(source, r"(?U)\s+"), lambda w: w != ""), lambda w: F.contains(stream, w))


def field_fails(field: Column, source: Column, on_page: Column, conventions: Column, money: Column, priced: Column) -> Column:
    """Whether a number field isn't what its span and page say: value, currency and unit are read again.

    ``on_page`` says whether all words of the source text stand on the page.
    """

    def compared(parts: Column, reading: Column) -> Column:
        same_value = (reading["status"] == "ok") & (reading["value"] == field["value"])
        same_currency = ~money | N.currency_code(parts["marker"]).eqNullSafe(field["currency"])
        same_unit = ~priced | parts["per"].eqNullSafe(field["per"])
        return same_value & same_currency & same_unit

    read_again = let(N.analyse(field["raw"]), lambda parts: let(N.read(parts, conventions), lambda reading: compared(parts, reading)))
    spanned = F.substring(source, field["start"] + 1, field["stop"] - field["start"]) == field["raw"]
    good = field["start"].isNotNull() & spanned & on_page & read_again
    return field["value"].isNotNull() & ~F.coalesce(good, F.lit(False))


def evidence_gate(items: DataFrame, streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that pass, refusals of those that don't); ``streams`` has doc_id, page and stream_text."""
    joined = items.join(streams.select(*KEYS, "stream_text"), KEYS, "left").withColumn("on_page", words_in(F.col("source_text"), F.col("stream_text")))
    failing = F.filter("fields", lambda f: field_fails(f, F.col("source_text"), F.col("on_page"), F.col("conventions"), f["role"].isin("unitPrice", "lineTotal"), f["role"] == "unitPrice"))
    checked = joined.withColumn("failed", F.when(F.col("stream_text").isNull(), F.lit("")).otherwise(F.get(failing, F.lit(0))["raw"]))
    checked = written(checked.drop("stream_text", "on_page"), "gated")
    passed = checked.filter("failed is null").drop("failed")
    what = F.when(F.col("failed") == "", "a value").otherwise(F.concat(F.lit("'"), F.col("failed"), F.lit("'")))
    refused = checked.filter("failed is not null").select(*KEYS, "row", F.lit("EVIDENCE_CHECK_FAILED").alias("code"), M.refusal("EVIDENCE_CHECK_FAILED", page=F.col("page"), what=what).alias("message"), "source_text")
    return passed, refused
