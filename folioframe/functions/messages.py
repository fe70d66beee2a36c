"""Sentences for refusals, notes and check reasons, as templates filled with columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as X

# Wording of refusals.
REFUSALS = {
    "NO_FILE": "No file arrived with the upload. Choose a PDF and try again.",
    "EMPTY_FILE": "This file is empty, so there's nothing to read.",
    "FILE_TOO_LARGE": "This file is {size}. The limit is {limit}. Try a smaller copy, for example with smaller images, or split it into several files.",
    "NOT_A_PDF": "This file isn't a PDF. Choose a PDF file and try again.",
    "NOT_A_PDF.named": "This file isn't a PDF, even though its name ends in .pdf. It may be another kind of file that was renamed. Save or export it as a PDF and try again.",
    "ENCRYPTED": "This PDF is protected with a password or other security, so we can't open it. Remove the protection and upload it again.",
    "CORRUPT_FILE": "This file is damaged and couldn't be opened. Try downloading or exporting it again.",
    "TOO_MANY_PAGES": "This file has {pages} pages. We read files of up to {limit} pages. Split it into smaller files and try again.",
    "TOO_MANY_LINES": "This file has more lines than we can send back in one reply ({lines} read{left}). Split it into {parts} and try again.",
    "NO_TEXT_LAYER.scan": "Page {page} is a scanned picture. We don't read scans, so nothing on it was extracted.",
    "NO_TEXT_LAYER.mostlyScan": "Page {page} is mostly a scanned picture. Only a few words on it can be read as text. We don't read scans, so nothing on it was extracted.",
    "NO_TEXT_LAYER.shapes": "Page {page} has drawings but no text we can read. The text may have been saved as shapes. We don't read drawings, so nothing on it was extracted.",
    "GARBLED_TEXT": "The text on page {page} turned into random symbols when we read it, so we didn't use any of it.",
    "ROTATED_TEXT.all": "All the text on page {page} is printed sideways, so we skipped the page.",
    "ROTATED_TEXT.numbers": "Most of the numbers on page {page} are printed sideways, so we could misread which column they belong to. We skipped the page.",
    "PAGE_LOAD_FAILED": "Page {page} couldn't be read: our reader hit an error on this page. The other pages weren't affected.",
    "PAGE_LOAD_FAILED.timeout": "Page {page} couldn't be read because it took too long. The other pages weren't affected.",
    "NO_TABLE_FOUND": "Page {page} has text, but we couldn't find a table of line items on it.",
    "AMBIGUOUS_COLUMNS.numbersVsHeader": "On page {page}, the numbers in {column} look like {numbers}, but its heading says {heading}. We can't tell which is right, so we didn't read the lines on this page.",
    "AMBIGUOUS_COLUMNS.sameRole": "Page {page} has {count} columns that could be the {role} ({columns}). We can't tell which is right, so we didn't read the lines on this page.",
    "COLUMN_MEANING_UNKNOWN": "We found a table on page {page}, but we couldn't tell which column is the quantity, the price or the total. So we didn't read any numbers from it. Its rows are shown as printed.",
    "CREDIT_OR_RETURN_PAGE": "Page {page} is titled '{title}', so its amounts may be refunds or credits rather than sales. We didn't list them as normal items.",
    "UNPARSEABLE_NUMBER": "'{raw}' on page {page} isn't a number we can read, so that line was left out.",
    "UNPARSEABLE_NUMBER.otherFormat": "'{raw}' on page {page} is written in a different number format from the other numbers on that page, so we can't be sure what it means. That line was left out.",
    "NO_DESCRIPTION": "A row on page {page} has numbers but no description ('{row}'), so we didn't attach them to any line.",
    "ARITHMETIC_MISMATCH": "On page {page}, {quantity} × {price} is {expected} (calculated by us), but the document says {total}. We can't tell which is right, so we left this line out.",
    "ARITHMETIC_MISMATCH.between": " There is a '{between}' column between the price and the total, which may explain the difference.",
    "AMBIGUOUS_NUMBER_FORMAT.line": "'{raw}' on page {page} could mean {first} or {second}, and nothing else in the document shows which one is right, so that line was left out.",
    "AMBIGUOUS_NUMBER_FORMAT.total": "'{raw}' on page {page} could mean {first} or {second}, and nothing else in the document shows which one is right, so we didn't use that total.",
    "EVIDENCE_CHECK_FAILED": "We found {what} on page {page} but couldn't match it to the exact text on the page, so we left it out.",
    "CONFLICTING_FIGURES": "The document says {first} in one place (page {page1}) and {second} in another (page {page2}). We can't tell which one is right.",
    "CONFLICTING_FIGURES.many": "The document gives different figures: {list}. We can't tell which one is right.",
    "TOTALS_DISAGREE": "The lines on {pages} add up to {sum} (calculated by us), but the {label} says {stated}. The difference is {difference} (calculated by us).",
    "TOTALS_UNVERIFIABLE.pageNotRead": "We couldn't check the {label} on page {at} because page {page} {what}.",
    "TOTALS_UNVERIFIABLE.missingLineTotal": "We couldn't check the {label} on page {at} because a line on page {page} has no line total.",
    "TOTALS_UNVERIFIABLE.twoAmounts": "The document shows {count} different amounts for the {label} ({list}), so we couldn't check it.",
    "NO_LINE_ITEMS_FOUND": "We read every page but found no table of line items.",
}

# Level and wording of notes.
NOTES = {
    "blankPage": ("info", "We found nothing to read on page {page}."),
    "imagesNotRead": ("info", "Page {page} has images as well as text. We read the text but not the images."),
    "rotatedTextIgnored": ("info", "On page {page}, some sideways text (like a stamp or watermark) was ignored."),
    "sectionHeading": ("info", "On page {page}, the line '{text}' inside the table has no numbers, so we kept it as a heading, not a line item."),
    "shortLineInTable": ("warning", "On page {page}, the line '{text}' inside the table isn't a full line item (it may be a discount or a subtotal), so we didn't list it."),
    "descriptionWraps": ("info", "On page {page}, some descriptions go on to the next line. The description shows the first line; the line's source text shows all of it."),
    "carriedForwardSkipped": ("info", "On page {page}, the line '{text}' carries a total from another page, so we skipped it to avoid counting it twice."),
    "totalsRowSkipped": ("info", "On page {page}, the line '{text}' is a total, not a line item, so we didn't list it."),
    "otherTableNotRead": ("warning", "Page {page} has another table, starting '{text}'. We didn't read it, so its lines are not in the list."),
    "columnNotRead": ("info", "We couldn't tell what the '{text}' column on page {page} holds, so we show its cells as printed."),
    "headerOnlyRole": ("info", "On page {page}, we read the '{text}' column as {role} because of its heading. The numbers didn't confirm it."),
    "headingFollowed": ("info", "The '{text}' column on page {page} looks like {looks}, but its heading says {role}, so we followed the heading."),
    "headingTwoMeanings": ("warning", "On page {page}, the heading '{text}' could mean two different things, so we didn't use it."),
    "mixedTotalWording": ("warning", "On page {page}, the '{text}' column mixes per-item figures and totals ({examples}), so we kept them as printed text and didn't read them as numbers."),
    "totalLabelNoAmount": ("info", "On page {page}, the line '{text}' has a total's label but no amount, so we didn't use it as a total."),
    "totalAmountNotRead": ("info", "On page {page}, the line '{text}' looks like a total, but we couldn't read its amount, so we didn't use it."),
    "totalNotMoney": ("info", "On page {page}, we didn't use '{text}' as a money total: it is a whole number with no currency sign, while the line totals have cents, so it may be a count."),
    "unknownLabelTotalUsed": ("info", "On page {page}, '{text}' equals the sum of the lines, so we used it as the total, though we don't recognise its label."),
    "unknownFigureAlsoMatches": ("info", "On page {page}, '{text}' also equals the sum of the lines, but we used the figure printed after it as the total."),
    "unknownFigureNotPlaced": ("info", "On page {page}, we didn't use '{text}' as the total: we don't recognise its label, and it isn't the sum of the lines."),
    "unknownFigureNotCompared": ("info", "On page {page}, we didn't use '{text}' as the total: we don't recognise its label, and we couldn't add up the lines to compare with it."),
    "unknownFigureIgnored": ("info", "On page {page}, we didn't use '{text}': we don't recognise its label, and a total we do recognise is printed."),
    "unknownFigureIgnoredTax": ("info", "On page {page}, we didn't use '{text}' as the total: we don't recognise its label, and a tax or discount line is printed, so we can't tell what the figures include."),
    "figureBeforeLines": ("info", "On page {page}, we didn't use '{text}' as the document's total, because there are lines on later pages."),
    "summaryPage": ("warning", "Page {page} is titled '{text}'. Its lines may repeat lines from other pages."),
    "unknownHeadings": ("warning", "We didn't recognise the headings on page {page}. Our check for returns and credit pages knows only English words, so it may not work on this page."),
    "noHeadings": ("warning", "The table on page {page} has no headings, so we couldn't tell its language. Our check for returns and credit pages knows only English words, so it may not work on this page."),
}

# Why a totals check did not run.
REASONS = {
    "nothingStated": "We found no subtotal or total on the pages we could read, so there was nothing to check the lines against.",
    "gstNoSubtotal": "A GST, tax or discount line is printed but no subtotal, so we can't tell whether the total should equal the lines.",
    "unknownFigure": "The figures near the table have labels we don't recognise, and none is the sum of the lines, so we didn't check them.",
    "unknownNotCompared": "We couldn't add up the lines, so we didn't compare them with the figures we found near the table.",
    "earlyTotal": "The subtotal or total is printed before some of the lines, so it can't cover them all, and we didn't check it.",
    "totalNotRead": "A total is printed, but we couldn't read its amount, so we didn't check the lines against it.",
    "totalLooksLikeCount": "The only total we found looks like a count, not an amount of money, so we didn't check the lines against it.",
    "noLines": "No line was listed on the pages this total covers, so there was nothing to add up.",
    "totalNotProved": "We couldn't match the printed total to the page's text, so we didn't check it.",
}
COUNT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def filled(template: str, **values: Column) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2))


def refusal(key: str, **values: Column) -> Column:
    return filled(REFUSALS[key], **values)


def note(code: str, **values: Column) -> Column:
    """struct(code, level, text)."""
    level, template = NOTES[code]
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), filled(template, **values).alias("text"))


def note_of(code: Column, among: tuple[str, ...], page: Column, text: Column) -> Column:
    """The note of a code column, for notes that say a page and a text only."""
    out = None
    for name in among:
        made = note(name, page=page, text=text)
        out = F.when(code == name, made) if out is None else out.when(code == name, made)
    return out


def role_word(role: Column, many: bool = False) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for r, words in X.ROLE_WORDS.items() for x in (r, words[many])]), role)


def total_word(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in X.TOTAL_WORDS.items() for x in pair]), label)


def count_word(n: Column) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(w) for w in COUNT_WORDS)), n), n.cast("string"))


def megabytes(n: Column, up: bool = True) -> Column:
    """A size in MB to a tenth, a file's rounded up, a limit's to the nearest."""
    tenths = F.ceil(n * 10 / 1048576) if up else F.floor(n * 10 / 1048576 + 0.5)
    return F.concat(F.regexp_replace((tenths / 10).cast("decimal(18,1)").cast("string"), r"\.0$", ""), F.lit(" MB"))
