"""Words, codes, limits and thresholds that decide results."""

from __future__ import annotations

# ISO 4217 codes that count as a currency marker.
CURRENCY_CODES = tuple(
    """
    AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF
    CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG
    HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA
    MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD
    RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX
    USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG
    """.split()
)

# Symbols that name one currency.
CURRENCY_SYMBOLS = {
    "NZ$": "NZD",
    "A$": "AUD",
    "AU$": "AUD",
    "US$": "USD",
    "CA$": "CAD",
    "HK$": "HKD",
    "NT$": "TWD",
    "R$": "BRL",
    "€": "EUR",
    "£": "GBP",
    "₫": "VND",
    "₹": "INR",
    "₪": "ILS",
    "₺": "TRY",
    "₴": "UAH",
    "₦": "NGN",
    "฿": "THB",
}

# Fixed values: (decimal mark, grouping mark), in the order in which readings are tried.
CONVENTIONS = ((".", ","), (".", " "), (".", "'"), (".", ""), (",", "."), (",", " "), (",", "'"), (",", ""))

# Heading words by role.
HEADER_WORDS = {
    "itemNo": ("item", "#", "no", "line"),
    "code": ("code", "sku", "part no", "product code"),
    "description": ("description", "details", "particulars", "product"),
    "quantity": ("qty", "quantity"),
    "unit": ("unit", "uom"),
    "unitPrice": ("unit price", "unit cost", "price", "rate", "each"),
    "lineTotal": ("line total", "amount", "total", "ext", "extended"),
}
NUMBER_ROLES = ("quantity", "unitPrice", "lineTotal")

# How messages name the roles, one and many.
ROLE_WORDS = {
    "itemNo": ("item number", "item numbers"),
    "code": ("code", "codes"),
    "description": ("description", "descriptions"),
    "quantity": ("quantity", "quantities"),
    "unit": ("unit", "units"),
    "unitPrice": ("unit price", "unit prices"),
    "lineTotal": ("line total", "line totals"),
}

# Title words.
CREDIT_WORDS = ("returns", "return", "credit", "refund", "adjustment")
SUMMARY_WORDS = ("summary", "acceptance")

# Labels of printed totals, kinds in order of precedence.
TOTAL_LABELS = {
    "subtotal": ("subtotal", "sub total", "sub-total", "net total", "total ex gst", "total excl gst", "total excluding gst"),
    "gst": ("gst", "total gst", "gst total", "gst amount"),
    "total": ("total", "total inc gst", "total incl gst", "total including gst", "grand total", "invoice total"),
    "amount_due": ("amount due", "amount payable", "balance", "balance due"),
}
TOTAL_WORDS = {"subtotal": "subtotal", "gst": "GST", "total": "total", "amount_due": "amount due"}
BASIS_WORDS = {"inclusive": ("inc", "incl", "including", "inclusive"), "exclusive": ("ex", "excl", "excluding", "exclusive")}
TAX_WORDS = ("gst",)
TOTAL_WORD = ("total",)
CARRIED_FORWARD = ("carried forward", "brought forward", "b/f", "c/f")

# Words after a number that make no count.
NOT_COUNT_WORDS = tuple(
    """
    of to and or at in on the a an x by for from per with
    second minute min hour hr day week month year am pm working business
    percent pct
    mm cm m km kg g t l ml lm m2 m3 sqm mtr tonne litre metre
    """.split()
)
MONTHS = tuple(
    """
    january february march april may june july august september october november december
    jan feb mar apr jun jul aug sep sept oct nov dec
    """.split()
)
DOCUMENT_NUMBER_LABELS = ("document no", "doc no", "invoice no", "order no", "docket no", "po", "ref", "reference")

# Thresholds of layout, numbers, roles and totals.
ROW_TOLERANCE = 0.35  # of the font size
MERGE_GAP = 0.4
SPACE_GAP = 0.1
ALIGN_TOLERANCE = 0.35
MIN_CELLS = 3
CONTINUATION_GAP = 0.8  # of the median pitch
HEADER_LINE_GAP = 1.3  # of the font size
NUMERIC_KIND_SHARE = 0.5
HEADER_MAX_PITCHES = 2
HEADER_MAX_FONT_SIZES = 3
JOIN_MAX_PITCHES = 1.5
NUMERIC_COLUMN_SHARE = 0.6
GARBLED_SHARE = 0.2
ROTATION_LIMIT = 5  # degrees
MOSTLY_SCAN_PIECES = 10
NO_TABLE_EVIDENCE_ROWS = 5
MARKED_SHARE = 0.5
PERCENT_SHARE = 0.5
DESCRIPTION_MIN_LENGTH = 8
DESCRIPTION_LENGTH_RATIO = 1.5
MIN_DISCRIMINATING_ROWS = 2
SUM_ROUNDING = 0.005
MAX_QUOTED = 5
MAX_DP = 10

# Limits of a file and a reply.
MAX_UPLOAD_BYTES = 4 * 1024 * 1024
MAX_PAGES = 200
MAX_REPLY_BYTES = 4 * 1024 * 1024
PAGE_SECONDS = 8.0
PDF_MARKER_WINDOW = 1024
SPLIT_MARGIN = 0.9

# What a page refusal makes of the page.
PARTIAL_CODES = ("COLUMN_MEANING_UNKNOWN",)
