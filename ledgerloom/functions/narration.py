"""What a bank line's narration says, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import params as P

# Fixed patterns: styles in the order they are tried, references, counts.
STYLES = (
    ("settlement", r"(?i)^(?:GATEWAY|RAZORPAY)\s+SETTLEMENT"),
    ("neft", r"(?i)^NEFT[-/]"),
    ("rtgs", r"(?i)^RTGS[-/]"),
    ("imps", r"(?i)^IMPS[-/]"),
    ("upi", r"(?i)^UPI[-/]"),
)
UTR = r"\b([A-Z]{4,6}\d{8,16})\b"
DIGITS = r"\b(\d{9,18})\b"
MERCHANT_REF = r"\b([A-Z]{2,4}-\d{4}-\d{2,8})\b"
SETTLEMENT_ID = r"\b(setl_[A-Za-z0-9]{8,20})\b"
COUNT = r"(?i)\b(\d+)\s*TXNS?\b"
MARKER = r"(?i)[-/](CR|DR)\s*$"
# References whose delimiters a rail has changed or dropped.
GARBLED = r"(?i)\b(INV[/\-]?\d{4}[/\-]?\d{2,8}|INV\d{4,12})\b"
GARBLED_WORD = r"(?i)^INV[0-9/\-]*$"
#: Words that belong to a rail and not to anybody's name, and those that the recovery of a name leaves out.
NOISE = (
    "CR", "DR", "NEFT", "RTGS", "IMPS", "UPI", "PAYMENT", "PMT", "TXN", "TXNS", "RAZORPAY", "SETTLEMENT", "TRANSFER", "TRF", "REF",
    "BY", "TO", "FROM", "FUND", "FUNDS", "CLG", "CMS", "INW", "REM", "MB", "ACCT", "AC", "FRM",
)
RECOVERY_NOISE = ("TRF", "FRM", "FROM", "BY", "CLG", "CMS", "MB", "INW", "REM", "CR", "DR", "FUND", "NEFT", "RTGS", "IMPS", "UPI", "PAYMENT", "TO", "REF")
JAMMED_ENDINGS = ("PVTLTD", "PRIVATELIMITED", "LTD", "LLP", "PVT")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def style(text: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(STYLES):
        out = F.when(F.trim(text).rlike(pattern), name).otherwise(out)
    return out


def reference(text: Column) -> Column:
    return F.coalesce(_first(F.upper(text), UTR), _first(text, DIGITS))


def merchant_ref(text: Column) -> Column:
    return _first(F.upper(text), MERCHANT_REF)


def settlement_id(text: Column) -> Column:
    return _first(text, SETTLEMENT_ID)


def txn_count(text: Column) -> Column:
    return _first(text, COUNT).cast("int")


def _longest(parts: Column) -> Column:
    """The first of the longest texts, null where all are empty."""
    return F.nullif(F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)), F.lit(""))


def _words(part: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(F.trim(part), r"\s+"), lambda w: (w != "") & keep(w)), " ")


def payer_name(text: Column) -> Column:
    """The longest part's words that aren't a rail's, a reference or a number; null for a settlement."""

    def keep(w: Column) -> Column:
        u = F.upper(w)
        return ~u.isin(*NOISE) & ~w.rlike(r"^\d+$") & ~u.rlike(rf"^{UTR[2:-2]}$") & ~u.rlike(rf"^{MERCHANT_REF[2:-2]}$") & ~w.rlike(GARBLED_WORD) & w.rlike("[A-Za-z]{2,}")

    parts = F.split(F.regexp_replace(F.trim(text), MARKER, ""), "[-/]")
    return F.when(style(text) != "settlement", _longest(F.transform(parts, lambda p: _words(p, keep))))


def name_is_clean(name: Column, ref: Column) -> Column:
    """Whether a name is free of its line's reference and of long numbers."""
    holds = F.coalesce(F.contains(F.upper(name), F.upper(ref)), F.lit(False))
    return F.coalesce(~holds & ~name.rlike(r"\d{6,}"), F.lit(True))


def needs_recovery(style_: Column, name: Column) -> Column:
    """An unknown style, or a bank rail without a name."""
    return (style_ == "unknown") | (style_.isin("neft", "rtgs", "imps", "upi") & name.isNull())


def recovered_ref(text: Column) -> Column:
    """A garbled invoice number in its usual form."""
    raw = _first(F.trim(text), GARBLED)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.concat(F.lit("INV-"), F.substring(digits, 1, 4), F.lit("-"), F.substr(digits, F.lit(5)))).otherwise(F.upper(raw))


def recovered_name(text: Column) -> Column:
    """The longest run of words that aren't a rail's; a jammed company ending gets its space back."""

    def keep(w: Column) -> Column:
        return ~F.upper(w).isin(*RECOVERY_NOISE) & ~w.rlike(r"^\d+$") & ~w.rlike(GARBLED_WORD) & w.rlike("[A-Za-z]{2,}")

    best = _longest(F.transform(F.split(F.trim(text), r"[/\-:,]| {2,}"), lambda p: _words(p, keep)))
    spaced = best
    for end in reversed(JAMMED_ENDINGS):
        cut = F.trim(F.concat(F.substr(best, F.lit(1), F.length(best) - len(end)), F.lit(" " + end)))
        spaced = F.when(F.endswith(best, F.lit(end)), cut).otherwise(spaced)
    return F.when(F.contains(best, F.lit(" ")), best).otherwise(spaced)


def bank_of(ref: Column) -> tuple[Column, Column]:
    """(bank, how it is known) by the four letters that a reference starts with."""
    code = F.upper(F.regexp_extract(F.trim(F.coalesce(ref, F.lit(""))), "^([A-Za-z]{4})", 1))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in P.BANK_OF_CODE.items() for x in kv]), code)
    how = F.when(code == "", P.BANK_ABSENT).when(name.isNull(), P.BANK_UNKNOWN).otherwise(P.BANK_DERIVED)
    return F.coalesce(name, code), how


def normalise_name(name: Column) -> Column:
    """Upper case, letters and digits only, corporate words dropped, single spaces."""
    words = F.split(F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*P.CORPORATE_WORDS)), " ")


def name_level(a: Column, b: Column) -> Column:
    """2 same tokens, 1 half of the shorter list agrees, 0 not, null if either is blank."""
    x, y = F.split(a, " "), F.split(b, " ")

    def agree(p: Column, q: Column) -> Column:
        short = F.when(F.length(p) <= F.length(q), p).otherwise(q)
        long = F.when(F.length(p) <= F.length(q), q).otherwise(p)
        return (p == q) | ((F.length(short) >= 3) & F.startswith(long, short))

    matched = F.size(F.filter(x, lambda p: F.exists(y, lambda q: agree(p, q))))
    half = matched / F.least(F.size(x), F.size(y)) >= 0.5
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), None).when(a == b, 2).when(half, 1).otherwise(0)


def _folded(name: Column, strip: bool) -> Column:
    """Upper-case letters, digits and single spaces; with ``strip``, without the company form at the end."""
    out = F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", "")
    for ending in P.COMPANY_ENDINGS if strip else ():
        out = F.regexp_replace(out, f"{ending}$", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def _cut_short(a: Column, b: Column) -> Column:
    """Equal, or the shorter agrees word by word and only its last word may be cut."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    x, y = F.split(short, " "), F.split(long, " ")
    n = F.size(x)
    heads = F.slice(x, 1, n - 1) == F.slice(y, 1, n - 1)
    last = F.coalesce(F.startswith(F.get(y, n - 1), F.get(x, n - 1)), F.lit(False))
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= P.ENTITY_FLOOR) & (n <= F.size(y)) & heads & last))


def same_entity(bank: Column, known: Column) -> Column:
    """Whether a bank's payer, perhaps cut short, is a registered name, with or without the company form."""
    a, b = (F.array(*(_folded(name, strip) for strip in (True, False))) for name in (bank, known))
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: F.coalesce(_cut_short(x, y), F.lit(False)))), F.lit(False))
