"""Text columns: amounts, labels, cleaning and canned replies. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RUPEE = "₹"

# Fixed value: code points that count as white space at the ends of a text.
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Fixed value: what an export may not carry (all but ASCII, Devanagari, rupee).
EXPORT_DROPPED = r"[^\x00-\x7F\x{0900}-\x{097F}\x{20B9}]"

# Keyword replies, first hit in this order wins.
GHOST_REPLY = "Ghost Billing is when a hospital bills for a patient who was never admitted."
UPCODE_REPLY = "Up-coding involves inflating reimbursement rates."


def float_text(value: Column) -> Column:
    """A floating number in its shortest digits: plain from 0.0001 to 1e16, else
    with a signed exponent of two digits or more."""
    value = value.cast("double")
    short = value.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    signed = F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), r"E(\d)", "E+$1")
    signed = F.lower(F.regexp_replace(signed, r"E([+-])(\d)$", "E$10$2"))
    size = F.abs(value)
    return (
        F.when((size >= 1e-4) & (size < 1e16), plain)
        .when(F.contains(short, F.lit("E")), signed)
        .otherwise(F.when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(short))
    )


def plain_number(value: Column, places: int) -> Column:
    """A number with fixed decimals, half-even, without grouping commas."""
    return F.regexp_replace(F.format_number(value, places), ",", "")


def rupees(value: Column) -> Column:
    """Whole rupees with grouping commas."""
    return F.concat(F.lit(RUPEE), F.format_number(value, 0))


def times(value: Column) -> Column:
    """A ratio such as 3.1x."""
    return F.concat(plain_number(value, 1), F.lit("x"))


def fmt_amount(value: Column) -> Column:
    """Crore and lakh tiers, else whole rupees."""
    crore = F.concat(F.lit(RUPEE), plain_number(value / F.lit(10_000_000), 1), F.lit(" Cr"))
    lakh = F.concat(F.lit(RUPEE), plain_number(value / F.lit(100_000), 1), F.lit(" L"))
    return F.when(value >= 10_000_000, crore).when(value >= 100_000, lakh).otherwise(rupees(value))


def strip_symbols(text: Column) -> Column:
    """Drop emoji and other symbols an export may not carry."""
    return F.regexp_replace(text, EXPORT_DROPPED, "")


def strip_ends(text: Column) -> Column:
    """Text without white space, of any script, at its ends."""
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+\\z", "")


def one_line(text: Column) -> Column:
    """Strip the ends, then turn newlines into spaces."""
    return F.translate(strip_ends(text), "\n", " ")


def date_label(text: Column) -> Column:
    """X05: '05 Jan 2024', or the first ten characters of what does not parse."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "dd MMM yyyy"), F.substring(text, 1, 10))


def datetime_label(text: Column) -> Column:
    """X06: '05 Jan 2024, 03:07 PM', or the first sixteen characters."""
    parsed = F.date_format(F.try_to_timestamp(text), "dd MMM yyyy, hh:mm a")
    return F.coalesce(parsed, F.substring(text, 1, 16))


def age_label(created: Column, as_of: Column) -> Column:
    """How long ago, in the largest whole unit; unknown times are just now."""
    seconds = ((F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(1_000_000)).cast("long")

    def unit(size: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / F.lit(size)).cast("string"), F.lit(f"{letter} AGO"))

    return (
        F.when(seconds.isNull(), F.lit("JUST NOW"))
        .when(seconds < 60, unit(1, "S"))
        .when(seconds < 3600, unit(60, "M"))
        .when(seconds < 86400, unit(3600, "H"))
        .otherwise(unit(86400, "D"))
    )


def keyword_reply(text: Column, cases: Column) -> Column:
    """The canned answer to a chat message, given the number of open cases."""
    lowered = F.lower(text)
    count = cases.cast("string")
    data = F.concat(F.lit("Currently, I see "), count, F.lit(" critical cases in the cloud database."))
    default = F.concat(
        F.lit("Forensic DB indicates "),
        count,
        F.lit(" investigations pending. Configure OpenAI or use specific keywords."),
    )
    return (
        F.when(F.contains(lowered, F.lit("ghost")), F.lit(GHOST_REPLY))
        .when(F.contains(lowered, F.lit("upcode")), F.lit(UPCODE_REPLY))
        .when(F.contains(lowered, F.lit("data")), data)
        .otherwise(default)
    )


def display_name(email: Column) -> Column:
    """The part before '@' with every run of letters capitalised."""
    name = F.lower(F.split_part(email, F.lit("@"), F.lit(1)))
    pieces = F.regexp_extract_all(name, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def short_id(identifier: Column) -> Column:
    """First eight characters."""
    return F.substring(identifier, 1, 8)


def initial(name: Column) -> Column:
    """First letter in upper case, G for a guest without a name."""
    return F.coalesce(F.upper(F.substring(F.nullif(name, F.lit("")), 1, 1)), F.lit("G"))


def user_id_of(uid: Column) -> Column:
    """An account id longer than twenty characters is a user id too."""
    return F.when(F.length(uid) > 20, uid)
