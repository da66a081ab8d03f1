"""How a text value reads as another type. Every expression is a built-in; none raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainwise.functions.exprs import matches

# The shapes a value must have before it is cast.
NUMBER_SHAPE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
WORD_NUMBER = r"(?i)[+-]?(nan|inf|infinity)"
DATE_SHAPE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"
TIME_SHAPE = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?"
TRUTH_WORD = r"(?i)^(true|t|yes|y|1|false|f|no|n|0)$"
LEADING_ZERO = r"^[+-]?0[0-9]"
TWO_DIGIT_YEAR = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2}"
ZERO_DATE = r"0000-00-00([ T]00:00:00)?"
# What a number written for people carries.
CURRENCY = "[₹$€£¥,]"
CURRENCY_AND_SPACE = r"[₹$€£¥,\s]"
SIGN_AND_SPACE = r"[₹$€£¥\s]"
US_NUMBER = r"[-+]?[₹$€£¥]?\s?[-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?"
EU_NUMBER = r"[-+]?[₹$€£¥]?\s?[-+]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?"
PERCENT = r"[-+]?\d+([.,]\d+)?\s?%"
NUMERIC_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$"
DATE_OPENS = r"^[\s+\-0-9]|^(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
# The date formats tried, in order, each behind the shape it can read.
GENERAL_FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}", "yyyy-M-d H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}", "yyyy-M-d'T'H:mm:ss"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"[A-Za-z]{3,9} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [A-Za-z]{3,9} \d{4}", "d MMMM yyyy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"),
    (r"\d{8}", "yyyyMMdd"),
)


def number(c: Column) -> Column:
    """The value as a double. Spark alone would also read '1d' and '2f', so the shape is checked."""
    text = F.trim(c)
    return F.when(matches(text, NUMBER_SHAPE) | matches(text, WORD_NUMBER), text.try_cast("double"))


def whole_number(c: Column) -> Column:
    """The value as a bigint, only when no fraction would be rounded away."""
    d = number(c)
    fits = (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
    # A failing cast to bigint is slow, so only digits are offered to it.
    text = F.trim(c)
    return F.when(matches(text, r"[+-]?\d+"), text.try_cast("bigint")).when(fits, d.try_cast("bigint"))


def cents(c: Column) -> Column:
    """The value as DECIMAL(18,2), only when it is exact to two places."""
    d = number(c)
    exact = d.try_cast("decimal(18,2)")
    return F.when(exact.cast("double") == d, exact)


def moment(c: Column) -> Column:
    """A full date, with or without a time, as a timestamp without zone."""
    text = F.trim(c)
    spelled = F.regexp_replace(text, "/", "-")
    shaped = matches(text, DATE_SHAPE) | matches(text, DATE_SHAPE + TIME_SHAPE)
    return F.when(shaped, spelled.try_cast("timestamp"))


def day(c: Column) -> Column:
    """A full date whose time, if any, is midnight."""
    at = moment(c)
    return F.when(at == F.date_trunc("day", at), at.cast("date"))


def truth(c: Column) -> Column:
    return F.when(c.rlike(TRUTH_WORD), c.try_cast("boolean"))


def literal_truth(c: Column) -> Column:
    """True and false spelled out, and nothing else."""
    return F.when(F.upper(F.trim(c)).isin("TRUE", "FALSE"), F.trim(c).try_cast("boolean"))


def signed_text(c: Column) -> Column:
    """Accounting negatives as a leading minus: (1,234.56) and 1234.56- alike."""
    text = F.trim(c)
    return (F.when(matches(text, r"\(.*\)"), F.concat(F.lit("-"), F.regexp_replace(text, r"^[()]+|[()]+$", "")))
            .when(matches(text, r"[^-].*[0-9.,]-"), F.concat(F.lit("-"), F.regexp_replace(text, r"-+$", "")))
            .otherwise(text))


def us_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(signed_text(c), SIGN_AND_SPACE, ""), ",", "")


def eu_text(c: Column) -> Column:
    bare = F.regexp_replace(signed_text(c), SIGN_AND_SPACE, "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")


def percent_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(signed_text(c), r"\s?%$", ""), ",", ".")


def currency_text(c: Column) -> Column:
    return F.regexp_replace(c, CURRENCY_AND_SPACE, "")


def _ordered(day_first: bool) -> list[tuple[str, str]]:
    """The six numeric formats of one day/month order, two-digit years first."""
    out = []
    for year_shape, year in ((r"\d{2}", "yy"), (r"\d{4}", "yyyy")):
        for shape_sep, sep in (("/", "/"), (r"\.", "."), ("-", "-")):
            order = f"d{sep}M{sep}" if day_first else f"M{sep}d{sep}"
            out.append((rf"\d{{1,2}}{shape_sep}\d{{1,2}}{shape_sep}{year_shape}", order + year))
    return out


def written_date(c: Column, order: str | None) -> Column:
    """A date by the first format that fits. `order` is 'day', 'month' or None when unsettled.

    Two-digit years from 69 on belong to the last century, so Spark's 20xx is moved back.
    """
    text = F.trim(c)
    formats = ([] if order is None else _ordered(order == "day")) + list(GENERAL_FORMATS)
    tries = []
    for shape, pattern in formats:
        at = F.when(matches(text, shape), F.try_to_timestamp(text, F.lit(pattern)))
        if pattern.endswith("yy") and not pattern.endswith("yyyy"):
            at = F.when(F.year(at) >= 2069, F.add_months(at, -1200).cast("timestamp")).otherwise(at)
        tries.append(at)
    return F.when(text.rlike(DATE_OPENS), F.coalesce(*tries))
