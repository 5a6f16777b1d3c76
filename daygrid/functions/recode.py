"""Column expressions that recode raw cohort values.

Every function takes a Column and returns a Column; nothing here runs Python on
rows. Text that does not parse follows the documented rule of each function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The recoding tables of the cohort's raw codes.
SEX = {"male": "0", "female": "1"}
CELLULARITY = {"NA": "NA", "极度减低": "0", "减低": "1", "活跃": "2", "明显活跃": "3", "极度活跃": "4"}
PRESENT = {"无": "0", "有": "1"}
STAGE = {"IV": "4", "III": "3", "II": "2", "I": "1", "NA": "NA"}
PRIOR_HSCT = {"无": "HSCT_No_Prior", "自体": "HSCT_Autologous", "异体": "HSCT_Allogeneic"}
YES_NO = {"否": "0", "是": "1"}
COSTIMULATORY = {"41BB": "41BB", "CD28": "CD28", "41BB+CD28": "41BB+CD28"}
CONSTRUCT = {
    "CD19+CD20 tandem": "Tandem",
    "CD19+CD22 tandem": "Tandem",
    "CD7 single target": "Single",
    "CD19 single target": "Single",
    "single target cocktail": "Cocktail",
    "CD20/22": "Tandem",
    "CD19+CD22": "Tandem",
    "CD19+CD22 tandem CD19+CD20 tandem": "Tandem",
}
# Accepted spellings of a date, tried in this order.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d H:mm:ss",
)


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Look the value up in a literal map; anything unmapped becomes null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col.cast("string"))


def number(col: Column) -> Column:
    """Double, or null when the text is no number (ANSI casts would fail).

    NaN spelled out in the data counts as missing.
    """
    parsed = _as_double(F.trim(col.cast("string")))
    return F.when(~F.isnan(parsed), parsed)


def _as_double(text: Column) -> Column:
    # a JVM parse would take the "d" and "f" of "1d" and "1f" for type suffixes
    return F.when(~text.rlike(r"[0-9.][dDfF]$"), text).try_cast("double")


def disease_group(col: Column) -> Column:
    return F.when(col.isNull(), None).when(col.contains("ALL"), "ALL").otherwise("B-NHL")


def extranodal_level(col: Column) -> Column:
    """0, 1, or 2 for two and more; negatives and text stay as they are."""
    n = number(col).try_cast("long")
    return F.when(n >= 2, "2").when(n == 1, "1").when(n == 0, "0").otherwise(col.cast("string"))


def therapy_line_level(col: Column) -> Column:
    """1, 2, 3, or 4 for more than three; zero, negatives and text stay."""
    n = number(col).try_cast("long")
    level = F.when(n > 3, "4").when(n.between(1, 3), n.cast("string"))
    return F.coalesce(level, col.cast("string"))


def grade_to_int(col: Column) -> Column:
    """"1.0" becomes "1" by truncation; "NA" and junk stay text."""
    return F.coalesce(number(col).try_cast("long").cast("string"), col.cast("string"))


def parse_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    text = F.trim(col.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def normalize_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(F.date_format(parse_date(col, formats), "yyyy-MM-dd"), col.cast("string"))


def over_threshold(col: Column, threshold: float) -> Column:
    """1 above the threshold, 0 up to it, null for null."""
    return (col > F.lit(threshold)).cast("int")


def at_least(col: Column, threshold: float) -> Column:
    return (col >= F.lit(threshold)).cast("int")


def age_group(col: Column, threshold: int = 65) -> Column:
    return F.when(col < threshold, f"< {threshold}").when(col >= threshold, f">= {threshold}")


def burden_band(col: Column) -> Column:
    return (
        F.when(col == 0, "none").when(col <= 25, "low").when(col <= 50, "medium")
        .when(col <= 75, "high").when(col.isNotNull(), "very high")
    )


def grade_category(col: Column) -> Column:
    """Half-to-even rounding to an integer."""
    return F.bround(col, 0).cast("int")


def level_category(col: Column) -> Column:
    return col.cast("int").cast("string")


def clip(col: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(col.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col)))


def is_numeric_or_missing(col: Column) -> Column:
    """Null, "NA", blank, or parseable as a number."""
    text = F.trim(col.cast("string"))
    missing = text.isNull() | text.isin("NA", "", "nan", "NaN", "null", "N/A")
    return missing | F.coalesce(_as_double(text).isNotNull(), F.lit(False))


def ratio_text(part: Column, whole: Column) -> Column:
    return F.format_string("%d/%d", part.cast("long"), whole.cast("long"))


def mean_sd_text(mean: Column, sd: Column) -> Column:
    return F.format_string("%.1f ± %.1f", mean, sd)


def median_iqr_text(median: Column, q1: Column, q3: Column) -> Column:
    return F.format_string("%.1f (%.1f-%.1f)", median, q1, q3)


def count_pct_text(count: Column, whole: Column) -> Column:
    pct = F.try_divide(count * F.lit(100.0), whole)
    return F.format_string("%d (%.1f%%)", count.cast("long"), pct)
