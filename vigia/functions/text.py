"""Text cleaning and text-to-number parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values:
#   placeholder for a missing category: "Sin informacion"
#   seniority sentinels that mean "unknown": "Sin informacion", "Sin información",
#   "nan", "None", "" (empty)
#   seniority used when unknown: 5 years
MISSING_CATEGORY = "Sin informacion"
SENIORITY_SENTINELS = ["Sin informacion", "Sin información", "nan", "None", ""]
SENIORITY_DEFAULT = 5.0

# A number written the way a spreadsheet cell holds it: optional sign, digits
# with an optional decimal point (or a leading point), optional exponent,
# surrounding blanks allowed.  Rejects "5d", "1_000", "3,5" and "".
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# Leading catalogue code such as "1." in "1.Golpe".
CATALOGUE_PREFIX = r"^\d+\."
# The earliest variant's pattern: the code must be followed by a space.
CATALOGUE_PREFIX_SPACED = r"^\d+\. "
# The characters Python's str.strip() removes: every code point for which
# str.isspace() holds (tab, newline, NBSP, the Unicode spaces, ...).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove whitespace from both ends like Python's ``str.strip()`` (tabs
    and non-breaking spaces included): one character-set trim that reads its
    input once, so nested cleaning steps do not multiply the expression."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def drop_catalogue_prefix(c) -> Column:
    """Strip, drop a leading ``<digits>.`` code, strip again."""
    return strip(F.regexp_replace(strip(c), CATALOGUE_PREFIX, ""))


def sentinel_to_null(c, sentinels) -> Column:
    """Whole-value match against ``sentinels`` becomes null."""
    x = _col(c)
    return F.when(x.isin(list(sentinels)), F.lit(None)).otherwise(x)


def parse_number(c, stripped: bool = False) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    ANSI-safe: the pattern is checked before ``try_cast`` so no cast can raise,
    and NaN/Infinity spellings are rejected like unparsable text.  Pass
    ``stripped=True`` when the text is already stripped.
    """
    s = _col(c).cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), (s if stripped else strip(s)).try_cast("double"))


def number_or(c, default: float) -> Column:
    """Parsed number with ``default`` for unparsable or missing values."""
    return F.coalesce(parse_number(c), F.lit(float(default)))


def double_or_zero(c) -> Column:
    """A numeric column with null and NaN replaced by 0.0."""
    x = _col(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def seniority(c) -> Column:
    """Seniority in years: trimmed text, sentinels and unparsable values -> 5."""
    return F.coalesce(parse_number(sentinel_to_null(strip(_col(c).cast("string")), SENIORITY_SENTINELS),
                                   stripped=True),
                      F.lit(SENIORITY_DEFAULT))


def category(c, trim: bool = True) -> Column:
    """Categorical cleaning: null -> "Sin informacion", optionally trimmed."""
    x = F.coalesce(_col(c).cast("string"), F.lit(MISSING_CATEGORY))
    if not trim:
        return x
    # a value that begins and ends with a visible ASCII character is told by comparing bytes; the others are searched
    ends = [x, F.substring(x, -1, 1)]
    plain = (ends[0] >= "!") & (ends[0] < "\x7f") & (ends[1] >= "!") & (ends[1] < "\x7f")
    return F.when(plain, x).otherwise(strip(x))


def as_text(c) -> Column:
    """Display text of a value the way a dataframe stringifies it: nulls read "nan"."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))
