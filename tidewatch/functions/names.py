"""Text functions on feature names: normalising, units, lags, suffixes, pair keys."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name patterns of columns that leak the target
LEAKAGE_PATTERNS = {
    "Plant auxiliary power": [r"auxiliary.*power", r"aux.*power", r"plant.*auxiliary"],
    "Net power output": [r"net.*power.*output", r"net.*output"],
    "Boiler efficiency": [r"boiler.*efficiency"],
    "Standard coal consumption rate": [r"standard.*coal.*consumption", r"coal.*consumption.*rate"],
    "Turbine heat rate": [r"turbine.*heat.*rate"],
    "Unit efficiency": [r"unit.*efficiency"],
}
# fixed values: units written after a name
UNITS = ["(℃)", "(mpa)", "(mw)", "(t/h)", "(%)", "(g/kwh)", "(kj/kwh)"]


def plain_words(name: str) -> str:
    """Driver-side form of `words`, for column lists."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def words(c: Column) -> Column:
    """Lower case, every other character run as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def display_name(c: Column) -> Column:
    """Lower case on one line, ASCII brackets, without a known unit."""
    one_line = F.translate(c, "\n\r（）", "  ()")
    out = F.lower(F.trim(one_line))
    for u in UNITS:
        out = F.replace(out, F.lit(u), F.lit(""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def snake(c: Column) -> Column:
    """Lower case; line breaks vanish, blanks and dashes become underscores."""
    return F.translate(F.translate(F.lower(F.trim(c)), "\n\r", ""), " -", "__")


def lag_step(c: Column) -> Column:
    """Step of a `<base>_lag_<k>` name, null for other names."""
    k = F.regexp_extract(c, r"(?i)_lag_(\d+)\s*$", 1)
    return F.when(k != "", k.cast("int"))


def lag_base(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)_lag_\d+\s*$"), F.trim(F.regexp_replace(F.trim(c), r"(?i)_lag_(\d+)$", "")))


def unit(c: Column) -> Column:
    """Text between the last brackets of either kind, empty when there is none."""
    return F.trim(F.regexp_extract(c, r"[(（]([^()（）]*)[)）][^()（）]*$", 1))


def signal_name(c: Column) -> Column:
    """Text before the first bracket, blanks collapsed."""
    return F.trim(F.regexp_extract(F.regexp_replace(c, r"\s+", " "), r"^([^(（]*)", 1))


# fixed values: suffixes of derived features, longest first
SUFFIXES = {"__rolling_std_5s": "rolling_std_5s", "__abs_diff_1s": "abs_diff_1s", "__diff_1s": "diff_1s"}


def base_feature(c: Column) -> Column:
    return F.regexp_replace(c, "(" + "|".join(SUFFIXES) + ")$", "")


def transformation(c: Column, default: str = "unknown") -> Column:
    out = F.lit(default)
    for suffix, name in reversed(SUFFIXES.items()):
        out = F.when(F.endswith(c, F.lit(suffix)), name).otherwise(out)
    return out


def codes_of(text: Column) -> Column:
    return F.split(text, r"\+")


def codes_text(codes: Column) -> Column:
    return F.array_join(codes, "+")
