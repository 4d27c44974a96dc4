"""Column names generated by rule: census codes and the short names they are given."""

from __future__ import annotations


def numbered(prefix: str, last: int, first: int = 1) -> list[str]:
    return [f"{prefix}{i}" for i in range(first, last + 1)]


def census_codes(table: str, first: int, last: int) -> list[str]:
    """``census_codes("B19001", 2, 3)`` -> ``["B19001_002E", "B19001_003E"]``."""
    return [f"{table}_{i:03d}E" for i in range(first, last + 1)]


# The census tables used and their code ranges.
INCOME_CODES = census_codes("B19001", 2, 17)
EDUCATION_CODES = census_codes("B15003", 2, 17)
HHSIZE_CODES = census_codes("B11016", 2, 8)
FOODSTAMP_TOTAL, FOODSTAMP_YES = census_codes("B22003", 1, 2)

COUNT_CODES = [*INCOME_CODES, *EDUCATION_CODES, *HHSIZE_CODES, FOODSTAMP_TOTAL, FOODSTAMP_YES]

INCOME = numbered("income", 16)
EDU = numbered("edu", 16)
HHSIZE = numbered("hhsize", 7)

# Code -> short name, by position inside each census table.
SHORT_NAMES = dict(zip([*INCOME_CODES, *EDUCATION_CODES, *HHSIZE_CODES], [*INCOME, *EDU, *HHSIZE]))

ZIP_COLUMN = "zip code tabulation area"

# The ZIP codes of the metro area.
METRO_ZIPS = [
    "50021", "50023", "50131", "50313", "50322", "50310", "50317", "50009", "50325", "50311",
    "50314", "50316", "50266", "50265", "50312", "50309", "50327", "50321", "50315", "50320",
]

# The map window as (xmin, ymin, xmax, ymax).
METRO_BOX = (-93.9, 41.4, -93.4, 41.8)
