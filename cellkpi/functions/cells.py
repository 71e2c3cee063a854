"""Site, band, sector and network element of a cell, read from the cell name.

Characters 1-6 name the site, characters 7-8 the band code, the last character the sector. The
codes are case-sensitive. Everything here is a function of the cell name alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "EUTRANCELLFDD"

# Band codes, network element suffixes and sector digits of the cell naming scheme.
BAND_CODES = {
    "L1800": ["AL", "EL", "IL", "ML", "SL"],
    "L2100": ["ER", "HR", "IR", "MR"],
    "L2300": ["ME", "MF", "IE", "IF", "MV", "VE", "VF"],
    "L900": ["MT", "ST"],
}
NETWORK_ELEMENT_SUFFIXES = {"L1800": "ML1", "L2100": "MR1", "L2300": "ME1", "L900": "MT1"}
NETWORK_ELEMENT_ONLY_CODES = {"L900": ["MM"]}
SECTOR_DIGITS = {"1": ["1", "4"], "2": ["2", "5"], "3": ["3", "6"]}
UNDEFINED = "Not Define"

BANDS = list(BAND_CODES)
SECTORS = list(SECTOR_DIGITS)
SITE_LENGTH = 6


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The entry of a fixed table, NULL if there is none. The key is computed once per row."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _by_value(groups: dict[str, list[str]]) -> dict[str, str]:
    return {value: name for name, values in groups.items() for value in values}


def site_id(cell: str = CELL) -> Column:
    return F.substring(F.col(cell), 1, SITE_LENGTH)


def site_key(cell: str = CELL) -> Column:
    """The site without regard to case, the grouping key of runs over all sites."""
    return F.lower(site_id(cell))


def band_code(cell: str = CELL) -> Column:
    return F.substring(F.col(cell), SITE_LENGTH + 1, 2)


def band(cell: str = CELL) -> Column:
    return F.coalesce(lookup(band_code(cell), _by_value(BAND_CODES)), F.lit(UNDEFINED))


def sector(cell: str = CELL) -> Column:
    last = F.substring(F.col(cell), -1, 1)
    return F.coalesce(lookup(last, _by_value(SECTOR_DIGITS)), F.lit(UNDEFINED))


def network_element(cell: str = CELL) -> Column:
    """Site plus band suffix. ``MM`` cells have one although their band is undefined."""
    bands = {**_by_value(BAND_CODES), **_by_value(NETWORK_ELEMENT_ONLY_CODES)}
    suffixes = {code: NETWORK_ELEMENT_SUFFIXES[name] for code, name in bands.items()}
    named = F.concat(site_id(cell), lookup(band_code(cell), suffixes))
    return F.coalesce(named, F.lit(UNDEFINED))
