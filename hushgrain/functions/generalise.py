"""Stepwise generalisation of quasi-identifiers: level 0 leaves a value, level 3 suppresses it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgrain.functions.labels import lookup
from hushgrain.functions.text import strip

MAX_LEVEL = 3

# Cities and their countries.
CITY_COUNTRY = {
    "plovdiv": "Bulgaria", "sofia": "Bulgaria", "burgas": "Bulgaria",
    "istanbul": "Türkiye", "ankara": "Türkiye",
    "moscow": "Russia", "st. petersburg": "Russia", "rostov": "Russia",
    "warsaw": "Poland", "krakow": "Poland",
    "budapest": "Hungary",
    "bucharest": "Romania",
    "kyiv": "Ukraine", "kiev": "Ukraine", "lviv": "Ukraine",
    "athens": "Greece", "thessaloniki": "Greece",
    "rome": "Italy", "milan": "Italy",
    "paris": "France", "lyon": "France",
    "london": "United Kingdom", "manchester": "United Kingdom",
    "edinburgh": "United Kingdom", "birmingham": "United Kingdom",
    "leeds": "United Kingdom", "glasgow": "United Kingdom",
    "liverpool": "United Kingdom", "bristol": "United Kingdom",
    "berlin": "Germany", "munich": "Germany",
    "madrid": "Spain", "barcelona": "Spain",
    "lisbon": "Portugal",
    "vienna": "Austria",
    "prague": "Czechia",
    "stockholm": "Sweden",
    "oslo": "Norway",
    "helsinki": "Finland",
    "copenhagen": "Denmark",
    "amsterdam": "Netherlands",
    "brussels": "Belgium",
    "dublin": "Ireland",
}
# Countries and their continents.
COUNTRY_CONTINENT = {
    "Bulgaria": "Europe", "Türkiye": "Europe/Asia", "Russia": "Europe/Asia",
    "Poland": "Europe", "Hungary": "Europe", "Romania": "Europe",
    "Ukraine": "Europe", "Greece": "Europe", "Italy": "Europe",
    "France": "Europe", "United Kingdom": "Europe", "Germany": "Europe",
    "Spain": "Europe", "Portugal": "Europe", "Austria": "Europe",
    "Czechia": "Europe", "Sweden": "Europe", "Norway": "Europe",
    "Finland": "Europe", "Denmark": "Europe", "Netherlands": "Europe",
    "Belgium": "Europe", "Ireland": "Europe",
}
# Demographic terms and broader ones.
DEM_BROADER = {
    "bulgarian": "European", "romanian": "European", "hungarian": "European",
    "russian": "Eastern European", "ukrainian": "Eastern European",
    "polish": "European", "german": "European", "french": "European",
    "italian": "European", "spanish": "European", "british": "European",
    "turkish": "Western Asian", "greek": "European",
    "muslim": "religious minority", "jewish": "religious minority",
    "christian": "religious affiliation", "orthodox": "religious affiliation",
    "catholic": "religious affiliation", "protestant": "religious affiliation",
    "buddhist": "religious affiliation", "hindu": "religious affiliation",
    "asylum-seeker": "person seeking residence", "refugee": "person seeking residence",
    "pensioner": "older person", "retiree": "older person",
    "roma": "ethnic minority", "kurd": "ethnic minority", "kurdish": "ethnic minority",
}
# The patterns of years and numbers.
YEAR = "(?U)\\b(1\\d{3}|20\\d{2}|21\\d{2})\\b"
NUMBER = "(?U)-?\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|-?\\d+(?:\\.\\d+)?"
_EXACT = "decimal(38,0)"


def _bracketed(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("]"))


def _floored(n: Column, to: int) -> Column:
    return (F.floor(n / to) * to).cast(_EXACT)


def _datetime(text: Column, level: int) -> Column:
    year = F.regexp_extract(text, YEAR, 1)
    shown = year if level == 1 else F.concat(F.substring(year, 1, 3), F.lit("0s"))
    return F.when(year != "", shown).otherwise("[DATETIME]")


def _quantity(text: Column, level: int) -> Column:
    number = F.regexp_replace(F.regexp_extract(text, NUMBER, 0), ",", "")
    n = F.regexp_extract(number, "^-?\\d+", 0).try_cast(_EXACT)
    about = lambda x: F.concat(F.lit("about "), x)
    low = F.lower(text)
    age = (n >= 0) & (n <= 120) & (low.contains("year") | low.contains("old"))
    band = _floored(n, 10)
    if level == 1:
        grouped = lambda to: about(F.format_number(_floored(n, to), 0))
        plain = lambda to: about(_floored(n, to).cast("string"))
        shown = F.when(age, about(band.cast("string"))).when(n >= 1_000_000, grouped(1_000_000)).when(n >= 1_000, grouped(1_000)).when(n >= 100, plain(100)).otherwise(plain(10))
    else:
        their = F.when(band >= 20, F.concat(F.lit("in their "), band.cast("string"), F.lit("s"))).otherwise(F.concat(F.lit("under "), (band + 10).cast(_EXACT).cast("string")))
        shown = F.when(age, their).otherwise("[QUANTITY]")
    return F.when(n.isNull(), "[QUANTITY]").otherwise(shown)


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "[.,;:]+$", "")


def _location(text: Column, level: int) -> Column:
    country = lookup(_key(text), CITY_COUNTRY)
    return F.coalesce(country if level == 1 else lookup(country, COUNTRY_CONTINENT), F.lit("[LOC]"))


def _demographic(text: Column, level: int) -> Column:
    return F.coalesce(lookup(_key(text), DEM_BROADER), F.lit("[DEM]")) if level == 1 else F.lit("[DEM]")


def generalise(entity_type: Column, text: Column, level: int) -> Column:
    """The text at a level. Types without a ladder are suppressed from level 1 on."""
    if level <= 0:
        return text
    if level >= MAX_LEVEL:
        return _bracketed(entity_type)
    return (
        F.when(entity_type == "DATETIME", _datetime(text, level))
        .when(entity_type == "QUANTITY", _quantity(text, level))
        .when(entity_type == "LOC", _location(text, level))
        .when(entity_type == "DEM", _demographic(text, level))
        .otherwise(_bracketed(entity_type))
    )
