"""Column names, fixed values and parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

Number = int | float | Decimal

MEASURES = ("kg", "ldm", "m3")
CATEGORIES = ("category1", "category2")

# Spreadsheet headers of a shipment file and our column names.
SHIPMENT_HEADERS = {
    "ZC from": "zc_from",
    "ZC to": "zc_to",
    "Date": "ship_date",
    "kg": "kg",
    "ldm": "ldm",
    "m3": "m3",
    "Branch": "branch",
    "Category1": "category1",
    "Category2": "category2",
}

# Headers of the reference tables and our column names.
BRIDGE_HEADERS = {"ZC to": "zone", "nuts0": "nuts0", "nuts1": "nuts1", "nuts2": "nuts2", "NUTS3": "nuts3"}
OFFICE_HEADERS = {
    "Country": "country",
    "lat": "lat",
    "lon": "lon",
    "Office Name": "office_name",
    "ZC": "zone",
    "Phone": "phone",
    "Opening hours": "opening_hours",
}
NAME_HEADERS = {
    "ISO2": "iso2",
    "Country 1": "country_1",
    "Country 2": "country_2",
    "Country 3": "country_3",
    "Country4": "country_4",
}
POSTAL_HEADERS = {"country": "country", "full_zc": "full_zc", "ZC": "zc"}
# Properties of the polygons of countries and of the levels below.
COUNTRY_PROPERTIES = ("ISO2", "NAME", "LAT", "LON")
REGION_PROPERTIES = ("NUTS_ID", "NUTS_NAME", None, None)

# Countries whose zones are reduced to the bare country code.
COLLAPSED_COUNTRIES = ("AD", "ME", "RU", "XK", "UA", "BY", "BA")

# Upper bounds of the weight brackets, in kg. The last one also
# takes everything heavier.
BRACKETS = (30, 100, 250, 500, 1000, 2500, 5000, 7500, 10000, 15000, 20000, 25500)

PRODUCTS = ("Parcel", "GRP", "LTL", "FTL")
WAYS = ("Dom", "Exp", "Imp", "X-trade")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAY_COLUMNS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

BRACKET_COLUMNS = {bound: f"b{bound}" for bound in BRACKETS}

SHIPMENT_SCHEMA = T.StructType(
    [
        T.StructField("zc_from", T.StringType()),
        T.StructField("zc_to", T.StringType()),
        T.StructField("ship_date", T.DateType()),
        T.StructField("kg", T.DecimalType(18, 3)),
        T.StructField("ldm", T.DecimalType(18, 3)),
        T.StructField("m3", T.DecimalType(18, 3)),
        T.StructField("branch", T.StringType()),
        T.StructField("category1", T.StringType()),
        T.StructField("category2", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Params:
    """The choices a user makes before shipments are enriched."""

    home: str = "FR"
    pw_ldm: Number = 1750
    pw_cbm: Number = 330
    parcel: Number = 30
    grp: Number = 2500
    ltl: Number = 20000
    ldm_factor: Number | None = None
