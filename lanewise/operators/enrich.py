"""Columns derived per shipment: countries, direction, pay-weight, bracket, product."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.schema import BRACKETS, Number, Params


def _exact(value: Number) -> Column:
    """Literal that keeps decimal columns decimal."""
    return F.lit(Decimal(str(value))) if isinstance(value, float) else F.lit(value)


def country_of(zone: str) -> Column:
    return F.substring(zone, 1, 2)


def direction(origin: Column, destination: Column, home: str) -> Column:
    """Exp, Imp, Dom or X-trade as seen from ``home`` (GB is spelt UK in zones)."""
    home = "UK" if home == "GB" else home
    leaves, arrives = origin == home, destination == home
    return F.when(leaves, F.when(arrives, "Dom").otherwise("Exp")).otherwise(
        F.when(arrives, "Imp").otherwise("X-trade")
    )


def pay_weight(params: Params) -> Column:
    """Highest of weight, loading metres and volume in kg; null without a weight."""
    heaviest = F.greatest("kg", F.col("ldm") * _exact(params.pw_ldm), F.col("m3") * _exact(params.pw_cbm))
    return F.when(F.col("kg").isNotNull(), heaviest)


def _at_most(weight: Column, limit: Number) -> Column:
    """``weight <= limit``; for a whole limit on whole numbers, which are quicker to compare than decimals."""
    if int(limit) == limit:
        return F.ceil(weight).cast("bigint") <= int(limit)
    return weight <= _exact(limit)


def bracket_of(weight: str | Column) -> Column:
    """Upper bound of the weight bracket.

    Weights of 0 or less belong to bracket 250 and unknown ones to the last
    bracket, as users of the reports are used to.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    positive = F.ceil(weight).cast("bigint") > 0
    first, second, *others, last = BRACKETS
    chain = F.when(positive & _at_most(weight, first), first).when(positive & _at_most(weight, second), second)
    for bound in others:
        chain = chain.when(_at_most(weight, bound), bound)
    return chain.otherwise(last)


def product_of(weight: str | Column, params: Params) -> Column:
    weight = F.col(weight) if isinstance(weight, str) else weight
    return (
        F.when(_at_most(weight, params.parcel), "Parcel")
        .when(_at_most(weight, params.grp), "GRP")
        .when(_at_most(weight, params.ltl), "LTL")
        .otherwise("FTL")
    )


def apply_ldm_factor(df: DataFrame, factor: Number) -> DataFrame:
    """Loading metres of at least ``kg / factor``, also kept as ``ldm_eq``."""
    from_weight = F.col("kg").cast("double") / F.lit(float(factor))
    at_least = F.when(F.col("ldm").isNotNull(), F.greatest(F.col("ldm").cast("double"), from_weight))
    return df.withColumns({"ldm_eq": at_least, "ldm": at_least})


def enrich_shipments(clean: DataFrame, params: Params = Params()) -> DataFrame:
    df = clean if params.ldm_factor is None else apply_ldm_factor(clean, params.ldm_factor)
    df = df.withColumns({"cntry_from": country_of("zc_from"), "cntry_to": country_of("zc_to")})
    df = df.withColumns(
        {
            "way": direction(F.col("cntry_from"), F.col("cntry_to"), params.home),
            "pay_weight": pay_weight(params),
        }
    )
    return df.withColumns({"bracket": bracket_of("pay_weight"), "product": product_of("pay_weight", params)})


def lane_key(origin: str = "zc_from", destination: str = "zc_to") -> Column:
    return F.concat(F.col(origin), F.lit(" - "), F.col(destination))
