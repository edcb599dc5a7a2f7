"""Facets over search results: counts and ranges, each under all filters but its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACET_LIMIT = 2000


def value_counts(rows: DataFrame, field: str, ordered: bool = True) -> DataFrame:
    """(value, n) of a field's values that aren't null, the most frequent first."""
    out = rows.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value") if ordered else out


def split_counts(rows: DataFrame, field: str, values: list) -> DataFrame:
    """One row (n_in, n_rest): how many rows have one of the values, and how many don't."""
    inside = F.coalesce(F.col(field).isin(values), F.lit(False))
    return rows.agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_rest"))


def value_range(rows: DataFrame, field: str) -> DataFrame:
    """One row (min, max), to two places; null fields count as 0, and no rows give 0."""
    value = F.coalesce(F.col(field).cast("double"), F.lit(0.0))
    return rows.agg(F.coalesce(F.round(F.min(value), 2), F.lit(0.0)).alias("min"), F.coalesce(F.round(F.max(value), 2), F.lit(0.0)).alias("max"))


def build_filters(always: list[dict], given: dict[str, list[dict]], without: str | None = None) -> dict:
    """The filters of all facets but ``without``, after those that always hold."""
    return {"and": [*always, *[f for name, fs in given.items() if name != without for f in fs]]}


def product_filters(category=None, brand=None, gender=None, promo=None, price_min=None, price_max=None) -> dict[str, list[dict]]:
    """The filters of a product search form, by facet; what isn't given, or an empty list, doesn't filter."""
    return {
        "category": [{"field": "category", "op": "in", "value": category}] if category else [],
        "brand": [{"field": "brand", "op": "in", "value": brand}] if brand else [],
        "gender": [{"field": "gender", "op": "=", "value": gender}] if gender else [],
        "promo": [{"field": "promo", "op": "in", "value": PROMO}] if promo else [],
        "price": [{"field": "price", "op": op, "value": v} for op, v in ((">=", price_min), ("<=", price_max)) if v is not None],
    }


PROMO = [-10 * i for i in range(1, 6)]  #: reductions that count as on sale
AVAILABLE = [{"field": "active", "op": "=", "value": True}, {"field": "stock", "op": ">", "value": 0}]


def adaptive(search: Callable[[dict], DataFrame], given: dict[str, list[dict]], always: list[dict] | None = None) -> dict[str, DataFrame]:
    """For each facet the rows found under all filters but its own; equal searches are planned once and shared.

    Nothing is cached here: who reads a facet's rows more than once caches and releases them.
    """
    seen: dict[str, DataFrame] = {}
    out = {}
    for name in given:
        filters = build_filters(always or [], given, name)
        key = repr(filters)
        if key not in seen:
            seen[key] = search(filters)
        out[name] = seen[key]
    return out


def response(search: Callable[[dict, int], DataFrame], given: dict[str, list[dict]], limit: int = 48) -> dict:
    """What a product search page shows: the rows found and the facets' counts, on the driver.

    The page's rows and counts are bounded by ``limit`` and FACET_LIMIT.
    """
    rows = search(build_filters(AVAILABLE, given), limit).collect()
    found = adaptive(lambda f: search(f, FACET_LIMIT), given, AVAILABLE)
    for df in found.values():
        df.cache()
    try:
        counts = {name: {r["value"]: r["n"] for r in value_counts(found[name], name).collect()} for name in ("category", "brand", "gender")}
        promo, price = split_counts(found["promo"], "promo", PROMO).first(), value_range(found["price"], "price").first()
    finally:
        for df in found.values():
            df.unpersist()
    return {"total": len(rows), "results": [r.asDict() for r in rows], "facets": counts | {"promo": {"on_sale": promo["n_in"], "full_price": promo["n_rest"]}, "price": {"min": price["min"], "max": price["max"]}}}
