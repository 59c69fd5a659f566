"""The thermal model T(t) = T_inf + sum k*exp(-t/tau)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_expr(t: Column, tinf: Column, terms: Column) -> Column:
    return tinf + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x["k"] * F.exp(-t / x["tau"]))


def component_expr(t: Column, tinf: Column, term: Column) -> Column:
    return tinf + term["k"] * F.exp(-t / term["tau"])


def jacobian(t: Column, terms: Column, order: int) -> list[Column]:
    """Partial derivatives for (T_inf, k1, tau1, k2, tau2, ...)."""
    columns = [F.lit(1.0)]
    for i in range(order):
        k, tau = terms[i]["k"], terms[i]["tau"]
        e = F.exp(-t / tau)
        columns += [e, k * t * e / (tau * tau)]
    return columns
