"""Text helpers: common prefixes, file names, fit legends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def _shared(a: Column, b: Column, cut) -> Column:
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(lengths, lambda i: cut(a, i) == cut(b, i)))


def common_prefix(value: Column) -> Column:
    """Aggregate: longest common prefix, which is that of the smallest and the largest value."""
    low, high = F.min(value), F.max(value)
    return F.left(low, _shared(low, high, lambda s, i: F.left(s, i)))


def common_suffix(value: Column) -> Column:
    low, high = F.min(F.reverse(value)), F.max(F.reverse(value))
    return F.reverse(F.left(low, _shared(low, high, lambda s, i: F.left(s, i))))


def exponential_text(k: Column, tau: Column, markup: str = "gnuplot") -> Column:
    """One signed term of a fit; a tau that prints as zero gets a second decimal."""
    shown = F.format_string("%.1f", tau)
    shown = F.when(shown.rlike("^[0.]*$"), F.format_string("%.2f", tau)).otherwise(shown)
    size = F.format_string("%.1f", F.abs(k))
    if markup == "gnuplot":
        sign = F.when(k < 0, F.lit(" – ")).otherwise(F.lit(" + "))
        return F.concat(sign, size, F.lit("⋅e^{−t/"), shown, F.lit("}"))
    if markup == "latex":
        sign = F.when(k < 0, F.lit("-")).otherwise(F.lit(" + "))
        return F.concat(sign, size, F.lit(r" e^{\frac{-t}{"), shown, F.lit("}}"))
    raise ValueError(f"unknown markup {markup}")


def fit_text(tinf: Column, terms: Column, minutes: bool = False, markup: str = "gnuplot") -> Column:
    """``T∞ ± k⋅e^{−t/τ} …`` with the terms in order of rising τ."""
    by_tau = F.array_sort(terms, lambda a, b: F.when(a["tau"] < b["tau"], -1).when(a["tau"] > b["tau"], 1).otherwise(0))
    div = 60.0 if minutes else 1.0
    texts = F.transform(by_tau, lambda x: exponential_text(x["k"], x["tau"] / div, markup))
    return F.concat(F.format_string("%.1f", tinf), F.array_join(texts, ""))
