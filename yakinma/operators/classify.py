"""Multi-label categories from weighted phrases, in one projection.

A phrase counts once, however often it occurs; a category applies from the threshold of its unrounded sum on. Every
phrase is a literal of its own containment test, so the sums are generated code over one text; no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yakinma.functions.rounding import py_round
from yakinma.functions.text import analysis_text, let, padded, phrase_python, phrase_text, pin
from yakinma.operators.rules import ALL, OTHER, Rules


def category_sums(look: Column, rules: Rules, explain: bool) -> Column:
    """array<struct<k, t, p>> of a padded phrase text: each category's number, sum of weights, and matched phrases."""

    def category(k: int, terms: tuple[tuple[str, float], ...]) -> Column:
        total, matched = F.lit(0.0), []
        for phrase, weight in terms:
            if plain := phrase_python(phrase):
                hit = F.contains(look, F.lit(f" {plain} "))
                total = total + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
                matched.append(F.when(hit, F.lit(phrase)))
        phrases = F.array_compact(F.array(*matched)) if explain and matched else F.array().cast("array<string>")
        return F.struct(F.lit(k).alias("k"), total.alias("t"), phrases.alias("p"))

    return F.array(*[category(k, terms) for k, (_, terms) in enumerate(rules.items)])


def _ranked(sums: Column, rules: Rules, threshold: float) -> Column:
    names = F.array(*[F.lit(c) for c in rules.categories])
    kept = F.transform(F.filter(sums, lambda s: s["t"] >= threshold), lambda s: F.struct((-py_round(s["t"], 2)).alias("o"), s["k"].alias("k"), s["p"].alias("p")))
    return let(
        F.array_sort(kept),
        lambda x: F.struct(
            F.when(F.size(x) > 0, F.element_at(names, F.get(x, F.lit(0))["k"] + 1)).otherwise(F.lit(OTHER)).alias("primary"),
            F.transform(x, lambda s: F.struct(F.element_at(names, s["k"] + 1).alias("category"), (-s["o"]).alias("score"))).alias("scores"),
            F.transform(x, lambda s: F.struct(F.element_at(names, s["k"] + 1).alias("category"), s["p"].alias("phrases"))).alias("matched"),
        ),
    )


def classify_text(text: Column, rules: Rules | None = None, threshold: float = 2.0, explain: bool = True) -> Column:
    """struct(primary, scores[category, score], matched[category, phrases]): scores descend, ties in rule order. Without
    ``explain`` the lists of phrases are empty."""
    rules = rules or Rules.of()
    return _ranked(let(padded(phrase_text(text)), lambda t: category_sums(t, rules, explain)), rules, threshold)


def with_classification(df: DataFrame, name: str, text: Column, rules: Rules | None = None, threshold: float = 2.0, explain: bool = True) -> DataFrame:
    """``classify_text`` as a column whose text and sums are computed once, in generated code."""
    rules = rules or Rules.of()
    df = pin(pin(df, "_look", padded(phrase_text(text))).withColumn("_sums", category_sums(F.col("_look"), rules, explain)).drop("_look"), name, _ranked(F.col("_sums"), rules, threshold))
    return df.drop("_sums")


def categories_of(result: Column) -> Column:
    """Categories of a classification, in order of score; the rest category where there are none."""
    found = F.transform(F.filter(result["scores"], lambda s: s["score"] > 0), lambda s: s["category"])
    return let(found, lambda x: F.when(F.size(x) == 0, F.array(F.lit(OTHER))).otherwise(x))


def explanation(result: Column) -> Column:
    """``Category: phrase, phrase; ...`` of what made a record match."""
    return F.array_join(F.transform(result["matched"], lambda m: F.concat(m["category"], F.lit(": "), F.array_join(m["phrases"], ", "))), "; ")


def classified(df: DataFrame, rules: Rules | None = None, threshold: float = 2.0, explain: bool = False) -> DataFrame:
    """Add ``classification`` and ``categories`` of title and own body (the answer is not looked at)."""
    df = with_classification(df, "classification", analysis_text(F.col("title"), F.col("complaint_text")), rules, threshold, explain)
    return pin(df, "categories", categories_of(F.col("classification")))


def in_category(category: str) -> Column:
    return F.lit(True) if category == ALL else F.array_contains("categories", category)
