"""Reference lists: their index, what a value resolves to, and the nearest names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriquill.functions.arrow import nearest_names, normalise_text
from veriquill.operators.sides import small_side

ENTRY = "list string, pos int, canonical string, search_terms string, aliases array<string>"


def reference_index(entries: DataFrame) -> DataFrame:
    """(list, form, canonical, kind): names and aliases by normal form; an alias that is the entry's own name is no alias."""
    named = entries.withColumn("own", normalise_text("canonical"))
    names = named.select("list", F.col("own").alias("form"), "canonical", F.lit("name").alias("kind"))
    aliases = named.select("list", "own", "canonical", F.explode("aliases").alias("alias")).withColumn("form", normalise_text("alias"))
    aliases = aliases.where("form <> '' and form <> own").select("list", "form", "canonical", F.lit("alias").alias("kind"))
    return names.unionByName(aliases).distinct()


def resolved(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """tokens (list, token, form, ...) with status (canonical, alias, ambiguous, no_match, empty), canonical and candidates.

    Names come before aliases; several entries under one form are ambiguous.
    """
    hits = index.groupBy("list", "form").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "name", F.col("canonical")))).alias("names"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "alias", F.col("canonical")))).alias("also"),
    )
    best = F.when(F.size("names") > 0, F.col("names")).otherwise(F.col("also"))
    out = tokens.join(small_side(hits), ["list", "form"], "left").withColumn("candidates", best)
    n = F.coalesce(F.size("candidates"), F.lit(0))
    status = F.when(F.col("form") == "", "empty").when(n > 1, "ambiguous").when(n == 0, "no_match").when(F.size("names") > 0, "canonical").otherwise("alias")
    return out.withColumn("status", status).withColumn("canonical", F.when(F.col("status").isin("canonical", "alias"), F.get("candidates", F.lit(0)))).drop("names", "also")


def suggestions(tokens: DataFrame, index: DataFrame, n: int = 5) -> DataFrame:
    """(list, form, rank, canonical, ratio): the n nearest names of each unmatched form, by its best ratio to a name or alias; ties by name.

    One row a distinct form and list goes to Python with the list's names, sorted once; bounds on the ratio leave out
    what cannot be among the n. A list is configuration; its names travel as one value.
    """
    named = index.groupBy("list").agg(F.array_sort(F.collect_set(F.struct("canonical", F.col("form").alias("other")))).alias("names"))
    both = tokens.where("form is not null").select("list", "form").distinct().join(named, "list")
    ranked = both.select("list", "form", F.posexplode(nearest_names("form", "names", F.lit(n))).alias("at", "s"))
    return ranked.select("list", "form", (F.col("at") + 1).alias("rank"), "s.canonical", "s.ratio")


def unknown_lists(catalogue: DataFrame, entries: DataFrame) -> DataFrame:
    """Fields whose reference list is not there."""
    return catalogue.where("canonical_reference is not null").join(entries.select(F.col("list").alias("canonical_reference")).distinct(), "canonical_reference", "left_anti")


def clashes(entries: DataFrame) -> DataFrame:
    """(list, form, canonicals): forms that lead to more than one entry."""
    return reference_index(entries).groupBy("list", "form").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals")).where("size(canonicals) > 1")
