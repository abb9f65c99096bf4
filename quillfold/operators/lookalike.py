"""Domains that look like others of the same group, without comparing all pairs.

Candidates meet in equi-joins: brands that are equal, brands that are a token of
another, and brands with a common variant after at most two deletions (two
strings within two edits always have one). The relation itself is then computed
on candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.identity import sld


def without_one(words: Column) -> Column:
    """All strings that one deletion makes of each of the words."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, 1000)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), drop)))


def lookalikes(domains: DataFrame, group: str, domain: str) -> DataFrame:
    """(group, a, b, relation): ordered pairs of different registrable domains of a group that are related."""
    d = domains.select(group, F.col(domain).alias("domain")).filter("domain is not null").distinct().withColumn("brand", sld(F.col("domain")))
    one = without_one(F.array("brand"))
    edits = F.when(F.length("brand") >= 5, F.array_union(F.array_union(F.array("brand"), one), without_one(one))).otherwise(F.array().cast("array<string>"))
    tokens = F.filter(F.split("brand", "[-_.]+"), lambda t: F.length(t) >= 4)
    keyed = d.select(group, "domain", "brand", F.explode(F.array_distinct(F.concat(F.transform(edits, lambda x: F.concat(F.lit("e"), x)), F.array(F.concat(F.lit("b"), F.col("brand"))), F.transform(tokens, lambda x: F.concat(F.lit("t"), x)), F.array(F.concat(F.lit("t"), F.col("brand")))))).alias("k"))
    pairs = keyed.alias("x").join(keyed.alias("y"), [group, "k"]).filter("x.domain != y.domain").select(group, F.col("x.domain").alias("a"), F.col("x.brand").alias("sa"), F.col("y.domain").alias("b"), F.col("y.brand").alias("sb")).distinct()
    longer = F.when(F.length("sa") >= F.length("sb"), F.col("sa")).otherwise(F.col("sb"))
    shorter = F.when(F.length("sa") >= F.length("sb"), F.col("sb")).otherwise(F.col("sa"))
    pairs = pairs.select(group, "a", "b", "sa", "sb", longer.alias("longer"), shorter.alias("shorter"))
    relation = (
        F.when(F.col("sa") == F.col("sb"), "sibling_tld")
        .when((F.length("shorter") >= 4) & F.array_contains(F.split("longer", "[-_.]+"), F.col("shorter")), "embedded_brand")
        .when((F.length("shorter") >= 6) & (F.levenshtein("sa", "sb") <= 2), "typosquat")
    )
    return pairs.select(group, "a", "b", relation.alias("relation")).filter("relation is not null")
