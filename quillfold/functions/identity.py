"""Domains and how two of them are related."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of two labels, and the relations that keep two addresses of one name apart.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "co.in", "com.au", "co.nz", "com.br", "co.za")
LOOKALIKE = ("embedded_brand", "typosquat", "sibling_tld")


def domain_of(mail: Column) -> Column:
    """What follows the last @, in lower case."""
    return F.lower(F.trim(F.substring_index(mail, "@", -1)))


def registrable(domain: Column) -> Column:
    """The last two labels; three where the last two form a suffix."""
    d = F.lower(F.trim(domain))
    two = F.substring_index(d, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(d, ".", -3)).otherwise(two)


def sld(domain: Column) -> Column:
    """The brand: the first label of the registrable domain."""
    return F.substring_index(registrable(domain), ".", 1)


def has_token(text: Column, token: Column) -> Column:
    return F.array_contains(F.split(text, "[-_.]+"), token)


def relation(ra: Column, sa: Column, rb: Column, sb: Column) -> Column:
    """How two domains are related, from their registrable forms and brands: plain comparisons of ready columns."""
    a_longer = F.length(sa) >= F.length(sb)
    shorter = F.least(F.length(sa), F.length(sb))
    inside = F.when(a_longer, has_token(sa, sb)).otherwise(has_token(sb, sa))
    return (
        F.when(ra.isNull() | rb.isNull(), F.lit(None).cast("string"))
        .when(ra == rb, "same")
        .when(sa == sb, "sibling_tld")
        .when((shorter >= 4) & inside, "embedded_brand")
        .when((shorter >= 6) & (F.levenshtein(sa, sb, 2) >= 0), "typosquat")
        .otherwise("unrelated")
    )


def with_relation(rows: DataFrame, domain_a: Column, domain_b: Column, out: str = "relation") -> DataFrame:
    """Adds the relation of two domains: same, embedded_brand, typosquat, sibling_tld or unrelated (null if either is null).

    Registrable domains and brands are projected once, so the generated code
    stays small.
    """
    a = rows.withColumns({"_ra": registrable(domain_a), "_rb": registrable(domain_b)})
    b = a.withColumns({"_sa": F.substring_index("_ra", ".", 1), "_sb": F.substring_index("_rb", ".", 1)})
    return b.withColumn(out, relation(F.col("_ra"), F.col("_sa"), F.col("_rb"), F.col("_sb"))).drop("_ra", "_rb", "_sa", "_sb")


def may_merge(found: Column) -> Column:
    """Whether two addresses of one name can be one person: not if a domain looks like the other."""
    return ~F.coalesce(found, F.lit("unrelated")).isin(*LOOKALIKE)
