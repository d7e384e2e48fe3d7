"""Set operations over harvested lists of tenants, companies and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_tenants(a: DataFrame, b: DataFrame, existing: DataFrame | None = None, labels: tuple[str, str] = ("cc", "wayback"), force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two harvests as one list per provider with its source (either label, or "both"), and the
    existing rows the rebuild would lose. Losses refuse the merge unless `force`.

    All: provider, tenant, url. Tenants compare lower-cased; b's link is preferred.
    """
    one = lambda df, name: df.filter(F.trim("tenant") != "").groupBy("provider", F.lower(F.trim("tenant")).alias("tenant")).agg(F.min("url").alias(name))
    both = one(a, "_a").join(one(b, "_b"), ["provider", "tenant"], "full_outer")
    label = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), labels[0]).otherwise(labels[1])
    merged = both.select("provider", "tenant", F.coalesce("_b", "_a").alias("url"), label.alias("source"))
    if existing is None:
        return merged, merged.select("provider", "tenant").limit(0)
    lost = existing.select("provider", F.lower(F.trim("tenant")).alias("tenant")).distinct().join(merged.select("provider", "tenant"), ["provider", "tenant"], "left_anti")
    if not force and lost.limit(1).count():
        raise ValueError("the merge would lose tenants already held; pass force to accept it")
    return merged, lost


def fold_tenants(pool: DataFrame, extra: DataFrame, label: str) -> DataFrame:
    """The pool with one more source's tenants added; a tenant it holds keeps its link and gains the label."""
    new = extra.groupBy("provider", F.lower(F.trim("tenant")).alias("tenant")).agg(F.min("url").alias("_u"))
    rows = pool.join(new, ["provider", "tenant"], "full_outer")
    held = F.col("source").isNotNull() & F.col("_u").isNotNull() & ~F.array_contains(F.split("source", r"\+"), label)
    source = F.when(F.col("source").isNull(), F.lit(label)).when(held, F.concat_ws("+", "source", F.lit(label))).otherwise(F.col("source"))
    return rows.select("provider", "tenant", F.coalesce("url", "_u").alias("url"), source.alias("source"))


def consolidate_lists(lists: DataFrame, names: Mapping[str, str], held: DataFrame | None = None, slug: str = r"^[a-z0-9][a-z0-9._-]{1,79}$") -> DataFrame:
    """`(provider, slug, sources)`: provider names normalised, slugs validated, one row each with
    every list that named it; those the ledgers hold are left out. `lists`: provider, slug, src."""
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    squeezed = F.regexp_replace(F.lower(F.trim("provider")), r"[^a-z0-9]", "")
    rows = lists.select(F.try_element_at(known, squeezed).alias("provider"), F.lower(F.trim("slug")).alias("slug"), "src")
    rows = rows.filter(F.col("provider").isNotNull() & F.col("slug").rlike(slug))
    # The lists are few, so a row's set of them stays small.
    merged = rows.groupBy("provider", "slug").agg(F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"))
    if held is None:
        return merged
    return merged.join(held.select("provider", F.lower("slug").alias("slug")).distinct(), ["provider", "slug"], "left_anti")


#: A web address as lists write it, with its host in group 1: scheme, login, "www", port, path and closing dots may be there.
_SITE = r"^\s*(?:\w+://)?(?:[^\s/?@]*@)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)\.*(?::\d+)?(?:[/?].*)?\s*$"


def site_of(c: Column) -> Column:
    """The host a list means, in lower case; empty where it names none."""
    return F.coalesce(F.regexp_extract(F.lower(c), _SITE, 1), F.lit(""))


def letters_of(c: Column) -> Column:
    """Only the letters and digits, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def alike(name: Column, site: Column) -> Column:
    """Whether a company may own a site: as far as the shorter of its name and the site's first label
    reaches, the longer has it inside or begins with it but for one letter in four."""
    n, s = letters_of(name), letters_of(F.substring_index(site, ".", 1))
    reach = F.least(F.length(n), F.length(s))
    off = F.levenshtein(F.left(n, reach), F.left(s, reach))
    return (reach > 0) & (n.contains(s) | s.contains(n) | ((reach >= 4) & (off * 4 <= reach)))


def merge_seeds(parts: DataFrame, seeded: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(seeds, set aside)`: company seeds unioned on their bare domain, first part wins. Bad and
    already seeded domains are dropped, and a name that does not fit its domain is set aside.

    `parts`: name, domain, part (its rank), place. Seeds are ordered uncovered first, then by part;
    `covered` holds names already served.
    """
    rows = parts.withColumn("_d", site_of(F.col("domain"))).filter(F.col("_d") != "")
    rows = rows.join(seeded.select(site_of(F.col("domain")).alias("_d")).distinct(), "_d", "left_anti")
    fits = alike(F.col("name"), F.col("_d"))
    first = rows.filter(fits).groupBy("_d").agg(F.min(F.struct("part", "place", "name")).alias("_f"))
    names = covered.select(letters_of(F.col("name")).alias("_n")).distinct().withColumn("covered", F.lit(True))
    seeds = first.select(F.col("_f.name").alias("name"), F.col("_d").alias("domain"), F.col("_f.part").alias("part"), F.col("_f.place").alias("place"))
    seeds = seeds.join(names, letters_of(F.col("name")) == F.col("_n"), "left").drop("_n").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return seeds.orderBy("covered", "part", "place", "domain"), rows.filter(~fits).select("name", F.col("_d").alias("domain"), "part")


def merge_resolutions(main: DataFrame, verify: DataFrame, key: str = "domain", fields: Sequence[str] = ("provider", "token")) -> DataFrame:
    """Main results overlaid by recoveries: a recovered answer fills one the main run lacks."""
    back = verify.select(key, *[F.col(f).alias(f"_v_{f}") for f in fields])
    rows = main.join(back, key, "full_outer")
    empty = reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields])
    got = reduce(lambda a, b: a | b, [F.col(f"_v_{f}").isNotNull() for f in fields])
    return rows.select(key, *[F.when(empty, F.col(f"_v_{f}")).otherwise(F.col(f)).alias(f) for f in fields], (empty & got).alias("recovered"))


def coverage_audit(source: DataFrame, merged: DataFrame, key: Sequence[str] = ("provider", "tenant")) -> DataFrame:
    """Source rows missing from the merged set, per provider."""
    norm = lambda df: df.select(key[0], F.lower(F.trim(key[1])).alias(key[1])).distinct()
    return norm(source).join(norm(merged), list(key), "left_anti")
