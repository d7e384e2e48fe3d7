"""Jobs over landed web data: pages, provider payloads, link indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, squash
from ..operators.clean import host_of, registrable_domain
from ..rules.feeds import BLOCKED_TOKENS, BOARD_LINKS, FEEDS, TENANT_SPECS

LD_JSON = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
POSTING_FIELDS = (
    "title", "url", "posted_at", "location", "department", "employment_type", "description", "experience", "salary", "requisition", "remote",
)


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _string(node: Column, path: str) -> Column:
    """The value at a path only where it is a string; an object is not read as its JSON."""
    return let(F.try_variant_get(node, path, "variant"), lambda value: F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string"))))


def _nodes(block: Column) -> Column:
    """A parsed block as its nodes: a list's items, and each one's @graph."""
    roots = F.coalesce(F.try_variant_get(block, "$", "array<variant>"), F.array(block))
    return F.flatten(F.transform(roots, lambda r: F.coalesce(F.try_variant_get(r, "$['@graph']", "array<variant>"), F.array(r))))


def _place(node: Column) -> Column:
    """One job place: its address parts, else its name, else the address as text."""
    part = lambda key: let(_string(node, f"$.address.{key}"), lambda said: F.when(said != "", said))
    country = F.coalesce(_string(node, "$.address.addressCountry.name"), part("addressCountry"))
    parts = F.array_join(F.array_distinct(F.array_compact(F.array(part("addressLocality"), part("addressRegion"), country))), ", ")
    return F.coalesce(let(parts, lambda said: F.when(said != "", said)), _string(node, "$.name"), _string(node, "$.address"))


def extract_jsonld_postings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """`(key, place in page, posting fields)` for every JobPosting node of the pages' ld+json blocks,
    lists and @graph flattened. Blocks that do not parse hide no other block; `jsonld_problems`
    lists their pages."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1))).alias("block", "_text"))
    # A block that does not parse is a node without a type, which the test of types drops; a filter of its own would parse all blocks twice.
    parsed = blocks.select(key, "block", F.try_parse_json(F.trim("_text")).alias("_v"))
    nodes = parsed.select(key, "block", F.posexplode(_nodes(F.col("_v"))).alias("node", "_n"))
    kinds = F.coalesce(F.try_variant_get("_n", "$['@type']", "array<string>"), F.array(_text(F.col("_n"), "$['@type']")))
    jobs = nodes.filter(F.array_contains(kinds, "JobPosting"))
    n = F.col("_n")
    kind_list = F.try_variant_get(n, "$.employmentType", "array<string>")
    places = F.coalesce(F.try_variant_get(n, "$.jobLocation", "array<variant>"), F.array(F.try_variant_get(n, "$.jobLocation", "variant")))
    place_texts = F.array_distinct(F.array_compact(F.transform(places, _place)))
    return jobs.select(
        key, "block", "node", _text(n, "$.title").alias("title"), _text(n, "$.description").alias("description"), _text(n, "$.datePosted").alias("posted_at"),
        F.coalesce(F.nullif(F.array_join(kind_list, ", "), F.lit("")), _text(n, "$.employmentType")).alias("employment_type"),
        F.nullif(F.array_join(place_texts, "; "), F.lit("")).alias("location"),
        F.nullif(F.coalesce(_string(n, "$.hiringOrganization.name"), _string(n, "$.hiringOrganization")), F.lit("")).alias("company"),
        F.when(_text(n, "$.jobLocationType") == "TELECOMMUTE", F.lit(True)).alias("remote"),
    )


def jsonld_problems(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages with a block that does not parse."""
    texts = F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1))
    broken = F.exists(texts, lambda t: F.try_parse_json(F.trim(t)).isNull())
    return pages.filter(broken).select(key)


def normalize_feed(raw: DataFrame, provider: str, mapping: Mapping | None = None) -> DataFrame:
    """Raw listing payloads of one provider as common postings. `raw`: slug, company, payload.

    The mapping names the payload's schema and an expression per field; one `select` is built from
    it, so a new provider is data, not code.
    """
    m = mapping or FEEDS[provider]
    if m["kind"] == "html":
        items = raw.select("slug", "company", F.explode(F.regexp_extract_all("payload", F.lit(f"({m['item']})"), F.lit(1))).alias("item"))
        found = {k: F.nullif(squash(F.regexp_replace(F.regexp_extract("item", p, 1), "<[^>]*>", " ")), F.lit("")) for k, p in m["fields"].items()}
    else:
        parsed = F.from_json("payload", m["schema"]) if m["kind"] == "json" else F.from_xml("payload", m["schema"])
        items = raw.withColumn("parsed", parsed).select("slug", "company", F.explode(F.expr(m["items"])).alias("item"))
        found = {k: F.expr(e) for k, e in m["fields"].items()}
    missing = lambda name: F.lit(None).cast("boolean" if name == "remote" else "string")
    columns = [found.get(name, missing(name)).alias(name) for name in POSTING_FIELDS]
    native = found["native"]
    return items.select(
        F.concat_ws(":", F.lit(provider), F.col("slug"), native).alias("id"), F.lit(provider).alias("ats"), F.concat_ws(":", F.lit(provider), F.col("slug")).alias("board"), "company", *columns
    ).filter(native.isNotNull() if m["kind"] == "html" else F.col("id").isNotNull())


def mine_tenants(urls: DataFrame, specs: Sequence[tuple[str, str, str]] = TENANT_SPECS) -> DataFrame:
    """`(provider, tenant, url)` from a web-index table (url, ord): links on a provider's registered
    domain, the tenant by its pattern, first link wins. The domain test is a cheap equality."""
    rows = urls.withColumn("_domain", registrable_domain(host_of(F.col("url"))))
    hits = [
        F.when(F.col("_domain") == domain, F.struct(F.lit(provider).alias("provider"), F.lower(F.regexp_extract("url", pattern, 1)).alias("tenant")))
        for provider, domain, pattern in specs
    ]
    found = rows.select("url", "ord", F.explode(F.array_compact(F.array(*hits))).alias("h")).filter(F.col("h.tenant") != "")
    return found.groupBy("h.provider", "h.tenant").agg(F.min(F.struct("ord", "url")).alias("_f")).select("provider", "tenant", F.col("_f.url").alias("url"))


def mine_host_graph(spark: SparkSession, path: str, prefixes: Sequence[str]) -> DataFrame:
    """`(host, prefix)` of a host list in compressed shards whose reversed name starts with a prefix,
    turned the right way round. One file is one task; the shards are many."""
    lines = spark.read.text(path).select(F.element_at(F.split("value", r"\s+"), -1).alias("_reversed"))
    return host_matches(lines, prefixes)


def host_matches(hosts: DataFrame, prefixes: Sequence[str], column: str = "_reversed") -> DataFrame:
    rows = hosts.select(F.explode(F.array_compact(F.array(*[F.when(F.col(column).startswith(p), F.struct(F.col(column).alias("r"), F.lit(p).alias("prefix"))) for p in prefixes]))).alias("h"))
    host = F.array_join(F.reverse(F.split("h.r", r"\.")), ".")
    return rows.select(host.alias("host"), F.col("h.prefix").alias("prefix")).distinct()


def fingerprint_pages(pages: DataFrame, patterns: Sequence[tuple[str, str, bool]] = BOARD_LINKS, blocked: Sequence[str] = BLOCKED_TOKENS,
                      key: str = "page_id", html: str = "html") -> DataFrame:
    """`(key, provider, token)`: the boards a page links to. Tokens of 3 to 60 characters, lower-cased
    but for providers that keep case, none whose first label is blocked."""
    hits = F.concat(*[
        F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), _hit(provider, lower)) for provider, pattern, lower in patterns
    ])
    found = pages.select(key, F.explode(F.array_distinct(hits)).alias("h")).select(key, "h.provider", "h.token")
    label = F.split(F.lower("token"), r"\.").getItem(0)
    return found.filter(F.length("token").between(3, 60) & ~label.isin(*blocked)).distinct()


def _hit(provider: str, lower: bool):
    return lambda t: F.struct(F.lit(provider).alias("provider"), (F.lower(t) if lower else t).alias("token"))
