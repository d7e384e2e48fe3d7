"""Ranking: nearest vectors, browse orders, spreads, slices and shortlists.

Every page is `orderBy(...).limit(...)`, which Spark runs as a per-partition top-k followed by one
small merge, so no ordering of the whole table takes place. Per-group tops use `row_number() <= n`,
whose limit Spark applies before the shuffle, so a group holding most rows ships n rows a partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import group_row_number, top_per_group
from ..functions.text import drop_last_part
from ..functions.vectors import cosine, literal_vector

PAGE_ROWS = 20
SORT_FLOOR = 0.67


def page_bounds(k: int | None, page: int | None) -> tuple[int, int]:
    """`(limit, offset)` of a page of k rows (20 unasked); neither may be below 1, and both may be
    as large as the caller asks."""
    k = PAGE_ROWS if k is None else k
    page = 1 if page is None else page
    if k < 1 or page < 1:
        raise ValueError("k and page start at 1")
    return k, (page - 1) * k


def scored(df: DataFrame, query: Sequence[float] | Column, vector: str = "vector") -> DataFrame:
    """The table with `similarity`, and `score` as shown: rounded to three places."""
    target = query if isinstance(query, Column) else literal_vector(query)
    sim = cosine(F.col(vector), target)
    return df.withColumn("similarity", sim).withColumn("score", F.round("similarity", 3))


def vector_topk(df: DataFrame, query, where: Column | None = None, k: int | None = None, page: int | None = None,
                vector: str = "vector") -> DataFrame:
    """Filter first, then the k nearest by cosine, ties by id."""
    limit, offset = page_bounds(k, page)
    kept = df if where is None else df.filter(where)
    ranked = scored(kept, query, vector).drop(vector).filter(F.col("similarity").isNotNull())
    return ranked.orderBy(F.desc("similarity"), F.asc("id")).offset(offset).limit(limit)


def more_like(df: DataFrame, row_id: str, where: Column | None = None, k: int | None = None, page: int | None = None,
              query: str | None = None) -> DataFrame:
    """Rank by a stored row's own vector, the row itself left out."""
    if query and query.strip():
        raise ValueError("rank by one row or by a query, not both")
    own = df.filter(F.col("id") == row_id).select(F.col("vector").alias("_query")).limit(1)
    rest = df.filter(F.col("id") != row_id)
    if where is not None:
        rest = rest.filter(where)
    # One row at most, so the join is a broadcast of a single vector.
    joined = rest.join(F.broadcast(own), F.lit(True), "inner")
    limit, offset = page_bounds(k, page)
    return (
        scored(joined, F.col("_query")).drop("vector", "_query")
        .orderBy(F.desc("similarity"), F.asc("id")).offset(offset).limit(limit)
    )


def vector_topk_approx(df: DataFrame, query: Sequence[float], k: int = 10, tables: int = 8, width: float = 1.0,
                       seed: int = 7, candidates: int = 400) -> DataFrame:
    """Candidates from random-projection buckets, re-ranked exactly.

    A row is a candidate when it shares a bucket with the query in at least one hash table; the
    most-shared `candidates` rows are re-ranked by true cosine. Approximate by design.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    norm = sum(float(v) * float(v) for v in query) ** 0.5 or 1.0
    unit = [float(v) / norm for v in query]
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit_col = F.transform("vector", lambda x: x.cast("double") / length)
    rows = df.withColumn("features", array_to_vector(unit_col))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width,
                                      numHashTables=tables, seed=seed).fit(rows)
    near = lsh.approxNearestNeighbors(rows, Vectors.dense(unit), max(candidates, k), distCol="distance")
    return scored(near, query).drop("features", "hashes", "distance", "vector").orderBy(
        F.desc("similarity"), F.asc("id")
    ).limit(k)


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k the approximate answer holds."""
    hits = exact.select("id").join(approx.select("id"), "id", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("found")).withColumn("k", F.lit(k)).withColumn(
        "recall", F.round(F.col("found") / k, 4)
    )


SORT_COLUMNS = {"posted": "posted_at", "seen": "first_seen", "salary": "min_salary_annual"}


def browse(df: DataFrame, where: Column | None = None, sort: str | None = None, k: int | None = None,
           page: int | None = None) -> DataFrame:
    """No query: newest first-seen first, nulls last, ties by id; or by posted, seen or salary."""
    limit, offset = page_bounds(k, page)
    column = SORT_COLUMNS.get(sort or "seen", "first_seen")
    kept = df if where is None else df.filter(where)
    return kept.orderBy(F.desc_nulls_last(column), F.asc("id")).offset(offset).limit(limit)


def salary_browse(df: DataFrame, currency: str, where: Column | None = None, k: int | None = None,
                  page: int | None = None) -> DataFrame:
    """The chosen currency in salary order, then the others grouped by currency, no currency last."""
    limit, offset = page_bounds(k, page)
    kept = df if where is None else df.filter(where)
    own = F.when(F.col("salary_currency") == currency, 0).otherwise(1)
    return kept.orderBy(
        own, F.asc_nulls_last("salary_currency"), F.desc_nulls_last("min_salary_annual"), F.asc("id")
    ).offset(offset).limit(limit)


def sort_within_relevance(df: DataFrame, query, sort: str, where: Column | None = None, floor: float = SORT_FLOOR,
                          window: int | None = None, currency: str | None = None, rates: Mapping[str, float] | None = None,
                          k: int | None = None, page: int | None = None) -> DataFrame:
    """The rows at least `floor` similar (only the closest `window` of them, if one is stated),
    re-ordered by a column; a salary sort is restated in one currency, and a row whose currency has
    no rate sorts with the unpriced."""
    limit, offset = page_bounds(k, page)
    kept = df if where is None else df.filter(where)
    top = scored(kept, query).drop("vector")
    if window is not None:
        top = top.orderBy(F.desc("similarity"), F.asc("id")).limit(window)
    column = SORT_COLUMNS.get(sort, sort)
    key = F.col(column)
    if column == "min_salary_annual" and currency:
        key = convert(F.col(column), F.col("salary_currency"), currency, rates or {})
    return top.filter(F.col("score") >= floor).orderBy(F.desc_nulls_last(key), F.desc("id")).offset(offset).limit(limit)


def convert(amount: Column, currency: Column, to: str, rates: Mapping[str, float]) -> Column:
    """`amount` in another currency; null when either currency has no rate."""
    if to not in rates or not rates:
        return F.lit(None).cast("double")
    pairs = [x for code, rate in rates.items() for x in (F.lit(code), F.lit(float(rate)))]
    rate = F.try_element_at(F.create_map(*pairs), F.upper(currency))
    return F.when(F.upper(currency) == to, amount.cast("double")).otherwise(amount.cast("double") / rate * F.lit(float(rates[to])))


def company_key(company: Column, board: Column) -> Column:
    """The employer a row counts under: its company case-folded, else its board."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce(company, F.lit("")), r"\s+", " ")))
    return F.when(name != "", name).otherwise(F.lower(board))


def spread_companies(ranked: DataFrame, per_company: int, order: Sequence[Column], window: int | None = None) -> DataFrame:
    """Ranked rows (only the first `window`, if one is stated) with each company's postings past its
    first `per_company` moved after all others and marked.

    `posting` names copies of one posting (the id itself when the column is absent): a copy of a
    kept posting is kept beside it. `more_from_company` says on a kept row how many of its
    company follow.
    """
    if window is not None:
        ranked = ranked.orderBy(*order).limit(window)
    by_company = Window.partitionBy("company_key")
    rows = group_row_number(ranked, [], order, "rank").withColumn("rank", F.col("rank").cast("int")).withColumn(
        "company_key", company_key(F.col("company"), drop_last_part(F.col("id")))
    )
    if "posting" not in rows.columns:
        rows = rows.withColumn("posting", F.col("id"))
    # The cap is met in rank order and never un-met, so a posting is kept exactly when its first
    # row is among its company's first `per_company` rows.
    place = F.row_number().over(by_company.orderBy("rank"))
    rows = rows.withColumn("_place", place)
    first = F.min("_place").over(Window.partitionBy("company_key", "posting"))
    rows = rows.withColumn("past_company_cap", first > per_company)
    rows = rows.withColumn(
        "more_from_company",
        F.when(~F.col("past_company_cap"), F.sum(F.col("past_company_cap").cast("int")).over(by_company)).otherwise(F.lit(0)),
    )
    return rows.drop("_place").orderBy("past_company_cap", "rank")


def alert_shortlist(hits: DataFrame, cap: int = 30) -> DataFrame:
    """Per subscription, the rows first seen strictly after its own watermark, best `cap` by score."""
    order = Window.partitionBy("subscription").orderBy(F.desc("score"), F.asc("id"))
    fresh = hits.filter(F.col("first_seen") > F.col("watermark"))
    return fresh.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)


def newest_in_family(df: DataFrame, assignments: DataFrame, family: str, n: int | None = None,
                     where: Column | None = None) -> DataFrame:
    """The rows of one role family, newest first, ties by id; only the first n, if n is stated."""
    members = assignments.filter(F.col("family") == family).select("id").distinct()
    kept = df if where is None else df.filter(where)
    return kept.join(members, "id", "left_semi").orderBy(F.desc_nulls_last("first_seen"), F.asc("id")).transform(lambda d: d if n is None else d.limit(n))


def closest_in_family(df: DataFrame, assignments: DataFrame, family: str, query, n: int) -> DataFrame:
    """The n rows of a family closest to a query."""
    members = assignments.filter(F.col("family") == family).select("id").distinct()
    top = scored(df.join(members, "id", "left_semi"), query).drop("vector")
    return top.orderBy(F.desc("similarity"), F.asc("id")).limit(n)


def closest_ids(df: DataFrame, missing: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """For each absent id, the served id on the board it names whose last part is most alike.

    The ratio is `1 - edits / longer length`. Only boards a missing id names are read. Two last parts
    within the bound share a piece: cut into one piece more than the edits allowed, one piece is left
    whole, so only ids that hold a piece of the missing one are compared. The best match is kept by
    a min that combines before the shuffle.
    """
    asked = missing.select(F.col("id").alias("asked")).distinct().withColumn("board", F.lower(drop_last_part(F.col("asked"))))
    asked = asked.filter(F.col("board") != F.lower("asked"))
    served = df.select(F.col("id"), "title", F.lower(drop_last_part(F.col("id"))).alias("board"))
    last = lambda c: F.element_at(F.split(c, ":"), -1)
    # The pieces of a text of n letters: as many as its longest partner may have edits, and one.
    pieces = lambda n: (F.floor((1 - cutoff) / cutoff * n + 1e-9) + 1).cast("int")
    cut = lambda text, n, i: F.substr(text, (F.floor(i * n / pieces(n)) + 1).cast("int"), (F.floor((i + 1) * n / pieces(n)) - F.floor(i * n / pieces(n))).cast("int"))
    asked = asked.withColumn("_a", last(F.col("asked"))).withColumn("_n", F.length("_a"))
    asked = asked.withColumn("_piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), pieces(F.col("_n")) - 1), lambda i: cut(F.col("_a"), F.col("_n"), i)))))
    served = served.join(asked.select("board").distinct(), "board", "left_semi").withColumn("_b", last(F.col("id"))).withColumn("_n", F.length("_b"))
    partners = F.sequence(F.ceil(F.col("_n") * cutoff - 1e-9).cast("int"), F.floor(F.col("_n") / cutoff + 1e-9).cast("int"))
    sizes = F.array_distinct(F.flatten(F.transform(partners, lambda n: F.array(F.floor(n / pieces(n)).cast("int"), F.ceil(n / pieces(n)).cast("int")))))
    held = F.flatten(F.transform(F.filter(sizes, lambda s: s <= F.col("_n")), lambda s: F.transform(F.sequence(F.lit(1), F.col("_n") - s + 1), lambda at: F.substr(F.col("_b"), at, s))))
    served = served.withColumn("_piece", F.explode(F.array_distinct(held))).select("id", "title", "board", "_piece")
    pairs = served.join(asked.select("asked", "board", "_piece"), ["board", "_piece"]).filter(F.col("id") != F.col("asked")).drop("_piece").distinct()
    a, b = last(F.col("asked")), last(F.col("id"))
    ratio = F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    rated = pairs.withColumn("ratio", F.round(ratio, 6)).filter(F.col("ratio") >= cutoff)
    # min over (negated ratio, id): the best ratio, and the lowest id among equals.
    best = F.min(F.struct((-F.col("ratio")).alias("neg"), F.col("id"), F.col("title"))).alias("best")
    return rated.groupBy("asked").agg(best).select(
        "asked", F.col("best.id").alias("id"), F.col("best.title").alias("title"), (-F.col("best.neg")).alias("ratio")
    )


def pick_slice(boards: DataFrame, size: int, head_share: float = 0.7, gap_share: float = 0.05, seed: int = 0) -> DataFrame:
    """Which boards are read next, with the ranking that seated each.

    `boards`: board, score (null = unscored), unsettled, last_look (null = never), and, where there
    is one, detail_pass (a source that needs a read per posting, taken last in the gap quota). The
    head takes the highest scores up to its share; the gap quota takes the most unsettled boards;
    the tail takes the longest unseen, an unused head share rolling over to it. A size of 0, or one
    no smaller than the list, takes every board. Ties follow a seeded hash.
    """
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("board")))
    scored_boards = boards.filter(F.col("score") > 0)
    if not size or size >= boards.count():
        seat = F.when(F.col("score") > 0, "head").otherwise("tail")
        return boards.select("board", seat.alias("seat"))
    head = scored_boards.orderBy(F.desc("score"), tie, "board").limit(size - round(size * (1 - head_share))).select("board").withColumn("seat", F.lit("head"))
    rest = boards.join(head, "board", "left_anti")
    # The head may be short: the tail's size is what is left over, known after one small count.
    tail_n = size - head.count()
    cheap_first = [F.asc("detail_pass")] if "detail_pass" in boards.columns else []
    wanting = rest.filter(F.col("unsettled") > 0).orderBy(*cheap_first, F.desc("unsettled"), tie, "board")
    gap = wanting.limit(round(tail_n * gap_share)).select("board").withColumn("seat", F.lit("gap"))
    waiting = rest.join(gap, "board", "left_anti")
    tail = waiting.orderBy(F.asc_nulls_first("last_look"), tie, "board").limit(tail_n - gap.count()).select("board").withColumn("seat", F.lit("tail"))
    return head.unionByName(gap).unionByName(tail)


def round_robin(edits: DataFrame, take: int | None = None) -> DataFrame:
    """Edited rows one source at a time in turn, best board first within a source.

    `edits`: id, source, score. With `take`, only each source's first `take` places can be among
    the first `take` rows, so no more are ranked; without it the numbering spreads a large source.
    """
    order = [F.desc_nulls_last("score"), F.asc("id")]
    if take is None:
        return group_row_number(edits, ["source"], order, "turn").orderBy("turn", "source")
    return top_per_group(edits, ["source"], order, take, "turn").orderBy("turn", "source").limit(take)
