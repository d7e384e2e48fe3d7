"""Counts, ledgers and reports over the posting table and the run tables.

Grouping keys are few or spread wide; every count, sum, minimum and maximum combines on the map
side, so a key that holds most rows ships one partial row a partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import exact_percentiles, top_per_group
from ..functions.text import squash
from ..rules import boards as B
from ..rules import derivations as R
from ..session import cut_lineage
from .annotate import annotate_country, band, skill_mentions, watch_roles
from .clean import place_key
from .rank import company_key


# --- role groups -----------------------------------------------------------------------------


def count_groups(rows: DataFrame, new_after: str, watchlist: Sequence[tuple] = R.WATCHLIST) -> DataFrame:
    """`(board, source, metric, family, band, n)`: stock is every row, new those first seen since
    the cut. Out-of-domain rows (family null) count apart as stock under "non-tech" and "all";
    watched roles re-count in-domain rows under their own key.

    `rows`: id, board, ats, family, title, min_years, employment_type, first_seen.
    """
    is_new = F.coalesce(F.col("first_seen") >= new_after, F.lit(False))
    base = rows.select("board", F.col("ats").alias("source"), "title", "family", is_new.alias("_new"),
                       band(F.col("min_years"), F.col("title"), F.col("employment_type")).alias("band"))
    tech = base.filter(F.col("family").isNotNull())
    watched = watch_roles(tech, watchlist).select("board", "source", F.col("role").alias("family"), "band", "_new")
    every = tech.select("board", "source", "family", "band", "_new").unionByName(watched)
    counted = every.groupBy("board", "source", "family", "band").agg(F.count("*").alias("stock"), F.count_if("_new").alias("new"))
    long = counted.select("board", "source", "family", "band", F.inline(F.array(
        F.struct(F.lit("stock").alias("metric"), F.col("stock").alias("n")), F.struct(F.lit("new").alias("metric"), F.col("new").alias("n"))
    ))).filter(F.col("n") > 0)
    apart = base.filter(F.col("family").isNull()).groupBy("board", "source").agg(F.count("*").alias("n")).select(
        "board", "source", F.lit(R.NON_TECH).alias("family"), F.lit("all").alias("band"), F.lit("stock").alias("metric"), "n"
    )
    return long.unionByName(apart).select("board", "source", "metric", "family", "band", "n")


def placements(rows: DataFrame) -> DataFrame:
    """Where each in-domain row is counted: (id, board, family, band, source)."""
    return rows.filter(F.col("family").isNotNull()).select(
        "id", "board", "family", band(F.col("min_years"), F.col("title"), F.col("employment_type")).alias("band"), F.col("ats").alias("source")
    )


def transitions(previous: DataFrame, current: DataFrame, column: str = "family") -> DataFrame:
    """`(from, to, n)` for ids in both snapshots."""
    both = previous.select("id", F.col(column).alias("from")).join(current.select("id", F.col(column).alias("to")), "id")
    return both.groupBy("from", "to").agg(F.count("*").alias("n"))


def reposts(arrived: DataFrame, absent: DataFrame) -> DataFrame:
    """How many arrivals share board and normalised title with a departed row."""
    key = lambda df: df.select(F.lower("board").alias("_b"), squash(F.lower(F.coalesce("title", F.lit("")))).alias("_t"))
    return key(arrived).join(key(absent).distinct(), ["_b", "_t"], "left_semi").agg(F.count("*").alias("reposts"))


def dedup_evictions(evicted: DataFrame, run: str) -> DataFrame:
    """Rows removed per run, board and rule, ready to append to the eviction ledger."""
    return evicted.groupBy(F.lit(run).alias("run"), "board", "rule").agg(F.count("*").alias("rows"))


# --- places, levels, values ------------------------------------------------------------------


def place_head(location: Column) -> Column:
    """The city a place names first."""
    return F.trim(F.split(F.split(squash(location), "[;|]").getItem(0), ",").getItem(0))


def location_rollup(df: DataFrame, per_country: int = 3, cap: int | None = None, countries: DataFrame | None = None) -> DataFrame:
    """`(country, place, jobs, country_jobs)`: rows by country with its top cities, spellings
    folded and shown as most rows spell them; the rows of no country under "" and the unstated
    under null. `cap` marks `capped` when at least that many rows were read.

    Rows are counted per distinct location first; countries are read once per location and per city.
    """
    per_place = df.groupBy(F.col("location")).agg(F.count("*").alias("_n")).withColumn("_shown", F.nullif(squash(F.coalesce("location", F.lit(""))), F.lit("")))
    stated = annotate_country(per_place.filter(F.col("_shown").isNotNull()), countries)
    stated = stated.withColumn("_head", F.nullif(place_head(F.col("location")), F.lit(""))).withColumnRenamed("countries", "_codes")
    stated = annotate_country(stated, countries, column="_head").withColumnRenamed("countries", "_head_codes")
    named = stated.select("_n", "_shown", "_head", "_head_codes", F.explode("_codes").alias("country"))
    totals = named.groupBy("country").agg(F.sum("_n").alias("country_jobs"))
    own_city = F.col("_head").isNotNull() & F.forall("_head_codes", lambda c: c == F.col("country"))
    city = named.withColumn("_city", F.when(own_city, F.col("_head")).otherwise(F.col("_shown")))
    city = city.filter(~F.col("_city").rlike(r"^(?:[A-Z]{2,3}|.*\d.*)$")).withColumn("_key", place_key(F.col("_city")))
    spelled = city.groupBy("country", "_key", "_city").agg(F.sum("_n").alias("_n"))
    folded = spelled.groupBy("country", "_key").agg(F.sum("_n").alias("jobs"), F.min(F.struct((-F.col("_n")).alias("neg"), "_city")).alias("_best"))
    top = Window.partitionBy("country").orderBy(F.desc("jobs"), F.asc("place"))
    cities = folded.select("country", F.col("_best._city").alias("place"), "jobs").withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= per_country)
    by_country = totals.join(cities, "country", "left").select("country", "place", "jobs", "country_jobs")
    nowhere = stated.filter(F.size("_codes") == 0).groupBy(F.col("_shown").alias("place")).agg(F.sum("_n").alias("jobs"))
    all_nowhere = stated.filter(F.size("_codes") == 0).agg(F.sum("_n").alias("country_jobs"))
    best_nowhere = nowhere.orderBy(F.desc("jobs"), F.asc("place")).limit(per_country)
    no_country = best_nowhere.join(F.broadcast(all_nowhere), F.lit(True)).select(F.lit("").alias("country"), "place", "jobs", "country_jobs")
    unstated = per_place.filter(F.col("_shown").isNull()).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("country_jobs")).select(
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("bigint").alias("jobs"), "country_jobs"
    )
    out = by_country.unionByName(no_country).unionByName(unstated)
    if cap is None:
        return out
    read = df.agg((F.count("*") >= cap).alias("capped"))
    return out.join(F.broadcast(read), F.lit(True))


def level_counts(df: DataFrame) -> DataFrame:
    """`(place, band, n)`: rows per seniority band in fixed order, empty bands kept."""
    counted = df.groupBy(band(F.col("min_years"), F.col("title"), F.col("employment_type")).alias("band")).agg(F.count("*").alias("n"))
    order = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(R.BANDS)], "place int, band string")
    return order.join(counted, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).alias("n"))


def recent_count(df: DataFrame, hours: int, now: str) -> DataFrame:
    """Rows first seen in the last hours, of how many a search lists."""
    since = F.date_format(F.lit(now).cast("timestamp") - F.expr(f"interval {int(hours)} hours"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    shown = df.filter(~F.coalesce("is_confident_non_tech", F.lit(False))) if "is_confident_non_tech" in df.columns else df
    return shown.agg(F.count_if(F.col("first_seen") >= since).alias("recent"), F.count("*").alias("served"))


def dimension_values(df: DataFrame) -> DataFrame:
    """`(dimension, value)`: the sources and currencies a table holds, and the accented words its
    locations are spelled with."""
    ats = df.select(F.lit("ats").alias("dimension"), F.col("ats").alias("value")).distinct()
    money = df.select(F.lit("currency").alias("dimension"), F.col("salary_currency").alias("value")).where(F.col("salary_currency").isNotNull()).distinct()
    words = df.select("location").distinct().select(F.explode(F.split(F.lower("location"), r"[^\p{L}]+")).alias("value"))
    accented = words.filter(F.col("value").rlike(r"[^\x00-\x7F]") & (F.regexp_replace("value", r"[\x00-\x7FÀ-ɏ]", "") == "")).select(
        F.lit("accented").alias("dimension"), "value"
    ).distinct()
    return ats.unionByName(money).unionByName(accented)


# --- requirements ----------------------------------------------------------------------------


def requirement_summary(sample: DataFrame, vocabulary: DataFrame | None = None, per_company: int | None = None,
                        top: int = 10, currencies: int = 5, skills: int = 40) -> DataFrame:
    """`(section, name, n, extra)` over a scope of postings, one row a requisition and at most
    `per_company` of one employer's: experience bands (stated, estimated, none), pay quartiles of
    range midpoints for the top currencies, companies, countries, remote, stances, skills with
    their employers.

    `sample`: a search's or a category's rows, all of them or as many as the caller chose, with
    `requisition_leader` (its group's first row) and `ord` (its place). `extra` holds quartiles or employers.
    """
    rows = sample.filter(F.col("id") == F.col("requisition_leader")) if "requisition_leader" in sample.columns else sample
    # Every section reads these rows, so they are written once.
    rows = cut_lineage(rows.withColumn("_company", company_key(F.col("company"), F.col("board"))))
    kept = rows if per_company is None else cut_lineage(top_per_group(rows, ["_company"], [F.col("ord")], per_company, "_k").drop("_k"))
    years = F.when(F.col("min_years") <= 1, "0-1").when(F.col("min_years") <= 4, "2-4").when(F.col("min_years") <= 7, "5-7").otherwise("8+")
    stated = F.col("experience_source").isin("field", "regex")
    experience = kept.select(
        F.when(F.col("min_years").isNull(), "not_stated").when(F.coalesce(stated, F.lit(False)), F.concat(F.lit("stated "), years)).otherwise("estimated_from_title").alias("name")
    ).groupBy("name").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    parts = [experience.select(F.lit("experience").alias("section"), "name", "n", none.alias("extra"))]
    middle = F.when(F.col("max_salary_annual").isNotNull() & F.col("min_salary_annual").isNotNull(), (F.col("min_salary_annual") + F.col("max_salary_annual")) / 2).otherwise(
        F.coalesce("min_salary_annual", "max_salary_annual"))
    paid = kept.withColumn("_mid", middle.cast("double")).filter(F.col("_mid").isNotNull() & F.col("salary_currency").isNotNull())
    common = paid.groupBy("salary_currency").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "salary_currency").limit(currencies)
    shares = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    at = exact_percentiles(paid, "_mid", tuple(shares), keys=["salary_currency"])
    quartiles = at.groupBy("salary_currency").agg(*[F.floor(F.max(F.when(F.col("share") == s, F.col("value"))) + 0.5).alias(n) for s, n in shares.items()])
    pay = common.join(quartiles, "salary_currency")
    parts.append(pay.select(F.lit("salary").alias("section"), F.col("salary_currency").alias("name"), "n",
                            F.concat_ws("/", *[F.col(c).cast("bigint").cast("string") for c in ("p25", "p50", "p75")]).alias("extra")))
    companies = rows.groupBy("_company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_company").limit(top)
    counted = F.least(F.col("n"), F.lit(per_company)) if per_company is not None else F.col("n")
    parts.append(companies.select(F.lit("company").alias("section"), F.col("_company").alias("name"), "n", counted.cast("string").alias("extra")))
    if "countries" in kept.columns:
        codes = kept.select(F.explode("countries").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
        parts.append(codes.select(F.lit("country").alias("section"), "name", "n", none.alias("extra")))
        parts.append(kept.agg(F.count_if(F.size("countries") == 0).alias("n")).select(F.lit("country").alias("section"), F.lit("no country").alias("name"), "n", none.alias("extra")))
    parts.append(kept.agg(F.count_if("remote").alias("n")).select(F.lit("remote").alias("section"), F.lit("remote").alias("name"), "n", none.alias("extra")))
    parts.append(kept.agg(F.count("*").alias("n")).select(F.lit("sample").alias("section"), F.lit("counted").alias("name"), "n", none.alias("extra")))
    if "stances" in kept.columns:
        said = kept.select(F.explode("stances").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        parts.append(said.select(F.lit("stance").alias("section"), "name", "n", none.alias("extra")))
    if vocabulary is not None:
        held = skill_mentions(kept.filter(F.col("description").isNotNull()), vocabulary).join(kept.select("id", "_company"), "id")
        ranked = held.groupBy("skill").agg(F.count("*").alias("n"), F.countDistinct("_company").alias("employers")).orderBy(F.desc("n"), "skill").limit(skills)
        parts.append(ranked.select(F.lit("skill").alias("section"), F.col("skill").alias("name"), "n", F.col("employers").cast("string").alias("extra")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- board ledgers ---------------------------------------------------------------------------


def ewma_ledger(previous: DataFrame, now: DataFrame, weight: float = 0.7, prune_below: float = 0.05, adopt_first: bool = False) -> DataFrame:
    """`(board, score, last)`: boards seen this run blended, others carried, decayed rows dropped.

    `previous`: board, score, last. `now`: board, value. A first value starts from zero, or with
    `adopt_first` is taken as it is.
    """
    rows = previous.join(now, "board", "full_outer")
    start = F.coalesce("score", F.col("value") if adopt_first else F.lit(0.0))
    blended = weight * F.col("value") + (1 - weight) * start
    rows = rows.select("board", F.when(F.col("value").isNull(), F.col("score")).otherwise(blended).alias("score"),
                       F.coalesce("value", "last").alias("last"), F.col("value").isNotNull().alias("_seen"))
    return rows.filter(~F.col("_seen") | (F.col("score") >= prune_below)).drop("_seen")


def cost_ledger(previous: DataFrame, measured: DataFrame, weight: float = 0.5) -> DataFrame:
    """`(board, seconds, jobs)`: measured seconds blended; an unfinished read's are a lower bound,
    and a read that failed or did not finish leaves the last full listing's count.

    `measured`: board, seconds, jobs, unfinished, errored. A read of no seconds is no measurement.
    """
    seen = measured.filter(F.col("seconds") > 0).select("board", F.col("seconds").alias("_s"), F.col("jobs").alias("_j"), "unfinished", "errored")
    rows = previous.join(seen, "board", "full_outer")
    bound = F.greatest("_s", F.coalesce("seconds", "_s"))
    blended = F.when(F.col("seconds").isNull(), F.col("_s")).otherwise(weight * F.col("_s") + (1 - weight) * F.col("seconds"))
    seconds = F.when(F.col("_s").isNull(), F.col("seconds")).when(F.col("unfinished"), bound).otherwise(blended)
    jobs = F.when(F.col("_s").isNull() | F.col("unfinished") | F.col("errored"), F.col("jobs")).otherwise(F.col("_j"))
    return rows.select("board", seconds.alias("seconds"), jobs.alias("jobs"))


def expected_cost(boards: DataFrame, ledger: DataFrame, fallback: float = 5.0) -> DataFrame:
    """`(board, seconds, basis)`: the board's own measure, else its source's median, else the
    median of medians, else a constant. Medians are exact at any ledger size."""
    rows = ledger.withColumn("_source", F.split("board", ":").getItem(0))
    medians = exact_percentiles(rows, "seconds", (0.5,), ["_source"]).select("_source", F.col("value").alias("_median"))
    overall = exact_percentiles(medians, "_median", (0.5,)).select(F.col("value").alias("_overall"))
    own = ledger.select("board", F.col("seconds").alias("_own"))
    joined = boards.select("board").distinct().withColumn("_source", F.split("board", ":").getItem(0)).join(own, "board", "left").join(medians, "_source", "left")
    joined = joined.join(F.broadcast(overall), F.lit(True), "left")
    basis = F.when(F.col("_own").isNotNull(), "own").when(F.col("_median").isNotNull(), "source").when(F.col("_overall").isNotNull(), "overall").otherwise("constant")
    return joined.select("board", F.coalesce("_own", "_median", "_overall", F.lit(fallback)).alias("seconds"), basis.alias("basis"))


def strike_ledger(previous: DataFrame, gone: DataFrame, produced: DataFrame, now: str, quarantine_at: int = B.QUARANTINE_AT,
                  parole_days: int = B.PAROLE_DAYS) -> DataFrame:
    """`(board, strikes, reason, last_gone, quarantined, paroled, reconfirmed)`: any output clears
    a streak, a gone answer adds to it, otherwise it is unchanged. A quarantined board is paroled
    once its verdict is a week old or unreadable; a strike past quarantine re-confirms it."""
    alive = produced.select("board").distinct().withColumn("_alive", F.lit(True))
    struck = gone.groupBy("board").agg(F.min("reason").alias("_reason"))
    rows = previous.join(struck, "board", "full_outer").join(alive, "board", "left").filter(F.col("_alive").isNull())
    hit = F.col("_reason").isNotNull()
    rows = rows.select("board", F.when(hit, F.coalesce("strikes", F.lit(0)) + 1).otherwise(F.col("strikes")).alias("strikes"),
                       F.coalesce("_reason", "reason").alias("reason"), F.when(hit, F.lit(now)).otherwise(F.col("last_gone")).alias("last_gone"))
    age = F.datediff(F.lit(now).cast("date"), F.substring("last_gone", 1, 10).try_cast("date"))
    held = F.col("strikes") >= quarantine_at
    return rows.withColumn("quarantined", held).withColumn("paroled", held & (age.isNull() | (age >= parole_days))).withColumn(
        "reconfirmed", F.col("strikes") > quarantine_at
    )


def gap_counts(stored: DataFrame, held: DataFrame, scrapable: DataFrame, read: DataFrame, emitted: DataFrame,
               disabled: Sequence[str] = ()) -> DataFrame:
    """`(board, n)`: stored rows whose text is not held, leaving out disabled sources, boards off
    the list, and ids gone from a board read in full. `stored`: id, ats, board."""
    rows = stored.join(held.select("id").distinct(), "id", "left_anti")
    if disabled:
        rows = rows.filter(~F.col("ats").isin(*disabled))
    rows = rows.withColumn("_key", F.lower("board")).join(scrapable.select(F.lower("board").alias("_key")).distinct(), "_key", "left_semi")
    full = read.select(F.lower("board").alias("_key")).distinct().withColumn("_full", F.lit(True))
    seen = emitted.select("id").distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(full, "_key", "left").join(seen, "id", "left").filter(F.col("_full").isNull() | F.col("_seen").isNotNull())
    return rows.groupBy(F.col("_key").alias("board")).agg(F.count("*").alias("n"))


def gap_drain(prior: DataFrame, now: DataFrame) -> DataFrame:
    """`(was, left_gap, joined_gap, net)` between two counts of the gap."""
    rows = prior.select("board", F.col("n").alias("_a")).join(now.select("board", F.col("n").alias("_b")), "board", "full_outer")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return rows.agg(F.sum(a).alias("was"), F.sum(F.greatest(a - b, F.lit(0))).alias("left_gap"), F.sum(F.greatest(b - a, F.lit(0))).alias("joined_gap"), F.sum(b - a).alias("net"))


def dormant_boards(df: DataFrame, today: str, unread: DataFrame | None = None, partial_sources: Sequence[str] = ("jibe",), days: int = 730) -> DataFrame:
    """`(board, newest)`: boards whose newest posting is older than two years. Any undated row, or
    a source that lists in part, vetoes; boards read short are left out."""
    posted = F.col("posted_at")
    day = F.when(posted.rlike(r"^.{4}-.{2}-.{2}") & (F.substring(posted, 1, 10) >= "2000-01-01"), F.substring(posted, 1, 10))
    day = F.when(~F.split(F.lower("board"), ":").getItem(0).isin(*partial_sources), day)
    by_board = df.select(F.lower("board").alias("board"), day.alias("_d")).groupBy("board").agg(F.max("_d").alias("newest"), F.bool_or(F.col("_d").isNull()).alias("_undated"))
    cut = F.date_sub(F.lit(today).cast("date"), days).cast("string")
    out = by_board.filter(~F.col("_undated") & (F.col("newest") < cut)).drop("_undated")
    return out if unread is None else out.join(unread.select(F.lower("board").alias("board")).distinct(), "board", "left_anti")


def freshness(history: DataFrame, reads: DataFrame, live: DataFrame, index: DataFrame, corpus: DataFrame, now: str) -> DataFrame:
    """`(board, last_authoritative, excluded_since, consecutive, age_days, protected_rows,
    not_reseen_rows)` of boards still withheld.

    `history`: board, last_authoritative, excluded_since, consecutive. `reads`: board, authoritative.
    A board read in full starts afresh; one read short this run adds one to its streak.
    """
    key = lambda df: df.withColumn("board", F.lower("board"))
    outcome = key(reads).groupBy("board").agg(F.bool_and("authoritative").alias("_full"))
    rows = key(history).join(outcome, "board", "full_outer").join(key(live).select("board").distinct(), "board", "left_semi")
    full, short = F.coalesce("_full", F.lit(False)), F.coalesce(~F.col("_full"), F.lit(False))
    rows = rows.select(
        "board", F.when(full, F.lit(now)).otherwise(F.col("last_authoritative")).alias("last_authoritative"),
        F.when(full, F.lit(None)).when(short, F.coalesce("excluded_since", F.lit(now))).otherwise(F.col("excluded_since")).alias("excluded_since"),
        (F.when(full, 0).otherwise(F.coalesce("consecutive", F.lit(0))) + F.when(short, 1).otherwise(0)).alias("consecutive"), short.alias("_short"),
    ).filter(F.col("consecutive") > 0)
    seen = corpus.select("id").distinct().withColumn("_seen", F.lit(True))
    held = key(index).join(seen, "id", "left").groupBy("board").agg(F.count("*").alias("protected_rows"), F.count_if(F.col("_seen").isNull()).alias("_missing"))
    age = F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_authoritative").cast("timestamp"))) / 86400, 2)
    return rows.join(held, "board", "left").select(
        "board", "last_authoritative", "excluded_since", "consecutive", age.alias("age_days"), F.coalesce("protected_rows", F.lit(0)).alias("protected_rows"),
        F.when(F.col("_short"), F.coalesce("_missing", F.lit(0))).alias("not_reseen_rows"),
    )


def freshness_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.split("board", ":").getItem(0).alias("source")).agg(
        F.count("*").alias("excluded_boards"), F.sum("protected_rows").alias("protected_rows"), F.sum(F.coalesce("not_reseen_rows", F.lit(0))).alias("not_reseen_rows"),
        F.count_if(F.col("age_days").isNull()).alias("unknown_age_boards"), F.max("age_days").alias("oldest_days"),
    )


def shape_percentiles(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """p50, p90, p99 and the maximum of a measure, nearest rank, exact at any size."""
    cut = exact_percentiles(df, value, (0.5, 0.9, 0.99, 1.0), keys, nearest=True)
    names = ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (1.0, "max"))
    return cut.groupBy(*keys).agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 1).alias(n) for s, n in names])


def error_summary(errors: DataFrame) -> DataFrame:
    """`(type, source, n)` with each type's and the grand total. `errors`: board, message."""
    rows = errors.select(F.split("message", ":").getItem(0).alias("type"), F.split("board", ":").getItem(0).alias("source"))
    return rows.rollup("type", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def scrape_health(reads: DataFrame, degraded: float = 0.02, critical: float = 0.10) -> DataFrame:
    """`(source, boards, unusable, share, verdict)` with the run's total under null."""
    bad = F.col("outcome").isin("failed", "truncated")
    rows = reads.rollup(F.split("board", ":").getItem(0).alias("source")).agg(F.count("*").alias("boards"), F.count_if(bad).alias("unusable"))
    share = F.round(F.col("unusable") / F.col("boards"), 6)
    return rows.withColumn("share", share).withColumn(
        "verdict", F.when(F.col("share") >= critical, "critical").when(F.col("share") >= degraded, "degraded").otherwise("healthy")
    )


def value_gate(costs: DataFrame, scores: DataFrame, today: str, floor: float = 2.0, time_floor: float = 600.0, zero_floor: float = 120.0,
               recheck_days: int = 14, trust_zero: bool = True) -> DataFrame:
    """`(board, per_minute)`: boards whose own unexpired measurement buys too little. A measured
    zero overrides a carried score, above a lower time floor. `costs`: board, seconds, jobs, updated_at."""
    nothing = (F.col("jobs") == 0) if trust_zero else F.lit(False)
    nothing = F.coalesce(nothing, F.lit(False))
    age = F.datediff(F.lit(today).cast("date"), F.substring("updated_at", 1, 10).try_cast("date"))
    rows = costs.join(scores.select("board", "score"), "board", "left")
    rows = rows.filter((F.col("seconds") > F.when(nothing, zero_floor).otherwise(time_floor)) & (age < recheck_days))
    rate = F.when(nothing, F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0)) / (F.col("seconds") / 60))
    return rows.withColumn("per_minute", rate).filter(F.col("per_minute") < floor).select("board", "per_minute", "seconds")


def gate_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """`(change, boards, minutes)`: newly dropped and released boards of a changed gate."""
    rows = before.select("board", F.col("seconds").alias("_a")).join(after.select("board", F.col("seconds").alias("_b")), "board", "full_outer")
    change = F.when(F.col("_a").isNull(), "newly_dropped").when(F.col("_b").isNull(), "released").otherwise("still_dropped")
    return rows.groupBy(change.alias("change")).agg(F.count("*").alias("boards"), F.round(F.sum(F.coalesce("_b", "_a")) / 60, 4).alias("minutes"))


# --- reports ---------------------------------------------------------------------------------


def domain_filter_report(df: DataFrame, dormant: DataFrame | None = None) -> DataFrame:
    """`(source, total, kept, dormant_skipped, empty)`: a source with rows and none kept is marked."""
    rows = df
    if dormant is not None:
        rows = rows.join(dormant.select(F.lower("board").alias("_key")).distinct().withColumn("_dormant", F.lit(True)), F.lower(df["board"]) == F.col("_key"), "left")
    else:
        rows = rows.withColumn("_dormant", F.lit(None).cast("boolean"))
    asleep = F.coalesce("_dormant", F.lit(False))
    return rows.groupBy(F.col("ats").alias("source")).agg(
        F.count("*").alias("total"), F.count_if(F.col("is_tech") & ~asleep).alias("kept"), F.count_if(F.col("is_tech") & asleep).alias("dormant_skipped")
    ).withColumn("empty", F.col("kept") == 0)


def extraction_coverage(df: DataFrame, source_column: str = "experience_source") -> DataFrame:
    """`(source, rows, field, regex, seniority, none, coverage)` per source and in total (null)."""
    tier = F.col(source_column)
    rows = df.rollup(F.col("ats").alias("source")).agg(
        F.count("*").alias("rows"), F.count_if(tier == "field").alias("field"), F.count_if(tier == "regex").alias("regex"),
        F.count_if(tier == "seniority").alias("seniority"), F.count_if(tier.isNull()).alias("none"),
    )
    return rows.withColumn("coverage", F.round(100 * (F.col("rows") - F.col("none")) / F.col("rows"), 4))


def sample_misses(df: DataFrame, source: str, n: int, seed: int = 7, source_column: str = "experience_source", min_chars: int = 400) -> DataFrame:
    """A seeded sample of one source's described rows without an answer."""
    misses = df.filter((F.col("ats") == source) & F.col(source_column).isNull() & (F.length("description") >= min_chars))
    return misses.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), "id").limit(n)


def location_class(location: Column, country_only: Sequence[str] = ()) -> Column:
    """missing, dirty, placeless, country-only or place."""
    raw = F.coalesce(location, F.lit(""))
    trimmed = F.lower(F.trim(raw))
    dirty = raw.rlike(r"[\x00-\x1f]") | raw.rlike(r"(^\s*,)|(,\s*,)|(,\s*$)") | raw.contains("://") | (raw != F.trim(raw))
    return (
        F.when(F.trim(raw) == "", "missing").when(dirty, "dirty").when(trimmed.rlike(r"^(remote|hybrid|anywhere|worldwide|multiple locations|various|flexible)$"), "placeless")
        .when(trimmed.isin(*country_only) | raw.rlike(r"^[A-Z]{2}$"), "country-only").otherwise("place")
    )


def location_health(df: DataFrame, country_only: Sequence[str]) -> DataFrame:
    """Rows per source and location class, one column a class."""
    shape = location_class(F.col("location"), country_only)
    return df.select(F.col("ats").alias("source"), shape.alias("_shape")).groupBy("source").agg(
        *[F.count_if(F.col("_shape") == s).alias(s.replace("-", "_")) for s in ("missing", "dirty", "placeless", "country-only", "place")]
    )


def gazetteer_audit(df: DataFrame) -> DataFrame:
    """`(countries, locations, rows)`: how many locations and rows name none, one or several countries."""
    kind = F.when(F.size("countries") == 0, "none").when(F.size("countries") == 1, "one").otherwise("several")
    per_place = df.filter(F.col("location").isNotNull()).groupBy("location").agg(F.count("*").alias("_n"), F.first("countries").alias("countries"))
    return per_place.groupBy(kind.alias("countries")).agg(F.count("*").alias("locations"), F.sum("_n").alias("rows"))


def yield_by_source(df: DataFrame, region: str = "IN") -> DataFrame:
    """Rows, in-domain and regional rows and their shares by source, most in-domain rows first."""
    there = F.array_contains("countries", region)
    rows = df.groupBy(F.col("ats").alias("source")).agg(
        F.count("*").alias("rows"), F.count_if("is_tech").alias("tech"), F.count_if(there).alias("region"), F.count_if(F.col("is_tech") & there).alias("tech_and_region")
    )
    pct = lambda c: F.round(100 * F.col(c) / F.col("rows"), 4)
    return rows.withColumn("tech_pct", pct("tech")).withColumn("region_pct", pct("region")).orderBy(F.desc("tech"), "source")


def flap_audit(events: DataFrame) -> DataFrame:
    """`(run, out, readded_next, readded_later, adds, known_adds)` per run.

    `events`: run (0, 1, ...), id, kind ("add" or an eviction label). Of the ids a run took out,
    those added again by the next run or any later one; of its adds, those already known.
    """
    # One row per id and run, then windows over one id's own runs.
    per = events.groupBy("id", "run").agg(F.bool_or(F.col("kind") == "add").alias("_add"), F.bool_or(F.col("kind") != "add").alias("_out"))
    mine = Window.partitionBy("id").orderBy("run")
    later = mine.rowsBetween(1, Window.unboundedFollowing)
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    # The next run's row may belong to a later run, so both its number and its kind are needed.
    next_run = F.when(F.lead("run").over(mine) == F.col("run") + 1, F.lead("_add").over(mine))
    rows = per.withColumn("_next", F.coalesce(next_run, F.lit(False))).withColumn("_later", F.coalesce(F.bool_or("_add").over(later), F.lit(False)))
    rows = rows.withColumn("_known", F.count("*").over(before) > 0)
    return rows.groupBy("run").agg(
        F.count_if("_out").alias("out"), F.count_if(F.col("_out") & F.col("_next")).alias("readded_next"), F.count_if(F.col("_out") & F.col("_later")).alias("readded_later"),
        F.count_if("_add").alias("adds"), F.count_if(F.col("_add") & F.col("_known")).alias("known_adds"),
    )


def flaps_by(events: DataFrame, key: str) -> DataFrame:
    """Ids taken out and added again in the window, counted by eviction label or board."""
    out = events.filter(F.col("kind") != "add").select("id", "run", "kind", "board")
    back = events.filter(F.col("kind") == "add").groupBy("id").agg(F.max("run").alias("_back"))
    flapped = out.join(back, "id").filter(F.col("_back") > F.col("run"))
    last = flapped.groupBy("id").agg(F.max(F.struct("run", "kind", "board")).alias("_l"))
    return last.groupBy(F.col(f"_l.{key}").alias(key)).agg(F.count("*").alias("n"))


def exclusion_streaks(reads: DataFrame) -> DataFrame:
    """`(board, first_run, last_run, runs)`: maximal runs of consecutive exclusions. `reads`: run
    (consecutive whole numbers), board, excluded. A streak's rows share `run - row number`."""
    out = reads.filter("excluded").select(F.lower("board").alias("board"), "run").distinct()
    island = F.col("run") - F.row_number().over(Window.partitionBy("board").orderBy("run"))  # one board's runs
    return out.withColumn("_i", island).groupBy("board", "_i").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.count("*").alias("runs")).drop("_i")


def holdout_estimate(sample: DataFrame, population: Mapping[str, int]) -> DataFrame:
    """Row-weighted recall and precision of a filter over a stratified sample, and the Wilson
    interval of the unweighted recall. `sample`: stratum, rows, label (tech, not_tech, ambiguous), kept."""
    sizes = sample.groupBy("stratum").agg(F.sum("rows").alias("_n"))
    total = F.create_map(*[x for k, v in population.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = sample.join(sizes, "stratum").withColumn("_w", F.col("rows") * F.try_element_at(total, F.col("stratum")) / F.col("_n"))
    clear = rows.filter(F.col("label") != "ambiguous")
    tech = F.col("label") == "tech"
    sums = clear.agg(
        F.sum(F.when(tech, F.col("_w")).otherwise(0.0)).alias("_tech"), F.sum(F.when(tech & F.col("kept"), F.col("_w")).otherwise(0.0)).alias("_tp"),
        F.sum(F.when(F.col("kept"), F.col("_w")).otherwise(0.0)).alias("_kept"), F.count_if(tech).alias("n"), F.count_if(tech & F.col("kept")).alias("k"),
    )
    z, p = 1.96, F.col("k") / F.col("n")
    centre = (p + z * z / (2 * F.col("n"))) / (1 + z * z / F.col("n"))
    half = z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n"))) / (1 + z * z / F.col("n"))
    return sums.select(F.round(F.col("_tp") / F.col("_tech"), 6).alias("recall"), F.round(F.col("_tp") / F.col("_kept"), 6).alias("precision"),
                       "k", "n", F.round(centre - half, 6).alias("low"), F.round(centre + half, 6).alias("high"))


def holdout_draw(df: DataFrame, size: Mapping[str, int], seed: int = 0) -> DataFrame:
    """A seeded sample of rows per stratum."""
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), F.asc("id")]
    wanted = F.create_map(*[x for k, v in size.items() for x in (F.lit(k), F.lit(int(v)))])
    drawn = top_per_group(df.filter(F.col("stratum").isin(*size)), ["stratum"], order, max(size.values()), "_r")
    return drawn.filter(F.col("_r") <= F.try_element_at(wanted, F.col("stratum"))).drop("_r")


def vote_names(df: DataFrame, share: float = 0.0) -> DataFrame:
    """`(board, name, votes, stating)`: the name most of a board's rows state, the lowest among
    equals, if at least `share` of the stating rows do."""
    counts = df.withColumn("_n", F.nullif(F.trim("company"), F.lit(""))).filter(F.col("_n").isNotNull()).groupBy("board", "_n").agg(F.count("*").alias("_c"))
    best = counts.groupBy("board").agg(F.min(F.struct((-F.col("_c")).alias("neg"), F.col("_n").alias("name"))).alias("_b"), F.sum("_c").alias("stating"))
    return best.filter(-F.col("_b.neg") >= F.col("stating") * share).select("board", F.col("_b.name").alias("name"), (-F.col("_b.neg")).alias("votes"), "stating")


def verify_filters(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """`(filter, kept, violations, missed)`: rows a compiled filter keeps, re-checked by an
    independent predicate, and rows the predicate keeps but the filter loses; all in one pass."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    aggs = []
    for name, (compiled, independent) in checks.items():
        a, b = sure(compiled), sure(independent)
        aggs += [F.count_if(a).alias(f"{name}__k"), F.count_if(a & ~b).alias(f"{name}__v"), F.count_if(b & ~a).alias(f"{name}__m")]
    rows = [F.struct(F.lit(n).alias("filter"), F.col(f"{n}__k").alias("kept"), F.col(f"{n}__v").alias("violations"), F.col(f"{n}__m").alias("missed")) for n in checks]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
