"""Approximate nearest neighbours by inner product: inverted lists whose vectors are read a few rotated dimensions at a time.

Equal vectors are one entry that carries its smallest ids. Entries are turned to unit length and rotated by seeded random
signs and Hadamard transforms, so that any few dimensions tell about the whole; they lie in lists around k-means centres of
a bounded sample, each list cut into pieces of a bounded size, each piece stored in blocks of columns. A query first reads
its nearest list, which gives it a score to beat, then its further lists in widening rounds that each raise that score:
after each block of columns the distance so far, scaled up to all dimensions, is tested against what the score to beat
allows, and candidates that fail are abandoned. Survivors are scored exactly on the original vectors. How many lists a
query reads is set so that a bounded set of the queries, answered by brute force over all entries, finds the share of
neighbours asked for.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LAST_ID = (1 << 63) - 1
_PAIRS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class ScanParams:
    """`sample_rows` bounds the rows that centres are fitted on, `trial_queries` the queries answered by brute force;
    `recall` is the share of neighbours whose lists must be read. A list has about `list_rows` entries while there are no
    more than `max_lists` lists of one vector length. A query's lists are read in rounds that each end at `widening` times
    as many lists; `slack` is the test's number of standard deviations."""

    sample_rows: int = 20_000
    trial_queries: int = 128
    recall: float = 0.96
    list_rows: int = 256
    max_lists: int = 2048
    widening: int = 4
    piece_rows: int = 2048
    block_queries: int = 256
    columns: int = 16
    slack: float = 2.1
    rounds: int = 8
    seed: int = 7


def rotate(units: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors, filled up with zeros to a power of two, under two rounds of random signs and a Hadamard transform."""
    n, dim = units.shape
    size = 1 << max(0, dim - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :dim] = units
    for turn in range(2):
        out *= np.random.default_rng((seed, turn, size)).choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pairs = out.reshape(n, -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
        out /= np.sqrt(size)
    return out


def norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow on the way."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(np.square(vectors / top[:, None]).sum(axis=1))


def fit_centres(units: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """K-means of unit vectors by inner product; a centre that nobody chooses stays where it was."""
    rng = np.random.default_rng(seed)
    centres = units[rng.permutation(len(units))[:lists]].copy()
    for _ in range(rounds):
        chosen = nearest_list(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, chosen, units)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def nearest_list(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(units[at:at + 1024] @ centres.T).argmax(axis=1) for at in range(0, len(units), 1024)] or [np.zeros(0, np.int64)])


def list_order(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All lists of each vector, nearest first."""
    return np.argsort(-(units @ centres.T), axis=1, kind="stable")


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components in double precision."""
    out = np.zeros(len(left))
    for column in range(left.shape[1]):
        out += left[:, column] * right[:, column]
    return out


def scan_piece(piece: dict, queries: np.ndarray, floors: np.ndarray, k: int, params: ScanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, entry and exact score of all pairs that may be among a query's `k` best, and how many column values were read.

    `floors` holds the score each query already has a k-th best of (-inf: none yet).
    """
    entries, sizes = piece["vectors"], piece["norms"]
    lengths = norms(queries)
    turned = rotate(queries / lengths[:, None], params.seed).astype(np.float32)
    floors, read, dims = floors.copy(), 0, turned.shape[1]
    kept_q, kept_c, kept_s = [], [], []
    per_turn = max(1, _PAIRS_AT_ONCE * 4 // max(1, len(queries)))
    for start in range(0, len(entries), per_turn):
        stop = min(len(entries), start + per_turn)
        # |q - x|^2 = 2 - 2 q x for unit vectors: what the distance may be if the pair is to reach the floor.
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            allowed = 2 - 2 * (floors[:, None] / lengths[:, None]) / sizes[None, start:stop]
        allowed = np.where(np.isnan(allowed), np.inf, allowed) + 1e-4
        q, c = np.nonzero(allowed > 0)
        so_far = None
        for block, first in zip(piece["blocks"], range(0, dims, params.columns)):
            part, mine = block[start:stop], turned[:, first:first + params.columns]
            last = first + part.shape[1]
            read += len(q) * part.shape[1]
            if so_far is None:
                added = np.square(mine).sum(axis=1)[:, None] + np.square(part).sum(axis=1)[None, :] - 2 * (mine @ part.T)
                so_far = added[q, c]
            else:
                for at in range(0, len(q), _PAIRS_AT_ONCE):
                    pick = slice(at, at + _PAIRS_AT_ONCE)
                    so_far[pick] += np.square(mine[q[pick]] - part[c[pick]]).sum(axis=1)
            bound = allowed[q, c]
            if last < dims:
                bound = bound * (1 + params.slack / np.sqrt(last)) ** 2 * last / dims
            alive = so_far <= bound
            q, c, so_far = q[alive], c[alive], so_far[alive]
        scores = np.concatenate([exact_scores(queries[q[at:at + _PAIRS_AT_ONCE]], entries[start + c[at:at + _PAIRS_AT_ONCE]]) for at in range(0, len(q), _PAIRS_AT_ONCE)] or [np.zeros(0)])
        good = scores >= floors[q]
        kept_q.append(q[good])
        kept_c.append(start + c[good])
        kept_s.append(scores[good])
        q, c, s, floors = _best(np.concatenate(kept_q), np.concatenate(kept_c), np.concatenate(kept_s), floors, k)
        kept_q, kept_c, kept_s = [q], [c], [s]
    return *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept_q, kept_c, kept_s)), read


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, floors: np.ndarray, k: int):
    """The pairs that reach their query's k-th best score, ties included, and the floors raised to it."""
    order = np.lexsort((-s, q))
    q, c, s = q[order], c[order], s[order]
    starts = np.searchsorted(q, np.arange(len(floors)))
    ends = np.searchsorted(q, np.arange(len(floors)), side="right")
    full = np.flatnonzero(ends - starts >= k)
    floors[full] = np.maximum(floors[full], s[starts[full] + k - 1])
    keep = s >= floors[q]
    return q[keep], c[keep], s[keep], floors


def _compact(vectors: np.ndarray) -> np.ndarray:
    """Single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    return short if np.array_equal(short.astype(np.float64), vectors) else vectors


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _assign(centres: dict[int, np.ndarray], probes: int):
    """Adds each vector's lists, nearest first: one, or `probes` of them."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at:at + 2048]
                for dim, rows in part.groupby("dim"):
                    vectors = _matrix(rows["v"])
                    vectors /= norms(vectors)[:, None]
                    known = centres.get(int(dim))
                    if known is None:
                        lists = np.zeros((len(rows), 1), np.int32)
                    elif probes == 1:
                        lists = nearest_list(vectors, known)[:, None]
                    else:
                        lists = list_order(vectors, known)[:, :probes]
                    yield rows.assign(lists=list(lists.astype(np.int32)))

    return assign


def _pack_piece(params: ScanParams):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(group["v"])
        sizes = norms(vectors)
        turned = rotate(vectors / sizes[:, None], params.seed).astype(np.float32)
        blocks = [np.ascontiguousarray(turned[:, at:at + params.columns]) for at in range(0, turned.shape[1], params.columns)]
        body = pickle.dumps({"entry": group["entry"].to_numpy(np.int64), "vectors": _compact(vectors), "norms": sizes, "blocks": blocks}, protocol=5)
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "list": group["list"].iloc[:1], "body": [body]})

    return pack


def _pack_queries(group: pd.DataFrame) -> pd.DataFrame:
    body = pickle.dumps((group["entry"].to_numpy(np.int64), _compact(_matrix(group["v"])), group["floor"].to_numpy(np.float64)), protocol=5)
    return pd.DataFrame({"dim": group["dim"].iloc[:1], "list": group["list"].iloc[:1], "queries": [body]})


def _search(k: int, params: ScanParams):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body, queries in zip(batch["body"], batch["queries"]):
                piece, (asking, vectors, floors) = pickle.loads(body), pickle.loads(queries)
                piece["vectors"] = piece["vectors"].astype(np.float64)
                q, c, score, _ = scan_piece(piece, vectors.astype(np.float64), floors, k, params)
                yield pd.DataFrame({"q": asking[q], "c": piece["entry"][c], "score": score.astype(np.float64)})

    return search


def _brute_force(trial: dict[int, tuple[np.ndarray, np.ndarray]], centres: dict[int, np.ndarray], k: int):
    """The best entries of each batch for the trial queries, with the place of the entry's list in the query's order."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = {dim: np.argsort(list_order(q / norms(q)[:, None], centres[dim]), axis=1) for dim, (_, q) in trial.items() if dim in centres}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                for dim, rows in batch.iloc[at:at + 4096].groupby("dim"):
                    if int(dim) not in order:
                        continue
                    ids, queries = trial[int(dim)]
                    scores = queries @ _matrix(rows["v"]).T
                    best = np.argsort(-scores, axis=1)[:, :k]
                    lists = rows["list"].to_numpy()[best]
                    places = np.take_along_axis(order[int(dim)], lists, axis=1)
                    yield pd.DataFrame({"q": np.repeat(ids, best.shape[1]), "score": np.take_along_axis(scores, best, axis=1).ravel(), "place": places.ravel()})

    return answer


def _few(entries: DataFrame, rows: int, of: int) -> DataFrame:
    """About `rows` of the entries, by a hash of their number."""
    return entries if of <= rows else entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 40)) < int((1 << 40) * rows / of))


def fit_lists(entries: DataFrame, total: int, params: ScanParams) -> dict[int, np.ndarray]:
    """Centres for every vector length in a sample of about `sample_rows` entries; other lengths have one list each."""
    sample = _few(entries.select("entry", "dim", "v"), params.sample_rows, total).toPandas()
    centres = {}
    for dim, rows in sample.groupby("dim"):
        units = _matrix(rows["v"])
        units /= norms(units)[:, None]
        expected = total * len(rows) / len(sample)
        lists = int(min(len(units), params.max_lists, max(1, expected // params.list_rows)))
        centres[int(dim)] = fit_centres(units, lists, params.rounds, params.seed)
    return centres


def lists_to_read(entries: DataFrame, asking: int, centres: dict[int, np.ndarray], k: int, params: ScanParams) -> int:
    """The fewest lists that hold `recall` of the true neighbours of the trial queries (entries that ask, by hash)."""
    chosen = _few(entries.where("asks").select("entry", "dim", "v"), params.trial_queries, asking).toPandas()
    trial = {int(dim): (rows["entry"].to_numpy(np.int64), _matrix(rows["v"])) for dim, rows in chosen.groupby("dim")}
    if not trial:
        return 1
    found = entries.select("dim", "list", "v").mapInPandas(_brute_force(trial, centres, k), "q long, score double, place int")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "place")
    places = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("place").count().orderBy("place").collect()
    total, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= params.recall * total:
            return r["place"] + 1
    return 1


def _probe(asks: DataFrame, pieces: DataFrame, k: int, params: ScanParams) -> DataFrame:
    """What queries (`entry`, `dim`, `v`, `floor`, `lists`) find in the pieces of their lists."""
    waiting = cut_lineage(asks.where(F.size("lists") > 0))
    each = waiting.select("entry", "dim", F.explode("lists").alias("list"))
    sizes = each.groupBy("dim", "list").agg(F.ceil(F.count("*") / params.block_queries).cast("int").alias("parts"))
    blocks = waiting.withColumn("list", F.explode("lists")).join(sizes, ["dim", "list"]).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("parts")))
    packed = blocks.select("dim", "list", "block", "entry", "v", "floor").groupBy("dim", "list", "block").applyInPandas(_pack_queries, "dim int, list int, queries binary")
    return cut_lineage(packed.join(pieces, ["dim", "list"]).select("body", "queries").mapInPandas(_search(k, params), "q long, c long, score double"))


def approximate_neighbours(vectors: DataFrame, is_query, k: int = 20, vector: str = "embedding", params: ScanParams = ScanParams()) -> DataFrame:
    """For every row of `vectors` (`vec_id`, `vector`) for which `is_query` holds the `k` rows found nearest by inner product:
    `query_id`, `rank` from 1, `vec_id`, `score` (double precision, of the original vectors, added up in component order).

    Ties go to the smaller `vec_id` (null last, then in no stated order). Rows that repeat an id are rows of their own; only
    a query's own row is left out. Vectors that are null, empty, all zero or hold a null or non-finite component take no part,
    as query or candidate; vectors of different lengths are never compared. Fewer candidates than `k` give fewer rows; an
    empty table gives none. Further columns are not read. The driver holds the sample, the centres and the trial queries,
    each bounded by a parameter; every other row stays in tasks.
    """
    value = F.col(vector)
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    usable = value.isNotNull() & F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))) & F.exists(value, lambda x: x != 0)
    rows = cut_lineage(vectors.where(usable).select(
        F.col("vec_id").alias("own_id"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST_ID)).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        (value if single else F.transform(value, lambda x: x.cast("double"))).alias("v"), F.monotonically_increasing_id().alias("row"),
    ))
    # One entry for equal vectors: of its rows only the k + 1 with the smallest ids can be among anybody's k nearest.
    first = Window.partitionBy("v").orderBy("id", "row")
    members = rows.select("v", "id", "row").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    members = members.groupBy("v").agg(F.collect_list(F.struct("id", "row")).alias("members"))
    asked = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    entries = cut_lineage(members.join(asked, "v").select(F.monotonically_increasing_id().alias("entry"), F.size("v").alias("dim"), "v", "members", "asks"))
    counts = entries.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    centres = fit_lists(entries, counts["n"], params)
    shape = f"entry long, dim int, v array<{'float' if single else 'double'}>, asks boolean, lists array<int>"
    listed = entries.select("entry", "dim", "v", "asks").mapInPandas(_assign(centres, 1), shape)
    listed = cut_lineage(listed.select("entry", "dim", "v", "asks", F.col("lists")[0].alias("list")))
    reads = lists_to_read(listed, counts["q"], centres, k + 1, params)

    sizes = listed.groupBy("dim", "list").agg(F.ceil(F.count("*") / params.piece_rows).cast("int").alias("parts"))
    cut = listed.join(sizes, ["dim", "list"]).withColumn("piece", F.pmod(F.xxhash64("entry"), F.col("parts")))
    pieces = cut_lineage(cut.select("dim", "list", "piece", "entry", "v").groupBy("dim", "list", "piece").applyInPandas(_pack_piece(params), "dim int, list int, body binary"))
    asking = cut_lineage(listed.where("asks").select("entry", "dim", "v", "asks").mapInPandas(_assign(centres, reads), shape))
    near, done, upto = None, 0, 1
    while done < reads:
        asks = asking.withColumn("lists", F.slice("lists", done + 1, upto - done))
        if near is None:
            asks = asks.withColumn("floor", F.lit(float("-inf")))
        else:
            reached = near.where(F.col("place") == k + 1).select(F.col("q").alias("entry"), F.col("score").alias("floor"))
            asks = asks.join(reached, "entry", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = _probe(asks, pieces, k + 1, params)
        found = found if near is None else found.unionAll(near.select("q", "c", "score"))
        ranked = found.withColumn("rank", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") <= k + 1)
        near = cut_lineage(ranked.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).drop("rank"))
        done, upto = upto, min(reads, upto * params.widening)
    near = near.drop("place")
    ids = near.join(entries.select(F.col("entry").alias("c"), F.explode("members").alias("m")), "c").select("q", "score", "m.id", "m.row")
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "row"))).where(F.col("r") <= k + 1).drop("r")
    answers = ids.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "row"))).alias("found"))
    answers = answers.join(entries.select(F.col("entry").alias("q"), "v"), "q").select("v", "found")
    mine = rows.where("asks").select(F.col("row").alias("q_row"), F.col("own_id").cast("long").alias("query_id"), "v").join(answers, "v")
    left = mine.select("query_id", F.slice(F.filter("found", lambda f: f["row"] != F.col("q_row")), 1, k).alias("found"))
    out = left.select("query_id", F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(F.col("f.id") != _LAST_ID, F.col("f.id")).alias("vec_id"), (-F.col("f.s")).alias("score"))


def recall_of(found: DataFrame, vectors: DataFrame, is_query, k: int = 20, vector: str = "embedding") -> float:
    """The share of true neighbours that `found` holds, by brute force over the blocks of `vectors`: for tests and reports
    on tables whose ids are unique and whose queries the driver can hold."""
    asking = vectors.where(is_query).select("vec_id", vector).toPandas()
    queries, own = _matrix(asking[vector]), asking["vec_id"].to_numpy(np.int64)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = queries @ _matrix(batch[vector]).T
            ids = batch["vec_id"].to_numpy(np.int64)
            scores[own[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1)[:, :k]
            yield pd.DataFrame({"query_id": np.repeat(own, top.shape[1]), "vec_id": ids[top].ravel(), "s": np.take_along_axis(scores, top, axis=1).ravel()})

    every = vectors.where(F.col(vector).isNotNull()).select("vec_id", vector).mapInPandas(best, "query_id long, vec_id long, s double")
    place = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    true = every.where(F.col("s") > float("-inf")).withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).select("query_id", "vec_id")
    return true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / max(1, true.count())
