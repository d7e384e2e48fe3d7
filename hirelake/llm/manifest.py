"""A Merkle manifest of a dataset: a digest for every row, one root for all, and for each row a witness that leads to the root.

Every source is a log of its rows' digests in the order of their ids, and the subroots of the sources are a log as well. A
log is a tree in which three neighbours make a parent. It is cut at multiples of 3^`height` nodes, so each block is a whole
subtree (the last one of a log: its ragged edge) that one task builds as a stream: nodes are appended one after the other,
only the open subtrees are kept, and each row's witness is extended whenever a sibling of its subtree is complete. The roots
of the blocks are then appended to the next tier in the same way, until one is left; a row's witness goes on with that of
its block. No task sees more than one block, and a tier has 3^`height` times fewer nodes than the one before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import group_row_number
from ..session import cut_lineage

_FAN = 3
_STEPS = "array<struct<left:binary,right:binary>>"


@dataclass(frozen=True)
class ManifestParams:
    """Levels of the tree that one task builds; a block has 3^`height` nodes."""

    height: int = 7


def row_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 over the fields in turn: `-` for null, else the count of UTF-8 bytes, a colon and the value as text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _join(*digests: bytes) -> bytes:
    """SHA-256 over digests written as lower-case hex."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class OpenSubtrees:
    """The growing edge of a log: per level up to two complete subtrees (digest, first leaf, end) that wait for siblings."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.witnesses: list[list[tuple[bytes, bytes]]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._place(0, (digest, at, at + 1))

    def _place(self, level: int, node: tuple[bytes, int, int]) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == _FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Makes a parent of a level's open nodes and tells each leaf below them its new siblings."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for place, (_, start, end) in enumerate(run):
            step = (b"".join(digests[:place]), b"".join(digests[place + 1:]))
            for leaf in range(start, end):
                self.witnesses[leaf].append(step)
        if level + 1 == len(self.open):
            self.open.append([])
        self._place(level + 1, (_join(*digests), run[0][1], run[-1][2]))

    def close(self, height: int | None) -> bytes:
        """Completes the ragged edge up to one node of `height` levels, or up to one node at all; returns its digest."""
        level = 0
        while True:
            last = level + 1 >= len(self.open) or not any(self.open[level + 1:])
            if height is None and last and len(self.open[level]) == 1 or level == height:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def _block_of(height: int):
    """The witnesses of one block's nodes up to the block's root, and that root."""

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        edge = OpenSubtrees()
        for digest in group["digest"].to_pylist():
            edge.append(digest)
        alone = group["total"][0].as_py() <= _FAN ** height
        root = edge.close(None if alone else height)
        flat = [step for steps in edge.witnesses for step in steps]
        ends = [0]
        for steps in edge.witnesses:
            ends.append(ends[-1] + len(steps))
        pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.binary()), pa.array([s[1] for s in flat], pa.binary())], ["left", "right"])
        steps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        columns = [group["log"], group["idx"], group["block"], group["total"], steps, pa.array([root] * group.num_rows, pa.binary())]
        return pa.table(columns, names=["log", "idx", "block", "total", "steps", "root"])

    return block


def append_logs(nodes: DataFrame, height: int) -> DataFrame:
    """`nodes` holds logs: `log` (may be null), `idx` from 0 without gaps, `total` nodes of the log, `digest` (binary).

    Returns `log`, `idx`, `steps` (all siblings up to the log's root, level by level, those left and right of the path) and
    `root`, the log's.
    """
    width = _FAN ** height
    tiers, most = [], nodes.agg(F.max("total")).first()[0] or 0
    while True:
        blocked = nodes.withColumn("block", F.floor(F.col("idx") / width).cast("long")).select("log", "idx", "total", "digest", "block")
        tier = cut_lineage(blocked.groupBy("log", "block").applyInArrow(_block_of(height), f"log {nodes.schema['log'].dataType.simpleString()}, idx long, block long, total long, steps {_STEPS}, root binary"))
        tiers.append(tier)
        if most <= width:
            break
        most = -(-most // width)
        heads = tier.where(F.col("idx") % width == 0)
        nodes = heads.select("log", F.col("block").alias("idx"), F.ceil(F.col("total") / width).cast("long").alias("total"), F.col("root").alias("digest"))
    out = tiers.pop().select("log", "idx", "steps", "root")
    for tier in reversed(tiers):
        above = out.select(F.col("log").alias("_log"), F.col("idx").alias("_block"), F.col("steps").alias("_steps"), F.col("root").alias("_root"))
        met = tier.join(above, F.col("log").eqNullSafe(F.col("_log")) & (F.col("block") == F.col("_block")))
        out = met.select("log", "idx", F.concat("steps", "_steps").alias("steps"), F.col("_root").alias("root"))
    return out


def _numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds `idx` within `log` and `total`, for logs of any size."""
    placed = cut_lineage(group_row_number(rows, ["log"], order, "idx").withColumn("idx", F.col("idx").cast("long") - 1))
    sizes = placed.groupBy(F.col("log").alias("_log")).agg(F.count("*").alias("total"))
    return placed.join(sizes, F.col("log").eqNullSafe(F.col("_log"))).drop("_log")


def build_manifest(leaves: DataFrame, carried: Sequence[str] = (), params: ManifestParams = ManifestParams()) -> DataFrame:
    """The manifest of `leaves` (`source`, `doc_id`, `leaf`: hex digest): one row each with `doc_id`, `source`, `leaf`, the
    columns named in `carried`, `subroot`, `root` (hex) and `witness`, an array of (left, right): the hex digests of the
    siblings before and after the path at each level, from the leaf over its source's root to the root of all.

    Within a source leaves ascend by id (null first, then by digest: rows that repeat an id each have a place, and equal rows
    may change places without changing a root); sources ascend by their UTF-8 bytes, null first. A log of one node has that
    node as its root. An empty table gives no rows. Text never leaves the scan that digests it.
    """
    rows = leaves.select(F.col("source").alias("log"), "doc_id", F.unhex("leaf").alias("digest"), F.struct(*carried).alias("carried") if carried else F.lit(None).alias("carried"))
    placed = cut_lineage(_numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest")]))
    logs = append_logs(placed.select("log", "idx", "total", "digest"), params.height)
    logs = cut_lineage(logs)
    subroots = logs.where(F.col("idx") == 0).select(F.lit(0).alias("log"), F.col("log").alias("source"), F.col("root").alias("digest"))
    tops = cut_lineage(_numbered(subroots, [F.col("source").asc_nulls_first()]))
    whole = append_logs(tops.select("log", "idx", "total", "digest"), params.height)
    top = tops.join(whole.select("idx", "steps", "root"), "idx").select(F.col("source").alias("_log"), F.col("steps").alias("_steps"), F.col("root").alias("_root"))
    named = logs.select(F.col("log").alias("_l"), F.col("idx").alias("_i"), "steps", F.col("root").alias("subroot"))
    met = placed.join(named, F.col("log").eqNullSafe(F.col("_l")) & (F.col("idx") == F.col("_i"))).join(top, F.col("log").eqNullSafe(F.col("_log")))
    text = lambda c: F.lower(F.hex(c))
    witness = F.transform(F.concat("steps", "_steps"), lambda s: F.struct(text(s["left"]).alias("left"), text(s["right"]).alias("right")))
    return met.select("doc_id", F.col("log").alias("source"), text(F.col("digest")).alias("leaf"), *[F.col("carried")[c].alias(c) for c in carried],
                      text(F.col("subroot")).alias("subroot"), text(F.col("_root")).alias("root"), witness.alias("witness"))


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf's digest and a witness lead to."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def proof_digest(witness: Column) -> Column:
    """SHA-256 over a witness's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def verify_rows(docs: DataFrame, manifest: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of `manifest` whose digest no row of `docs` with the same id has any more (`fields`: what was digested)."""
    now = docs.select(F.col("doc_id").alias("_id"), row_digest([F.col(f) for f in fields]).alias("_leaf")).distinct()
    return manifest.join(now, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("leaf") == F.col("_leaf")), "left_anti")
