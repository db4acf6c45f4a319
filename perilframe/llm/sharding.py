"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a document belongs to the arc its key falls on. A shard takes at most its quota
of rows (quotas differ by one and add up to all rows), keys of its own arcs first; keys beyond a full shard continue
clockwise to the next point whose shard has room. So counts are at most one apart, and a changed document or shard
moves few others.

The walk runs on counts, not rows: arcs are counted in one aggregate, the walk yields one interval of places per arc and
shard, and rows find theirs by their place in the arc. Arcs with many rows (one key may hold a third of them) are split
into cells of about ``cell_rows``, so no task numbers a whole hot arc. The driver sees one row per cell: shards x points
plus rows / ``cell_rows``, which also bounds the broadcast.

Defined results: a null text has size 16 and crc32 of the empty text; a null ``doc_id`` is a key of its own; repeated
rows are placed one by one; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilframe.llm.common import written

SHARDS = 40
POINTS = 256
CELL_ROWS = 1_000_000
OVERHEAD = 16


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of all virtual nodes and the shard that owns each."""
    owners = np.repeat(np.arange(shards, dtype=np.int32), points)
    places = np.array([
        int.from_bytes(hashlib.blake2b(f"{shard}/{point}".encode(), digest_size=8).digest(), "big", signed=True)
        for shard in range(shards) for point in range(points)], dtype=np.int64)
    order = np.argsort(places, kind="stable")
    return places[order], owners[order]


def walk(cells: Iterable[tuple[int, int, int]], owners: np.ndarray, quotas: list[int]) -> list[tuple[int, ...]]:
    """Intervals (arc, cell, first, end, shard, slot of the first) that place every row of ``cells``.

    ``cells`` holds (arc, cell, rows). Own keys go first; what a full shard cannot take moves clockwise.
    """
    room, taken = list(quotas), [0] * len(quotas)
    placed: list[tuple[int, ...]] = []
    waiting: dict[int, list[tuple[int, int, int, int]]] = {}

    def take(arc: int, cell: int, first: int, end: int, shard: int) -> int:
        """Places as many rows from ``first`` on as the shard has room for; returns the first row left."""
        count = min(room[shard], end - first)
        if count:
            placed.append((arc, cell, first, first + count, shard, taken[shard]))
            room[shard] -= count
            taken[shard] += count
        return first + count

    for arc, cell, rows in sorted(cells):
        first = take(arc, cell, 0, rows, int(owners[arc]))
        if first < rows:
            waiting.setdefault(arc, []).append((arc, cell, first, rows))
    moving: deque[tuple[int, int, int, int]] = deque()
    for step in range(2 * len(owners)):
        point = step % len(owners)
        if step < len(owners):
            moving.extend(waiting.pop(point, ()))
        shard = int(owners[point])
        while moving and room[shard]:
            arc, cell, first, end = moving.popleft()
            first = take(arc, cell, first, end, shard)
            if first < end:
                moving.appendleft((arc, cell, first, end))
    return placed


def sharded(df: DataFrame, shards: int = SHARDS, points: int = POINTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; the law is ``rows``."""
    spark = df.sparkSession
    places, owners = ring(shards, points)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, position.to_numpy(np.int64)) % len(places)).astype(np.int32))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(df.select(
        F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id").alias("position"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("arc", arc_of("position")), "shard-rows")

    per_arc = {row["arc"]: row["count"] for row in rows.groupBy("arc").count().collect()}
    total = sum(per_arc.values())
    quotas = [total // shards + (shard < total % shards) for shard in range(shards)]
    parts = spark.createDataFrame(pd.DataFrame({
        "arc": pd.Series(list(per_arc), dtype="int32"),
        "parts": pd.Series([-(-count // cell_rows) for count in per_arc.values()], dtype="int64")}), "arc int, parts long")
    # One row per arc: at most shards * points.
    celled = rows.join(F.broadcast(parts), "arc").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("parts")))
    per_cell = [tuple(row) for row in celled.groupBy("arc", "cell").count().collect()]
    intervals = pd.DataFrame(walk(per_cell, owners, quotas),
                             columns=["arc", "cell", "first", "end", "shard", "base"], dtype="int64")
    plan = spark.createDataFrame(intervals.astype({"arc": "int32", "shard": "int32"}),
                                 "arc int, cell long, first long, end long, shard int, base long")
    in_cell = Window.partitionBy("arc", "cell").orderBy("position", "doc_id", "text_crc32", "row")
    ranked = celled.withColumn("place", (F.row_number().over(in_cell) - 1).cast("long"))
    # One row per cell and shard it reaches: see the module docstring for the bound.
    return ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.arc") == F.col("p.arc"))
                                  & (F.col("r.cell") == F.col("p.cell"))
                                  & (F.col("r.place") >= F.col("p.first")) & (F.col("r.place") < F.col("p.end"))).select(
        "r.doc_id", "r.size", "r.text_crc32", F.lit("rows").alias("law"), "p.shard",
        (F.col("p.base") + F.col("r.place") - F.col("p.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
