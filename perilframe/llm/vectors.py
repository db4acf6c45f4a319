"""Near-duplicate vectors by int8 tile products with error bounds.

Equal vectors are one class. Classes are dealt into blocks, and each pair of blocks is one task: both are quantised to
int8 with a scale of their own, multiplied as a tile, and for each pair the product and the norms of the two rounding
errors bound the cosine. Pairs whose upper bound misses the threshold are dropped, those whose lower bound reaches it
are links, and only pairs between the bounds are computed again in double precision. So the result is that of the full
comparison in double precision.

A task returns one row per class: the links it found for it, and the root of its links inside the tile. So what is
written grows with classes x blocks, never with the number of pairs. The products themselves grow with the square of
the number of distinct vectors; README.md has figures.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors
of different length do not link; rows of one ``vec_id`` are separate vectors; a null ``vec_id`` takes part in links, but is
never a component's name; an empty table gives an empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import written
from perilframe.llm.components import components

THRESHOLD = 0.9
BLOCK = 8192
#: Rows of a tile that are multiplied at once.
STRIP = 512
#: Beyond the bounds, for rounding in single and double precision.
SLACK = 1e-5

LINKS = "class long, root long, links long"


class Quantised:
    """Unit vectors of a block, their int8 form, and what rounding can change."""

    def __init__(self, vectors: np.ndarray):
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.whole = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        near = self.whole * self.scale[:, None]
        self.error = np.linalg.norm(self.unit - near, axis=1)
        self.length = np.linalg.norm(near, axis=1)
        # Products of int8 are whole numbers; single precision holds them exactly up to 2 ** 24.
        exact = vectors.shape[1] * 127 * 127 < 1 << 24
        self.factors = self.whole.astype(np.float32 if exact else np.float64)


def strips(left: Quantised, right: Quantised, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs, as positions in ``left`` and ``right``, strip by strip; below the diagonal if both are one block."""
    worst = right.error.max()
    for first in range(0, len(left.unit), STRIP):
        rows = slice(first, first + STRIP)
        tile = left.factors[rows] @ right.factors.T
        tile *= left.scale[rows, None]
        tile *= right.scale[None, :]
        floor = threshold - left.error[rows] - left.length[rows] * worst - SLACK
        i, j = np.nonzero(tile >= floor[:, None].astype(tile.dtype))
        if same:
            below = i + first > j
            i, j = i[below], j[below]
        product = tile[i, j].astype(np.float64)
        i += first
        slip = left.error[i] + left.length[i] * right.error[j] + SLACK
        sure = product - slip >= threshold
        unsure = np.nonzero(~sure & (product + slip >= threshold))[0]
        for at in range(0, len(unsure), 1 << 16):
            part = unsure[at:at + (1 << 16)]
            cosine = np.einsum("ij,ij->i", left.unit[i[part]], right.unit[j[part]])
            sure[part] = cosine >= threshold
        yield i[sure], j[sure]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked positions the smallest label either has, and so on until all links hold."""
    while True:
        first, second = labels[a], labels[b]
        apart = first != second
        if not apart.any():
            return
        a, b, first, second = a[apart], b[apart], first[apart], second[apart]
        np.minimum.at(labels, np.maximum(first, second), np.minimum(first, second))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels[:] = shorter


def tile_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks, summed per class."""
    low, high = group["low"].iloc[0], group["high"].iloc[0]
    parts = [group[group["block"] == block] for block in ([low] if low == high else [low, high])]
    if any(part.empty for part in parts):
        return pd.DataFrame({"class": [], "root": [], "links": []}, dtype="int64")
    blocks = [Quantised(np.array(part["vector"].tolist(), dtype=np.float64)) for part in parts]
    ids = np.concatenate([part["class"].to_numpy(np.int64) for part in parts])
    copies = np.concatenate([part["copies"].to_numpy(np.int64) for part in parts])
    shift = 0 if low == high else len(parts[0])
    labels, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for i, j in strips(blocks[0], blocks[-1], threshold, low == high):
        j = j + shift
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        joined(labels, i, j)
    some = links > 0
    return pd.DataFrame({"class": ids[some], "root": ids[labels[some]], "links": links[some]})


def linked(df: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    vector = F.col("embedding").cast("array<double>")
    sound = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = sound & F.exists(vector, lambda x: x != 0)
    rows = df.select("vec_id", F.when(F.coalesce(some, F.lit(False)), vector).alias("vector"))
    classes = written(rows.where("vector IS NOT NULL").groupBy("vector").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("class", F.monotonically_increasing_id()), "vector-classes")

    sizes = classes.groupBy(F.size("vector").alias("dim")).count().collect()  # one row per vector length
    blocks = max([1, *(-(-row["count"] // block_rows) for row in sizes)])
    dealt = classes.withColumn("dim", F.size("vector")).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "class", "vector", "copies", "dim", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = written(tiles.groupBy("dim", "low", "high").applyInPandas(
        lambda group: tile_links(group, threshold), LINKS), "vector-links")

    roots = components(found, "class", "root")
    named = roots.join(classes.select(F.col("class").alias("node"), "first"), "node")
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    component = roots.join(names, "root").select(F.col("node").alias("class"), "component")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = (classes.join(counts, "class", "left").join(component, "class", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "first").alias("component_id")))
    return rows.join(known, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same rows by comparing all pairs; for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), s AS MATERIALIZED (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
