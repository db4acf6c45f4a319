"""Near-duplicate documents by DartMinHash signatures, banded joins and an exact check.

A document is a weighted set of five-word shingles (words are runs of letters and digits, lower-cased; weight 1, or the
number of occurrences). Every element owns a column of the weight x rank plane, cut into cells of area one that hold
Poisson(1) darts, all drawn from a hash, so equal elements of all documents see the same darts. A document throws darts
into its elements' regions up to a rank that promises enough hits, and keeps the earliest dart of each coordinate: two
signatures agree in a coordinate with the probability of their weighted Jaccard similarity. The number of darts does not
grow with the document.

Links. Equal texts are one node. Nodes that share a band are compared with the least node of the bucket, and links of
similarity 0.8 or more, computed from the whole shingle sets, are joined to components. Buckets that then still hold
more than one component are compared exhaustively across components: split into chunks, one task per pair of chunks,
where a pair that meanwhile is connected needs no comparison. Tasks return links that join components, at most one per
node, so nothing grows with the pairs of a group, and no bucket is capped or dropped.

Defined results: a null text is its own group; texts without words are grouped only with equal texts; texts of one to
four words have one shingle of all their words; the group's name is its least ``doc_id`` (null if it has none); repeated
rows share group and verdict; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import written
from perilframe.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: 30 bands of 6: a pair of similarity 0.8 shares no band with probability 1e-4, one of 0.3 shares some with 0.02.
BANDS = 30
BAND_ROWS = 6
CHUNK = 256
#: Bytes of text whose words are hashed at once.
SEGMENT = 1 << 22
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A hash for every byte that can be part of a word, 0 for all that separate words."""
    codes = np.arange(256)
    part = ((codes >= ord("a")) & (codes <= ord("z"))) | ((codes >= ord("0")) & (codes <= ord("9"))) | (codes >= 128)
    return np.where(part, mixed((codes.astype(np.uint64) + np.uint64(1)) * GOLDEN) | np.uint64(1), np.uint64(0))


BYTES = _byte_values()
POWERS = np.cumprod(np.full(4096, np.uint64(0x5851F42D4C957F2D)))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    found, first = [], 0
    while first < len(data):
        end = min(len(data), first + SEGMENT)
        while end < len(data) and BYTES[data[end]]:  # a word is never cut
            end += 1
        values = BYTES[data[first:end]]
        inside = values != 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if len(starts):
            at = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values)))) \
                if not starts[0] else np.concatenate((np.zeros(starts[0], dtype=np.int64), np.arange(
                    starts[0], len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))))
            found.append(np.add.reduceat(values * POWERS[at & 4095], starts))
        first = end
    return mixed(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``text`` as sorted 64-bit hashes, and how often each occurs."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes, np.empty(0, dtype=np.int64)
    width = min(words, len(hashes))
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for place in range(width):
        total = mixed(total + GOLDEN + hashes[place:len(hashes) - width + 1 + place])
    return np.unique(total, return_counts=True)


def _poisson_steps() -> np.ndarray:
    """Upper ends, as 53-bit fractions, of the ranges of a uniform number that give 0, 1, 2, ... darts in a cell."""
    terms = np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 18))))
    return np.cumsum(terms)


STEPS = _poisson_steps()


def _uniform(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def darts(elements: np.ndarray, weights: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Identity and rank of all darts of rank up to ``limit`` in the regions of the elements.

    Strip v of a column covers weights from 2**v - 1 to 2**(v + 1) - 1 and is cut into cells of height 2**-v.
    """
    names, ranks = [], []
    for strip in range(int(np.floor(np.log2(weights.max() + 1))) + 1):
        low, width = 2.0 ** strip - 1, 2.0 ** strip
        inside = weights > low
        if not inside.any():
            break
        cells = int(np.ceil(limit * width))
        own, room = elements[inside], weights[inside]
        seeds = mixed(own + GOLDEN * np.array([strip + 1], dtype=np.uint64))
        cell = np.tile(np.arange(cells, dtype=np.uint64), len(own))
        seed = mixed(np.repeat(seeds, cells) + GOLDEN * (cell + np.uint64(1)))
        count = np.searchsorted(STEPS, _uniform(seed), side="right")
        hit = np.flatnonzero(count)
        each = count[hit]
        number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        dart = mixed(np.repeat(seed[hit], each) + GOLDEN * (number + 1).astype(np.uint64))
        rank = (np.repeat(cell[hit], each).astype(np.float64) + _uniform(mixed(dart + np.uint64(1)))) / width
        weight = low + width * _uniform(mixed(dart + np.uint64(2)))
        kept = (rank <= limit) & (weight < np.repeat(np.repeat(room, cells)[hit], each))
        names.append(dart[kept])
        ranks.append(rank[kept])
    return np.concatenate(names), np.concatenate(ranks)


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The earliest dart of each of ``size`` coordinates; needs at least one element."""
    wanted = size * np.log(size + 1) + 2 * size
    limit = wanted / weights.sum()
    while True:
        names, ranks = darts(elements, weights, limit)
        order = np.argsort(-ranks, kind="stable")
        coordinate = (mixed(names + np.uint64(3)) % np.uint64(size)).astype(np.int64)[order]
        found = np.zeros(size, dtype=np.uint64)
        filled = np.zeros(size, dtype=bool)
        found[coordinate] = names[order]  # the last of equal coordinates, the earliest dart, stays
        filled[coordinate] = True
        if filled.all():
            return found
        limit *= 2


def band_keys(text: str, words: int, bands: int, rows: int, counted: bool) -> np.ndarray | None:
    elements, counts = shingles(text, words)
    if not len(elements):
        return None
    weights = counts.astype(np.float64) if counted else np.ones(len(elements))
    darts_kept = signature(elements, weights, bands * rows).reshape(bands, rows)
    key = np.zeros(bands, dtype=np.uint64)
    for row in range(rows):
        key = mixed(key + GOLDEN + darts_kept[:, row])
    return key.view(np.int64)


def nodes(df: DataFrame, words: int, bands: int, rows: int, counted: bool) -> DataFrame:
    """One row per distinct text: ``node, key, first`` (its least doc_id), ``copies`` and the keys of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [band_keys(text, words, bands, rows, counted) for text in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int64()))],
                                  names=["doc_id", "key", "bands"])

    signed = df.mapInArrow(sign, "doc_id long, key binary, bands array<long>")
    return written(signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"),
                                             F.first("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")


def keyed(df: DataFrame) -> DataFrame:
    """``doc_id, key, text`` of the rows with a text; the key is a digest of the whole text."""
    return df.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")


def shingle_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, elements`` for the nodes of ``wanted`` (node, key, first). Copies spread over tasks by their doc_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(text, words)[0].view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "elements"])

    same = (F.col("t.key") == F.col("w.key")) & F.col("t.doc_id").eqNullSafe(F.col("w.first"))
    chosen = texts.alias("t").join(wanted.alias("w"), same).select("w.node", "t.text")
    return chosen.mapInArrow(cut, "node long, elements array<long>").dropDuplicates(["node"])


def similar(left: str, right: str, least: float):
    """Jaccard similarity of two columns of distinct elements, at least ``least``."""
    common = F.size(F.array_intersect(left, right))
    return common >= F.lit(least) * (F.size(left) + F.size(right) - common)


def linked_across(group: pd.DataFrame, least: float, band: int) -> list[tuple[int, int]]:
    """Links between different components among the rows of one pair of chunks, each joining two of them."""
    label = {root: root for root in group["root"]}

    def top(root: int) -> int:
        while label[root] != root:
            label[root] = label[label[root]]
            root = label[root]
        return root

    elements = [np.asarray(value) for value in group["elements"]]
    sizes = np.array([len(value) for value in elements])
    bands = np.array(group["bands"].tolist())
    node, root = group["node"].to_numpy(), group["root"].to_numpy()
    left = np.flatnonzero(group["side"].to_numpy() == 0)
    right = np.flatnonzero(group["side"].to_numpy() == 1)
    found = []
    for i in left:
        fits = (np.minimum(sizes[right], sizes[i]) >= least * np.maximum(sizes[right], sizes[i])) & (root[right] != root[i])
        for j in right[fits]:
            # A pair that shares several bands is compared in the first of them.
            if top(root[i]) == top(root[j]) or np.argmax(bands[i] == bands[j]) != band:
                continue
            common = len(np.intersect1d(elements[i], elements[j], assume_unique=True))
            if common >= least * (sizes[i] + sizes[j] - common):
                found.append((int(node[i]), int(node[j])))
                label[top(root[i])] = top(root[j])
    return found


def grouped(df: DataFrame, **options) -> DataFrame:
    """``doc_id, group_id, group_size, kept`` for every row; one document of each group is kept, the least doc_id."""
    rest = df.where(F.col("text").isNull()).select(
        F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("group_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return _grouped(keyed(df), **options).drop("key").unionByName(rest)


def _grouped(texts: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS,
             rows: int = BAND_ROWS, counted: bool = False, chunk: int = CHUNK) -> DataFrame:
    """`grouped` for the rows of `keyed`, with their key."""
    known = nodes(texts, words, bands, rows, counted)
    # A link table of what shares buckets with others.
    banded = known.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "hash"))
    leaders = banded.groupBy("band", "hash").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(banded.join(leaders.select("band", "hash", "leader"), ["band", "hash"]), "minhash-members")
    pairs = members.where("node <> leader").select("leader", "node").distinct()
    wanted = known.join(members.select("node").distinct(), "node").select("node", "key", "first")
    sets = written(shingle_sets(texts, wanted, words), "minhash-sets")
    checked = (pairs.join(sets, "node").withColumnRenamed("elements", "own")
               .join(sets.select(F.col("node").alias("leader"), "elements"), "leader")
               .where(similar("own", "elements", least)).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    first = written(components(checked), "minhash-roots")

    more = _links_across(members, known, sets, first, least, chunk)
    roots = components(first.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
    named = known.select("node", "key", "first", "copies").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    # A written table, so that Spark can split the join where one group is large.
    names = written(named.groupBy("root").agg(
        F.min("first").alias("group_id"), F.sum("copies").alias("group_size")), "minhash-groups")
    verdicts = named.select("key", "root").join(names, "root").select("key", "group_id", "group_size")
    return texts.select("doc_id", "key").join(verdicts, "key").select(
        "doc_id", "key", "group_id", "group_size", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def _links_across(members: DataFrame, known: DataFrame, sets: DataFrame, roots: DataFrame, least: float,
                  chunk: int) -> DataFrame:
    """Further links, for buckets that hold several components: rows outside the leader's component against all rows."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_leader = roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    rooted = rooted.join(of_leader, "leader", "left").withColumn("leader_root", F.coalesce("leader_root", "leader"))
    odd = F.col("root") != F.col("leader_root")
    buckets = rooted.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("all"), F.sum(odd.cast("long")).alias("odd")).where("odd > 0")
    buckets = buckets.select("band", "hash", F.ceil(F.col("all") / chunk).cast("int").alias("all_chunks"),
                             F.ceil(F.col("odd") / chunk).cast("int").alias("odd_chunks"))
    rows = rooted.join(buckets, ["band", "hash"]).select(
        "band", "hash", "node", "root", odd.alias("odd"), "all_chunks", "odd_chunks")
    left = rows.where("odd").withColumn("i", F.pmod(F.hash("node"), F.col("odd_chunks"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("all_chunks") - 1))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", F.pmod(F.hash("node"), F.col("all_chunks"))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("odd_chunks") - 1))).withColumn("side", F.lit(1))
    columns = ["band", "hash", "i", "j", "side", "node", "root"]
    both = left.select(*columns).unionByName(right.select(*columns))
    loaded = both.join(sets, "node").join(known.select("node", "bands"), "node")

    def across(group: pd.DataFrame) -> pd.DataFrame:
        found = linked_across(group, least, int(group["band"].iloc[0]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return loaded.groupBy("band", "hash", "i", "j").applyInPandas(across, "a long, b long")


def deduplicated(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df``, all columns, without those whose group keeps another; of equal kept rows one stays.

    Rows with a null text all stay.
    """
    # Two plain columns stand for the row, so one shuffle serves the aggregate and the join.
    tag = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("tag")
    texts = keyed(df)
    kept = _grouped(texts, **options).where("kept").select("key", tag).distinct()
    whole = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"))
    filled = whole.where(F.col("row.text").isNotNull()).select(
        F.unhex(F.md5(F.col("row.text").cast("binary"))).alias("key"),
        F.coalesce(F.col("row.doc_id").cast("string"), F.lit("none")).alias("tag"), "row")
    once = filled.groupBy("key", "tag").agg(F.first("row").alias("row"))
    return once.join(kept, ["key", "tag"], "left_semi").select("row.*").unionByName(
        whole.where(F.col("row.text").isNull()).select("row.*"))
