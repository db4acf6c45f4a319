"""Byte-level BPE encoding and decoding with overlapping chunks.

`encode` cuts texts of more than ``chunk`` characters into chunks that overlap, pre-tokenises all chunks in parallel and
stitches neighbours at the first boundary that both scans share: the pattern never looks back, so two scans that agree
on one boundary agree on all that follow. The pieces between stitches are then encoded in parallel, and put together
per document. A document whose scans share no boundary inside an overlap (a run of one class longer than the overlap)
is encoded in one piece instead. Texts of one chunk need no stitch and never leave their task.

Decoding concatenates the bytes of the ids; `decode` does so for any column of ids.

Defined results: null text counts as empty; an empty text has 0 tokens; equal rows give equal rows; an empty table gives
an empty result; the identity of a row is its own, so null and repeated ``doc_id`` are allowed. Only ``doc_id`` and the
text column are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilframe.llm.common import written

#: The pattern that splits text before merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 16
OVERLAP = 1 << 12
#: A match that ends this close to a cut may look different in the whole text (a contraction has three characters).
MARGIN = 4
#: Pre-tokens a worker remembers.
CACHED = 400_000

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces(dict):
    """Pre-token -> (number of ids, their decimal text, the bytes they decode to), filled on demand."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The whole input is one match, so this applies the merges to a single pre-token.
        self.merges = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.merges.encode_ordinary(piece)
        made = len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = made
        return made

    def encode(self, text: str) -> tuple[int, str, bytes]:
        parts = [self[piece] for piece in self.pattern.findall(text)]
        return (sum(part[0] for part in parts), ",".join([part[1] for part in parts]),
                b"".join([part[2] for part in parts]))

    def ends(self, text: str) -> list[int]:
        return [match.end() for match in self.pattern.finditer(text)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _digests(encoded: tuple[int, str, bytes]) -> tuple[int, str, str]:
    count, ids, raw = encoded
    return count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def encode(df: DataFrame, vocabulary: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    rows = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(vocabulary)
        for batch in batches:
            made = [_digests(known.encode(value)) for value in batch.column(1).to_pylist()]
            counts, ids, raw = zip(*made) if made else ((), (), ())
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return short.mapInArrow(whole, RESULT).unionByName(_long(rows, vocabulary, chunk, overlap))


def _long(rows: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, value in zip(batch["row"], batch["doc_id"], batch["text"]):
                for place, start in enumerate(range(0, len(value), chunk)):
                    yield pd.DataFrame({
                        "row": [row], "doc_id": pd.array([doc], "Int64"), "place": [place], "start": [start],
                        "last": [start + chunk >= len(value)], "text": [value[start:start + chunk + overlap]]})

    chunks = written(
        rows.where(F.length("text") > chunk).select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
        .mapInPandas(cut, "row long, doc_id long, place long, start long, last boolean, text string")
        .repartition(F.col("row"), F.col("place")), "bpe-chunks")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces(vocabulary)
        for batch in batches:
            heads, tails = [], []
            for start, value in zip(batch["start"], batch["text"]):
                sure = [end for end in known.ends(value) if end <= len(value) - MARGIN]
                heads.append([start] + [start + end for end in sure if end <= overlap])
                tails.append([start + end for end in sure if end >= chunk])
            yield pd.DataFrame({"row": batch["row"], "place": batch["place"], "start": batch["start"],
                                "last": batch["last"], "head": heads, "tail": tails})

    in_order = Window.partitionBy("row").orderBy("place")
    scanned = chunks.mapInPandas(
        scan, "row long, place long, start long, last boolean, head array<long>, tail array<long>")
    shared = scanned.select(
        "row", "place", "start", "last",
        F.array_min(F.array_intersect("tail", F.lead("head").over(in_order))).alias("until"))
    cuts = shared.select(
        "row", "place",
        F.coalesce(F.lag("until").over(in_order), F.col("start")).alias("since"), "until",
        F.max(F.col("until").isNull() & ~F.col("last")).over(Window.partitionBy("row")).alias("apart"))
    placed = chunks.join(cuts, ["row", "place"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces(vocabulary)
        for batch in batches:
            made = []
            for value, start, since, until in zip(batch["text"], batch["start"], batch["since"], batch["until"]):
                made.append(known.encode(value[int(since - start):None if pd.isna(until) else int(until - start)]))
            yield pd.DataFrame({
                "row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "place": batch["place"],
                "n": [item[0] for item in made], "ids": [item[1] for item in made],
                "raw": [item[2] for item in made]})

    kind = "row long, doc_id long, place long, n long, ids string, raw binary"
    encoded = placed.where(~F.col("apart")).mapInPandas(part, kind)

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        made = _digests((int(group["n"].sum()), ",".join(group["ids"]), b"".join(group["raw"])))
        return _one_row(group["doc_id"].iloc[0], made)

    def rejoined(group: pd.DataFrame) -> pd.DataFrame:
        value = "".join(text[:chunk] for text in group.sort_values("place")["text"])
        return _one_row(group["doc_id"].iloc[0], _digests(pieces(vocabulary).encode(value)))

    return (encoded.groupBy("row").applyInPandas(together, RESULT)
            .unionByName(placed.where("apart").groupBy("row").applyInPandas(rejoined, RESULT)))


def _one_row(doc: object, made: tuple[int, str, str]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc) else int(doc)], "Int64"), "n_tokens": [made[0]],
                         "ids_sha256": [made[1]], "decoded_sha256": [made[2]]})


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", output: str = "raw") -> DataFrame:
    """Adds the bytes that an array of ids stands for; a null array gives null."""

    @F.pandas_udf("binary")
    def joined(column: pd.Series) -> pd.Series:
        known = pieces(vocabulary).bytes_of
        return column.map(lambda row: None if row is None else b"".join(known[int(number)] for number in row))

    return df.withColumn(output, joined(F.col(ids)))
