"""Packing by minimum bin slack.

Texts are tokenised, cut into full windows and one shorter rest, and dealt into groups of about ``windows`` windows by a
hash of the piece, so groups are even whatever one document or source holds. Inside a group each window is filled with
the multiset of remaining lengths whose sum comes closest to the capacity: a bitset subset-sum over the distinct
lengths, longest first, that stops as soon as the capacity itself is reached, with counts found by backtracking. Every
window but the last few of a group is full; nothing is truncated or dropped.

The pre-tokeniser of the vocabulary drops white space and never joins characters across it, and lower-casing acts on
single characters, so the ids of a text are the ids of its white-space separated parts; each part is encoded once and
remembered. The tokenizer knows the names of its special tokens, as they are written, before it lower-cases; a part that
holds one goes through the whole tokenizer as it is, and is told from the same part made by lower-casing.

Defined results: a null text counts as empty, and an empty text is the closing id alone; equal rows are packed one by
one; null and repeated ``doc_id`` are carried along; an empty table gives an empty result. Only ``doc_id`` and the text
column are read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import written

CAPACITY = 4096
CLOSING_ID = 2
#: Windows of one group: the piece lengths of a group are what one task holds.
WINDOWS = 1024
#: Parts of texts a worker remembers.
CACHED = 1_000_000

PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class Words(dict):
    """Text between white space, lower-cased -> its ids as little-endian unsigned 32-bit integers.

    A word of Latin letters is one pre-token, so its merges are asked for directly; a full stop or comma after it is a
    pre-token of its own. Everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        #: For lower-cased parts: what only looks like a special token there was none in the text.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.visible = byte_letters()
        self.stops = {mark: self._packed(self.tokenizer.encode(mark, add_special_tokens=False).ids) for mark in ".,"}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return b"".join([number.to_bytes(4, "little") for number in ids])

    def _letters(self, word: str) -> bytes:
        known = self.get(word)
        if known is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.visible)
            known = self[word] = self._packed([token.id for token in self.model.tokenize(shown)])
        return known

    def learn(self, words: set[str]) -> None:
        """Encode those of ``words`` that are not known."""
        if len(self) > CACHED:
            self.clear()
        others, as_they_are = [], []
        for word in words:
            if word in self:
                continue
            if word[:1] == AS_IT_IS:
                as_they_are.append(word)
                continue
            stop = word[-1:] if word[-1:] in self.stops else ""
            core = word[:-1] if stop else word
            if core.isalpha() and max(core) < LATIN_END:
                self[word] = self._letters(core) + self.stops.get(stop, b"")
            else:
                others.append(word)
        for word, encoding in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self[word] = self._packed(encoding.ids)
        for word in as_they_are:
            self[word] = self._packed(self.whole.encode(word[1:], add_special_tokens=False).ids)


#: Starts the key of a part that is not lower-cased. No other key starts with white space.
AS_IT_IS = " "
#: Letters below this code point are composed, so normalising leaves them alone.
LATIN_END = "\u0250"


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary: bytes that show none get the next
    free ones from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(256 + place) for place, byte in enumerate(hidden)}


@lru_cache(maxsize=2)
def known_words(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return Words(path)


#: Characters that Python splits at, but the tokenizer does not take for white space.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def split_text(text: str) -> list[str]:
    """Lower-cased parts between white space. A final sigma is lower-cased like any other."""
    lowered = text.replace("Σ", "σ").lower()
    if NOT_SPACE.search(lowered):
        return re.split(r"(?:(?![\x1c-\x1f])\s)+", lowered)
    return lowered.split()


def split_special(text: str, special: list[str]) -> list[str]:
    """Like `split_text`, for a text with special tokens: parts that hold one stay as they are."""
    parts = []
    for part in re.split(r"(?:(?![\x1c-\x1f])\s)+", text):
        if any(name in part for name in special):
            parts.append(AS_IT_IS + part)
        else:
            parts += split_text(part)
    return parts


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text, without the closing id, four bytes each; a few texts at a time share one dictionary pass."""
    words = known_words(path)
    held: list[list[str]] = []
    size = 0
    for text in texts:
        special = any(name in text for name in words.special)
        held.append(split_special(text, words.special) if special else split_text(text))
        size += len(held[-1])
        if size > 100_000:
            yield from _joined(held, words)
            held, size = [], 0
    yield from _joined(held, words)


def _joined(held: list[list[str]], words: Words) -> Iterator[bytes]:
    words.learn(set().union(*held))
    for parts in held:
        yield b"".join(map(words.__getitem__, parts))


def pieces(df: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of at most ``capacity``; all but the last are full."""
    closing = CLOSING_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            texts = batch.column(2).to_pylist()
            for row, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                     token_bytes(texts, vocabulary)):
                ids += closing
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at:at + 4 * capacity]
                    for name, value in zip(("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"), (
                            row, doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                        out[name].append(value)
            yield pa.record_batch([pa.array(out[name], pa.int64()) for name in (
                "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")], names=[
                "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                     F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length whose total is the largest that does not exceed ``capacity``."""
    reached, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        before, left, factor = reached, min(counts[length], capacity // length), 1
        while left:  # powers of two make every count from 0 to ``left``
            take = min(factor, left)
            reached |= (reached << (length * take)) & mask
            left -= take
            factor *= 2
        steps.append((length, before))
        if reached >> capacity & 1:
            break
    total = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(steps):
        used = 0
        while not before >> (total - used * length) & 1:
            used += 1
        if used:
            chosen[length] = used
            total -= used * length
    return chosen


def fill_windows(lengths: list[int], capacity: int = CAPACITY) -> Iterator[list[int]]:
    """Positions in ``lengths`` that share a window, window by window, until none are left."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for position, length in enumerate(lengths):
        waiting[length].append(position)
    counts = {length: len(positions) for length, positions in waiting.items()}
    while counts:
        window = []
        for length, used in best_fill(counts, capacity).items():
            window += [waiting[length].pop() for _ in range(used)]
            counts[length] -= used
            if not counts[length]:
                del counts[length]
        yield window


def pack(cut: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """Sequence and offset of every piece. ``cut`` is read twice, so it should be a written table."""
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * windows)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = group["length"].tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        first = int(group["part"].iloc[0]) << 32
        for number, window in enumerate(fill_windows(lengths, capacity)):
            filled = 0
            for position in window:
                sequence[position], offset[position] = first + number, filled
                filled += lengths[position]
        group["doc_id"] = group["doc_id"].astype("Int64")
        group["sequence_id"], group["offset"] = sequence, offset
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(packed, PACKED)


def packed_documents(df: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY,
                     windows: int = WINDOWS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return pack(written(pieces(df, vocabulary, text, capacity), "pack-pieces"), capacity, windows)
