"""Runs of repeated words: a suffix automaton of the words, recoloured by link-cut accesses.

A run is a stretch of words that repeats with a smallest period q at least `REPEATS` times, spans at least `LEAST` words
and cannot be extended on either side with that period.

Method. The states of a text's suffix automaton, hung on their suffix links, are a tree in which the path from the root
to the state of a prefix holds all its suffixes. Every state remembers the last place where one of its words ended: a
colour. The words are appended one after another; each gives the whole path of its prefix the new place as colour, by
the access of a link-cut tree (splay trees over the path segments of one colour). Before a segment changes colour from e
to i, its deepest state tells the longest common suffix l of the prefixes that end at e and i: the words of the stretch
of length l + (i - e) that ends at i are equal at distance i - e. If l is at least (REPEATS - 1) (i - e), that is a
repetition, maximal on its left, whose smallest period is i - e: a smaller one would have ended later than e. The same
start and distance at the next words extend it to the run. Each access changes O(log n) segments, amortised.

Only words that can be part of a run go through the automaton. Each window of `GRAM` words inside a run occurs in it
twice, so stretches of windows that do not occur twice within their stretch are set aside, until nothing changes; this
loses no run and cuts none. The automaton compares words, so equal hashes of windows only cost time.

Texts are independent, so the work is one narrow pass. A document is one unit: its automaton takes about half a kilobyte
a word that can be part of a run.

Defined results: words are runs of bytes other than blanks, tabs, line ends, vertical tabs and form feeds; a null text
has no words; a null ``doc_id`` is carried along; repeated rows are searched one by one; equal starts stand in order of
their periods; an empty table gives an empty result. Only ``doc_id`` and the text column are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 24
REPEATS = 3
GRAM = 8
#: Words that are searched for repeated windows at once.
AT_ONCE = 300_000

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of every state (the root is 0), and the state of every prefix."""
    length, link, moves, prefix = [0], [-1], [{}], []
    last = 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        moves.append({})
        state = last
        while state >= 0 and word not in moves[state]:
            moves[state][word] = new
            state = link[state]
        if state >= 0:
            target = moves[state][word]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                split = len(length)
                length.append(length[state] + 1)
                link.append(link[target])
                moves.append(dict(moves[target]))
                link[target] = link[new] = split
                while state >= 0 and moves[state].get(word) == target:
                    moves[state][word] = split
                    state = link[state]
        last = new
        prefix.append(new)
    return link, length, prefix


class Segments:
    """Path segments of one colour of a rooted tree, each a splay tree ordered by depth. Node 0 stands for none."""

    def __init__(self, link: list[int]):
        self.up = [0, *(parent + 1 for parent in link)]
        self.left = [0] * len(self.up)
        self.right = [0] * len(self.up)
        self.colour = [-1] * len(self.up)

    def rotate(self, node: int) -> None:
        left, right, up = self.left, self.right, self.up
        over = up[node]
        top = up[over]
        if left[over] == node:
            moved = left[over] = right[node]
            right[node] = over
        else:
            moved = right[over] = left[node]
            left[node] = over
        if moved:
            up[moved] = over
        up[over], up[node] = node, top
        if left[top] == over and top:
            left[top] = node
        elif right[top] == over and top:
            right[top] = node
        self.colour[node] = self.colour[over]  # a segment's colour is that of its root

    def splay(self, node: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            over = up[node]
            if not over or (left[over] != node and right[over] != node):
                return
            top = up[over]
            if top and (left[top] == over or right[top] == over):
                self.rotate(over if (left[top] == over) == (left[over] == node) else node)
            self.rotate(node)

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Give the path from the root to ``node`` its new colour; yields the deepest node and colour of each segment left."""
        below = 0
        while node:
            self.splay(node)
            old = self.colour[node]
            if old >= 0:
                yield node - 1, old
            rest = self.right[node]
            if rest:
                self.colour[rest] = old
            self.right[node] = below
            below, node = node, self.up[node]
        self.colour[below] = colour


def runs_of(words: list, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Start, length and period of every run of ``words``."""
    link, length, prefix = automaton(words)
    segments = Segments(link)
    ends: dict[tuple[int, int], int] = {}
    for at, state in enumerate(prefix):
        for deepest, before in segments.access(state + 1, at):
            shared, distance = length[deepest], at - before
            if shared >= (repeats - 1) * distance and shared + distance >= least:
                ends[at - distance - shared + 1, distance] = at
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def candidates(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """Per text the stretches of words, as (start, end), that may hold runs."""
    sizes = np.array([len(words) for words in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    window = np.fromiter((hash(word) for words in texts for word in words), np.int64, len(owner)).view(np.uint64)
    width = 1
    while width < GRAM:
        window = window[:-width] * np.uint64(0x9E3779B97F4A7C15) + (window[width:] ^ (window[width:] >> np.uint64(29)))
        width *= 2
    if len(owner) < GRAM:
        return found
    alive = np.flatnonzero(owner[:-(GRAM - 1)] == owner[GRAM - 1:])
    stretch = owner[alive]
    while len(alive):
        key = window[alive] ^ (stretch.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(alive), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        kept = alive[twice]
        number = np.cumsum(np.diff(kept, prepend=-2) != 1)  # windows of two texts are never neighbours
        long = np.bincount(number)[number] >= least - GRAM + 1 if len(kept) else np.zeros(0, dtype=bool)
        kept, number = kept[long], number[long]
        if len(kept) == len(alive):
            break
        alive, stretch = kept, number
    if len(alive):
        first = np.concatenate(([0], np.cumsum(sizes)))
        breaks = np.flatnonzero(np.diff(alive) != 1)
        for a, b in zip(alive[np.concatenate(([0], breaks + 1))], alive[np.concatenate((breaks, [len(alive) - 1]))]):
            text = owner[a]
            found[text].append((int(a - first[text]), int(b - first[text]) + GRAM))
    return found


def searched(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    for words, stretches in zip(texts, candidates(texts, least)):
        runs = [(start + a, length, period) for a, b in stretches
                for start, length, period in runs_of(words[a:b], least, repeats)]
        yield sorted(runs, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repetitions, joined by blanks; of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[at] for at in np.flatnonzero(kept)])


def found(df: DataFrame, text: str = "text", reworded: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
          least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period) and ``collapsed``, the text without repetitions, for every row.

    ``reworded`` may change a document's words, given as UTF-8, before they are searched. ``least`` and ``repeats`` hold
    as long as every window of `GRAM` words of a run occurs in it twice: ``least >= 22`` and ``repeats >= 3``.
    """
    if repeats < REPEATS or least < 3 * GRAM - 2:
        raise ValueError("shorter runs may hold windows that occur once")

    def finished(docs: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = list(searched(texts, least, repeats))
        left = [collapsed(words, own).decode() for words, own in zip(texts, runs)]
        spans = [[{"start": start, "length": length, "period": period} for start, length, period in own] for own in runs]
        return pa.record_batch([pa.array(docs, pa.int64()), pa.array(spans, _RUN_TYPE), pa.array(left, pa.string())],
                               names=["doc_id", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (own.as_buffer().to_pybytes() if own.is_valid else b"").split()
                docs.append(doc)
                texts.append(reworded(doc, words) if reworded else words)
                held += len(words)
                if held > AT_ONCE:
                    yield finished(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield finished(docs, texts)

    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return own.mapInArrow(search, f"doc_id long, runs {RUNS}, collapsed string")


def trial(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the checksum of its number, repeats a stretch of its own words from some word on."""
    if doc_id is None or not words:
        return words
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10:
        return words
    seed, n = checksum // 10, len(words)
    first = seed % n
    period = 1 + (n - first) // (3 + seed % 8)
    stretch = words[first:first + period]
    return words[:first] + (stretch * (-(-(n - first) // period)))[:n - first]


def _stronger(best: Column, run: Column) -> Column:
    """Whether ``run`` has the greater exact length / period; among equals the run that starts first stays."""
    ahead, behind = run["length"] * best["period"], best["length"] * run["period"]
    return best.isNull() | (ahead > behind)


def digests(rows: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and digests of runs and collapsed text."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda held, run: F.when(_stronger(held, run), run).otherwise(held))
    lines = F.array_join(F.transform("runs", lambda run: F.concat_ws(
        ",", run["start"].cast("string"), run["length"].cast("string"), F.concat(run["period"].cast("string"), F.lit("\n")))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def oracle(longest_period: int = 1 << 16) -> str:
    """The same rows without an automaton, for periods up to ``longest_period``.

    Inside a run of period q, any window of q to 2q words (8 at least) that lies a period or more behind the start has its
    nearest earlier copy exactly q words before. So windows of 8, 16, 32, ... words are named by hashes of their halves,
    and neighbours with the same distance to their nearest earlier copy make a run.
    """
    steps, width = ["g1 AS (SELECT r, i, n, hash(w) AS x FROM w)"], 1
    while width < longest_period:
        width *= 2
        steps.append(f"g{width} AS MATERIALIZED (SELECT * FROM (SELECT r, i, n, hash(x, lead(x, {width // 2}) OVER (PARTITION BY r ORDER BY i)) AS x "
                     f"FROM g{width // 2}) WHERE i + {width} <= n)")
    near, width = [], 8
    while width <= longest_period:
        near.append(f"SELECT r, i, i - lag(i) OVER (PARTITION BY r, x ORDER BY i) AS q, {width} AS g, "
                    f"{0 if width == 8 else width // 2} AS above FROM g{width}")
        width *= 2
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(doc_id::VARCHAR)),
           lambda p: list_transform(range(8), lambda b: (ascii(substr(doc_id::VARCHAR, (p + 1)::BIGINT, 1)) >> b::INTEGER) & 1)))::BIGINT[]),
           lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)) AS c
  FROM documents
), h AS (
  SELECT doc_id, r, ws, len(ws) AS n, CASE WHEN doc_id IS NOT NULL THEN xor(c, 4294967295) END AS h FROM d
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS m FROM h
), w AS MATERIALIZED (
  SELECT r, n, i, CASE WHEN i >= a THEN ws[(a + (i - a) % (1 + (n - a) // m) + 1)::BIGINT] ELSE ws[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM a)
), {', '.join(steps)}, near AS (
  {' UNION ALL '.join(near)}
), level AS (
  SELECT *, i - row_number() OVER (PARTITION BY r, g, q ORDER BY i) AS part FROM near WHERE q > above AND q <= g
), runs AS MATERIALIZED (
  SELECT * FROM (SELECT r, (min(i) - q)::BIGINT AS start, (max(i) - min(i) + g + q)::BIGINT AS length, q::BIGINT AS period
                 FROM level GROUP BY r, g, q, part)
  WHERE length >= greatest({LEAST}, {REPEATS} * period)
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs) WHERE k = 1
), listed AS (
  SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), left_over AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS s FROM w LEFT JOIN gone ON gone.r = w.r AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.r
)
SELECT h.doc_id, coalesce(listed.n, 0)::BIGINT AS n_runs, best.start, best.length, best.period,
       ((1000 * best.length) // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(left_over.s, '')) AS collapsed_sha256
FROM h LEFT JOIN listed ON listed.r = h.r LEFT JOIN best ON best.r = h.r LEFT JOIN left_over ON left_over.r = h.r"""
