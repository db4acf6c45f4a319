"""Small tables and brute-force versions for the tests of the corpus operators."""

from __future__ import annotations

import re
from itertools import combinations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    rows = [(start + place, text, "en", "s", None if text is None else len(text)) for place, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def odd_documents(spark):
    """Null and empty texts, a null id, a repeated row, a very long text, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{number} the {number % 7}" for number in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "no id here at all"),
            (5, long), (6, "x" * 50_000), (7, "é ß 漢字 \x1c   \U0001f600"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", F.lit("a").alias("key"), F.lit(1).alias("n_words"), F.lit(2).alias("row"), F.lit(True).alias("kept"),
                        F.lit("z").alias("node"), F.lit(0).alias("size"), F.lit(9).alias("part"))


def shingle_set(text, width=5):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[at:at + width]) for at in range(len(words) - width + 1))


def components(nodes, links):
    parent = {node: node for node in nodes}

    def top(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {node: top(node) for node in nodes}


def near_groups(texts, least=0.8):
    """Least id of each text's component; ``texts`` maps ids to texts."""
    sets = {doc: shingle_set(text) for doc, text in texts.items()}
    links = []
    for a, b in combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if texts[a] == texts[b] or common and common >= least * (len(sets[a]) + len(sets[b]) - common):
            links.append((a, b))
    return components(texts, links)
