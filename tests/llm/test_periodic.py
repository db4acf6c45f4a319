"""Periodic runs against all periods tried one by one, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import documents, odd_documents

from perilframe.llm import periodic


def tried(words, least=periodic.LEAST, repeats=periodic.REPEATS):
    """Every period in turn; the first that finds a stretch is its smallest."""
    found = {}
    for period in range(1, len(words) // repeats + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - at + period >= max(least, repeats * period) and end > at:
                found.setdefault((at, end - at + period), period)
            at = max(end, at + 1)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda run: (run[0], run[2]))


def mixed(seed):
    draw = random.Random(seed)
    words = [b"%d" % draw.randrange(draw.choice([1, 2, 3, 20])) for _ in range(draw.randrange(140))]
    if words and draw.random() < 0.7:
        first = draw.randrange(len(words))
        period = 1 + (len(words) - first) // draw.randrange(3, 9)
        words = [words[at] if at < first else words[first + (at - first) % period] for at in range(len(words))]
        if draw.random() < 0.5:
            words[draw.randrange(len(words))] = b"x"
    return words


@pytest.mark.parametrize("block", range(8))
def test_runs_by_brute_force(block):
    texts = [mixed(seed) for seed in range(block * 60, block * 60 + 60)]
    assert list(periodic.searched(texts)) == [tried(words) for words in texts]


@pytest.mark.parametrize("least,repeats", [(4, 2), (6, 3), (24, 3)])
def test_automaton_by_brute_force(least, repeats):
    for seed in range(150):
        words = mixed(seed)
        assert sorted(periodic.runs_of(words, least, repeats), key=lambda run: (run[0], run[2])) == tried(words, least, repeats)


def test_states_hold_the_suffixes():
    words = list("abcabcabxabcab")
    link, length, prefix = periodic.automaton(words)
    for at, state in enumerate(prefix):
        ends = []
        while state > 0:
            ends.append(length[state])
            state = link[state]
        assert ends[0] == at + 1 and ends == sorted(set(ends), reverse=True)


TEXTS = [" ".join("ab"[n % 2] for n in range(40)), "x\x0by\x0cz " * 12, "one two three " * 9, "z " * 24, "z " * 23,
         " ".join(f"w{n % 9}" for n in range(27)), " ".join(f"w{n % 9}" for n in range(26)), "p q r s t u v w x y " * 4 + "e " * 30 + "p q r s t u v w x y " * 4]


def test_matches_sql(spark):
    frame = odd_documents(spark).select("doc_id", "text").unionByName(documents(spark, TEXTS, 100).select("doc_id", "text"))
    got = periodic.digests(periodic.found(frame, reworded=periodic.trial))
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(periodic.oracle()).fetchall())


def test_spans_and_texts(spark):
    rows = {row["doc_id"]: row for row in periodic.found(documents(spark, [*TEXTS, None])).collect()}
    for doc, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = tried(words)
        gone = {at for start, length, period in runs for at in range(start + period, start + length)}
        assert [tuple(run) for run in rows[doc]["runs"]] == runs
        assert rows[doc]["collapsed"] == " ".join(word for at, word in enumerate(words) if at not in gone)
    assert rows[3]["collapsed"] == "z" and rows[4]["runs"] == [] and rows[len(TEXTS)]["collapsed"] == ""
    assert [tuple(run) for run in rows[7]["runs"]] == [(0, 40, 10), (40, 30, 1), (70, 40, 10)]


def test_trial_wording():
    words = [b"%d" % n for n in range(50)]
    for doc in range(200):
        checksum = zlib.crc32(str(doc).encode())
        first, n = checksum // 10 % 50, 50
        period = 1 + (n - first) // (3 + checksum // 10 % 8)
        made = [words[at] if at < first else words[first + (at - first) % period] for at in range(n)]
        assert periodic.trial(doc, words) == (words if checksum % 10 else made)
    assert periodic.trial(None, words) == words and periodic.trial(30, []) == []


def test_very_long_text(spark):
    stretch = [f"v{n}" for n in range(40_000)]
    text = " ".join(["start"] + stretch * 3 + ["end"])
    row = periodic.found(documents(spark, [text])).first()
    assert [tuple(run) for run in row["runs"]] == [(1, 120_000, 40_000)] and row["collapsed"] == " ".join(["start"] + stretch + ["end"])


def test_nothing_and_limits(spark):
    assert periodic.found(documents(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.found(documents(spark, ["a"]), repeats=2)
