"""Quality rules, licences, tokens, packing, sharding and pseudonyms against SQL, libraries and brute force."""

import base64
import datetime as dt
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import pytest
from helpers import documents, odd_documents
from pyspark.sql import functions as F

from perilframe.llm import bpe, licences, packing, pii, quality, sharding
from perilframe.llm.licence_texts import LICENCES
from perilframe.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def by_sql(frame, name, sql):
    con = duckdb.connect()
    con.register(name, frame)
    return Counter(tuple(map(repr, row)) for row in con.execute(sql).fetchall())


def rows_of(frame):
    return Counter(tuple(map(repr, row)) for row in frame.collect())


def empty(spark):
    return documents(spark, []).limit(0)


# ---- quality rules ---------------------------------------------------------------------------
def test_quality_matches_sql(spark):
    texts = ["a b c d e f g h " * 4, "the line\nthe line\n\n \nthe line\nthe of " + "x y " * 20, "AA!! BB!! " * 30,
             "of the and to in a is that it " * 3 + "*** $$$ #", "\x0b\x0c", "é ñ x " * 25]
    frame = documents(spark, texts).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    got = rows_of(quality.judged(frame).select(*quality.CONTRACT))
    held = frame.toPandas().astype({"doc_id": "Int64"})
    assert got == by_sql(held, "documents", quality.oracle())


def test_quality_repeats_by_brute_force(spark):
    text = " ".join("abcdefghij"[number % 10] for number in range(23)) + " z q r s t u v w a b c d e f g h"
    words, seen = text.split(), defaultdict(list)
    for at in range(len(words) - 7):
        seen[tuple(words[at:at + 8])].append(at)
    covered = {at + k for places in seen.values() if len(places) > 1 for at in places for k in range(8)}
    row = quality.measured(documents(spark, [text])).first()
    assert row["n_repeat_words"] == len(covered) > 0


def test_quality_keeps_columns_and_rows(spark):
    frame = odd_documents(spark)
    kept = quality.kept(frame)
    assert kept.columns == frame.columns
    assert {row["doc_id"] for row in kept.collect()} <= {5}
    assert quality.kept(empty(spark)).count() == 0


@pytest.mark.parametrize("lang,kept", [("pl", True), (None, True), ("tr-TR", True), ("en", False), ("de-AT", False)])
def test_function_words_are_asked_for_in_known_languages_only(spark, lang, kept):
    text = " ".join(f"słowo{chr(97 + number)} rzeka{chr(97 + number)} miasto" for number in range(12)) + "."
    frame = documents(spark, [text]).withColumn("lang", F.lit(lang).cast("string"))
    row = quality.judged(frame).first()
    assert row["kept"] == row["rule_stop_words"] == kept and quality.kept(frame).count() == kept
    assert quality.kept(frame).columns == frame.columns and "_other_language" not in row


# ---- licences --------------------------------------------------------------------------------
def test_licences_match_sql(spark):
    texts = ["Copyright (c) 2020 X\n\n" + LICENCES["MIT"].upper().replace("\n", " \n "),
             LICENCES["ISC"].replace(",", " ;"), "Released under the MIT Licence.\nx\nlicensed under CC BY-NC 4.0", "© 2020 x"]
    frame = documents(spark, texts).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    got = rows_of(licences.scanned(frame).select("doc_id", "digest", "licence", "notices"))
    assert got == by_sql(frame.toPandas().astype({"doc_id": "Int64"}), "documents", licences.oracle())
    found = {row["doc_id"]: row for row in licences.scanned(documents(spark, texts)).collect()}
    assert [found[n]["licence"] for n in range(4)] == ["MIT", "ISC", None, None]
    assert found[2]["notices"] == ["CC-BY-NC-4.0", "MIT"]


def test_every_notice_is_found(spark):
    notices = [form.format(name) for names in licences.NAMES.values() for name in names for form in licences.FORMS]
    texts = [*notices, " " * 300 + "Released   under\tCC BY 4.0" + " " * 300, "Re*leased under the MIT.", "DISTRIBUTED UNDER THE MIT!"]
    frame = documents(spark, texts).select("doc_id", "text")
    got = rows_of(licences.scanned(frame))
    assert got == by_sql(frame.toPandas(), "documents", licences.oracle())
    assert all(row["notices"] for row in licences.scanned(frame).collect())


def test_further_licence_texts(spark):
    more = spark.createDataFrame([("Own-1.0", "Do as you like, at your own risk."), ("Other", LICENCES["MIT"])], "licence string, text string")
    frame = documents(spark, ["DO as you like -- at your own risk", LICENCES["MIT"]])
    assert [row["licence"] for row in licences.scanned(frame, more).orderBy("doc_id").collect()] == ["Own-1.0", "MIT"]


@pytest.mark.parametrize("name", sorted(LICENCES))
def test_known_licences_do_not_collide(name):
    assert licences.known_licences()[licences.digest(LICENCES[name])] == name


def test_wrapping_does_not_change_a_digest():
    assert licences.digest(LICENCES["MIT"]) == licences.digest(LICENCES["MIT"].replace(" ", "\n"))


# ---- byte-level BPE --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 12), (700, 60), (64, 16)])
def test_bpe_matches_whole_texts(spark, encoding, chunk, overlap):
    frame = odd_documents(spark).select("doc_id", "text").unionByName(documents(spark, [
        "it's we're they'll " * 40, "a" * 900, "   \n\n\t  " * 60, "12 345 ...!!" * 50, "x'r e' s'l l " * 30], 100).select(
        "doc_id", "text"))
    expected = Counter()
    for row in frame.collect():
        ids = encoding.encode_ordinary(row["text"] or "")
        expected[row["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256((row["text"] or "").encode()).hexdigest()] += 1
    made = bpe.encode(frame, vocabulary("byte_bpe_multi_50k.tiktoken"), chunk=chunk, overlap=overlap)
    assert Counter(tuple(row) for row in made.collect()) == expected


def test_bpe_empty_and_decode(spark, encoding):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(empty(spark), path).count() == 0
    text = "naïve 漢字 \U0001f600 it's"
    frame = spark.createDataFrame([(encoding.encode_ordinary(text),), ([],), (None,)], "ids array<int>")
    assert [row["raw"] and bytes(row["raw"]) for row in bpe.decode(frame, path).collect()] == [text.encode(), b"", None]


# ---- packing ---------------------------------------------------------------------------------
@pytest.mark.parametrize("windows", [1024, 2])
def test_packing_is_whole_and_tight(spark, windows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    special = ["end <|endoftext|> next <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|>.<|endoftext|>Wörd<|STARTofTEXT|>", "A<|endoftext|>B\x1c<|startoftext|>\u2003Σ",
               "<|endoftext|", " <|endoftext|>", "<|ENDOFTEXT|>"]
    frame = odd_documents(spark).select("doc_id", "text").unionByName(
        documents(spark, ["Σίσυφος don't a.b, <|endoftext|> word. " * (n % 37 + 1) for n in range(300)] + special, 100).select("doc_id", "text"))
    assert tokenizer.encode(special[0], add_special_tokens=False).ids == [806, 49407, 1131, 49406]
    pieces = Counter()
    for row in frame.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 4096):
            part = ids[at:at + 4096]
            pieces[row["doc_id"], at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    got = packing.packed_documents(frame, vocabulary("word_bpe_49k.json"), windows=windows).collect()
    assert Counter(tuple(row)[:5] for row in got) == pieces
    sequences = defaultdict(list)
    for row in got:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(row["length"] for row in got)
    groups = -(-total // (4096 * windows))
    assert len(sequences) <= -(-total // 4096) + 2 * groups


def test_fill_by_brute_force():
    for lengths in ([3, 3, 5, 7, 9], [4, 4, 4], [11], [2, 6, 6, 8], [1] * 9):
        sums = {sum(value * count for value, count in zip(sorted(set(lengths)), counts))
                for counts in product(*[range(lengths.count(value) + 1) for value in sorted(set(lengths))])}
        chosen = packing.best_fill(dict(Counter(lengths)), 12)
        assert sum(length * count for length, count in chosen.items()) == max(s for s in sums if s <= 12)
        assert all(count <= lengths.count(length) for length, count in chosen.items())


def test_packing_nothing(spark):
    assert packing.packed_documents(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0


# ---- sharding --------------------------------------------------------------------------------
@pytest.mark.parametrize("cell_rows", [1_000_000, 15])
def test_shards_are_even_and_gapless(spark, cell_rows):
    frame = odd_documents(spark).select("doc_id", "text").unionByName(
        documents(spark, [f"text {n}" for n in range(700)], 50).select("doc_id", "text")).unionByName(
        documents(spark, ["same"] * 300).select(F.lit(77).cast("long").alias("doc_id"), "text"))
    got = sharding.sharded(frame, cell_rows=cell_rows).collect()
    slots = defaultdict(list)
    for row in got:
        slots[row["shard"]].append(row["slot"])
    assert sorted(slots) == list(range(40))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((row["doc_id"], len((row["text"] or "").encode()) + 16, zlib.crc32((row["text"] or "").encode()))
                   for row in frame.collect())
    assert Counter((row["doc_id"], row["size"], row["text_crc32"]) for row in got) == want
    assert sharding.sharded(empty(spark)).count() == 0


def test_a_further_shard_moves_little(spark):
    frame = documents(spark, [f"text {n}" for n in range(4000)])
    before, after = ({row["doc_id"]: row["shard"] for row in sharding.sharded(frame, shards).collect()} for shards in (40, 41))
    moved = sum(before[doc] != after[doc] for doc in before)
    assert moved < 0.25 * len(before)  # dealing anew would move nearly all


# ---- pseudonyms ------------------------------------------------------------------------------
def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + at % 2), 10)) for at, d in enumerate(reversed(digits))) % 10 == 0


def with_check(body):
    return body + next(str(d) for d in range(10) if luhn(body + str(d)))


def reference_characters(value, key, tweak):
    """The character network of the module, step by step."""
    radix = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in value]
    numbers = [int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0 for c, r in zip(value, radix)]
    half = len(value) // 2
    left, right = numbers[:half], numbers[half:]
    for turn in range(8):
        own, other, base = (left, right, radix[:half]) if turn % 2 == 0 else (right, left, radix[half:])
        seed = "|".join([key, tweak, str(turn), ",".join(map(str, other))])
        stream = "".join(hashlib.sha256(f"{seed}|{block}".encode()).hexdigest() for block in range(len(own) // 32 + 1))
        moved = [(number + int(stream[2 * at:2 * at + 2], 16)) % base[at] for at, number in enumerate(own)]
        left, right = (moved, right) if turn % 2 == 0 else (left, moved)
    made = [str(n) if r == 10 else chr(n + (97 if c.islower() else 65)) if r == 26 else c
            for c, n, r in zip(value, left + right, radix)]
    return "".join(made)


def test_card_numbers_by_brute_force(spark):
    bodies = [f"4{number:014d}" for number in range(0, 99999999999999, 3333333333333)]
    cards = [with_check(body) for body in bodies]
    frame = documents(spark, [f"pay {card}." for card in cards])
    got = [row["text"][4:-1] for row in pii.pseudonymised(frame, "k").orderBy("doc_id").collect()]
    assert got == [with_check(reference_characters(body, "k", "card")) for body in bodies]
    assert len(set(got)) == len(cards) and all(map(luhn, got)) and not set(got) & set(cards)


def test_values_stay_linked_across_notations(spark):
    text = ("4041894974608795 4041-8949-7460-8795 | 2024-02-29 29.02.2024 29/02/2024 | +1 (988) 555-2485 +1 988 555 2485 | "
            "DE89370400440532013000 DE89 3704 0044 0532 0130 00 | Ab.c9@mail.example ab.c9@mail.example")
    row = pii.pseudonymised(documents(spark, [text])).first()
    bare = [re.sub(r"[ -]", "", part) for part in row["text"].split(" | ")]
    assert bare[0][:16] == bare[0][16:] and bare[3][:22] == bare[3][22:]
    assert bare[2].replace("(", "").replace(")", "").count(re.sub(r"\D", "", bare[2])[:11]) == 2
    days = row["text"].split(" | ")[1].split()
    assert dt.date.fromisoformat(days[0]) == dt.datetime.strptime(days[1], "%d.%m.%Y").date() == dt.datetime.strptime(
        days[2], "%d/%m/%Y").date()
    a, b = row["text"].split(" | ")[4].split()
    assert a.lower() == b and a[0].isupper() and not b.startswith("ab.c9") and len(row["text"]) == len(text)
    assert row["n_chars"] == len(text) and row["n_replaced"] == 11
    number = bare[3][:22]
    assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def test_dates_and_social_numbers_are_permuted(spark):
    days = [str(dt.date(1999, 1, 1) + dt.timedelta(n)) for n in range(400)]
    numbers = [f"{area:03d}-{group:02d}-{serial:04d}" for area in (1, 665, 667, 899) for group in (1, 99) for serial in (1, 9999)]
    frame = documents(spark, days + numbers)
    got = [row["text"] for row in pii.pseudonymised(frame).orderBy("doc_id").collect()]
    assert len(set(got[:400])) == 400 and all(dt.date.fromisoformat(day) for day in got[:400])
    assert len(set(got[400:])) == len(numbers)
    for value in got[400:]:
        area, group, serial = map(int, value.split("-"))
        assert 1 <= area <= 899 and area != 666 and group and serial


def test_invalid_values_and_clean_texts_stay(spark):
    texts = ["4041894974608796", "1.2.3.400", "2023-02-29", "666-12-1234", "version 1.2.3, page 12", "a@b", "10:30 = x", "", None]
    frame = documents(spark, texts)
    assert [row["text"] for row in pii.pseudonymised(frame).orderBy("doc_id").collect()] == texts


def test_pseudonyms_keep_rows_and_columns(spark):
    frame = odd_documents(spark)
    made = pii.pseudonymised(frame)
    assert made.columns[:len(frame.columns)] == frame.columns and made.count() == frame.count()
    assert pii.pseudonymised(empty(spark)).count() == 0


def test_pseudonyms_run_no_python(spark):
    plan = pii.pseudonymised(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


CARD, AMEX, SPAIN, GERMANY = "4111 1111 1111 1111", "3782 822463 10005", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"


NEXT_TO_OTHERS = [
    (f"{CARD} 12/25", [CARD]), ("4111111111111111 123", ["4111111111111111"]), (f"{AMEX} 1234", [AMEX]),
    (f"Nr 123456 {CARD}", [CARD]), (f"12 {CARD} 11", [CARD]), (f"1234 {CARD} 5500 0000 0000 0004", [CARD, "5500 0000 0000 0004"]),
    (f"{CARD} 2024-02-29", [CARD, "2024-02-29"]), (f"{CARD} 29/02/2024 12a", [CARD, "29/02/2024"]),
    (f"{CARD} 123-45-6789", [CARD, "123-45-6789"]), (f"{CARD} 77@mail.example", [CARD, "77@"]), (f"{CARD} 1.5", [CARD]),
    ("41111111 11111111 7", ["41111111 11111111"]), ("9 " * 1500 + CARD + " 9" * 1500, [CARD]),
    (f"{SPAIN} BIC CAIXESBB", [SPAIN]), ("ES9121000418450200051332 BIC CAIXESBB", ["ES9121000418450200051332"]),
    (f"ES9121000418450200051332 {GERMANY} BIC", ["ES9121000418450200051332", GERMANY]),
    (f"{SPAIN} {CARD} 123", [SPAIN, CARD]), (f"IBAN {GERMANY} 12", [GERMANY]),
]


@pytest.fixture(scope="module")
def next_to_others(spark):
    rows = pii.pseudonymised(documents(spark, [text for text, _ in NEXT_TO_OTHERS])).collect()
    return {row["doc_id"]: row for row in rows}


@pytest.mark.parametrize("number", range(len(NEXT_TO_OTHERS)))
def test_values_next_to_others_are_replaced(next_to_others, number):
    (text, values), row = NEXT_TO_OTHERS[number], next_to_others[number]
    assert not [value for value in values if value in row["text"]]
    assert len(row["text"]) == len(text) and row["n_replaced"] >= 1
    for value in values:
        at = text.index(value)
        bare = re.sub(r"[ -]", "", row["text"][at:at + len(value)])
        if value in (SPAIN, GERMANY):
            assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        elif len(bare) > 12 and bare.isdigit():
            assert luhn(bare)
    kept = text.replace("@", " ")
    for value in values:
        kept = kept.replace(value.strip("@"), "\0" * len(value.strip("@")))
    assert all(made == own for made, own in zip(row["text"].replace("@", " "), kept) if own != "\0")
