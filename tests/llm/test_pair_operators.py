"""Near-duplicates, vectors, pages, archives and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import components, documents, near_groups, odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from perilframe.llm import html, minhash, vectors, warc
from perilframe.llm.components import components as spark_components
from perilframe.llm.queries import vocabulary


# ---- components ------------------------------------------------------------------------------
def test_components_of_chains_stars_and_loops(spark):
    links = ([(n, n + 1) for n in range(1, 60)] + [(200, n) for n in range(201, 260)] + [(300, 300), (259, 61), (61, 62)]
             + [(n, n + 50) for n in range(400, 450)] + [(450, 449)])
    frame = spark.createDataFrame([*links, (None, 5), (7, None), links[0]], "a long, b long")
    real = [(a, b) for a, b in links if a != b]
    expected = components({node for link in real for node in link}, real)
    assert {row["node"]: row["root"] for row in spark_components(frame).collect()} == expected
    assert spark_components(frame.limit(0)).count() == 0


# ---- near-duplicate documents ----------------------------------------------------------------
def near_texts():
    """Groups with edits of all sizes, chains of copies of copies, a shared passage, exact copies and very short texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for group in range(25):
        base = [word() for _ in range(60 + group * 4)]
        texts.append(" ".join(base))
        for copy in range(6):
            changed = list(base)
            for _ in range(copy):
                changed[rng.randrange(len(base))] = word()
            texts.append(" ".join(changed))
            if copy % 3 == 2:
                base = changed
    passage = [word() for _ in range(80)]
    texts += [" ".join(passage + [word() for _ in range(20 + n % 30)]) for n in range(60)]
    texts += [texts[0]] * 20 + ["", "", "one", "one", "One!", "two words", "!!", "!!", "!?"]
    return texts


@pytest.mark.parametrize("chunk", [256, 5])
def test_groups_match_brute_force(spark, chunk):
    texts = dict(enumerate(near_texts()))
    got = {row["doc_id"]: row for row in minhash.grouped(documents(spark, list(texts.values())), chunk=chunk).collect()}
    expected = near_groups(texts)
    assert {doc: row["group_id"] for doc, row in got.items()} == expected
    sizes = Counter(expected.values())
    assert all(row["group_size"] == sizes[expected[doc]] and row["kept"] == (doc == expected[doc]) for doc, row in got.items())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    elements = minhash.mixed(np.arange(300, dtype=np.uint64))
    a, b = rng.integers(1, 20, 300).astype(float), rng.integers(1, 20, 300) * 0.5
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = (minhash.signature(elements, a, 3000) == minhash.signature(elements, b, 3000)).mean()
    assert abs(got - want) < 0.04
    assert (minhash.signature(elements, a, 64) == minhash.signature(elements[::-1], a[::-1], 64)).all()


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = "ab  cd,EF ghé ij " * 50
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "SEGMENT", 7)
    assert (minhash.word_hashes(text) == whole).all() and len(whole) == 250
    assert len(minhash.word_hashes(" ,. ")) == 0


def test_dedup_keeps_one_row_and_all_columns(spark):
    frame = odd_documents(spark)
    made = minhash.deduplicated(frame)
    assert made.columns == frame.columns
    # Three rows without text stay; of the empty text, the blank one and the repeated row, one each.
    assert Counter(row["doc_id"] for row in made.collect()) == Counter([1, 2, 3, 4, None, 5, 6, 7, None])
    assert minhash.grouped(frame).count() == frame.count()
    assert minhash.deduplicated(documents(spark, []).limit(0)).count() == 0


# ---- vectors ---------------------------------------------------------------------------------
def vector_rows():
    rng = np.random.default_rng(11)
    rows = []
    for group in range(12):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * spread).tolist() for spread in np.linspace(0, 0.9, 14)]
    rows += [rows[3]] * 9 + [[2 * x for x in rows[5]], [0.0] * 16, None, [], [float("nan")] * 16, [1.0] * 15 + [None],
                             [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    return [(place, vector) for place, vector in enumerate(rows)]


@pytest.mark.parametrize("block", [8192, 20])
def test_vectors_match_sql(spark, block):
    frame = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = Counter(map(tuple, vectors.linked(frame, block_rows=block).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [tuple(row)[:2] for row in frame.collect()])
    expected = Counter(con.execute(vectors.ORACLE).fetchall())
    assert got == expected and sum(row[1] > 0 for row in expected) > 50
    assert vectors.linked(frame.limit(0)).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(2)
    block = vectors.Quantised(rng.normal(size=(200, 24)) * np.exp(rng.normal(size=(200, 1))))
    exact = block.unit @ block.unit.T
    near = (block.whole * block.scale[:, None]) @ (block.whole * block.scale[:, None]).T
    assert (np.abs(exact - near) <= block.error[:, None] + block.length[:, None] * block.error[None, :] + 1e-12).all()
    for least in (0.1, 0.5):
        found = {(int(i), int(j)) for a, b in vectors.strips(block, block, least, True) for i, j in zip(a, b)}
        assert found == {(i, j) for i in range(200) for j in range(i) if exact[i, j] >= least}


# ---- pages -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    return html.fit(html.labelled_pages(spark))


TEXT = "Some words of an article that go on for a while, as they do. And another sentence follows here."


@pytest.mark.parametrize("page,text", [
    (f"<nav><a href=/>x</a></nav><article><h1>Title</h1><p>{TEXT}<p>a &amp; <b>b</b>c<br>d</article><footer>{TEXT}</footer>",
     f"Title\n{TEXT}\na & bc d"),
    (f"<header><h2>Site</h2></header><main><p>{TEXT}</p><ul><li>{TEXT}</li></ul></main><aside><p>{TEXT}</p></aside>", f"{TEXT}\n{TEXT}"),
    (f"<div class=story><p>{TEXT}</p><div class=advert>{TEXT}</div><p>{TEXT}</p></div><div id=comments><p>{TEXT}</p></div>",
     f"{TEXT}\n{TEXT}"),
    (f"<article><p>{TEXT}</p><p>{TEXT}</p></article><div class='cookie notice'>{TEXT}</div><form><p>{TEXT}</p></form>",
     f"{TEXT}\n{TEXT}"),
    (f"<script>var a='<p>{TEXT}</p>'</script><style>p{{}}</style><!-- <p>no</p> --><article><p>{TEXT}</p><p>x < y", f"{TEXT}\nx < y"),
    ("", ""), (None, ""),
])
def test_main_text(model, page, text):
    assert html.main_text(page, model) == text


BODY = "<article><h1>High water</h1><p>{}The river rose in one night, and the lower road was closed.</p><p>Nobody was hurt.</p></article>"
BODY_TEXT = "High water\nThe river rose in one night, and the lower road was closed.\nNobody was hurt."


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body>" + BODY.format("") + "</body></html>",
    "<html><head><title>x</title><meta charset=utf-8><script>a = 1</script>" + BODY.format("") + "</html>",
    "<html><head><title>x</title></head><body>" + BODY.format("<svg viewBox='0 0 1 1'/>") + "</body></html>",
    "<html><head><title>x</title></head><body>" + BODY.format("<svg><path d='M0 0'/><g/></svg>") + "</body></html>"])
def test_open_heads_and_closed_drawings_silence_nothing(model, page):
    assert html.main_text(page, model) == BODY_TEXT


def test_text_ends_an_open_head():
    _, blocks = html.tree("<head><title>x</title>\n<style>p {}</style>One. <b>Two.</b><p>Three.")
    assert [text for _, text in blocks] == ["One. Two.", "Three."]


def test_marginals_are_exact(model):
    """Messages against the sum over all states of all nodes."""
    from itertools import product

    nodes, _ = html.tree("<div><p>one two.</p><ul class=menu><li><a>x</a></li><li>y</li></ul></div>")
    html.describe(nodes)
    weight = [[np.exp(sum(model.seen.get(name, [0, 0, 0])[s] for name in node.features)) for s in html.STATES] for node in nodes]
    total, content = 0.0, np.zeros(len(nodes))
    for states in product(html.STATES, repeat=len(nodes)):
        value = np.prod([weight[at][s] for at, s in enumerate(states)])
        value *= np.prod([model.follow[states[node.parent]][states[at]] for at, node in enumerate(nodes) if at])
        total += value
        content += value * (np.array(states) == html.CONTENT)
    assert np.allclose(model.marginals(nodes), content / total)


def test_labelled_pages_are_learnt(spark):
    """Held-out accuracy: fitted on half of the labelled pages."""
    pages = [row["html"] for row in html.labelled_pages(spark).collect()]
    random.Random(1).shuffle(pages)
    fitted = html.fit(spark.createDataFrame([(page,) for page in pages[::2]], "html string"))
    right = total = 0
    for page in pages[1::2]:
        nodes, blocks = html.tree(page)
        html.describe(nodes)
        content = fitted.marginals(nodes)
        right += sum((content[node] > 0.5) == (nodes[node].label == "main") for node, _ in blocks)
        total += len(blocks)
    assert right / total > 0.95


def test_extraction_query_shape(spark, model):
    frame = spark.createDataFrame([(1, "u", f"<article><p>{TEXT}é</p><p>{TEXT}</p></article>"), (None, None, None), (2, "v", "")],
                                  "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {row["page_id"]: row for row in html.extracted(frame, model).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) > 10 and got[None]["text"] == got[2]["text"] == ""
    assert html.extracted(frame.limit(0), model).count() == 0


# ---- archives --------------------------------------------------------------------------------
def test_store_names():
    assert warc.store_of("/tmp/a b")[1] == "/tmp/a b" and warc.store_of("file:///tmp/x")[1] == "/tmp/x"
    assert warc.SCHEMES["s3a"] == "s3"


def test_ranges_stay_tasks(spark):
    files = spark.createDataFrame([("/none", 40 << 20)], "path string, size long")
    assert warc.read(files).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("range_bytes", [1 << 20, 7000, 700, 97])
def test_archives_match_sql(spark, range_bytes):
    inner = warc.member(warc.record(9, "u", b"inner", "0" * 64, None), level=0).decode("latin-1")
    rows = [(1, "http://a/é x\r\n", TEXT * 3), (2, None, TEXT * 3), (0, "b", TEXT * 3), (0, "b", TEXT * 3), (5, "c", None), (6, "d", ""),
            (7, "e", "short"), (8, "f", "short"), (None, "g", TEXT * 3), (10, "h", "\x1f\x8b\x08 raw" * 40), (11, "i", inner * 20),
            (12, "j", "é" * 50), (13, "k", "é" * 50)]
    if range_bytes > 1000:
        rows.append((14, "l", "".join(hashlib.sha256(b"%d" % n).hexdigest() for n in range(16_000))))  # a member of several steps
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    back = warc.read(warc.write(frame), range_bytes)
    kept = F.col("payload").isNotNull()
    got = Counter(map(tuple, back.select(
        "page_id", F.when(kept, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long"),
        F.when(kept, F.sha2("payload", 256)).otherwise(F.col("declared_digest")), "record_type", "refers_to").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == Counter(con.execute(warc.ORACLE).fetchall())
    assert Counter(map(tuple, warc.archived(frame).collect())) == got
    assert warc.archived(frame.limit(0)).count() == 0


# ---- pipeline --------------------------------------------------------------------------------
def test_pipeline_by_brute_force(spark, tmp_path):
    clean = " ".join(f"the word{n} of a place and" for n in range(30))
    texts = [clean + " 4041894974608795", clean + " 4041894974608795 x", "junk " * 50, clean.replace("place", "house") + " a@b.example", None]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append(docs)
    assert [sorted(row["doc_id"] for row in kept.collect()) for kept in seen[:3]] == [[0, 1, 3], [0, 3], [0, 3]]
    assert all(kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] for kept in seen[:3])
    text = {row["doc_id"]: row["text"] for row in seen[2].collect()}
    assert text[0].startswith(clean) and "4041894974608795" not in text[0] and "a@b" not in text[3]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    packed = {row["doc_id"]: row["doc_tokens"] for row in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == {doc: len(tokenizer.encode(value, add_special_tokens=False).ids) + 1 for doc, value in text.items()}
