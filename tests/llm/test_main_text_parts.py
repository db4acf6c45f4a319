"""Main text where text stands directly beside other parts of a page, on pages unlike the labelled ones."""

from collections import Counter

import pytest

from perilframe.llm import html
from perilframe.llm.training_pages import SENTENCES

S = "The council met on Monday to discuss the new harbour wall."
NAV = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>"


@pytest.fixture(scope="module")
def model():
    counts = Counter()
    for number, (layout, main, others) in enumerate(html.product(html.LAYOUTS, html.MAIN, html.OTHER)):
        counts.update(html.labelled_counts(layout(main, others, number)))
    return html.Model(counts)


@pytest.mark.parametrize("page,text", [
    (f'{NAV}<article>{S} {S} {S}<div class="comments"><p>Nice one</p><p>me too, great read</p></div></article>', f"{S} {S} {S}"),
    (f'{NAV}<div class="post-body">{S} {S}<div class="share"><a href=x>Tweet</a> <a href=y>Share</a></div>Second part. {S}</div>',
     f"{S} {S}\nSecond part. {S}"),
    (f'<div class="story">{S}<br><br>{S}<div class="ad">Buy now! <a>Click</a></div></div>', f"{S} {S}"),
    (f"<table><tr><td><a href=/>Home</a></td><td>{S} {S} {S}</td></tr></table>", f"{S} {S} {S}"),
    (" ".join([S] * 6), " ".join([S] * 6)), (f"<html><body>{S} {S} {S}</body></html>", f"{S} {S} {S}"), (f"<p>{S}</p><p>{S}</p>", f"{S}\n{S}"),
    (f"<body>{NAV}{S} {S}<hr>{S}<footer>Imprint and more</footer></body>", f"{S} {S}\n{S}"),
])
def test_text_beside_other_parts(model, page, text):
    assert html.main_text(page, model) == text


WORDS = ("Rainfall in the valley doubled.", "Farmers met at the old mill.", "The mayor, who had opposed the plan, gave way.",
         "Costs will be shared by both towns.", "A first part is due in May.")


def other_pages():
    """Pages with their texts, built from words and layouts that the labelled pages don't hold."""
    for number in range(60):
        text = [" ".join(WORDS[(number + at + k) % 5] for k in range(1 + (number + at) % 4)) for at in range(2 + number % 4)]
        holder = ("article", 'div class="news-text"', 'section id="main-content"', "main", 'td class="content"')[number % 5]
        close = holder.split()[0]
        comment = '<div class="comment-thread"><p>Well said</p><p>I was there and it rained all day.</p></div>'
        advert = '<div class="sponsor-box">Cheap flights, <a href=/f>book here</a></div>'
        share = '<ul class="social-share"><li><a href=1>Mail</a></li><li><a href=2>Print</a></li></ul>'
        inner = (advert, share, comment, "")[number % 4]
        body = [f"<p>{part}</p>" for part in text] if number % 2 else [part + "<br><br>" for part in text]
        if number % 2 == 0 and inner:
            expected = [" ".join(text[:1]), " ".join(text[1:])]
        else:
            expected = text if number % 2 else [" ".join(text)]
        content = f"<{holder}>{body[0]}{inner}{''.join(body[1:])}</{close}>"
        content = f"<table><tr>{content}</tr></table>" if close == "td" else content
        yield (f'<body><div class="topbar"><a href=/>Start</a> <a href=/b>Region</a></div>{content}'
               f'<div class="widget sidebar"><h4>Most read</h4><a href=/c>{WORDS[0]}</a></div><footer>Imprint 2020</footer></body>', expected)


def test_other_pages_by_block(model):
    """Precision and recall of blocks; the figures stand in README.md."""
    right = wrong = missed = 0
    for page, expected in other_pages():
        found = [block for block in html.main_text(page, model).split("\n") if block]
        hits = sum((Counter(found) & Counter(expected)).values())
        right, wrong, missed = right + hits, wrong + len(found) - hits, missed + len(expected) - hits
    print("precision", right / (right + wrong), "recall", right / (right + missed))
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_deep_and_long_pages(model):
    deep = "<div>" * 20_000 + f"<p>{S}</p>" + "</div>" * 20_000
    assert html.main_text(deep, model) in (S, "")
    long = f"<article>{''.join(f'<p>{s} {S}</p>' for s in SENTENCES * 3000)}</article>"
    assert html.main_text(long, model).count("\n") == 8 * 3000 - 1
    assert html.main_text(f"<article><p>{S * 50_000}</p></article>", model) == S * 50_000


def test_repeated_rows(spark, model):
    rows = [(1, "u", f"<article><p>{S}</p><p>{S}</p></article>")] * 3
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert [row["text"] for row in got] == [f"{S}\n{S}"] * 3
