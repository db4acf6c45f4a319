"""Parts of labelled pages: ways to hold the content, other parts of a page, and layouts that put them together."""

from __future__ import annotations

SENTENCES = (
    "The river rose by two metres in the course of one night, and the lower road was closed.",
    "Nobody expected the old bridge to hold, but it did.",
    "Engineers measured the flow at six places; their figures are listed below.",
    "In the following spring the council voted for a new wall, which cost less than planned.",
    "A second report, published last week, comes to the same result.",
    "It took three years to repair the harbour.", "Most families came back within a month.",
    "What remains is the question of who pays for the next flood.",
)
LINKS = ("Home", "News", "About us", "Contact", "Archive", "Sport", "Weather", "Imprint", "Jobs", "Shop")


def prose(start: int, count: int) -> str:
    return " ".join(SENTENCES[(start + place) % len(SENTENCES)] for place in range(count))


def links(start: int, count: int, mark: str = "li") -> str:
    return "".join(f'<{mark}><a href="/{place}">{LINKS[(start + place) % len(LINKS)]}</a></{mark}>' for place in range(count))


#: Sentences of a paragraph: mostly few, some very many.
LENGTHS = (1, 2, 3, 1, 5, 8, 2, 40, 4, 1, 12, 25, 3, 100)


def paragraph(start: int) -> str:
    """Some paragraphs have no full stop, some are a few words."""
    text = prose(start, LENGTHS[start % len(LENGTHS)])
    if start % 5 == 4:
        text = text.replace(".", "").replace(";", "")
    return " ".join(text.split()[:1 + start % 6]) if start % 4 == 3 else text


def body(start: int) -> str:
    """Headings, paragraphs of any length, a list, a quotation and a table."""
    if start % 6 == 5:  # some articles are a line or two
        return f"<h1>{' '.join(SENTENCES[start % 8].split()[:1 + start % 5])}</h1>" * (start % 4 != 3) + "".join(
            f"<p>{' '.join(SENTENCES[(start + place) % 8].split()[:1 + start % 13])}</p>" for place in range(1 + start % 3))
    if start % 6 == 2:  # and some a short paragraph or two
        return f"<h1>{' '.join(SENTENCES[start % 8].split()[:1 + start % 7])}</h1>" * (start % 5 != 4) + "".join(
            f"<p>{prose(start + place, 1 + (start + place) % 2)}</p>" for place in range(1 + start // 6 % 2)) + (
            f"<p>{' '.join(SENTENCES[start % 8].split()[:1 + start % 4])}</p>" * (start // 6 % 3 == 0))
    kind = start % 4
    text = f"<h1>{prose(start, 1)}</h1>" * (start % 7 != 6) + "".join(
        f"<p>{paragraph(start * 3 + place)}</p>" for place in range(1 + start % 9))
    if kind % 2:
        text += f"<h2>What follows</h2><ul><li>{prose(start, 1)}</li><li>{prose(start + 1, 1)}</li></ul><p>See above.</p>"
    if start % 3:
        item = "<li><p>{}</p></li>" if start % 2 else "<li>{}</li>"
        mark = ("ul", "ol")[start // 2 % 2]
        text += f"<{mark}>" + "".join(item.format(paragraph(start + place)) for place in range(2 + start % 5)) + f"</{mark}>"
    if kind == 2:
        text += f"<blockquote><p>{prose(start, 2)}</p></blockquote><p>So it <a href='/x'>was said</a> then.</p>"
    if kind == 3:
        text += "<table><tr><th>Place</th><th>Flow</th></tr><tr><td>North gate</td><td>14 cubic metres</td></tr></table>"
        text += f"<figure><img src=x><figcaption>{prose(start, 1)}</figcaption></figure><pre>a = 1</pre>"
    return text


def flowing(start: int) -> str:
    """Text that stands directly in its element: paragraphs are parted by line breaks, or not at all."""
    gap = ("<br><br>", "<br>", " ", "<br/>\n<br/>")[start % 4]
    text = gap.join(paragraph(start * 5 + place) for place in range(1 + start % 6))
    return f"<h{1 + start % 2}>{prose(start, 1)}</h{1 + start % 2}>" * (start % 3 != 2) + text


def _main(opening: str, closing: str, content=body):
    return lambda start: f'<{opening} data-label="main">{content(start)}</{closing}>'


MAIN = (
    _main("article", "article"), _main("article", "article"), _main('article class="post entry"', "article"), _main("main", "main"),
    _main('div id="content"', "div"), _main('div class="article-body story text"', "div"),
    _main('section class="post-content entry-content"', "section"), _main('div class="main"', "div"), _main("div", "div"),
    _main('div itemprop="articleBody"', "div"), _main('div class="page-body copy"', "div"),
    _main("article", "article", flowing), _main('div class="story text"', "div", flowing), _main("div", "div", flowing),
    _main('div class="post-body entry"', "div", flowing), _main('div id="content"', "div", flowing),
)


def _other(text: str) -> str:
    """The outermost element of ``text``, labelled."""
    name, rest = text[1:].split(">", 1)
    return f'<{name} data-label="other">{rest}'


def _set(number: int) -> tuple[str, str, str]:
    """What stands before, inside and after the content."""
    menus = (f"<nav><ul>{links(number, 6)}</ul></nav>", f'<div class="menu navbar navigation"><ul>{links(number, 8)}</ul></div>',
             f'<ul id="nav" class="topnav">{links(number, 5)}</ul>', f'<div role="navigation">{links(number, 4, "span")}</div>')
    headers = (f"<header><h1>The Daily Post</h1><p>{prose(number, 1)}</p></header>",
               f'<header class="header masthead site-header"><h1>The Post</h1><p>{prose(number + 1, 1)}</p></header>',
               f'<div id="header" class="banner top">{prose(number, 1)}</div>', f'<header role="banner">{links(number, 2, "p")}</header>')
    notices = (f'<div class="cookie-notice consent">{prose(number, 2)} <a href="/c">Accept</a></div>',
               f'<div class="alert notice warning gdpr">{prose(number + 2, 1)}</div>',
               f'<div id="banner" class="popup modal overlay">{prose(number, 1)}</div>',
               f'<section class="cookies privacy announcement message">{prose(number, 3)}</section>')
    adverts = (f'<div class="ad">{prose(number, 1)}</div>', f'<div class="ads advert advertisement">{prose(number, 2)} <a href="/buy">{prose(number, 1)}</a></div>',
               f'<aside class="sponsored promo">{prose(number, 2)}</aside>', f'<div id="ad" class="ad sponsor promotion">Buy now! <a href="/ad">{LINKS[number % 10]}</a></div>')
    sides = (f"<aside><h3>Read next</h3><p>{prose(number, 2)}</p><ul>{links(number, 4)}</ul></aside>",
             f'<div class="sidebar widget related"><h2>Related</h2><p>{prose(number, 3)}</p></div>',
             f'<div id="sidebar" role="complementary"><p>{prose(number, 2)}</p></div>',
             f'<section class="related recommended teaser more">{links(number, 5, "p")}<p>{prose(number, 1)}</p></section>')
    forms = (f'<form><p>{prose(number, 1)}</p><label>Name</label><input></form>',
             f'<form class="search newsletter subscribe"><p>{prose(number, 2)}</p></form>',
             f'<div class="newsletter signup subscribe login"><p>{prose(number, 2)}</p><form><label>Mail</label></form></div>',
             f'<form id="contact" class="form contact register"><fieldset><legend>Write</legend><p>{prose(number, 1)}</p></fieldset></form>')
    comments = (f'<div class="comments"><h3>Comments</h3><div class="comment"><p>{prose(number, 3)}</p></div></div>',
                f'<section id="comments" class="responses replies"><ol><li class="comment reply"><p>{prose(number, 2)}</p></li></ol></section>',
                f'<div class="comment-list discussion disqus"><article class="comment"><p>{prose(number, 4)}</p></article></div>',
                f'<ul class="comments thread feedback"><li class="comment user"><p>{prose(number, 2)}</p><p>{prose(number + 1, 1)}</p></li></ul>')
    shares = (f'<div class="share social">{links(number, 3, "span")}</div>', f'<p class="breadcrumb breadcrumbs">{links(number, 3, "span")}</p>',
              f'<div class="tags meta byline author">{prose(number, 1)}</div>', f'<ul class="pagination pager toc">{links(number, 4)}</ul>')
    footers = (f"<footer>&copy; The Post. {prose(number, 1)}</footer>", f'<div class="footer site-footer"><p>{prose(number, 2)}</p></div>',
               f'<div id="footer" role="contentinfo" class="copyright legal">{prose(number, 1)}</div>', f"<footer><ul>{links(number, 6)}</ul><p>{prose(number, 3)}</p></footer>")
    pick = lambda kinds, step: _other(kinds[(number // step) % 4])
    before = pick(headers, 1) * (number % 3 != 0) + pick(menus, 1) + pick(notices, 2) * (number % 2) + pick(adverts, 1)
    inside = (pick(adverts, 2), pick(shares, 1), "", pick(forms, 1), "", pick(comments, 3))[number % 6]
    after = pick(comments, 1) * (number % 4 != 1) + pick(sides, 1) + pick(forms, 2) * (number % 2) + pick(shares, 2) + pick(footers, 1)
    return before, inside, after


OTHER = tuple(_set(number) for number in range(16))


def _held(main: str, inside: str, number: int) -> str:
    """``main`` with another part in it: after a paragraph or line break of its own, or at its end."""
    if not inside:
        return main
    ends = [place + len(mark) for mark in ("</p>", "<br>") for place in range(len(main)) if main.startswith(mark, place)]
    at = sorted(ends)[len(ends) // 2] if ends and number % 3 else main.rindex("</")
    return main[:at] + inside + main[at:]


def _page(content: str, opening: str = "<body>") -> str:
    return f"<!DOCTYPE html><html><head><title>The Post</title></head>{opening}{content}</body></html>"


def plain(main, others: tuple[str, str, str], number: int) -> str:
    before, inside, after = others
    return _page(before + _held(main(number), inside, number) + after)


def wrapped(main, others: tuple[str, str, str], number: int) -> str:
    before, inside, after = others
    return _page(f'<div class="page wrapper container">{before}<div class="row columns">{_held(main(number), inside, number)}'
                 f"</div>{after}</div>")


def tabled(main, others: tuple[str, str, str], number: int) -> str:
    """A layout table: menus in one cell, the content in another."""
    before, inside, after = others
    menu = f'<td data-label="other">{links(number, 1 + number % 6, ("p", "div", "span")[number % 3])}</td>'
    return _page(f"{before * (number % 2)}<table><tr>{menu * (number % 4 != 3)}<td>{_held(main(number), inside, number)}</td></tr></table>{after}")


def bare(main, others: tuple[str, str, str], number: int) -> str:
    """Content that stands in the body itself, on some pages alone."""
    before, inside, after = others if number % 3 else ("", "", "")
    content = (body, flowing)[number % 2](number)
    return _page(before + _held(content + "</", inside, number)[:-2] + after, '<body data-label="main">')


#: With and without containers around, in a table, and without any element of its own.
LAYOUTS = (plain, wrapped, tabled, bare)
