"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that holds no content, only content, or both, and every run of text that stands
directly in an element is a leaf below it, which is content or not. So an article that holds an advert or its readers'
comments loses none of its own text. A node's potential is the likelihood of what can be seen of it (tag, words of its
attributes, length, links; of a leaf also its sentences), a parent-child potential says how states follow each other, and
sum-product messages, first from the leaves to the root, then back, give each node's exact marginal. A run of text is taken
if the marginal of its leaf is above `LEVEL`, where the labelled pages show few errors of either kind. Both kinds of
potentials are counted from labelled pages by a Spark job (`fit`); in a labelled page, ``data-label`` is ``main`` or
``other`` and holds for all that is inside. `labelled_pages` makes a set for a start; any table with such pages can take
its place.

Defined results: a null or empty html has an empty text; markup that is cut off or badly nested is read as far as it
goes; repeated rows give equal rows; an empty table gives an empty result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import product
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe.llm.training_pages import LAYOUTS, MAIN, OTHER

#: Elements whose text is no text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea",
          "button", "head", "title", "audio", "video"}
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
#: Elements that are part of a line of text; all others are blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "br", "img", "wbr", "ruby", "rt", "rp", "input"}
#: What can stand in a head; anything else ends an open one.
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title", "html", "head"}
#: Elements with a syntax of their own, where "/>" closes.
FOREIGN = {"svg", "math"}
#: What an opening tag ends, if it is open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
#: How far an implied end reaches.
WALLS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "td", "th", "form", "aside",
         "nav", "header", "footer"}

ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-zA-Z][\w:-]*")
TOKEN = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SENTENCE = re.compile(r"[.!?](?=\s|$)")

#: Marginal above which text is taken: missing text costs more than it does to be unsure.
LEVEL = 0.2
#: What an element may be: without content, content only, or a container of both.
STATES = OUTSIDE, CONTENT, MIXED = 0, 1, 2


#: Stands for the tag of a run of text.
TEXT = "#text"


@dataclass
class Node:
    tag: str
    parent: int
    tokens: frozenset[str]
    label: str | None = None
    chars: int = 0
    linked: int = 0
    stops: int = 0
    features: list[str] = field(default_factory=list)


def tag_end(html: str, at: int) -> int:
    """Place of the > that ends the tag starting at ``at``, quoted ones skipped; the end of the page if there is none."""
    quote = ""
    for place in range(at, len(html)):
        mark = html[place]
        if quote:
            if mark == quote:
                quote = ""
        elif mark in "\"'" and html[place - 1] in "= \t\n":
            quote = mark
        elif mark == ">":
            return place
    # A quote that never closes hides nothing.
    return html.find(">", at) if quote and ">" in html[at:] else len(html)


def parts(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", name, attributes) and ("close", name, "") in page order."""
    place, size = 0, len(html)
    while place < size:
        mark = html.find("<", place)
        if mark < 0:
            yield "text", "", html[place:]
            return
        if mark > place:
            yield "text", "", html[place:mark]
        after = html[mark + 1:mark + 2]
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            place = size if end < 0 else end + 3
        elif after in ("!", "?"):
            end = html.find(">", mark)
            place = size if end < 0 else end + 1
        elif after == "/":
            end = html.find(">", mark)
            name = NAME.match(html, mark + 2)
            if name:
                yield "close", name[0].lower(), ""
            place = size if end < 0 else end + 1
        elif after.isascii() and after.isalpha():
            simple = html.find(">", mark)
            end = simple if simple > 0 and not {'"', "'"} & set(html[mark:simple]) else tag_end(html, mark)
            name = NAME.match(html, mark + 1)[0].lower()
            yield "open", name, html[mark + 1 + len(name):end]
            place = end + 1
            if name in RAW:
                closing = re.compile(f"</{name}", re.I).search(html, place)
                place = closing.start() if closing else size
        else:
            yield "text", "", "<"
            place = mark + 1


def attributes(source: str) -> tuple[frozenset[str], str | None]:
    """Words of class, id and role, with "hidden" for what isn't shown; the label, if there is one."""
    if not source.strip(" /"):
        return frozenset(), None
    words, label = set(), None
    for name, value in ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words.update(TOKEN.findall(value.lower()))
        elif name == "hidden" or name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value == "true":
            words.add("hidden")
        elif name == "data-label":
            label = value
    return frozenset(words), label


def tree(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements and runs of text in page order, the root first, and the texts with the leaf of each."""
    nodes = [Node("html", -1, frozenset())]
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # name, node, silent
    blocks: list[tuple[int, str]] = []
    line: list[str] = []
    links = linked = 0

    def end_block() -> None:
        nonlocal linked
        if line:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                above = stack[-1][1]
                blocks.append((len(nodes), text))
                size = len(text) - text.count(" ")
                nodes.append(Node(TEXT, above, frozenset(), nodes[above].label, size, min(linked, size), len(SENTENCE.findall(text))))
            linked = 0

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            name = stack[-1][0]
            if name not in INLINE:
                end_block()
            elif name == "a":
                links -= 1
            stack.pop()

    def end_head() -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == "head":
                close(depth)
                break

    for kind, name, source in parts(html):
        # Text ends a head only where it stands in it directly: that of a title or script is the element's own.
        if kind == "text" and stack[-1][0] == "head" and source.strip() or kind == "open" and name not in HEAD:
            end_head()
        if kind == "text":
            if not stack[-1][2]:
                text = unescape(source)
                line.append(text)
                if links:
                    linked += len(text) - text.count(" ")
        elif kind == "open":
            if name in VOID:
                if name == "br":
                    line.append(" ")
                elif name not in INLINE:
                    end_block()
                continue
            if name in INLINE:
                if name == "a":
                    links += 1
                stack.append((name, stack[-1][1], stack[-1][2]))
            else:
                ended = ENDS.get(name, set()) | {"p"}
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in ended:
                        close(depth)
                        break
                    if stack[depth][0] in WALLS:
                        break
                end_block()
                if name == "html":
                    continue
                if name in FOREIGN or stack[-1][2] and any(open_ in FOREIGN for open_, _, _ in stack):
                    # A drawing or formula holds no text, so it says nothing of its surroundings.
                    if not source.endswith("/"):
                        stack.append((name, stack[-1][1], True))
                    continue
                words, label = attributes(source)
                nodes.append(Node(name, stack[-1][1], words, label or nodes[stack[-1][1]].label))
                stack.append((name, len(nodes) - 1, stack[-1][2] or name in SILENT))
            if name in RAW:
                stack[-1] = (name, stack[-1][1], True)
        else:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
    end_block()
    return nodes, blocks


def describe(nodes: list[Node]) -> list[int]:
    """Fills in the features of every node; returns how much text each holds, its descendants included."""
    size, linked, children = [node.chars for node in nodes], [node.linked for node in nodes], [0] * len(nodes)
    for place in range(len(nodes) - 1, 0, -1):
        children[nodes[place].parent] += 1
        size[nodes[place].parent] += size[place]
        linked[nodes[place].parent] += linked[place]
    for place, node in enumerate(nodes):
        share = linked[place] / size[place] if size[place] else 0.0
        kind = "leaf" if node.tag == TEXT else ""
        seen = [f"{kind}size={min(10, size[place].bit_length())}", f"{kind}links={round(share * 4)}"]
        if kind:
            # An only child is as long as its parent, where that has been seen already.
            seen = seen * (children[node.parent] > 1) + [f"stops={min(3, node.stops)}"]
        node.features = [f"tag={node.tag}", *seen, *[f"word={word}" for word in sorted(node.tokens)]]
    return size


class Model:
    """Log-likelihoods of features and the parent-child table, from counts."""

    def __init__(self, counts: dict[tuple[str, int], int], smooth: float = 0.05):
        totals = [sum(n for (name, own), n in counts.items() if name.startswith("tag=") and own == state)
                  for state in STATES]
        seen = {name for name, _ in counts if "=" in name}
        kinds = Counter(name.split("=")[0] for name in seen)
        self.seen = {}
        for name in seen:
            # A word is there or not; of the others, each node has one value.
            kind = 2 if name.startswith("word=") else kinds[name.split("=")[0]]
            # Sizes and shares are steps of a scale: that one of them was not seen says little.
            extra = smooth if name.startswith(("word=", "tag=")) else 1.0
            self.seen[name] = [log((counts.get((name, state), 0) + extra) / (totals[state] + extra * kind))
                               for state in STATES]
        self.follow = []
        for above in STATES:
            pair = [counts.get((f"pair{above}", state), 0) + smooth for state in STATES]
            self.follow.append([value / sum(pair) for value in pair])

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content per node: messages up the tree, then down."""
        seen, nothing = self.seen, [0.0, 0.0, 0.0]
        below = []  # potential times the messages from the children
        for node in nodes:
            logs = [sum(values) for values in zip(*[seen.get(name, nothing) for name in node.features])]
            most = max(logs)
            below.append([exp(max(-60.0, value - most)) for value in logs])
        up = [(1.0, 1.0, 1.0)] * len(nodes)
        (a, b, c), (d, e, f), (g, h, i) = self.follow
        for place in range(len(nodes) - 1, 0, -1):
            x, y, z = below[place]
            total = x + y + z
            x, y, z = x / total, y / total, z / total
            up[place] = message = (a * x + b * y + c * z, d * x + e * y + f * z, g * x + h * y + i * z)
            above = below[nodes[place].parent]
            above[0] *= message[0]
            above[1] *= message[1]
            above[2] *= message[2]
            if max(above) < 1e-100:
                above[:] = [value * 1e100 for value in above]
        full = list(below)
        for place in range(1, len(nodes)):
            whole, own, message = full[nodes[place].parent], below[place], up[place]
            x, y, z = whole[0] / message[0], whole[1] / message[1], whole[2] / message[2]
            x, y, z = (own[0] * (x * a + y * d + z * g), own[1] * (x * b + y * e + z * h),
                       own[2] * (x * c + y * f + z * i))
            total = x + y + z
            full[place] = [x / total, y / total, z / total]
        return [state[CONTENT] / sum(state) for state in full]


def labelled_counts(html: str) -> Counter:
    """Counts of (feature, state) and (parent state, state) of a labelled page."""
    nodes, _ = tree(html)
    size = describe(nodes)
    main = [node.chars if node.label == "main" else 0 for node in nodes]
    for place in range(len(nodes) - 1, 0, -1):
        main[nodes[place].parent] += main[place]
    state = [(CONTENT if node.label == "main" else OUTSIDE) if not most else
             OUTSIDE if not held else CONTENT if held == most else MIXED
             for node, held, most in zip(nodes, main, size)]
    counts: Counter = Counter()
    for place, node in enumerate(nodes):
        counts.update((name, state[place]) for name in node.features)
        if place:
            counts[f"pair{state[node.parent]}", state[place]] += 1
    return counts


def labelled_pages(spark: SparkSession) -> DataFrame:
    """``html`` of labelled pages: every layout with every way to hold the content and each set of other parts."""
    pages = [layout(main, others, number) for number, (layout, main, others) in enumerate(product(LAYOUTS, MAIN, OTHER))]
    return spark.createDataFrame([(page,) for page in pages], "html string")


def fit(labelled: DataFrame, limit: int = 10_000) -> Model:
    """Potentials from at most ``limit`` labelled pages; the driver gets one row per feature and state."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                counts.update(labelled_counts(html or ""))
        yield pa.record_batch([pa.array([name for name, _ in counts], pa.string()),
                               pa.array([state for _, state in counts], pa.int32()),
                               pa.array(list(counts.values()), pa.int64())], names=["name", "state", "n"])

    rows = (labelled.select("html").limit(limit).mapInArrow(count, "name string, state int, n long")
            .groupBy("name", "state").agg(F.sum("n").alias("n")).collect())
    return Model({(row["name"], row["state"]): row["n"] for row in rows})


def main_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    nodes, blocks = tree(html)
    describe(nodes)
    content = model.marginals(nodes)
    return "\n".join([text for node, text in blocks if content[node] > LEVEL])


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    known = model or fit(labelled_pages(pages.sparkSession))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, known) for html in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(text) for text in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")
