"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block is described by its word count and link
density and those of the blocks before and after it, and by the word counts of the nearest blocks on either side that
are not mostly links, so that a list of links between two paragraphs looks other than a menu; beside these stand what
its tags say: whether it is a heading,
whether it lies in the article or main element, and whether an element around it is page furniture (navigation, form,
advert, comments, by tag or by a word of its class, id or role). The tree's upper splits are on word counts and link
densities only; tags come in below, where those leave a block undecided. It is fitted on the blocks of a small
labelled table, `LABELLED` and pages laid out by rule (`laid_out`), each page once with and once without its tags, so
that it can tell text on pages whose tags say nothing.

A mark on an element tells nothing of what it holds if that is the article or main element, or, for class words and
forms on pages without either, most of the page's words.

Defined cases: null or empty html gives an empty text; a page without blocks gives an empty text; broken markup is
read to its end (an unclosed script, style or comment runs to the end of the page); character references are decoded
once; a very long text is read whole, in one pass; rows are independent, so repeated rows and ties give equal results;
an empty table gives an empty result; other columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

# Element names of HTML by how they matter here.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose contents are no text of the page: scripts, styles, controls, what stands in for media, and notes to machines.
RAW = set("script style title textarea noscript template iframe noembed noframes object canvas audio video select button desc annotation annotation-xml".split())
#: Those of them that stand within a line.
INLINE_RAW = set("object canvas audio video select button iframe textarea annotation annotation-xml".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FURNITURE = set("nav footer aside form menu dialog search".split())
MAIN = {"article", "main"}
#: Words in class, id or role that mark what is not the article.
HINTS = set("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot comment comments discuss disqus respond reply replies cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager tags copyright legal search form complementary contentinfo".split())
#: Beside these words a hint is no mark: a state (has-sidebar, comments-open) or a part of the article (entry-header).
STATES = set("has with no without is open closed enabled disabled allowed off on".split())
PARTS = set("article post entry story content main text body".split())
SPLIT = re.compile(r"[^a-z]+")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
HIDDEN = re.compile(r"(?:^|[\s/])hidden(?:[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

FLAT = ("words", "links", "words_before", "links_before", "words_after", "links_after", "text_before", "text_after")
FEATURES = (*FLAT, "heading", "place", "furniture")
#: Splits from the root that only the flat features may make, all splits, and the fewest blocks of a leaf.
FLAT_LEVELS, DEPTH, LEAST_LEAF = 3, 9, 4
#: Link density from which a block is mostly links.
LINKED = 0.5
#: Words of a piece of furniture that is an example without its tags too, at most.
BRIEF = 6
#: Pages laid out by rule for the labelled table, and the seed of the deal.
PAGES, DEAL = 900, 11


def marked(value: str) -> bool:
    """Whether a class, id or role marks furniture."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower().split():
        words = SPLIT.split(name)
        if HINTS.intersection(words) and not STATES.intersection(words) and not (words[0] in PARTS and words[-1] in ("header", "foot", "footer", "banner", "tags", "legal")):
            return True
    return False


#: Labelled pages: (html, one digit for each block: 1 main text, 0 not). Written for this table.
LABELLED: list[tuple[str, str]] = [
    ("<body><nav><ul><li><a>Home</a></li><li><a>About us</a></li></ul></nav><article><h1>A day out</h1><p>We went to the lake early and stayed until the sun was low.</p><p>Good.</p><p><a>All pictures</a></p><p>Nobody wanted to leave before the evening train came in.</p></article><footer>Copyright by the authors of this page</footer></body>", "00" + "11111" + "0"),
    ("<body><header>The Daily Page</header><div class=ad>Buy one of our lamps today and get another one for half the price, only this week.</div><main><h1>Rain</h1><p>It rained for the whole week in the north.</p><aside>More on weather</aside><p>Then it stopped.</p></main><div class=sidebar>Most read stories of the week and of the month</div><footer>Imprint</footer></body>", "00" + "11" + "0" + "1" + "00"),
    ("<body><article><h2>Soup</h2><p>Cut the leeks and cook them with salt for an hour.</p><div class=comments><p>I made this soup yesterday and my whole family liked it a lot.</p><p>Nice!</p></div></article></body>", "11" + "00"),
    ("<body><div><a>Home</a> <a>News</a> <a>Contact</a></div><div>The council met on Monday to talk about the new bridge over the river, which will open to traffic in two years at the earliest.</div><div>It will cost more than was planned when the work was first agreed on by all the parties that sit in the council.</div><div><a>Next</a> <a>Back</a></div></body>", "0110"),
    ("<body><p>Menu</p><ul><li><a>One</a></li><li><a>Two</a></li></ul><p>A long walk leads from the village up to the old castle, past the mill and the two ponds that lie behind it in the wood.</p><p>At the top there is a view over the whole valley and, on a clear day, of the hills that lie on the other side of the border.</p><p><a>Print this page</a></p><p>All rights reserved</p></body>", "000" + "11" + "00"),
    ("<body><form>Search the site for words <input> and more</form><article><p>Short note.</p><p>Another short note.</p></article><div class='cookie notice'>We use cookies to make this page better for you and for everyone who reads it.</div></body>", "0" + "11" + "0"),
    ("<body><div>Log in</div><div>In the spring the birds return to the marsh in great numbers and build their nests in the reeds along the water, where few people come.</div><div>They stay until autumn.</div><div>Then the flocks gather on the meadows, and one morning all of them have gone south again, as they have done for as long as anyone knows.</div><div><a>Imprint</a> <a>Terms</a></div></body>", "01110"),
    ("<body><div><a>Ten things that our readers liked this week</a> <a>What the council said about the new bridge</a></div><div>The old mill has been standing still since the stream was led into the new bed, and <a>the wheel</a> has long since rotted away.</div><div>Now a group of neighbours wants to repair it.</div><div><a>How to get rid of moss in your garden</a> <a>The best soup of the year</a></div></body>", "0110"),
    ("<body><div>Sign up</div><article><h1>Two notes</h1><p>The first note is short.</p><p>End.</p></article></body>", "0" + "111"),
    ("<body><article><h1>Tides</h1><p>High water comes twice a day, and each time a little later than the day before.</p></article>", "11"),
    ("<body><main><p><a>The whole of this line is one link to a longer account of it</a></p><p>Fin</p></main></body>", "11"),
    ("<body><ul><li><a>Start</a></li></ul><div class=notice>The shop is closed for the whole of next week, and orders will be sent out after that.</div><article><p>Bread needs time.</p></article><div class=banner>A new oven for every kitchen, now at a price that you will like</div></body>", "00" + "1" + "0"),
    ("<body><div>This page is read by more people every month, and we thank all of them for the letters that they send to us, which we read with great care.</div><article><p>Snow fell in the night.</p></article><div>The editors choose what stands here once a day, and do not take money for it from anyone, as they have promised ever since the paper was first printed.</div><div>It has been so for years, and it will stay like this as long as the paper has readers who pay for it.</div></body>", "0" + "1" + "00"),
    ("<body><article><p>First of all the text.</p><div class=newsletter>Get our letter every week with the best of what we wrote.</div><p>Last of all the text.</p><div class='share'><a>Send</a></div></article><div>You may also like these stories that our readers liked</div></body>", "101" + "00"),
]


#: How the labelled pages mark what is no text: element names, or class and id words.
MARKS = {
    "comments": ("comments", "comment", "replies", "discuss"),
    "side": ("aside", "sidebar", "related", "newsletter"),
    "notice": ("cookie-notice", "consent", "alert", "notice"),
    "advert": ("ad", "banner", "promo", "sponsored"),
    "footer": ("footer", "site-footer", "copyright"),
}


class Blocks:
    """The flat text blocks of a page: texts and feature rows."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.rows: list[tuple] = []
        self.parts: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, int, bool]] = []
        self.open: Counter = Counter()
        self.main: list[str] = []
        self.marks: list[int] = []  # open elements that are marked as furniture
        self.kinds: list[str] = []  # of each marked element: tag, form or class
        self.around: list[int] = []  # and the marked element that it lies in, or -1
        self.holds_main: set[int] = set()
        self.heading = self.link = 0
        self.missing: set[str] = set()
        self.read(page)
        self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(x for x, _ in self.parts).split())
        if text:
            words = len(text.split(" "))
            linked = sum(len(x.split()) for x, in_link in self.parts if in_link)
            self.texts.append(text)
            self.rows.append((words, min(1.0, linked / words), self.heading > 0, "article" in self.main, bool(self.main), self.marks[-1] if self.marks else -1))
        self.parts = []

    def read(self, page: str) -> None:
        at, n, find = 0, len(page), page.find
        while at < n:
            lt = find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            if lt > at:
                self.text(page[at:lt])
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = self.past(page, "-->", lt + 4)
                at = end if end >= 0 else n
            elif after in ("!", "?"):
                end = self.past(page, ">", lt)
                at = end if end >= 0 else n
            elif after == "/" or after.isalpha() and after.isascii():
                closing = after == "/"
                name = NAME.match(page, lt + 1 + closing)
                end = self.tag_end(page, name.end() if name else lt + 1)
                if end < 0:
                    return  # a tag that is cut off at the end of the page
                if name:
                    at = self.tag(page, name[0].lower(), closing, page[name.end() : end], end + 1)
                else:
                    at = end + 1
            else:
                self.text("<")
                at = lt + 1

    def past(self, page: str, what: str, at: int) -> int:
        """The place behind the next `what`, or -1; a search that failed once is not made again."""
        if what in self.missing:
            return -1
        end = page.find(what, at)
        if end < 0:
            self.missing.add(what)
            return -1
        return end + len(what)

    def tag_end(self, page: str, at: int) -> int:
        """The place of the `>` that ends a tag, outside quotes; a quote without its end is no quote."""
        while True:
            end = page.find(">", at)
            if end < 0:
                return -1
            quote = min((q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0), default=-1)
            if quote < 0:
                return end
            close = self.past(page, page[quote], quote + 1)
            if close < 0:
                return end
            at = close

    def text(self, raw: str) -> None:
        self.parts.append((html.unescape(raw) if "&" in raw else raw, self.link > 0))

    def tag(self, page: str, name: str, closing: bool, attributes: str, at: int) -> int:
        if name in RAW and not closing:
            if name in INLINE_RAW or (name == "title" and self.open["svg"]):
                self.parts.append((" ", False))
            else:
                self.flush()
            if attributes.endswith("/"):
                return at
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at) if f"</{name}" not in self.missing else None
            if end is None:
                self.missing.add(f"</{name}")
                return len(page) if name in ("script", "style", "title", "textarea") else at
            return end.end()
        if name == "br":
            self.parts.append(("\n", False))
            return at
        if name in BLOCK:
            self.flush()
        if closing:
            if self.open[name]:
                while self.pop() != name:
                    pass
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == name:
                self.pop()
            elif name in BLOCK and self.open["p"]:
                self.close_paragraph()
            self.push(name, attributes)
        return at

    def close_paragraph(self) -> None:
        """A block element ends an open paragraph that only inline elements stand between."""
        k = len(self.stack) - 1
        while k >= 0 and self.stack[k][0] not in BLOCK:
            k -= 1
        if k >= 0 and self.stack[k][0] == "p":
            while len(self.stack) > k:
                self.pop()

    def push(self, name: str, attributes: str) -> None:
        kind = ""
        if name in FURNITURE or (name == "header" and not self.main):
            kind = "form" if name == "form" else "tag"
        elif attributes and name not in ("html", "body"):
            if any(key.lower() in ("class", "id", "role") and marked(value) for key, value in ATTRIBUTE.findall(attributes)):
                kind = "class"
            elif HIDDEN.search(attributes):
                kind = "tag"
        if name in MAIN and not kind:
            for m in reversed(self.marks):
                if m in self.holds_main:
                    break
                self.holds_main.add(m)
            self.main.append(name)
        if kind:
            self.around.append(self.marks[-1] if self.marks else -1)
            self.marks.append(len(self.kinds))
            self.kinds.append(kind)
        self.stack.append((name, kind != "", name in MAIN and not kind))
        self.open[name] += 1
        self.heading += name in HEADINGS
        self.link += name == "a"

    def pop(self) -> str:
        name, is_mark, is_main = self.stack.pop()
        self.open[name] -= 1
        if is_main:
            self.main.pop()
        if is_mark:
            self.marks.pop()
        self.heading -= name in HEADINGS
        self.link -= name == "a"
        return name

    def features(self) -> np.ndarray:
        """One row for each block, as FEATURES names them; place: 1 in the article, 0.5 in main beside an article, 0
        unknown, -1 outside of both."""
        out = np.zeros((len(self.rows), len(FEATURES)))
        if not self.rows:
            return out
        out[:, :3] = [(r[0], r[1], 0) for r in self.rows]
        inside = [0] * len(self.kinds)
        for r in self.rows:
            if r[5] >= 0:
                inside[r[5]] += r[0]
        for m in range(len(inside) - 1, -1, -1):  # elements come after those that they lie in
            if self.around[m] >= 0:
                inside[self.around[m]] += inside[m]
        most = sum(r[0] for r in self.rows) / 2
        has_main = any(r[4] for r in self.rows)
        bad_within = [False] * (len(inside) + 1)  # the last one stands for no mark
        for m, kind in enumerate(self.kinds):
            void = m in self.holds_main or (not has_main and kind != "tag" and inside[m] > most)
            bad_within[m] = not void or bad_within[self.around[m]]
        bad = np.array([bad_within[r[5]] for r in self.rows])
        article, main = (np.array([r[k] for r in self.rows]) & ~bad for k in (3, 4))
        out[1:, 2:4] = out[:-1, 0:2]
        out[0, 2] = 0
        out[:-1, 4:6] = out[1:, 0:2]
        for column, order in ((6, range(len(out))), (7, range(len(out) - 1, -1, -1))):
            last = 0.0
            for k in order:
                out[k, column] = last
                if out[k, 1] < LINKED:
                    last = out[k, 0]
        heading, place, furniture = range(len(FLAT), len(FEATURES))
        out[:, heading] = [r[2] for r in self.rows]
        if article.any():
            out[:, place] = np.where(article, 1, np.where(main, 0.5, -1))
        elif main.any():
            out[:, place] = np.where(main, 1, -1)
        out[:, furniture] = bad
        return out


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, flat: int = len(FLAT)) -> list[tuple]:
    """A decision tree by Gini impurity, as a list of (feature, threshold, left, right) and (-1, class). Its first
    FLAT_LEVELS splits are on the first `flat` features; equal gains go to the first feature, then the least threshold."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, level: int) -> int:
        own = len(nodes)
        nodes.append(())
        share = y[rows].mean()
        best = (share * (1 - share) * len(rows) - 1e-9, None)
        if level < depth and 0 < share < 1:
            for f in range(flat if level < FLAT_LEVELS else x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, hits = x[order, f], np.cumsum(y[order])
                at = np.arange(1, len(v))
                ok = np.flatnonzero((v[1:] > v[:-1]) & (at >= LEAST_LEAF) & (len(v) - at >= LEAST_LEAF))
                if not len(ok):
                    continue
                low, high = at[ok], len(v) - at[ok]
                a, b = hits[ok] / low, (hits[-1] - hits[ok]) / high
                loss = a * (1 - a) * low + b * (1 - b) * high
                k = int(loss.argmin())
                if loss[k] < best[0] - 1e-9:
                    best = (float(loss[k]), (f, float((v[ok[k]] + v[ok[k] + 1]) / 2)))
        if best[1] is None and level < FLAT_LEVELS and level < depth and 0 < share < 1:
            level = FLAT_LEVELS  # no flat feature helps here: the tags may
            nodes.pop()
            return grow(rows, level)
        if best[1] is None:
            nodes[own] = (-1, int(share >= 0.5))
        else:
            f, t = best[1]
            low = x[rows, f] <= t
            nodes[own] = (f, t, grow(rows[low], level + 1), grow(rows[~low], level + 1))
        return own

    grow(np.arange(len(y)), 0)
    return nodes


def apply_tree(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        node = nodes[k]
        if node[0] < 0:
            out[rows] = bool(node[1])
        else:
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def laid_out(n: int = PAGES, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled pages made by rule: what a page has around its text, and how it is marked, is drawn for each page.
    Marked furniture may be of any length; a list of links between paragraphs is text, one at an end is a menu."""
    rnd = random.Random(seed)

    def any_length() -> int:
        return round(4 * 100 ** rnd.random())

    def words(low: int, high: int) -> str:
        return " ".join("".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(low, high)))

    def links(count: int, item: str) -> str:
        longest = rnd.choice((2, 4, 12))
        return "".join(f"<{item}><a href='/{words(1, 1)}'>{words(1, longest)}</a></{item}>" for _ in range(count))

    out = []
    for k in range(n):
        page: list[str] = []
        labels: list[str] = []
        marked_words = [0]

        def add(html_of: str, label: str, page=page, labels=labels) -> None:
            page.append(html_of)
            labels.append(label)

        def wrapped(tag: str, mark: str, inner: str, label: str) -> None:
            add(f"<{tag}{' class=' + mark if mark else ''}>{inner}</{tag}>", label)

        tags = k % 4  # 0: article, 1: main with article, 2: main alone, 3: neither
        named = rnd.random() < 0.5  # whether furniture outside is named by tag or class
        short = k % 3 == 0  # a note of few words, often with little around it
        likely = (0.0, 0.5, 0.5)[k // 4 % 3] if short else 1.0
        there = lambda share, likely=likely: rnd.random() < share * likely
        if there(0.9):
            count = rnd.choice((1, 2, 3, 5, 8))
            wrapped("nav" if named else "div", "", links(count, rnd.choice(("li", "div", "p"))), "0" * count)
        if there(0.5):
            wrapped("header" if named else "div", "" if named else "masthead", words(1, 5), "0")
        def marked_blocks(kinds: tuple[str, ...], add=add, marked_words=marked_words) -> None:
            """Furniture of one to three blocks of any length, marked by a tag, a class or an id."""
            kind, count = rnd.choice(kinds), rnd.choice((1, 1, 2, 3))
            name = rnd.choice(MARKS[kind])
            opened = f"<{name}>" if name in FURNITURE else f"<div {rnd.choice(('class', 'id'))}={name}>"
            inner = [words(n := any_length(), n) for _ in range(count)]
            marked_words[0] += sum(len(x.split()) for x in inner)
            if count == 1 and rnd.random() < 0.5:
                add(f"{opened}{inner[0]}</{opened[1:].split(' ')[0].rstrip('>')}>", "0")
            else:
                add(f"{opened}{''.join(f'<p>{x}</p>' for x in inner)}</{opened[1:].split(' ')[0].rstrip('>')}>", "0" * count)

        if there(0.6):
            marked_blocks(("notice", "advert"))
        if tags in (1, 2):
            page.append(rnd.choice(("<main>", "<main class='content has-sidebar'>", "<main id=main>")))
            if tags == 1 and rnd.random() < 0.4:
                few = rnd.choice((3, 4))
                add(f"<ul>{links(few, 'li')}</ul>", "0" * few)
        if tags in (0, 1):
            page.append(rnd.choice(("<article>", "<article class='post comments-open'>", "<article id=post-12>")))
        head = f"<h1>{words(1, 9)}</h1>"
        if not short or rnd.random() < 0.5:
            add(rnd.choice((head, f"<div class=article-header>{head}</div>", f"<header>{head}</header>" if tags < 3 else head)), "1")
        for _ in range(rnd.randint(1, 4) if short else rnd.randint(3, 12)):
            draw = 0.52 + 0.21 * rnd.random() if short else rnd.random()
            if draw < 0.62:
                add(f"<p>{words(18, 90) if rnd.random() < 0.7 else words(n := round(90 * 5 ** rnd.random()), n)}</p>", "1")
            elif draw < 0.72:
                add(f"<p>{words(1, 8)}</p>", "1")
            elif draw < 0.78:
                add(f"<p>{words(8, 30)} <a href=x>{words(1, 4)}</a> {words(2, 9)}</p>", "1")
            elif draw < 0.81:
                add(f"<p><a href=x>{words(1, 12)}</a></p>", "1")
                add(f"<p>{words(2, 60)}</p>", "1")
            elif draw < 0.85:
                add(f"<h2>{words(1, 5)}</h2>", "1")
                add(f"<p>{words(18, 60)}</p>", "1")
            elif draw < 0.89:
                add(f"<ul><li>{words(3, 15)}</li><li>{words(2, 15)}</li></ul>", "11")
            elif draw < 0.94:
                few = rnd.choice((2, 3, 4, 6, 9))
                add(f"<p>{words(12, 60)}</p>", "1")
                item = rnd.choice(("li", "p"))
                add(f"<ul>{links(few, item)}</ul>" if item == "li" else links(few, item), "1" * few)
                if tags < 3 and rnd.random() < 0.5:  # where tags say that this is the article, a list may end it
                    break
                add(f"<p>{words(12, 60)}</p>", "1")
            else:
                marked_blocks(("side", "advert", "notice"))
                add(f"<p>{words(18, 60)}</p>", "1")
        if tags in (0, 1):
            page.append("</article>")
        if there(0.4):
            marked_blocks(("comments",))
        if tags in (1, 2):
            page.append("</main>")
        if there(0.5):
            few = rnd.choice((1, 2, 3, 6))
            wrapped("aside" if named else "div", "", links(few, rnd.choice(("li", "p"))), "0" * few)
        if named and there(0.3):
            wrapped("form", "", words(2, 8), "0")
        if there(0.4):
            marked_blocks(("comments", "side", "notice", "footer"))
        if there(0.8):
            wrapped("footer" if named else "div", "", words(2, 12), "0")
        whole = "".join(page)
        if tags == 3 and 2 * marked_words[0] >= len(re.sub("<[^>]*>", " ", whole).split()):
            continue  # what holds most of such a page's words is no furniture, whatever its mark
        out.append((f"<html><body>{whole}</body></html>", "".join(labels)))
    return out


def examples(labelled: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks."""
    x, y = [], []
    for page, classes in labelled:
        rows = Blocks(page).features()
        if len(rows) != len(classes):
            raise ValueError(f"{len(rows)} blocks, {len(classes)} labels: {page[:60]}")
        x.append(rows)
        y += map(int, classes)
    return np.concatenate(x), np.array(y, float)


def train(labelled: list[tuple[str, str]] | None = None) -> list[tuple]:
    x, y = examples(LABELLED + laid_out() if labelled is None else labelled)
    # without tags, a long notice or comment can't be told from text: such blocks are no examples
    some = (x[:, -1] == 0) | (x[:, 0] <= BRIEF)
    blank = x[some]
    blank[:, len(FLAT) + 1 :] = 0
    # where tags speak of a block that is no links, they do so whatever the lengths around it: flat features dealt anew
    told = ((x[:, len(FLAT) + 1] != 0) | (x[:, -1] != 0)) & (x[:, 1] < LINKED)
    dealt = x[told]
    dealt[:, : len(FLAT)] = dealt[np.random.default_rng(DEAL).permutation(len(dealt)), : len(FLAT)]
    return fit_tree(np.concatenate([x, blank, dealt]), np.concatenate([y, y[some], y[told]]))


@cache
def fitted() -> list[tuple]:
    """The tree of the labelled table, fitted once in a process."""
    return train()


def main_text(page: str | None, tree: list[tuple]) -> str:
    blocks = Blocks(page or "")
    keep = apply_tree(tree, blocks.features())
    return "\n".join(t for t, k in zip(blocks.texts, keep, strict=True) if k)


def extract(pages: DataFrame, tree: list[tuple] | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, the main text of the column html, and its number of code points."""
    tree = tree or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    kept = C.text_first(pages, "html", keep)
    return C.arrow_map_kept(kept, run, "text string, n_chars long")
