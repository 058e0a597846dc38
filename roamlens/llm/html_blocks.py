"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at its block-level tags.  A block is described by
its own word count and link density, those of its two neighbours, and where it
stands (inside the article, inside furniture, a list item, a heading).  A decision
tree trained on the small labelled pages below (marked block by block) says which
blocks are main text; where no name or tag tells, the neighbours decide.  All work on a page is inside its row.
"""

from __future__ import annotations

import html as htmllib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- blocks ----------------------------------------------------------------

#: Tags that end an element left open: its own end tag is missing.
_BOUND = ("address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|"
          "menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<open>iframe|svg|math|object|select)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"(?:(?:(?!<(?P=open)[\s/>]).)*?</(?P=open)\s*>|(?<=/>)|.*?(?=</?(?:" + _BOUND + r")[\s/>]|<(?P=open)[\s/>]|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")

#: Tags that stay inside a block; every other tag ends it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = frozenset(("p", "blockquote", "pre", "dd"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu head label fieldset".split())
MAIN_TAGS = frozenset("article main".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu "
    "breadcrumb breadcrumbs sidebar side footer masthead cookie cookies consent notice gdpr popup modal newsletter subscribe "
    "signup login share sharing social related recommended pager pagination widget toolbar copyright legal disclaimer "
    "comment comments reply replies responses disqus discussion respond feedback".split())
MAIN_WORDS = frozenset("article content post entry story main body".split())
#: What an opening tag ends where an end tag was left out: an open element of the same
#: group, unless one of its bounds was opened since.  Any of ENDS_PARAGRAPH ends an open p.
_LISTS = "ul ol menu dl table td th caption button object html article aside section nav main header footer blockquote details fieldset figure form"
_CELL = "td th caption button object html"
GROUPS = (("p", "p", "table " + _CELL), ("item", "li", _LISTS), ("term", "dt dd", _LISTS), ("cell", "td th", "table html"), ("row", "tr", "table html"),
          ("part", "thead tbody tfoot", "table html"), ("option", "option", "datalist html"), ("heading", "h1 h2 h3 h4 h5 h6", None))
CLOSES = {"li": ("item",), "dt": ("term",), "dd": ("term",), "td": ("cell",), "th": ("cell",), "tr": ("cell", "row"),
          "thead": ("cell", "row", "part"), "tbody": ("cell", "row", "part"), "tfoot": ("cell", "row", "part"), "option": ("option",)}
ENDS_PARAGRAPH = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                           "header hr li main menu nav ol p pre search section table ul".split())
#: End tags that reach past a cell; those of other elements stay inside it.
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption body html".split())

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density",
            "in_main", "in_furniture", "in_list", "is_heading", "in_paragraph", "page_has_main")


#: What an element opens: furniture by its tag, role or being hidden; furniture by a word of
#: its class or id, or a form (either may wrap a whole page); main text by such a word; main
#: text by its tag or role.
HARD, SOFT, NAMED, MAIN = 1, 2, 3, 4
#: A class that tells how the page is laid out, not what the element is.
_LAYOUT = re.compile(r"(?:has|have|no|with|without)[-_]")
#: Words of notices, adverts and comments: an element with one never wraps a whole page
#: (unless an article or main element says so).
NEVER_WRAP = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal newsletter "
    "subscribe signup login comment comments reply replies responses disqus discussion respond feedback related recommended".split())


def _kind(tag: str, attrs: str, inside_main: bool) -> tuple[int, bool]:
    """One of the above, furniture first, or 0; and whether it may wrap a whole page."""
    hard = (tag in FURNITURE_TAGS and tag != "form") or (tag == "header" and not inside_main)
    soft = tag == "form"
    main, named, wraps = tag in MAIN_TAGS, False, True
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            value, name = (a or b or c).lower(), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                hard = True
            elif name == "role":
                hard |= value in FURNITURE_ROLES
                main |= value in ("main", "article")
            elif name in ("class", "id") and tag not in INLINE and tag not in ("body", "html"):
                words = set(re.split(r"[^a-z]+", " ".join(x for x in value.split() if not _LAYOUT.match(x))))
                soft |= bool(words & FURNITURE_WORDS)
                named |= bool(words & MAIN_WORDS)
                wraps &= not words & NEVER_WRAP
    return (HARD if hard else SOFT if soft else MAIN if main else NAMED if named else 0), wraps


class _Open:
    """The open elements.  What holds at the present place is kept in counts that change
    as elements open and close, so a place costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}  # places in the stack, by tag and by group
        self.of: dict[str, list[str]] = {}
        for group, tags, bounds in GROUPS:
            for t in tags.split():
                self.of.setdefault(t, []).append("+" + group)
            for t in (bounds or "").split():
                self.of.setdefault(t, []).append("-" + group)
        for t in "td th caption button object html table".split():
            self.of.setdefault(t, []).append("-end")
        for t in PARAGRAPHS:
            self.of.setdefault(t, []).append("text")
        self.hard = self.named = 0
        #: Soft elements around the innermost article or main element.
        self.main: list[int] = []
        #: Open soft elements; for each of the page, the one around it and whether it may wrap the page.
        self.soft: list[int] = []
        self.softs: list[tuple[int, bool]] = []

    def last(self, key: str) -> int:
        places = self.at.get(key)
        return places[-1] if places else -1

    def push(self, tag: str, attrs: str) -> None:
        kind, wraps = _kind(tag, attrs, bool(self.named or self.main))
        for key in (tag, *self.of.get(tag, ())):
            self.at.setdefault(key, []).append(len(self.stack))
        self.stack.append((tag, kind))
        if kind == HARD:
            self.hard += 1
        elif kind == SOFT:
            self.softs.append((self.soft[-1] if self.soft else -1, wraps))
            self.soft.append(len(self.softs) - 1)
        elif kind == MAIN:
            self.main.append(len(self.soft))
        elif kind == NAMED:
            self.named += 1

    def cut(self, place: int) -> None:
        """Closes the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            tag, kind = self.stack.pop()
            for key in (tag, *self.of.get(tag, ())):
                self.at[key].pop()
            if kind == HARD:
                self.hard -= 1
            elif kind == SOFT:
                self.soft.pop()
            elif kind == MAIN:
                self.main.pop()
            elif kind == NAMED:
                self.named -= 1

    def opening(self, tag: str) -> None:
        """Closes what the opening of ``tag`` ends."""
        if self.last("head") >= 0:
            self.cut(self.last("head"))
        for group in CLOSES.get(tag, ()) + (("p",) if tag in ENDS_PARAGRAPH else ()):
            place = self.last("+" + group)
            if place > self.last("-" + group):
                self.cut(place)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.cut(len(self.stack) - 1)

    def closing(self, tag: str) -> None:
        place = self.last(tag)
        bound = self.last("table") if tag in TABLE_TAGS and tag not in ("table", "body", "html") else -1 if tag in TABLE_TAGS else self.last("-end")
        if place >= 0 and place >= bound:
            self.cut(place)

    def state(self) -> tuple:
        around = self.main[-1] if self.main else None
        return ((self.hard > 0, len(self.soft), around, self.soft[-1] if self.soft else -1), bool(self.main or self.named), bool(self.at.get("li")),
                bool(self.at.get("+heading")), bool(self.at.get("text")))


def _in_furniture(found: list[tuple], softs: list[tuple[int, bool]]) -> list[bool]:
    """Which blocks stand in furniture.  Soft furniture is none where it merely wraps the
    page's main text.

    With articles or main elements: where none of them has text outside of any soft
    element, the fewest around those with half as many words as those of any other number
    wrap.  Without: if no named main text stands outside of soft elements, a soft element that
    may wrap does so if it holds three quarters of the words that are neither links nor in
    furniture of another kind."""
    size: dict[int, int] = {}
    for block in found:
        hard, soft, around, _ = block[3]
        if around is not None and soft == around and not hard:
            size[around] = size.get(around, 0) + block[1]
    base = 0 if not size or 0 in size else min(k for k in size if 2 * size[k] >= max(size.values()))
    wraps = [False] * len(softs)
    if not size and any(b[3][1] for b in found) and not any(b[4] and not b[3][0] and not b[3][1] for b in found):
        may = [w for _, w in softs]
        for i, (around, _) in enumerate(softs):  # an element comes after those around it
            may[i] &= around < 0 or may[around]
        words, total = [0] * len(softs), 0
        for b in found:
            hard, _, _, inner = b[3]
            if not hard and (inner < 0 or may[inner]):
                total += b[1] - b[2]
                if inner >= 0:
                    words[inner] += b[1] - b[2]
        for i in range(len(softs) - 1, -1, -1):
            if softs[i][0] >= 0:
                words[softs[i][0]] += words[i]
        for i, (around, _) in enumerate(softs):
            wraps[i] = may[i] and 4 * words[i] >= 3 * total > 0 and (around < 0 or wraps[around])

    def furniture(hard, soft, around, inner) -> bool:
        return hard or (soft > base if around is not None else inner >= 0 and not wraps[inner])

    return [furniture(*b[3]) for b in found]


def blocks(html: str) -> list[tuple]:
    """(text, words, linked words, in main, in furniture, in a list, heading, in a
    paragraph) of each flat block with a word, in page order.  Linear in the page."""
    out: list[tuple] = []
    text: list[str] = []
    linked: list[str] = []
    opened = _Open()
    at, links = 0, 0

    def flush() -> None:
        if text:
            s = _SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
            if s:
                n = len(s.split())
                inside = len(htmllib.unescape("".join(linked)).split())
                out.append((s, n, min(n, inside), *opened.state()))
            text.clear()
            linked.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at:m.start()]
            text.append(piece)
            if links:
                linked.append(piece + " ")
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if (m["raw"] or m["open"] or "").lower() in ("title", "iframe", "select", "textarea", "object"):
                flush()
            continue
        tag = tag.lower()
        if tag == "a":
            links = max(0, links - 1) if m["close"] else 1
            continue
        if tag in INLINE:
            continue
        flush()
        if m["close"]:
            opened.closing(tag)
        elif tag in VOID:
            if tag in ENDS_PARAGRAPH:
                opened.opening(tag)
        else:
            opened.opening(tag)
            if not m["attrs"].endswith("/"):
                opened.push(tag, m["attrs"])
    if at < len(html):
        text.append(html[at:])
        if links:
            linked.append(html[at:])
    flush()
    return [(*b[:3], b[4], furniture, *b[5:]) for b, furniture in zip(out, _in_furniture(out, opened.softs))]


def features(found: list[tuple]) -> list[list[float]]:
    size = [(b[1], b[2] / b[1]) for b in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    main = float(any(b[3] for b in found))
    return [[*size[i], *around[i], *around[i + 2], *map(float, b[3:]), main]
            for i, b in enumerate(found)]


# --- the labelled table ----------------------------------------------------

#: Small pages labelled by hand: a block that begins with "+" is main text, one
#: that begins with "-" is not.
LABELLED_PAGES = (
    "<body><nav><ul><li><a>-Home</a><li><a>-World news</a><li><a>-Sport</a></ul></nav><div class=ad>-Buy two lamps and pay one today.</div>"
    "<article><h1>+Harbour opens again</h1><p>+The harbour opened again on Monday after eight weeks of repairs to its outer wall.</p>"
    "<p>+Short line.</p><p>+Yes.</p><p>+Fishing boats left at dawn and the market sold out before noon, the harbour master said.</p></article>"
    "<footer>-Copyright 2020 The Harbour Times, all rights reserved by the owners of this site.</footer>",
    "<body><header><h1><a>-The Daily Lamp</a></h1><p>-News for people who read late at night and early in the morning</p></header>"
    "<main><h2>+A quiet winter</h2><p>+Snow came late.</p><ul><li>+first the hills went white</li><li>+then the river froze</li></ul>"
    "<p>+Nobody in the valley could remember a winter as quiet as this one, and nobody complained about it either.</p></main>"
    "<aside><h3>-Most read</h3><ul><li><a>-Ten soups for cold days and how to cook them well</a><li><a>-The lamp maker</a></ul></aside>"
    "<section id=comments><h3>-3 comments</h3><div>-Great piece, thank you for writing about our valley, I grew up there.</div><div>-Nonsense!</div></section>"
    "<form>-Your name and mail address are needed to leave a comment here</form>",
    "<body><div id=cookie-notice>-We use cookies to give you the best experience on our site, read more about them in our policy.</div>"
    "<div class=menu><a>-Start</a> <a>-Shop</a></div><div class=post><h1>+How to mend a chair</h1><p>+Take the seat off first.</p>"
    "<p>+Then glue every joint, press it, and leave the chair alone for a whole day even if it looks dry after an hour.</p>"
    "<blockquote>+A chair is patient.</blockquote><div class=share><a>-Tweet</a> <a>-Mail</a></div>"
    "<p>+Sand it <a>with fine paper</a> when you are done.</p><div class=advert>-Glue now at half the price, only this week and only in our shop.</div>"
    "<p>+Enjoy.</p></div><div class=related><a>-How to mend a table</a></div><div class=footer>-Imprint</div>",
    "<body><div><a>-Home</a> | <a>-About us</a> | <a>-Contact</a></div><div><p>+Every page without any names is told by its words alone.</p></div>"
    "<div>+The old bridge was built by hand in a single summer, and the people who built it never crossed it again in their lives.</div>"
    "<div>+It carried carts, cattle, soldiers and in the end tourists, and it carried all of them without ever asking for repair.</div>"
    "<div><a>-Next page</a></div><div>-Terms <a>of use</a></div>",
    "<body><table><tr><td><a>-Index</a></td><td>+The table held the whole text of the page as old pages did, with the menu on its left side and the words here.</td></tr>"
    "<tr><td><a>-Back to the list of all pages</a></td><td>+A second row went on with the story of the lamp maker who moved to the harbour and sold soup.</td></tr></table>"
    "<div><a>-Top</a></div><div>-Made by hand.</div><div>-2004</div>",
    "<body><div>-My page</div><div>-Since 1999</div><div>+A page without any marks begins with its name, and its first long words are those that matter to readers.</div>"
    "<div>+They go on here for a while, as long as the writer has something to tell about the sea and the soup.</div>"
    "<div>-All rights reserved.</div><div>-Best viewed at night</div>",
    "<body>+A page may hold a single line of some fifteen words and nothing else beside it.",
    "<body><h1>+On tea</h1><p>+Tea is a leaf.</p><p>+It is dried, rolled and boiled, and then it is drunk from small cups by those who have the time.</p>"
    "<p>+More is not known.</p><p><a>-Back</a></p><div>-Updated in May</div>",
    "<body><div><a>-News</a> <a>-Shop</a></div><p>+It rained.</p><p>+The roofs shone and the gutters sang.</p><p>+Then the sun came out.</p>"
    "<div>-Printed on paper</div><p><a>-Print</a> <a>-Mail</a></p>",
    "<body>+The sea was calm that day, the nets were full, and everyone who had a boat was out before the sun was up.",
    "<body><div>-Harbour</div>+The first text of this page stands between its menus, without a tag of its own around it or near it.<br>"
    "+It goes on in a second line.<div>-Made with care</div>",
    "<body><div>-A box before the text offers a course in rowing to all readers who pay before the first of June, and a free lamp to the rest.</div>"
    "<article><p>+Rowing is old.</p><p>+It is done with oars.</p></article><div>-A box after the text repeats the offer for those who came from below, "
    "with a picture of the lamp and the rower who won it last year.</div><div>-Call us today</div>",
    "<body><main><p>+The lamp burned all night.</p></main><div>-You have read three of five free texts this month, and after them you will be asked to pay a little.</div>"
    "<div>-Readers of this text also liked the one about soup, the one about chairs and the one about the old bridge in the valley.</div>",
    "<body><div>-Weather: mild</div><main><h1>+Soup</h1><p>+Soup is old.</p><p>+It was cooked in clay before there were words for it.</p></main>"
    "<div>-Shop now</div><div>-Everything that is sold here is made by people who like soup and who live close to the harbour.</div>",
    "<body><nav>-Menu</nav><article><h1>+One</h1><p>+Two words.</p><section class=comments><article class=comment><p>-I do not agree with this at all, "
    "and I have said so before to everyone who would listen to me.</p></article><article class=comment><p>-Me neither.</p></article></section></article>"
    "<footer><p>-A long footer tells where the office is, when it is open, who owns the paper and how to write a letter to the people there.</p></footer>",
    "<body><article><header><h1>+Inside heads belong to the text</h1></header><p>+So do words <a>with links</a> in them.</p>"
    "<ol><li><a>+Even a list of sources, wholly linked</a></li></ol><aside>-Follow us</aside><p>+The end.</p></article>"
    "<aside><p>-Our newsletter brings you a letter every week with all that we wrote and some things that we did not write.</p></aside>"
    "<div>-Mild today, rain tomorrow.</div><div>-This box stands beside the article without saying what it is, and it sells holidays by the sea.</div>"
    "<div role=dialog><p>-Please log in to read more of these fine articles on this site today.</p></div>",
    "<body><div id=page class='site has-sidebar no-comments'><nav><a>-Home</a></nav><div class='content-sidebar wrap'><article><h1>+Nets</h1>"
    "<p>+Nets are mended in winter.</p><p>+It takes two people, a long table and more patience than most of them have in the first week of it.</p>"
    "<div class=share><a>-Tweet</a></div></article><aside><p>-The shop by the harbour sells nets to all who ask for them politely before noon.</p></aside>"
    "<div class=related><article><h3>-How to mend a chair</h3><p>-Take the seat off first.</p></article></div></div></div>",
    "<body><div><a>-Boats</a></div><article><h1><a>+Boats for the winter</a></h1><p><a>+The list of all boats that lie in the harbour until the ice is gone</a></p>"
    "<p><a>+A boat</a></p><div><a>+A drawing of the boat</a></div><p>+It is drawn up.</p><p><a>+The drawing</a> <a>+and the plan</a></p>"
    "<ul><li><a>+Hull</a><li><a>+Mast and all that hangs from it when the wind is gone</a></ul><h2><a>+Where it lies</a></h2><div>+By the wall.</div>"
    "<div><a>+Harbour plan</a></div><p>+It lies by the wall where the water is deep enough for it at any time of the day.</p></article><div><a>-Top</a></div><ul><li><a>-Nets</a></ul>",
    "<body><h2><a>-Site</a></h2><main><div><a>+The whole of the first line leads to another page of the same book</a></div><p><a>+One</a></p><p><a>+Two words</a></p>"
    "<blockquote><a>+A saying of three</a></blockquote><h3><a>+Notes</a></h3><ol><li><a>+First note</a><li><a>+Second note</a></ol></main><p><a>-Mail</a></p><div><a>-Print this</a></div>",
    "<body><p>+The ferry did not come.</p><p>+It had run out of coal on the other side of the sound, and the stoker had gone home to fetch some from his cellar.</p>"
    "<p>+We waited on the quay with our boxes until the lamps were lit and the cook asked all of us in.</p>"
    "<div class=sidebar><h3>-The house</h3><p>-Everyone who sails into our harbour should read these lines before the mast comes down and the nets are hung up.</p>"
    "<p>-They were written by people who came here by mistake and who stayed because the soup was better than elsewhere.</p>"
    "<div>-Whoever wishes to add a line may write it on the back of a card and leave it with the cook.</div></div>"
    "<div class=comments><p>-I was on that ferry and can say that there was coal enough, only nobody had wanted to carry it up.</p><p>-So was I.</p>"
    "<p>-Then you will remember the stoker, who sang all night and did not let anybody sleep before the morning came.</p></div>"
    "<div id=cookies><p>-This house keeps a list of those who read its letters, and by reading on you agree to be on it.</p><p>-You may ask to see it.</p>"
    "<p>-The list is kept in the kitchen, under the bread, and is burned at the end of each year with the other lists.</p></div>"
    "<div class=advert><div>-Coal of the best kind is sold by the brother of the stoker, who will bring it to your ship by night.</div>"
    "<div>-He takes no money before the fire burns, and he carries the ash away when you leave the harbour again.</div></div>",
    "<body><form id=page><div class='with-nav'><div class=menu><a>-Start</a></div><main class=sidebar-right><p>-A box.</p></main><main><h1>+Oars</h1>"
    "<p>+Short.</p><p>+Oars are made of ash, and ash does not mind the salt as much as other woods that grow here.</p></main></div></form>",
)


#: Pages whose blocks are plain boxes without a telling name or tag, one to a line and
#: labelled the same way ("a:" is a wholly linked box).  A short box is main text between two long
#: ones of prose, and none among links, at the ends of a page or between other short boxes.
PLAIN_PAGES = (
    """a:-Home
a:-All letters
-The letter box
+A letter from the lighthouse came with the last boat of the year, and it took us two evenings to read all of it aloud.
+It began with the weather.
+The wind had turned in the night and the keeper had not slept, since the lamp had to be watched until the morning came.
+Nobody came.
+For six weeks no boat could land, and the bread was made from the flour that had been kept for the summer guests.
a:-Older letters
-Written by hand
-Sent in June""",
    """-Garden notes
a:-Beds
a:-Trees
+Beans want warm ground, and those who sow them in April will sow them a second time in May when the first have rotted.
+Wait for it
+A hand that lies flat on the soil for a minute and does not grow cold is the best tool that a gardener can own.
+Then sow them deep
+Two beans in a hole, one for the mouse and one for the kitchen, is what the old people of the village used to say.
a:-More on beans
-Rain tonight
a:-Seeds by post
-Open on Sundays""",
    """a:-Start
-Road news
-Updated at noon
-No delays
+The road over the pass was closed at noon after a lorry had lost its load of bricks on both lanes near the chapel.
+Nobody was hurt
a:-Map of the pass
+Helpers from three villages cleared the bricks by hand until the evening, and the road was opened again before it grew dark.
-Call the road line
-Snow chains
a:-Webcam""",
    """-Today
-Soup of the day
a:-Menu
a:-Tables
+Our kitchen has cooked with the same pot since the house was built, and the pot has never once been empty in all that time.
+It is a big pot.
+Whoever comes in from the cold gets a bowl before being asked for a name, and pays when the boat has brought the money.
+So it was.
+So it will stay as long as there is someone who gets up at four in the morning to light the fire under it.
-Cash only
-Dogs welcome
a:-How to find us""",
    """a:-Back
a:-Forward
-Page nine
+The ninth day was spent in the tent, as the rain did not stop and the river had come up to the stones of the hearth.
a:-Picture of the tent
+We played cards with what was left of the pack, and the one who lost had to go out and look at the water.
+Towards evening
+It sank by a hand, and then by another, and when the moon came out we could hear the stones again under the bridge.
-Nine of thirty
a:-Day ten""",
    """-Lost and found
-Ask inside
+A brown dog with one white foot was seen on the quay on Friday and again on Sunday, and it seems to belong to nobody.
+It is friendly.
+It will take bread from any hand, but it does not want to be held, and it sleeps under the boat with the red stripe.
-No calls at night
-Thank you
a:-More notices""",
    """a:-Index
-Volume two
-Chapter four
+The miller had three sons and a mill that stood still for half of the year, since the brook was dry from May to autumn.
+The eldest left.
+He went down to the coast with a sack of flour on his back, and sold it in the first harbour for a knife and a coat.
+The second left.
+He took the donkey with him and was not heard of again until the donkey came back alone with a letter tied to its neck.
-Four of twelve
a:-Chapter five
-Printed in Lisbon""",
    """a:-News
a:-Shop
a:-Help
-Basket empty
-Free returns
+This lamp was made to burn for ten hours without being filled, and it did so in each of the forty nights we tried it.
+It is not light.
+The foot is cast from iron so that it stands when the ship rolls, and the glass can be changed without any tools at all.
-In stock
-Two years warranty
a:-Add to basket
-Ships on Monday
a:-Other lamps""",
)


def plain_page(lines: str) -> str:
    """The page of such a text."""
    boxes = [f"<div><a>{x[2:]}</a></div>" if x.startswith("a:") else f"<div>{x}</div>" for x in lines.split("\n")]
    return "<body>" + "".join(boxes)


def framed_pages(lines: str) -> list[str]:
    """The same boxes where furniture or an article around them tells, whatever stands beside them."""
    boxes = plain_page(lines).removeprefix("<body>")
    out, text = boxes.replace(">+", ">-"), boxes.replace(">-", ">+")
    first = "<article><p>+Short.</p><p>+The article itself has a long line as well, and it ends where the next box begins to speak of something else.</p></article>"
    return [f"<body><aside>{out}</aside>", f"<body>{first}<footer>{out}</footer>", f"<body><nav>{out}</nav>{first}", f"<body><main>{text}</main>"]


def labelled_rows() -> list[tuple[list[float], float]]:
    rows = []
    framed = [page for lines in PLAIN_PAGES for page in framed_pages(lines)]
    for page in (*LABELLED_PAGES, *map(plain_page, PLAIN_PAGES), *framed):
        found = blocks(page)
        for (text, *_), x in zip(found, features(found)):
            rows.append((x, float(text[0] == "+")))
    return rows


@lru_cache(maxsize=8)
def _tree(depth: int) -> tuple:
    """The fitted tree as nested tuples (feature, threshold, left, right) or a label."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame([(Vectors.dense(x), y) for x, y in labelled_rows()], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=1).fit(table.coalesce(1))

    def flat(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        return (node.split().featureIndex(), float(node.split().threshold()), flat(node.leftChild()), flat(node.rightChild()))

    return flat(model._java_obj.rootNode())


def train(depth: int = 9) -> tuple:
    return _tree(depth)


def is_main(tree, x: list[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if x[feature] <= threshold else right
    return tree > 0.5


def main_text(tree, html: str) -> str:
    found = blocks(html)
    return " ".join(b[0] for b, x in zip(found, features(found)) if is_main(tree, x))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree=None) -> DataFrame:
    """Per row of ``pages``: its id, url, text (main blocks joined by a space) and
    n_chars (code points).  Null or empty html gives an empty text; ids and urls
    pass as they are, null or repeated; other columns are not read."""
    import pyarrow as pa

    tree = tree or train()

    def batches(it):
        for b in it:
            texts = [main_text(tree, x) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f.dataType.simpleString() for f in src.schema]
    out = src.mapInArrow(batches, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
