"""Flat blocks against a plain recursion, open elements, wrappers, neighbours."""

import random
import time

import pytest

from roamlens.llm import html_blocks as H

PROSE = "<p>The harbour opened again on Monday after eight weeks of repairs to its outer wall.</p>"
SAID = PROSE[3:-4]

#: Pages of plain boxes that the tree has not seen, marked like the labelled ones.
HELD_OUT = (
    """a:-First page
-Boat house
+The boat was bought from a fisherman who had no sons, and it lay upside down in the grass for two winters before we came.
+It leaked.
+We filled the seams with tar and wool, as we had been told to, and on the third day in the water it stayed dry inside.
+That was June
+By the end of the summer we had been around the island twice and had caught more fish than we could eat or give away.
-All boats
a:-Next boat
-Tar and wool""",
    """a:-Bread
a:-Cakes
-Open from six
+The oven is as old as the street, and the street is as old as the wall, which was built when the town had been burned down.
+It bakes well.
+Nobody knows why the loaves from the left side are darker than those from the right, and nobody wishes to have that changed.
-Closed on Monday
-Ring twice
a:-The way here""",
    """-Night train
-Platform three
a:-Tickets
+The night train leaves at ten and stops wherever somebody stands with a lamp, so that nobody can tell when it will arrive.
+Bring a blanket
+The carriages are heated with wood that the guard cuts himself at the stops, and those who help him ride for half the fare.
+He sings too
+In the morning there is coffee from a can, and the sea comes up on the left side, grey at first and then suddenly blue.
-No dogs
a:-Day trains
-Mind the gap""",
)


def held_out():
    return [[(x, b[0][0] == "+") for b, x in zip(found, H.features(found))] for found in (H.blocks(H.plain_page(p)) for p in HELD_OUT)]


def test_neighbours_matter(spark):
    """On unseen plain pages the tree is right; with neighbours of another block it is not."""
    tree, rows = H.train(), [r for page in held_out() for r in page]
    right = sum(H.is_main(tree, x) == y for x, y in rows) / len(rows)
    around = [H.FEATURES.index(n) for n in ("prev_words", "prev_link_density", "next_words", "next_link_density")]
    worse = []
    for seed in range(20):
        other = [x for x, _ in rows]
        random.Random(seed).shuffle(other)
        mixed = [[o[i] if i in around else v for i, v in enumerate(x)] for (x, _), o in zip(rows, other)]
        worse.append(sum(H.is_main(tree, x) == y for x, (_, y) in zip(mixed, rows)) / len(rows))
    assert right >= 0.95 and sum(worse) / len(worse) < right - 0.1, (right, worse)


def test_wrapped_pages(spark):
    tree = H.train()
    pages = [f"<form id=aspnetForm><div class=menu><a>Start</a></div><div class=content>{PROSE * 3}</div><div class=footer>Imprint</div></form>",
             f"<div class='main-content sidebar-layout'>{PROSE * 3}</div>", f"<form>{PROSE * 3}</form>",
             f"<div class='page-navigation-enabled'><div class='post'>{PROSE * 3}</div></div>",
             f"<div class='sidebar-page'><form><div class='nav-on'>{PROSE * 3}</div></form><div class=cookie>{PROSE * 9}</div></div>"]
    assert [H.main_text(tree, x) for x in pages] == [" ".join([SAID] * 3)] * len(pages)
    # Furniture longer than the text is not what wraps it.
    for other in ("comments", "related", "newsletter"):
        assert H.main_text(tree, f"<div>{PROSE}</div><div class={other}>{PROSE * 9}</div>") == SAID, other
    for other in ("sidebar", "menu", "comments"):
        assert H.main_text(tree, f"<div class=post>{PROSE}</div><div class={other}>{PROSE * 9}</div>") == SAID, other
    assert H.main_text(tree, f"<div class=comments>{PROSE * 9}</div>") == ""
    assert H.main_text(tree, f"<article>{PROSE}<p><a>A line of links</a></p>{PROSE}</article>") == f"{SAID} A line of links {SAID}"
    assert H.main_text(tree, f"<article><h2><a>A linked title</a></h2>{PROSE}</article>") == f"A linked title {SAID}"


def test_closing_rules(spark):
    def marks(html, field):
        return [(b[0], b[field]) for b in H.blocks(html)]

    assert marks("<p>a<p>b<div>c</div>d", 7) == [("a", True), ("b", True), ("c", False), ("d", False)]
    assert marks("<p>a<table><tr><td><div>b</div></table>c", 7) == [("a", True), ("b", False), ("c", False)]
    assert marks("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f", 5) == [("a", True), ("b", True), ("c", True), ("d", True), ("e", True), ("f", False)]
    assert marks("<dl><dt>a<dd>b<dt>c</dl>", 7) == [("a", False), ("b", True), ("c", False)]
    # A new row closes the cell and what is open in it, an inner table does not.
    assert marks("<table><tr><td><blockquote>a<td>b<tr><td>c</table>", 7) == [("a", True), ("b", False), ("c", False)]
    assert marks("<table><tr><td><blockquote>a<table><tr><td>b<tr><td>c</table>d<td>e</table>", 7) == [
        ("a", True), ("b", True), ("c", True), ("d", True), ("e", False)]
    # An end tag inside a cell closes nothing outside of the table, and one without a start nothing at all.
    assert marks("<div class=post><table><tr><td>a</div>b</table>c</section>d</div>e", 3) == [
        ("a", True), ("b", True), ("c", True), ("d", True), ("e", False)]
    assert marks("<h1>a<h2>b</h2>c", 6) == [("a", True), ("b", True), ("c", False)]
    assert marks("<head><title>t</title><div>a</div>", 4) == [("a", False)]


@pytest.mark.parametrize("unit", ["<div>x", "<tr><td>a b<td>c d", "<dt>a<dd>b", "<p>a</div>", "<div class=sidebar>x", "<ul><li>x", "<table><tr><td>x",
                                  "<h1>x", "<form>x</div></form></td>", "<nav><article>x", "x</td></li></p></form>"])
def test_linear_in_open_elements(unit):
    began = time.time()
    assert len(H.blocks("<table>" + unit * 100_000)) >= 1
    assert time.time() - began < 30


# --- against a recursion over whole trees -------------------------------------

NAMES = ["", "", "", "post", "sidebar", "comments", "x"]


def tree_of(r, depth=0):
    """(tag, class, children) with texts as leaves; no rule closes any of it early."""
    tag = r.choice(["div", "section", "article", "main", "nav", "ul", "h2", "blockquote", "form", "header"])
    inner = [f"w{r.randrange(99)} " * r.randint(1, 3) if depth > 4 or tag == "h2" or r.random() < 0.5 else tree_of(r, depth + 1) for _ in range(r.randint(1, 4))]
    return tag, r.choice(NAMES), inner


def write(node):
    return node if isinstance(node, str) else f"<{node[0]} class='{node[1]}'>" + "".join(map(write, node[2])) + f"</{node[0]}>"


def expected(node, path=()):
    """Blocks of a tree, each with what a look along its whole path says."""
    if isinstance(node, str):
        main = lambda t, c: t in H.MAIN_TAGS and c not in ("sidebar", "comments")
        soft = lambda p: [i for i, (t, c) in enumerate(p) if t != "nav" and not bare(p, i) and (t == "form" or c in ("sidebar", "comments"))]
        marked = lambda p: any(main(t, c) or (c == "post" and t not in ("nav", "form") and not bare(p, i)) for i, (t, c) in enumerate(p))
        bare = lambda p, i: p[i][0] == "header" and not marked(p[:i])
        hard = any(t == "nav" or bare(path, i) for i, (t, _) in enumerate(path))
        tags = [t for t, _ in path]
        yield (" ".join(node.split()), len(node.split()), 0, marked(path), hard, len(soft(path)),
               any(t in H.HEADINGS for t in tags), any(t in H.PARAGRAPHS for t in tags))
        return
    run = []
    for child in (*node[2], None):
        if isinstance(child, str):
            run.append(child)
            continue
        if run:
            yield from expected("".join(run), (*path, node[:2]))
            run = []
        if child is not None:
            yield from expected(child, (*path, node[:2]))


def test_blocks_against_recursion(monkeypatch):
    """What stands around a block, by counts and by a look along the whole path."""
    monkeypatch.setattr(H, "_in_furniture", lambda found, softs: [(b[3][0], b[3][1]) for b in found])
    for seed in range(400):
        r = random.Random(seed)
        root = ("body", "", [tree_of(r) for _ in range(3)])
        got = [(*b[:4], *b[4], *b[6:]) for b in H.blocks(write(root))]
        assert got == list(expected(root)), write(root)
