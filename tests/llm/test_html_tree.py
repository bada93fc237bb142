"""The block classifier on unmarked pages, what the neighbours add, and time on broken nesting."""

import time

import numpy as np
import pytest

from casegrid.llm import html_text as H

LONG = "Running text of this page goes on for well over a dozen words so that it stands on its own."
MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>World news</a></li><li><a href=3>Sport</a></li></ul>"
ENDS = "<ul><li><a href=4>Contact</a></li><li><a href=5>Terms of use</a></li></ul><p>© 2020 The Company</p>"

# Pages without marked content, and their main text.
PAGES = [
    (f"<h1>Title</h1><p>Short para.</p><p>{LONG}</p><p>End.</p>", ["Title", "Short para.", LONG, "End."]),
    (f"{MENU}<h1>Title of it</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>{ENDS}", ["Title of it", LONG, "Yes.", LONG]),
    (f"<p>{LONG}</p><h2>A part</h2><p>{LONG}</p><blockquote>To be or not to be.</blockquote>", [LONG, "A part", LONG, "To be or not to be."]),
    (f"<p>{LONG}</p><p><a href=x>The whole report</a></p><p>{LONG}</p>", [LONG, "The whole report", LONG]),
    (f"{MENU}<p>{LONG}</p><h3>Last</h3><p>Few words.</p>", [LONG, "Last", "Few words."]),
    (f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><h4>More stories</h4>{MENU}{ENDS}", ["Title", LONG, LONG]),
    (f"<div>Search this site</div><div>Log in</div><div>{LONG}</div><div>A short line stands between the two.</div><div>{LONG}</div>",
     [LONG, "A short line stands between the two.", LONG]),
    (f"<div>Search it</div><div>Log in</div><div>Yes</div><div>{LONG}</div><div>Yes.</div><div>{LONG}</div>", [LONG, "Yes.", LONG]),
    (f"<h2>Fruit</h2><ul><li>Apples</li><li>Green pears</li></ul><p>{LONG}</p>", ["Fruit", "Apples", "Green pears", LONG]),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_unmarked_pages(page, want):
    assert H.main_text(f"<html><body>{page}</body></html>", H.labelled_tree()).split("\n") == want


@pytest.mark.parametrize("without", ["words_before words_after".split(), "links_before links_after".split()])
def test_neighbours_decide(without):
    """A tree that can't see the neighbours' words or links gets pages wrong that the whole one gets right."""
    x, y = H.labelled_blocks()
    columns = [H.FEATURES.index(f) for f in without]
    x[:, columns] = 0
    tree = H.fit(x, y)

    class Blind:
        def predict(self, rows):
            rows = rows.copy()
            rows[:, columns] = 0
            return tree.predict(rows)

    assert any(H.main_text(page, Blind()).split("\n") != want for page, want in PAGES)
    assert ((tree.predict(x) >= 0.5) != y).any()


def test_marked_text_is_whole():
    refs = "<h2>References</h2><ul>" + "".join(f"<li><a href={i}>Author {i}, a paper of some length, 2001</a></li>" for i in range(4)) + "</ul>"
    page = f"{MENU}<article><h1>T</h1>{MENU}<p>{LONG}</p><p><a href=x>The whole report</a></p><p>{LONG}</p><div>Loose.</div>{refs}</article>{ENDS}"
    assert H.main_text(page, H.labelled_tree()).split("\n") == [
        "T", LONG, "The whole report", LONG, "Loose.", "References", *(f"Author {i}, a paper of some length, 2001" for i in range(4))]


def test_rules_of_marks_and_names():
    """On random blocks: named or outside the marked part goes, unlinked marked text stays, and so does unmarked
    text away from links."""
    rng = np.random.default_rng(3)
    rows = np.zeros((20_000, len(H.FEATURES)))
    for f in (0, 2, 4):
        rows[:, f], rows[:, f + 1] = np.round(np.exp(rng.uniform(0, 6, len(rows)))), rng.choice([0, 0.1, 0.5, 1], len(rows))
    rows[:, 6], rows[:, 9], rows[:, 10] = rng.random(len(rows)) < 0.2, rng.choice([0, 1, 2], len(rows)), rng.random(len(rows)) < 0.2
    rows[:, 7] = np.maximum(rows[:, 6], rng.random(len(rows)) < 0.5)
    rows[:, 8] = (main := rows[:, 9]) * (rng.random(len(rows)) < 0.2) == 2       # lines of rights, in marked text
    kept, main, named = H.labelled_tree().predict(rows) >= 0.5, rows[:, 9], rows[:, 10] == 1
    assert not kept[named | (main == 0)].any() and kept[~named & (main == 2) & (rows[:, 1] <= 0.5)].all()
    assert kept[~named & (main == 1) & (rows[:, 7] == 1) & (rows[:, [1, 3, 5]] < 0.3).all(1)].all()


@pytest.mark.parametrize("unit", ["<div><p>w ", '<a <b "', "<b>x", "<center>", "<a href=x><div>y", "<i><p>z</i>", "<div class='related'>w <a href=x>", "</i>", "<!-", "<li><ul>", "<p title=don't>x "])
def test_time_grows_with_length(unit):
    tree = H.labelled_tree()
    start = time.monotonic()
    H.main_text(unit * 30_000 + "</i>" * 30_000, tree)
    assert time.monotonic() - start < 15            # the square of it takes minutes


def test_unclosed_anchors_and_quotes():
    tree = H.labelled_tree()
    assert H.main_text(f'<article><a name="comments" class="comments"><p>{LONG}</p><a name=b><p>{LONG}</p></article>', tree).split("\n") == [LONG, LONG]
    assert H.main_text(f'<article><p title="broken>{LONG}</p><p>{LONG}</p></article>', tree).split("\n") == [LONG, LONG]
