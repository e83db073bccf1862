"""Texts and pages that are long, odd or of common markup: every one gets its result, in time."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from spokeline.llm import html, toxicity


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(np.random.default_rng(0).random((64, 64, 64)).astype(np.float32) * 5)


@pytest.mark.parametrize("run", ["." * 100_000, "-" * 100_000, "| " * 50_000, "! " * 50_000, "*" * 5_000 + "bc", "a" + "." * 100_000 + "b", "|" + "-" * 100_000 + "|", "-.-." * 25_000, "a*" * 3_000 + "bcd", "(" * 100_000, "! a " * 25_000, "$ " * 50_000 + "xy"])
def test_runs_of_signs_in_time(restorer, run):
    began = time.time()
    for text in (run, run + "a", "Introduction" + run + "12", run + " word"):
        assert isinstance(restorer.restore(text), str)
    assert time.time() - began < 30


def test_tables_and_leaders_keep_their_words(restorer):
    text = "contents\nintroduction" + "." * 60 + " 12\n| name | size |\n|-----|-----|\n| one | two |\n" + "=" * 80
    assert restorer.restore(text) == text


def by_definition(chunk):
    """Brackets before, then the shortest core that closing marks and runs of a sign can follow."""
    head = re.match(r"""[("'\[{<]*""", chunk)[0]
    rest = chunk[len(head) :]
    ends = {len(rest)}
    for i in range(len(rest) - 1, -1, -1):
        if rest[i] in ".,;:!?\"')]}>" and i + 1 in ends:
            ends.add(i)
        if not (rest[i].isalnum() or rest[i] == "_" or rest[i].isspace()):
            j = i
            while j < len(rest) and rest[j] == rest[i]:
                j += 1
                if j - i >= 3 and j in ends:
                    ends.add(i)
    cut = min(ends)
    return head, rest[:cut], rest[cut:]


def test_edges_and_groups_by_their_definitions():
    rng = random.Random(1)
    separators, one = toxicity.BY_ONES, lambda c: c.isalnum() or c in toxicity.LOOK_ALIKES
    for _ in range(6000):
        chunk = "".join(rng.choice("ab1_!!..--**(\"'|@x") for _ in range(rng.randint(0, 11)))
        assert toxicity.edges(chunk) == by_definition(chunk), chunk

        def groups(at, n):
            """Whether so many groups from here end well."""
            for size in (1, 2):
                if at + size <= len(chunk) and all(map(one, chunk[at : at + size])):
                    z = at + size
                    if n >= 2 and not (z < len(chunk) and chunk[z].isalnum()):
                        return True
                    if z < len(chunk) and chunk[z] in separators and groups(z + 1, n + 1):
                        return True
            return False

        want = any(not (i and chunk[i - 1].isalnum()) and groups(i, 0) for i in range(len(chunk)))
        assert toxicity.by_ones(chunk) == want, chunk


WORDS = "This is the text of the article, which is long enough, has commas, and says something about its matter to all who read it."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="single no-sidebar"><p>{WORDS}</p></body>',
        f'<body><article class="post has-sidebar"><p>{WORDS}</p></article></body>',
        f'<body><div id=content class="search-results-off"><p>{WORDS}</p></div></body>',
        f'<body class="cookie-consent-ready"><p>{WORDS}</p></body>',
        f'<body><main><div class="post-content share-enabled"><p>{WORDS}</p></div></main></body>',
        f'<body><div title="the hidden truth"><p>{WORDS}</p></div></body>',
        f'<body><a name="top"><div><p>{WORDS}</p></div></body>',
        f'<body><a href="#top">Top<div><p>{WORDS}</p></div><a href="#end">End</a></body>'.replace("Top", ""),
        f'<body><main class="search with-aside"><p>{WORDS}</p></main></body>',
        f'<html class="js no-touch menu-closed"><body><div class="layout with-sidebar"><article class="post related-off"><p>{WORDS}</p></article></div></body></html>',
    ],
)
def test_articles_of_common_markup_stay(page):
    assert html.main_text(page).split("\n")[0] == WORDS


def test_what_is_not_the_article_still_goes():
    rest = "".join(f'<{tag} {name}><p>Leave this out, please, it is not part of the article, whatever its length, with commas, and so on.</p></{tag}>' for tag, name in [
        ("div", 'class="sidebar"'), ("div", 'class="site-footer"'), ("section", 'id="comments"'), ("article", 'class="comment-body"'), ("div", "hidden"), ("div", 'aria-hidden="true"'), ("div", "style='color:red; display: none'"),
        ("div", 'role="navigation"'), ("div", 'class="cookie-notice big"'), ("nav", ""), ("div", 'class="main-nav"')])
    assert html.main_text(f"<body><article><p>{WORDS}</p><p>{WORDS}</p></article>{rest}</body>") == f"{WORDS}\n{WORDS}"


def test_unclosed_sections_in_time():
    began = time.time()
    for part in ("<![CDATA[>", "<!x", "<a href=x>", "<a ", '<p class="a', "<?php "):
        assert WORDS in html.main_text(f"<body><p>{WORDS}</p>" + part * (10_000_000 // len(part) if part == "<![CDATA[>" else 60_000))
    assert time.time() - began < 60
