import itertools
import os
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urlrisk.llm.chat import BEFORE, STATES, TRANSITIONS, best_path, block_matrix, emissions, format_chats, split_marker
from urlrisk.llm import neighbours, registry
from urlrisk.llm.html_text import SURGE_SHARE, WINDOW, extract_text, main_text, regions
from urlrisk.llm.neighbours import fit_forest, nearest

SF = "/root/testdata/sf0.01"

PAGE = """<html><head><title>T</title></head><body><header><a href=/>Home</a> site</header><div id="cookie-notice">We use cookies <button>ok</button></div>
<div class="content"><h1>Title &amp; more</h1><p>First para with <a href=x>a link</a> and&nbsp;text that is long enough to count, really it is so.</p><p>Short.</p>
<div class="ad-slot">Buy now</div><p>Second &lt;para&gt; &eacute;.</p></div><div class="sidebar"><p>Other stories you may like, long text long text long text long text</p></div>
<section id=comments><p>I agree with everything in this very long comment text. I agree with everything.</p></section><form><p>Sign up</p></form><footer>c</footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE) == "Title & more\nFirst para with a link and text that is long enough to count, really it is so.\nShort.\nSecond <para> é."


def test_article_is_kept_whole():
    page = '<nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Long advert text, long advert text, long advert text.</div><article><h1>H</h1><p><b>B.<br><p>x   y\n z</p><p>&quot;q&quot;</article><footer>&copy; f</footer>'
    assert main_text(page) == 'H\nB.\nx y z\n"q"'


PARAGRAPHS = "".join(f"<p>Paragraph {k} of the article goes on and on here.</p>" for k in range(6))
TEXT = "\n".join(f"Paragraph {k} of the article goes on and on here." for k in range(6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="content has-sidebar">{PARAGRAPHS}</div>', TEXT),
        (f'<div class="layout no-sidebar">{PARAGRAPHS}</div>', TEXT),
        (f'<div class="sidebar"><div>{PARAGRAPHS}</div></div>', TEXT),  # it holds most of the text
        (f'<article class="post comment-open">{PARAGRAPHS}<div class="legal"><p>Law</p></div></article>', TEXT + "\nLaw"),
        (f'<article><div class="post-header"><h1>Head</h1></div>{PARAGRAPHS}</article>', "Head\n" + TEXT),
        (f"<form id=aspnetForm><div>{PARAGRAPHS}</div></form>", TEXT),
        (f"<body><div><h1>T</h1>{PARAGRAPHS}</div><div>Unrelated blurb text about something else.</div></body>", "T\n" + TEXT),
        (f"<h1>T</h1><div class=ad>Buy</div><div>{PARAGRAPHS}</div>", "T\n" + TEXT),
        (f"<div>{PARAGRAPHS}<p><a href=x>A paragraph that is mostly a link</a>.</p></div>", TEXT + "\nA paragraph that is mostly a link."),
        (f"<article><h3><a href=1>Teaser</a></h3><p>few words</p></article><div>{PARAGRAPHS}</div>", TEXT),
        (f"<article>{PARAGRAPHS}<section id=comments><article class=comment><p>{'I agree. ' * 99}</p></article></section></article>", TEXT),
        (f"<article>{PARAGRAPHS}<p>a<span hidden>not</span>b</p></article>", TEXT + "\nab"),
        ("<p>AT&am<b></b>p;T and AT&amp;T", "AT&amp;T and AT&T"),
        ("<head><meta charset=x><body><p>The head was never closed", "The head was never closed"),
    ],
)
def test_structure_only_weighs(page, text):
    assert main_text(page) == text


class Article(HTMLParser):
    """The blocks of the article element of pages without other markup in it, by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.now = False, [], []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.now.append(" ")
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.end()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)

    def end(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")
def test_query_equals_another_parser(spark):
    """All pages of the table, whose article elements hold the whole article and nothing else."""
    got = registry.op3_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        truth = Article()
        truth.feed(pages[r.page_id])
        truth.close()
        assert r.text == "\n".join(truth.blocks) and r.n_chars == len(r.text)


def flat(page):
    """Without structural elements and names: all of them are plain ``div``."""
    page = re.sub(r"(</?)(article|main|nav|header|footer|aside|form|section)\b", r"\1div", page)
    return re.sub(r'\s(class|id)="[^"]*"', "", page)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")
def test_pages_without_any_structure(spark):
    """The same texts where neither elements nor names tell what is what."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        truth = Article()
        truth.feed(r.html)
        truth.close()
        assert main_text(flat(r.html)) == "\n".join(truth.blocks)


def links(word, n=5):
    return "<ul>" + "".join(f"<li><a href={k}>{word} {k}</a></li>" for k in range(n)) + "</ul>"


SPLIT = f"<body>{links('Menu')}<p>Log in here.</p>{links('Topic')}<h1>T</h1>{PARAGRAPHS}{links('Related')}<p>Copyright by us, all rights reserved.</p>{links('About')}</body>"


def test_surge_and_dive_decide():
    """All in one container: only the dives of the sums tell the article from what surrounds it."""
    whole = lambda sizes: [(0, len(sizes))]
    assert main_text(SPLIT) == "T\n" + TEXT
    assert main_text(SPLIT, whole) == "Log in here.\nT\n" + TEXT + "\nCopyright by us, all rights reserved."


ONE_BY_ONE = [f"<p>Paragraph {k} of the article goes on and on here.</p>" for k in range(6)]
TALK = "<p>I agree very much with all of it, really, I do agree.</p><p>Me too, I agree with it all, I say so here and now.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><div class="banner"><h1>Head</h1></div>{PARAGRAPHS}</article>', "Head\n" + TEXT),
        (f'<div class="header"><h1>Head</h1></div><div>{PARAGRAPHS}</div>', "Head\n" + TEXT),
        (f'<div class="masthead"><h1>Head</h1></div><article>{PARAGRAPHS}</article>', "Head\n" + TEXT),
        (f"<header><h1>Site</h1><a href=/>Home</a></header><div>{PARAGRAPHS}</div>", TEXT),
        (f'<article>{PARAGRAPHS}<p class="notice">Note this.</p><p class="share">A share of it.</p></article>', TEXT + "\nNote this.\nA share of it."),
        (f'<article>{"".join(ONE_BY_ONE[:3])}<div class="widget">{"".join(ONE_BY_ONE[3:5])}</div>{ONE_BY_ONE[5]}</article>', TEXT),
        (f"<article>{PARAGRAPHS}<h2>Sources</h2>{links('Book', 3)}</article>", TEXT + "\nSources\nBook 0\nBook 1\nBook 2"),
        (f'<article>{PARAGRAPHS}<div class="reader-comments">{TALK}</div></article>', TEXT),
        (f'<article>{PARAGRAPHS}<div class="ad-slot">Buy it now.</div><p class="advert">Buy.</p></article>', TEXT),
        (f'<body><div>{PARAGRAPHS}</div><div class="discussion">{TALK}</div></body>', TEXT),
        (f'<body><div>{PARAGRAPHS}</div><div class="teasers">{TALK}</div></body>', TEXT),
        (f'<body><div class="cookie-law-info">{TALK}</div><div>{PARAGRAPHS}</div></body>', TEXT),
        (f"<div>Advert in a bare box.</div><div><h1>T</h1><p>A short article of one sentence alone.</p></div><div>Footer in a bare box.</div>", "T\nA short article of one sentence alone."),
    ],
)
def test_names_and_headlines(page, text):
    assert main_text(page) == text


def regions_by_definition(sizes):
    """Surges and dives found by looking at every pair of places."""
    n = len(sizes)
    filled = [s != 0 for s in sizes]
    stretches = []  # longest stretches that begin and end with text and have no gap as long as a window
    for a in range(n):
        for z in range(a + 1, n + 1):
            inner = all(any(filled[k : k + WINDOW]) for k in range(a, z - WINDOW + 1))
            closed = not any(filled[max(0, a - WINDOW) : a]) and not any(filled[z : z + WINDOW])
            if filled[a] and filled[z - 1] and inner and closed:
                stretches.append((a, z))
    top = max((sum(sizes[k : k + WINDOW]) for k in range(n)), default=0)
    return [{k for k in range(a, z) if filled[k]} for a, z in stretches if any(sum(sizes[k : k + WINDOW]) >= SURGE_SHARE * top > 0 for k in range(a, z))]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 30, 100]), max_size=25))
def test_regions_equal_their_definition(sizes):
    assert [{k for k in range(a, z) if sizes[k]} for a, z in regions(sizes)] == regions_by_definition(sizes)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</i>" * 40_000, '<a "' * 50_000, "<li><b>" * 50_000, "<p><b>x" * 50_000, "<select><div>" * 20_000, "<td>x" * 50_000, "<!--" * 50_000, "<!" * 500_000, "<?" * 500_000, "<!x <p>" * 50_000, "<h1>" * 50_000, "<div class=ad>x" * 30_000])
def test_large_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_odd_pages(spark):
    assert [main_text(x) for x in (None, "", "plain", "a < b <p>c", "<nav><article><p>in", "<script>x</script>", "<p", "<!-- <p>no</p>")] == ["", "", "plain", "a < b\nc", "in", "", "", ""]
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (2, "v", "<p>" + "w " * 100_000, 3), (2, "v", "<p>" + "w " * 100_000, 3)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_markers():
    assert split_marker("User: hi") == ("user", "hi")
    assert split_marker("### Assistant: yes") == ("assistant", "yes")
    assert split_marker("[SYSTEM] be kind") == ("system", "be kind")
    assert split_marker("Note: this") == (None, "Note: this")


def viterbi(lines):
    e = [emissions(*x) for x in lines]
    score = TRANSITIONS[BEFORE] + e[0]
    for x in e[1:]:
        score = (score[:, None] + TRANSITIONS).max(axis=0) + x
    return best_path(e, BEFORE, int(score.argmax()))


def test_blocks_equal_one_pass(spark):
    """Cutting a conversation into blocks changes neither roles nor text."""
    rng = random.Random(8)
    rows = []
    for conv in range(6):
        for turn in range(rng.choice([1, 2, 9, 150])):
            who = ("User: ", "Assistant: ", "", "[system] ")[rng.choice([0, 0, 1, 1, 2, 3])]
            rows.append((conv, turn, who + rng.choice(["what is it?", "Sure, here it is", "- item\n- item", "text", "", "You are a helper"])))
    more = [(None, 1, "User: no id"), (99, None, None), (99, 3, ""), (98, -5, "Q: x"), (98, -5, "Q: x")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows + more], "conv_id long, turn long, text string, role int")
    whole = {r.conv_id: r for r in format_chats(df, span=10**6).collect()}
    assert len(whole) == 9
    parts = {}
    for r in sorted(format_chats(df, span=3, fan=4).collect(), key=lambda r: r.block):
        parts.setdefault(r.conv_id, []).append(r)
    for conv, r in whole.items():
        assert "".join(p.chat for p in parts[conv]) == r.chat
        assert ",".join(p.roles for p in parts[conv] if p.roles) == r.roles
        assert sum(p.n_turns for p in parts[conv]) == r.n_turns
    for conv in range(6):
        lines = [(line, k == 0) for _, _, t in sorted(x for x in rows if x[0] == conv) for k, line in enumerate(t.split("\n"))]
        assert whole[conv].n_lines == len(lines)
        assert whole[conv].n_turns == sum(s % 2 == 0 for s in viterbi(lines))
    assert format_chats(df.limit(0)).count() == 0


def all_paths(lines):
    """The best of all paths, each scored as a whole."""
    e = [emissions(*x) for x in lines]
    n = len(STATES) - 1

    def score(path):
        return sum(TRANSITIONS[a, b] + x[b] for a, b, x in zip((BEFORE, *path), path, e, strict=False))

    return max(itertools.product(range(n), repeat=len(lines)), key=score)


def test_path_is_the_best_of_all():
    rng = random.Random(12)
    pieces = ["User: hi", "Assistant: yes", "what is it?", "Sure, here it is", "- item", "text", "", "You are a helper", "[system] be kind", "x" * 500]
    for _ in range(40):
        lines = [(rng.choice(pieces), rng.random() < 0.5) for _ in range(rng.randint(1, 4))]
        best = all_paths(lines)
        e = [emissions(*x) for x in lines]
        assert best_path(e, BEFORE, best[-1]) == list(best)
        assert np.isclose(block_matrix(e)[BEFORE].max(), block_matrix(e)[BEFORE][best[-1]])


def test_crowded_blocks_are_cut(spark):
    """Rows of one conversation that all have the same turn, or none, in blocks of at most ``span`` rows."""
    rows = [(7, turn, f"{'User' if k % 2 else 'Assistant'}: line {k:05d}") for turn in (None, 4) for k in range(700)]
    df = spark.createDataFrame([*rows, (8, 1, "User: hi"), (8, 900, "Sure, it is")], "conv_id long, turn long, text string")
    got = sorted(format_chats(df, span=10, fan=4).collect(), key=lambda r: (r.conv_id, r.block))
    assert max(r.n_lines for r in got) <= 10 and sum(r.n_lines for r in got) == 1402
    order = [t.split(": ")[1] for turn in (None, 4) for t in sorted(t for _, u, t in rows if u == turn)]
    chat = "".join(r.chat for r in got if r.conv_id == 7)
    assert [line for line in chat.split("\n") if line.startswith("line")] == order
    assert chat.count("<|user|>") == chat.count("<|assistant|>") == 700
    whole = sorted(format_chats(df, span=10**6).collect(), key=lambda r: r.conv_id)
    assert chat == whole[0].chat and "".join(r.chat for r in got if r.conv_id == 8) == whole[1].chat


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")
def test_query_recovers_roles(spark):
    """Roles of the table's turns, and of those alone that have no mark in the transcript."""
    truth = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id", "turn", "role", "pmod(xxhash64(conv_id, turn), 8) = 0 AS bare").collect()
    chats = {}
    for r in sorted(registry.op7_chat(spark, SF).collect(), key=lambda r: r.block):
        chats.setdefault(r.conv_id, []).extend(r.roles.split(",") if r.roles else [])
    by_conv = {}
    for r in sorted(truth, key=lambda r: r.turn):
        by_conv.setdefault(r.conv_id, []).append(r)
    assert set(chats) == set(by_conv)
    right = {c: len(chats[c]) == len(t) and [x.role for x in t] == chats[c] for c, t in by_conv.items()}
    bare = [chats[c][k] == x.role for c, t in by_conv.items() if len(chats[c]) == len(t) for k, x in enumerate(t) if x.bare]
    assert np.mean(list(right.values())) > 0.97 and len(bare) > 20 and np.mean(bare) > 0.95


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the generated tables")
def test_query_finds_most_neighbours(spark):
    """Recall of the query on the table of sf0.1, against brute force."""
    folder = SF.replace("0.01", "0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mine = {}
    for r in registry.op5_neighbours(spark, folder).collect():
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    found = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cos = x @ x[q]
        cos[q] = -2
        best = ids[np.lexsort((ids, -cos))[:5]]
        found += len(mine[ids[q]] & set(best.tolist()))
        total += 5
    assert found / total >= 0.9


def test_a_crowd_of_nearly_equal_vectors(spark):
    """Each leaf gives a query no more than it needs, in the exact order, though single precision can't tell them apart."""
    rng = np.random.default_rng(11)
    x = np.concatenate([1 + 1e-7 * rng.normal(size=(900, 8)), rng.normal(size=(100, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 100 = 0"), leaf_rows=2000)
    mine = {}
    for r in got.collect():
        mine.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, 1000, 100):
        cos = (x * x[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[q] * x[q]).sum()))
        order = [j for j in np.lexsort((np.arange(1000), -cos)).tolist() if j != q][:5]
        assert [mine[q][k + 1] for k in range(5)] == [(j, cos[j]) for j in order]


def test_all_leaves_can_be_walked():
    forest = fit_forest(np.random.default_rng(1).normal(size=(500, 8)), 3, 4)
    leaves = list(forest.walk(np.zeros(8, np.float32)))
    assert sorted(leaves) == [(t, k) for t in range(3) for k in range(16)]


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16))
    x[700:] += 4 * rng.normal(size=(8, 16))[rng.integers(0, 8, 800)]
    x[40:60] = x[40]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (2006, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = nearest(df, df.where("vec_id % 50 = 0"), leaf_rows=64, trees=8).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
        assert abs(r.score - float(unit[r.query_id] @ unit[r.vec_id])) < 1e-12 and r.vec_id != r.query_id
    for q in range(0, 1500, 50):
        cos = np.round(unit @ unit[q], 12)
        order = [j for j in sorted(range(1500), key=lambda j: (-cos[j], j)) if j != q][:5]
        mine = sorted(by_query[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        found += len({r.vec_id for r in mine} & set(order))
        total += 5
    assert set(by_query) == set(range(0, 1500, 50)) and found / total >= 0.9
    assert [r.vec_id for r in sorted(by_query[50], key=lambda r: r.rank)] == [40, 41, 42, 43, 44]
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 10)
    again = nearest(df, df.where("vec_id % 50 = 0"), leaf_rows=64, trees=8).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in again} == {(r.query_id, r.rank, r.vec_id) for r in got}
    monkeypatch.undo()
    few = nearest(df.where("vec_id < 3"), df.where("vec_id < 1")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert nearest(df.where("vec_id > 1999"), df.where("vec_id > 1999")).count() == 0
    assert nearest(df.limit(0), df.limit(0)).count() == 0
