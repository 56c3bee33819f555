import time

import pytest

from factloom.llm import wrappers
from factloom.llm.wrappers import extract, main_text


def page(i, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/{i}">link {i}</a></li></ul></nav><div class="x{"yz"[i % 2]}"><p>Same words on all pages</p></div><div class="body">{body}</div>{extra}<footer>&copy; f{i}</footer></body></html>'


def test_constants_go_and_slots_stay(spark):
    rows = [(i, f"http://h.example/{i}", page(i, f"<h1>Head {i}</h1><p>Text <b>num</b>ber {i}<br>more &amp; <i>more</i>\n\n x</p><div class='comments'>c{i}</div>")) for i in range(20)]
    rows += [(100, "http://h.example/z", None), (101, None, ""), (102, "bad url", "<p>un<b>closed<p>next<!-- x"), (103, "http://k.example", "<article><p>A</p><aside>no</aside></article><p>outside</p>"), (104, "http://h.example/z", "<" * 3000), (105, "u", "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        assert got[i].text == f"Head {i} Text number {i} more & more x" and got[i].n_chars == len(got[i].text)
    assert [got[k].text for k in (100, 101, 102, 103)] == ["", "", "unclosed next", "A"]
    assert got[105].text == "deep"


def test_many_wrappers_meet_pages_by_salt(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", page(i, f"<p>Text {i}</p>")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, extract(df).collect()))
    monkeypatch.setattr(wrappers, "SENT", 0)
    assert sorted(map(tuple, extract(df).collect())) == want


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_entities_and_raw_elements():
    assert main_text("<article>a&lt;b <script>if (a<b) {}</script><textarea>x</textarea>c&nbsp;d</article>", None) == "a<b c d"


def test_no_caps_on_children_depth_or_pages(spark):
    """Constants beside hundreds of other kinds of children, an article below hundreds of open elements, and noise as deep."""
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    deep, shut = "<div>" * 400, "</div>" * 400
    rows = []
    for i in range(12):
        kinds = "".join(f'<section class="k{letters(100 * i + j)}">only here {i} {j}</section>' for j in range(90))
        rows.append((i, f"http://many.example/{i}", f'<body>{kinds}<div class="bar">Same on all pages</div><p>Text {i}</p></body>'))
        rows.append((100 + i, f"http://deep.example/{i}", f"<body>{deep}<article><p>Start {i}</p>{deep}<nav>menu {i}</nav><p>End {i}</p>{shut}<p>Last {i}</p></article>{shut}<p>outside</p></body>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert "Same on all pages" not in got[i] and f"only here {i} 89" in got[i] and got[i].endswith(f"Text {i}")
        assert got[100 + i] == f"Start {i} End {i} Last {i}"


def test_order_of_pages_does_not_matter():
    import random

    rng = random.Random(4)
    trees = [wrappers.collapse([wrappers.parse(page(i, "".join(rng.choice([f"<p>x{i}</p>", "<h2>same</h2>", "<ul><li>a</li></ul>", f"<div class='q{rng.choice('abc')}'>y</div>"]) for _ in range(6))))], "#", "#") for i in range(20)]
    results = set()
    for _ in range(4):
        rng.shuffle(trees)
        whole = None
        for x in trees:
            t = wrappers.as_template(x, x["hash"])
            whole = wrappers.merge(whole, t) if whole else t
        w = wrappers.decide(whole)
        assert wrappers.loads(wrappers.dumps(w)) == w
        results.add(tuple(sorted((path, d) for path, d in paths(w))))
    assert len(results) == 1


def paths(w, above=()):
    out = [((*above, w["kind"]), w["d"])]
    for c in w["kids"].values():
        out += paths(c, (*above, w["kind"]))
    return out


def plain_matching(x, y):
    """The most nodes that two lists of children share in order, by trying all choices."""
    a, b = (sorted(t["kids"].values(), key=lambda c: c["i"]) for t in (x, y))

    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        most = max(best(i + 1, j), best(i, j + 1))
        if a[i]["kind"] == b[j]["kind"]:
            most = max(most, 1 + plain_matching(a[i], b[j]) + best(i + 1, j + 1))
        return most

    return best(0, 0)


def test_matching_against_brute_force():
    import random

    rng = random.Random(8)

    def tree(depth):
        kinds = rng.sample("abcdef", rng.randrange(5)) if depth else []
        return {"kids": {k: tree(depth - 1) | {"kind": k, "i": i} for i, k in enumerate(kinds)}}

    for _ in range(150):
        x, y = tree(3), tree(3)
        assert wrappers.match(x, y, {})[0] == plain_matching(x, y)


WRAPPED = [
    ('<div class="content has-sidebar"><article><p>The story.</p></article></div>', "The story."),
    ('<div id="page" class="no-comments"><p>The story.</p></div>', "The story."),
    ('<div id="page" class="no-comments"><article><p>The story.</p></article></div>', "The story."),
    ('<article><p>One.</p><div class="notice-board">Two.</div></article>', "One. Two."),
    ('<div class="widget sidebar"><main>The story is here.</main></div>', "The story is here."),
    ('<form id="aspnetForm"><div class="search"><article>All of it.</article></div></form>', "All of it."),
    ('<div class="layout-with-sidebar"><div class="promo-page"><p>Most of the text of this page stands here.</p></div><div class="site-nav">Some links</div></div>', "Most of the text of this page stands here."),
    ('<article>Short.</article><div class="comments"><p>A comment that is far longer than the article is.</p></div>', "Short."),
    ('<article>Story.<div class="comment-list">I disagree.</div><div class="ad-slot">Buy!</div></article>', "Story."),
    ('<article>Story, a long one.</article><aside><article>Another story.</article></aside>', "Story, a long one."),
    ('<article>Story, a long one.</article><div id="comments"><article class="comment">No.</article></div>', "Story, a long one."),
    ('<div class="post">Text of the post.</div><div class="comments">Words of readers, many more than the post has, on and on.</div>', "Text of the post."),
    ('<div class="site-nav">Home</div><div class="cookie-banner">We ask.</div><div class="post">Text of the post.</div>', "Text of the post."),
    ("<div hidden>Off.</div><div class='hidden'>Off.</div><p>On.</p>", "On."),
    ("", ""),
]


@pytest.mark.parametrize("page,text", WRAPPED)
def test_no_wrapper_swallows_the_article(page, text):
    assert main_text(f"<html><body>{page}</body></html>", None) == text


def test_unclosed_tags_take_linear_time():
    began = time.perf_counter()
    assert main_text("<p>a " + "<b x=' " * 30_000, None).startswith("a")
    assert main_text("<p>a " + "<b x=' " * 30_000 + ">z<!-- open", None) == "a z"
    assert time.perf_counter() - began < 20
