import html as entities
import re

import pytest

from lodestone.llm import html
from lodestone.llm.html_pages import labelled_pages

ARTICLE = "<h1>On &amp; off</h1><p>First   para with <b>some</b> words\n in it.</p><p>Second para<br>after a break &eacute;&#33;</p>"
TEXT = "On & off\n\nFirst para with some words in it.\n\nSecond para after a break é!"
AROUND = [
    '<nav><a href="/">Home page of the site</a></nav>', "<header><h1>The Site Name Here</h1></header>", "<footer>All rights reserved &copy;</footer>",
    '<div class="sidebar"><p>Read these other things too.</p></div>', '<div id="cookie-notice">We use cookies, do you mind?</div>',
    '<div class="ad">Buy our soap today, it is cheap.</div>', "<form><label>Your mail</label><input><button>Go</button></form>",
    '<script>var a = "<p>not text</p>";</script>', "<style>p { margin: 0 }</style>", "<!-- <p>hidden words</p> -->",
    '<section class="comments"><article class="comment"><p>A reader says a great many words about this and that and more.</p></article></section>',
]


def test_weights_have_their_signs():
    w = html.default_weights()
    assert len(w) == len(html.FEATURES) == html.SET_ASIDE + 1
    assert w[html.WORD] > 0 and w[html.WORD] + w[html.INSIDE] > 0 and all(x <= 0 for x in w[html.PROSE_TAG :])
    assert w[html.ELEMENT] < 0 and w[html.NAMED] < 0 and w[html.LINKED] < 0 and w[html.OUTSIDE] < 0
    assert tuple(html.fit_weights(labelled_pages(600))) == w


def labelled(page):
    """(page without its marks, its content)"""
    parsed, truth = html._labelled(page)
    blocks = {}
    for item, content in zip(parsed.items, truth, strict=True):
        if content and item.text:
            blocks.setdefault(item.block, []).append(item.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return re.sub("[⟦⟧]", "", page), "\n\n".join(t for t in texts if t)


def agreement(pages, weights=None):
    """(share of pages with exactly the labelled text, mean F1 of their words)"""
    from collections import Counter

    exact, f1 = 0, 0.0
    for page, want in map(labelled, pages):
        got = html.main_text(page, weights)
        common = (Counter(got.split()) & Counter(want.split())).total()
        f1 += 2 * common / max(1, len(got.split()) + len(want.split()))
        exact += got == want
    return exact / len(pages), f1 / len(pages)


def test_held_out_pages(monkeypatch):
    """Pages of another seed, with and without marks of their content; the scan and its weights decide."""
    pages = labelled_pages(300, seed=9)
    exact, f1 = agreement(pages)
    assert exact >= 0.9 and f1 >= 0.985
    for marked in (True, False):
        some = [p for p in pages if ("<article>⟦" in p or "<main>" in p or "role=\"main\"" in p) == marked]
        assert len(some) > 80 and agreement(some)[1] >= 0.975
    flat = [0.0] * len(html.FEATURES)
    flat[html.WORD], flat[html.OTHER_TAG] = 1.0, -1.0
    assert agreement(pages, flat)[0] < exact - 0.2
    monkeypatch.setattr(html, "best_region", lambda scores: (0, len(scores)))
    assert agreement(pages)[0] < exact - 0.4


def test_region_of_whole_pages_is_the_maximum(monkeypatch):
    import numpy as np

    seen = []
    scan = html.best_region
    monkeypatch.setattr(html, "best_region", lambda scores: seen.append(list(scores)) or scan(scores))
    for page in labelled_pages(40, seed=5):
        html.main_text(labelled(page)[0])
    for scores in seen:
        sums = np.r_[0, np.cumsum(scores)]
        a, b = scan(scores)
        assert sums[b] - sums[a] == pytest.approx(max(0, max((sums[i:] - sums[i - 1]).max() for i in range(1, len(sums)))))


def test_names_are_features_only():
    assert html.main_text('<article><p>Alpha beta gamma</p><p class="ad">Buy our soap</p><p class="cookie-notice">We use them</p><p class="notice">Mind this</p></article>') == "Alpha beta gamma\n\nMind this"
    assert html.main_text('<article><p>Alpha beta</p><p class="legal">Court ruled so</p><div class="story related-party"><p>Body of it</p></div></article>') == "Alpha beta\n\nCourt ruled so\n\nBody of it"
    words = " ".join(["prose"] * 30)
    page = f"<body><div><p>{words}</p><ul><li>one of four</li><li>two of four</li><li>three of four</li><li>four of four</li></ul><div><div><p>{words}</p></div></div></div></body>"
    assert html.main_text(page) == "\n\n".join([words, "one of four", "two of four", "three of four", "four of four", words])
    assert html.main_text(f'<body><form action="/"><nav><a href="/">Home</a></nav><main><p>{words}</p></main></form></body>') == words


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div><div>{}</div></div>"])
def test_boilerplate_around_and_inside(wrap):
    for part in AROUND:
        page = f"<html><head><title>T</title></head><body>{part}{wrap.format(ARTICLE)}{part}</body></html>"
        assert html.main_text(page) == TEXT, part
    middle = ARTICLE.replace("<p>Second", "".join(x for x in AROUND if "<header>" not in x) + "<p>Second")
    assert html.main_text("<body>" + wrap.format(middle) + "</body>") == TEXT


def test_best_region_is_the_maximum():
    import random

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3, -1, -0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0, *[sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)]])


def test_title_in_a_head_of_its_own():
    page = "<body><div>Menu</div><div class='post'><div class='post-header'><h1>The title</h1></div><div><p>{}</p></div></div></body>"
    assert html.main_text(page.format("word " * 30)) == "The title\n\n" + " ".join(["word"] * 30)


def test_the_scan_decides_on_marked_pages():
    one, two = " ".join(["one"] * 12), " ".join(["two"] * 30)
    assert html.main_text(f"<body><main><h1>Title</h1><article><p>{two}</p></article></main></body>") == f"Title\n\n{two}"
    assert html.main_text(f"<body><article><p>{one}</p></article><article><p>{two}</p></article></body>") == f"{one}\n\n{two}"
    assert html.main_text(f"<article><p>{one}</p><article><p>{two}</p></article><p>{one}</p></article>") == f"{one}\n\n{two}\n\n{one}"
    page = f"<body><div><article><p>Short note</p></article></div><div><p>{two * 9}</p></div></body>"
    level = [x if k != html.OUTSIDE else 0.0 for k, x in enumerate(html.default_weights())]
    assert html.main_text(page) == "Short note" and html.main_text(page, level) == two * 9
    assert html.main_text(f"<body><div>{one}</div><article><p>{two}</p></article><div>{one}</div></body>") == two
    beside = list(html.default_weights())
    beside[html.OUTSIDE], beside[html.MARKED_TAG], beside[html.OTHER_TAG] = 0.0, -1.0, -1.0
    links = "<div><ul>" + "<li><a href=x>more of this</a></li>" * 9 + "</ul></div>"
    beside[html.LINKED] = -40.0
    assert html.main_text(f"<div>{links}<div><p>{two}</p></div><article><p>{two}</p></article></div>", beside) == f"{two}\n\n{two}"


def test_closing_tags_find_openers_at_any_depth():
    text = " ".join(["word"] * 20)
    for depth in (10, 63, 64, 5000):
        left_open = "<b>" * depth
        assert html.main_text(f"<body><div class='sidebar'>{left_open}hidden words</div><article><p>{text}</p></article></body>") == text
        assert html.main_text(f"<body><article><p>{text}{left_open}</p></article><div>After it</div></body>") == text


def test_odd_markup():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>only a menu</nav>") == ""
    assert html.main_text("just words, no tags &lt; &am") == "just words, no tags < &am"
    assert html.main_text('<article><p title="open>words here</p><p>more words</p></article>')
    assert html.main_text("<article><p>cut off in the mid<b") == "cut off in the mid"
    assert html.main_text("<article><p>a < b and c > d</article>") == "a < b and c > d"
    assert html.main_text("<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "</article>") == "deep"
    long = " ".join(["word"] * 300000)
    assert html.main_text(f"<p>{long}</p>") == long
    assert html.main_text("<article><script>never closed <p>x</p>") == ""
    assert html.main_text("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>") == "one\n\ntwo\n\na\n\nb"


def plain(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>|</?(?:p|h1)$", m[1])
    texts = (" ".join(entities.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_query(spark):
    from lodestone.llm.queries import op7_html

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op7_html(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 0), (None, "u", "<p>a b</p>", 0), (2, "u", "<p>a b</p>", 0)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "", 0), (None, "a b", 3), (2, "a b", 3)]
    assert html.extract(df.limit(0)).count() == 0


#: What stands between the first and the last words of an article.
BETWEEN = {
    "a linked clause": "<p>see <a href=x>one two three four five six seven eight nine ten eleven twelve thirteen fourteen</a> there</p>",
    "five links": "<p>" + " ".join(f"<a href=x>ref{k}</a>" for k in range(5)) + "</p>",
    "forty links": "<p>" + " ".join(f"<a href=x>ref{k}</a>" for k in range(40)) + "</p>",
    "a list of links": "<ul>" + "".join(f"<li><a href=x>item {k} linked</a></li>" for k in range(12)) + "</ul>",
    "code": "".join("<p>use <code>a</code> <em>b</em> <b>c</b></p>" for _ in range(6)),
    "nested elements": "".join("<div><span>a</span></div>" for _ in range(6)),
    "figures": "".join("<figure><div><div><img src=a></div></div></figure>" for _ in range(3)),
}


@pytest.mark.parametrize("between", BETWEEN)
@pytest.mark.parametrize("mark", ["<article>%s</article>", "<main><div>%s</div></main>", "<main><article>%s</article></main>"])
def test_nothing_of_an_article_is_lost(mark, between):
    for first, last in (("<p>START of the text, and some words.</p>", "<p>The last words of it: END.</p>"), ("<h1>START</h1>", "<p>END</p>"), ("<h1>START</h1>", "")):
        page = f"<html><body><nav><a href=a>Home</a> <a href=b>News</a></nav>{mark % (first + BETWEEN[between] + last)}<footer>Copyright us</footer></body></html>"
        text = html.main_text(page)
        assert "START" in text and ("END" in text or not last) and "Home" not in text and "Copyright" not in text
        words = re.sub("<[^>]*>", " ", BETWEEN[between]).split()
        assert " ".join(words) in " ".join(text.split())
