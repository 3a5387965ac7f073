import math
import time
from collections import defaultdict

import numpy as np
import pytest

from strandspark.llm import html_text as H
from strandspark.llm.html_text import extract, main_text

FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t="</p>";if(a<b){{}}</script></head><body>
<header><a href=/>Logo</a> Site name</header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-banner">We use cookies, for many reasons. Accept them, please.</div><!-- ad 3 --><div class="ad">Buy now, really cheap.</div>
{body}<aside><p>Sidebar words, in a sentence. And one more, to be long.</p></aside>
<form><label>Name</label><input name=q><textarea>typed text</textarea><button>Send</button></form>
<div id="comments"><div class="comment">First! I really like this, a lot. Good work, go on.</div></div><footer>&copy; 2020 &middot; All rights.</footer></body></html>"""
PARAGRAPHS = ["A first paragraph, with words &amp; more words, and so on. It has two sentences.", "Short.", "Another   one\n goes <b>on and</b> on, over <a href=x>a link</a>, to its end.<br>New line.", "Caf&eacute; &#233; &lt;tag&gt; &am stays."]
WANT = ["A first paragraph, with words & more words, and so on. It has two sentences.", "Short.", "Another one goes on and on, over a link, to its end. New line.", "Café é <tag> &am stays."]


@pytest.mark.parametrize("body", [
    "<article><h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article>",
    "<article><h1>Head line</h1>" + "".join(f"<p><b>{p}" for p in PARAGRAPHS) + "</article>",
    "<main><div><h2>Head line</h2><div>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div></div></main>",
    "<div class=post><h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div>",
    "<div class='page with-sidebar has_menu'><div class='text'><h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div></div>",
    "<ARTICLE CLASS='entry'><H1>Head line</H1>" + "".join(f"<P>{p}" for p in PARAGRAPHS) + "</ARTICLE>",
])
def test_article_of_a_page(body):
    assert main_text(FRAME.format(body=body)) == "\n\n".join(["Head line", *WANT])


def test_broken_and_small_pages():
    assert main_text(None) == "" == main_text("") == main_text("<html><head><title>x</title></head><body></body></html>")
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<article><p>Cut off, here. And <em>so") == "Cut off, here. And so"
    assert main_text("<article><p>Cut off, here. And so</p><p cla") == "Cut off, here. And so"
    assert main_text("<article><p>a < b, and 3 <4 is fine.</p></article>") == "a < b, and 3 <4 is fine."
    assert main_text("<p title='a>b'>one, two.</p><script>never closed <p>x</p>") == "one, two."
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    assert main_text(deep) == "deep, text."


def test_long_page():
    text = " ".join(f"word{i}," for i in range(40_000))
    assert main_text(f"<nav>{'<a>m</a>' * 999}</nav><article><p>{text}</p></article>") == text


def test_table(spark):
    rows = [(1, "u", "<article><p>Hi, you.</p></article>", "x"), (1, "u", "<article><p>Hi, you.</p></article>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=str) == sorted([(1, "u", "Hi, you.", 8), (1, "u", "Hi, you.", 8), (None, None, "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []


def test_articles_of_whole_table(spark):
    """The test pages' articles, cut out by their own marks."""
    import html
    import re

    from strandspark.llm.q_html import query

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0].replace("<b>", "")
        cut = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        want[r["page_id"]] = "\n\n".join(b for b in cut if b)
    assert {r["page_id"]: r["text"] for r in query(spark, sf).collect()} == want


@pytest.mark.parametrize("tag", ["section", "div", "article"])
def test_short_section_beside_a_long_one(tag):
    long, short = "Many words, in a long sentence, go on here. " * 12, "A short section, of one sentence."
    parts = [("One", [long.strip()] * 4), ("Two", [short]), ("Three", [long.strip()])]
    inner = "".join(f"<{tag}><h2>{h}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</{tag}>" for h, ps in parts)
    want = "\n\n".join(x for h, ps in parts for x in (h, *ps))
    assert main_text(FRAME.format(body=inner if tag == "article" else f"<div>{inner}</div>")) == want


TEXT = "".join(f"<p>Sentence {i}, with some words in it. And another one follows, as it goes on.</p>" for i in range(6))
WANT_TEXT = "\n\n".join(f"Sentence {i}, with some words in it. And another one follows, as it goes on." for i in range(6))


@pytest.mark.parametrize("page,want", [
    # names that only sound like furniture, or that all the text is under
    (f"<div class='related-work'><h2>Related</h2>{TEXT}</div><div>Short footer</div>", "Related\n\n" + WANT_TEXT),
    (f"<article><h1>T</h1>{TEXT}<section class='social-policy'><h2>Social</h2><p>Policy, in short.</p></section></article>", f"T\n\n{WANT_TEXT}\n\nSocial\n\nPolicy, in short."),
    (f"<div class='sidebar-right'><h2>Head</h2>{TEXT}<div class='ad'>Buy it, now.</div></div><div><a href=x>More</a></div>", "Head\n\n" + WANT_TEXT),
    (f"<form><div class=x><h1>T</h1>{TEXT}</div><div class='ad'>Buy this, now.</div></form>", "T\n\n" + WANT_TEXT),
    # headers of articles
    (f"<article><header><h1>Title</h1><p>By me</p></header>{TEXT}<footer><p>Tags: a, b</p></footer></article>", "Title\n\n" + WANT_TEXT),
    (f"<div class='entry-header'><h1>Title</h1></div><div class=entry>{TEXT}</div>", "Title\n\n" + WANT_TEXT),
    (f"<header><h1>Site</h1><article><h1>Title</h1>{TEXT}</article>", "Title\n\n" + WANT_TEXT),
    # nothing around the text has a name
    (f"<div><a href=x>One</a> <a href=y>Two</a></div><div>Logo</div><div><h1>Title</h1>{TEXT}<ul><li>point<li>other</ul></div><div>(c) us</div>", f"Title\n\n{WANT_TEXT}\n\npoint\n\nother"),
    (f"<h1>Title</h1>{TEXT}<div>(c) us</div><ul><li><a>more</a></ul>", "Title\n\n" + WANT_TEXT),
    (f"<table><tr><td><a href=x>One</a> <a href=y>Two</a></td><td><h1>Title</h1>{TEXT}</td></tr></table>", "Title\n\n" + WANT_TEXT),
    (f"<div><div><p>Lead, in short.</p></div><div>{TEXT}</div><div><p>The end, then.</p></div></div>", f"Lead, in short.\n\n{WANT_TEXT}\n\nThe end, then."),
    # reader comments are no articles of the page
    (f"<article>{TEXT}</article><section id=comments>" + "<article class=comment><p>I like it, all of it. Really.</p></article>" * 9 + "</section>", WANT_TEXT),
    ("<nav><a>Home</a></nav><footer>(c) 2020</footer>", ""),
])
def test_pages_by_their_scores(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_threshold_decides(monkeypatch):
    """Without it, what has no name and no links comes along."""
    page = f"<body><div class=a1><p>Buy it now</p></div><div class=a2>{TEXT}</div><div class=a3><p>All of it is ours</p></div></body>"
    assert main_text(page) == WANT_TEXT
    scores = H.path_scores
    monkeypatch.setattr(H, "path_scores", lambda p: (*scores(p)[:2], 0.0))
    assert main_text(page) == f"Buy it now\n\n{WANT_TEXT}\n\nAll of it is ours"


def brute_scores(p):
    """Each path's score and the threshold, block by block."""
    per = defaultdict(list)
    for i, text, linked in p.blocks:
        per[p.path[i]].append((len(text), sum(c in ".,;:!?…。，、！？；：¿¡" for c in text), min(len(text), linked)))
    mean = {k: [sum(x[j] for x in v) / len(v) for j in range(3)] for k, v in per.items()}
    rows = [mean[p.path[i]] for i, _, _ in p.blocks]
    r = min(3, len(rows) - 1)
    weight = {d: math.exp(-d * d / 0.5) for d in range(-r, r + 1)}
    near = lambda k, j: sum(w * rows[min(max(k + d, 0), len(rows) - 1)][j] for d, w in weight.items()) / sum(weight.values())
    least = min(p.named[i] for i, _, _ in p.blocks)
    outside = any(p.named[i] == least and len(t) >= H.SENTENCE and any(c in ".,;:!?…。，、！？；：¿¡" for c in t) and 2 * x < len(t) for i, t, x in p.blocks)
    whole = sum(x[0] for v in per.values() for x in v)
    share = {k: sum(x[0] for x in v) / whole for k, v in per.items()}
    fused = [near(k, 0) * (1 + near(k, 1)) * (1 - rows[k][2] / rows[k][0]) * share[p.path[i]] * (1 if p.named[i] == least else 0 if outside else H.PRIOR) for k, (i, _, _) in enumerate(p.blocks)]
    by_path = defaultdict(list)
    for (i, _, _), x in zip(p.blocks, fused):
        by_path[p.path[i]].append(x)
    score = {k: sum(v) / len(v) for k, v in by_path.items()}
    centre = sum(fused) / len(fused)
    return score, min(math.sqrt(sum((x - centre) ** 2 for x in fused) / len(fused)), max(score.values()))


def test_scores_against_plain_ones(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages += [FRAME.format(body="".join(f"<div class=c{i % 3}><p>{p}</p></div>" for i, p in enumerate(PARAGRAPHS * 4))), "<p>one</p>", f"<form>{TEXT}<a>x, y</a></form>"]
    for page in pages:
        for unread in (H.UNREAD, H.NAMED, H.CLEAR):
            p = H.parse(page, unread)
            path, score, least = H.path_scores(p)
            want, limit = brute_scores(p)
            assert least == pytest.approx(limit)
            for (i, _, _), k in zip(p.blocks, path):
                assert score[k] == pytest.approx(want[p.path[i]])


def test_scores_find_articles_without_any_names(spark):
    """All element, class and id names ignored, the paths' scores alone find the articles,
    but for some titles and some footers of very short pages."""
    clean = whole = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        p = H.parse(r["html"], H.CLEAR)
        path, score, least = H.path_scores(p)
        content, inside = (score >= least)[path], np.array([p.article[i] >= 0 for i, _, _ in p.blocks])
        size = np.array([len(t) for _, t, _ in p.blocks])
        total += 1
        clean += not content[~inside].any()
        whole += size[content & inside].sum() >= 0.7 * size[inside].sum()
    assert clean >= 0.95 * total and whole >= 0.95 * total


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "deep, text." + "</div>" * n,
    lambda n: "<ul><li>" * n + "deep, text.",
    lambda n: "<div>" * n + "</b></x>" * n + "deep, text.",
    lambda n: "<article><p>Some text, here.</p></article>" * n,
    lambda n: "<blockquote>some, text. " * n,
    lambda n: "<li><ul>" + "<div>" * n + "<li>some, text." * n,
    lambda n: "<b class=ad><i hidden>" * n + "deep, text.",
])
def test_time_is_linear_in_depth(make):
    main_text(make(100))
    took = []
    for n in (8_000, 64_000):
        began = time.process_time()
        main_text(make(n))
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_comments_never_replace_an_article():
    """However short the article, and however many and long the comments."""
    sentence = "The river rose in the night, and by the morning the lower fields were under water again. "
    for paragraphs, times, comments, name in ((1, 1, 30, "comments"), (5, 3, 120, "comments"), (8, 3, 300, "reader-reviews"), (1, 1, 400, "disqus-thread")):
        body = "".join(f"<p>{(sentence * times).strip()} Part {i}.</p>" for i in range(paragraphs))
        said = "".join(f"<div class='comment'><p>I think that this is so true, {i} of us saw it; thank you for it, all of you! {sentence * 2}</p></div>" for i in range(comments))
        got = H.main_text(f"<html><body><h1>The flood</h1>{body}<div class='{name}'>{said}</div></body></html>")
        assert got.split("\n\n") == ["The flood", *[f"{(sentence * times).strip()} Part {i}." for i in range(paragraphs)]]


def test_text_under_a_name_of_furniture_alone():
    sentence = "The river rose in the night, and by the morning the lower fields were under water again. "
    page = f"<html><body><p>Home</p><div class='widget'><p>{sentence * 4}</p><p>{sentence * 3}</p></div></body></html>"
    assert H.main_text(page).count("river") == 7
