import random

import pytest

from siftlab.llm import html_extract

SCHEMA = "page_id long, url string, html string, text string, id string"
LABELLED = (
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home page</a></li><li>News</li></ul></nav>"
    "<div class='ad'>Buy this now</div><article><h1>Head &amp; line</h1><p>One two three four.</p><p>Five <b>six</b>\n seven</p></article>"
    "<footer>&copy; someone</footer></body></html>"
)
PLAIN = (
    "<html><body><header><a href=/>Site</a></header><nav><ul><li>a b c</li></ul></nav><div class=\"cookie-notice\">We use cookies on this site</div>"
    "<div id=content><h2>Title here</h2><p>One two three four five six.</p><div class=advert><p>Buy now this and that</p></div>"
    "<ul><li>First point</li><li>Second point</li></ul><p>Seven &eacute;ight<br>nine &#116;en.<p>x</div><form>Your name <input></form>"
    "<div class=comments><p>I think this is a really long comment by a reader.</p></div><aside>Other things</aside><footer>foot words here</footer></body></html>"
)


def extract(spark, pages):
    frame = spark.createDataFrame([(i, f"u{i}", h, "t", "i") for i, h in enumerate(pages)], SCHEMA)
    return [(r["text"], r["n_chars"]) for r in html_extract.extract_pages(frame).orderBy("page_id").collect()]


def test_main_text(spark):
    got = extract(spark, [LABELLED] * 5 + [PLAIN, None, "", "<p>plain <!-- no --> words", "just words", LABELLED.replace("</article>", "")])
    assert got[0][0] == "Head & line\nOne two three four.\nFive six seven"
    assert got[5][0] == "Title here\nOne two three four five six.\nFirst point\nSecond point\nSeven éight nine ten.\nx"
    assert [g[0] for g in got[6:10]] == ["", "", "plain words", "just words"]
    assert got[10] == got[0] and all(n == len(t) for t, n in got)


def test_without_labelled_pages_and_empty(spark):
    assert extract(spark, [PLAIN])[0][0].startswith("Title here\nOne two three four five six.")
    assert extract(spark, []) == []


def test_broken_and_very_long_pages():
    weights = html_extract.fit({})
    assert html_extract.main_text("<div>" * 20_000 + "some words", weights) == "some words"
    assert html_extract.main_text('<a "' * 20_000, weights) is not None
    assert html_extract.main_text("<script>" * 5_000, weights) == ""
    assert len(html_extract.main_text("<p>" + "word " * 200_000, weights)) == 999_999


def test_best_run():
    assert html_extract.best_run([-1, 2, -1, 3, -5, 3]) == (1, 4)
    assert html_extract.best_run([-1, -2]) == (0, 0)
    assert html_extract.best_run([1, -1, 1]) == (0, 1)


def test_unclosed_and_self_closed_hidden_elements_drop_nothing_else():
    weights = html_extract.fit({})
    body = "<p>One two three four.</p><p>Five six seven eight.</p>"
    want = "One two three four.\nFive six seven eight."
    for page in (
        f"<html><head><title>t</title><meta charset=x><body>{body}</body></html>", f"<head><title>t</title>{body}",
        "<p>One two three four.</p><svg/><p>Five six seven eight.</p>", "<p>One two three four.</p><iframe src='x' /><p>Five six seven eight.</p>",
        f"<button>{body}", f"<object data=x>{body}", f"<select>{body}", f"{body}<svg><text>no</text><svg></svg> no</svg>",
        f"<head><noscript><p>no</p></noscript></head><body>{body}", f"{body}<button>no</button><template><p>no</p></template>",
    ):
        assert html_extract.main_text(page, weights) == want, page


@pytest.mark.parametrize(
    "before, after",
    [
        ('<body class="single-post no-sidebar"><article>', "</article></body>"),
        ('<body><div class="content has-header with-share"><article>', "</article></div></body>"),
        ('<body><div class="ad-free story">', "</div></body>"),
        ('<body><article class="post-type-post category-legal">', "</article></body>"),
        ('<body><div class="header-layout"><main>', "</main></div></body>"),
    ],
)
def test_names_that_do_not_mark_surroundings_keep_the_article(before, after):
    words = "some plain words of a long story that goes on for a while"
    menu = '<div class="sidebar menu"><p>Home Shop News About us and all the rest</p></div>'
    text = html_extract.main_text(f"<html>{before}<p>{words}</p><p>{words} again</p>{after}{menu}</html>", html_extract.fit({}))
    assert text == f"{words}\n{words} again"


def test_best_run_equals_trying_all_runs():
    rng = random.Random(11)
    for _ in range(2000):
        scores = [rng.choice((-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)) for _ in range(rng.randint(0, 14))]
        runs = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max((r[0] for r in runs), default=0.0)
        start, end = html_extract.best_run(scores)
        assert sum(scores[start:end]) == max(best, 0.0)
