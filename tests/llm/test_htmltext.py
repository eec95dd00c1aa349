import pytest

from quern.llm.htmltext import extract, main_text

ARTICLE = "A long enough paragraph of the article, with words in it and even more words after these."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("plain text only", "plain text only"),
        ("<p>a &amp; b&nbsp;c &#233; &copy d</p>", "a & b c é © d"),
        (f"<html><body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>{ARTICLE}</p><p>{ARTICLE}</p></article><footer>f</footer>", f"Title\n\n{ARTICLE}\n\n{ARTICLE}"),
        (f"<body><div class='ad'>buy</div><article><h1>T</h1><p><b>{ARTICLE}<br><p>x</p></article>", f"T\n\n{ARTICLE}\n\nx"),
        (f"<body><article><h1>T</h1><p><b>{ARTICLE}</b> end</p></article><aside>side</aside>", f"T\n\n{ARTICLE} end"),
        (f"<body><article><p>{ARTICLE}</p><script>var t='</p>';</script><style>p{{}}</style><p>{ARTICLE}</p><div id=comments><p>{ARTICLE}</p></div></article>", f"{ARTICLE}\n\n{ARTICLE}"),
        (f"<body><main><section><p>{ARTICLE}</p><p>{ARTICLE}</p></section><section><p>{ARTICLE}</p><p>{ARTICLE}</p></section></main>", "\n\n".join([ARTICLE] * 4)),
        (f"<body><article><ul><li>{ARTICLE}<li>{ARTICLE}</ul><!-- note --><p>{ARTICLE}", "\n\n".join([ARTICLE] * 3)),
        ("<body><article><p>one  \n\t two<br>three</p></article>", "one two three"),
        ("<body><form><p>f</p></form>", ""),
        (f"<body><p class='note-adder'>{ARTICLE}</p>", ARTICLE),
        ("<script>unclosed", ""),
        ("<p>a<b>c</p>d < e", "ac\n\nd < e"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_nesting_deeper_than_calls():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_edges(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (None, "n", "<p>x</p>", 1), (3, "u", "<p>x</p>", 1), (3, "u", "<p>x</p>", 1), (4, "u", f"<article><p>{'word ' * 200000}</p></article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.url, len(r.text), r.n_chars) for r in extract(pages).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (2, "u", 0, 0), (None, "n", 1, 1), (3, "u", 1, 1), (3, "u", 1, 1), (4, "u", 999999, 999999)], key=str)
    assert extract(pages.filter("page_id < 0")).count() == 0
