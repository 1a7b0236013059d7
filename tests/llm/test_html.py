import re

import pytest
from pyspark.sql import functions as F

from tarn.llm import html


def lines(text):
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


ARTICLE = "<p>First paragraph, with commas, and enough words to count as text.</p><p>Second one, also long enough to be kept.</p>"
TEXT = "First paragraph, with commas, and enough words to count as text.\nSecond one, also long enough to be kept."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a<p>b", "a\nb"),
        ("<div>x &amp; y<br>z&nbsp;&#233;</div>", "x & y z é"),
        (f"<body><nav><a href=x>Home, start, more</a></nav><article>{ARTICLE}</article></body>", TEXT),
        (f"<div id='content'>{ARTICLE}</div><div class='sidebar'><p>Other, things, to, read, here, now.</p></div>", TEXT),
        (f"<main>{ARTICLE}<section class='comments'><p>I, think, this, is, long, enough.</p></section></main>", TEXT),
        (f"<article><header><p>Site, name</p></header>{ARTICLE}<footer>&copy; x</footer></article>", TEXT),
        (f"<article>{ARTICLE}<script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --></article>", TEXT),
        (f"<article>{ARTICLE}<form><input><p>Your, name, please, type, it</p></form>", TEXT),
        ("<article><ul><li>one<li>two <b>bold</b></ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo bold\nc1\nc2"),
        ("<article><p>open <b>bold<p>next</article><p class=x>outside", "open bold\nnext"),
        ("<p>cut off <a hre", "cut off"),
        ("<script>never closed", ""),
        ("<div class='cookie-notice'><p>We, use, cookies, and, more, of, them.</p></div><p>Short.</p>", "Short."),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_links_count_for_little():
    menu = "<div>" + "".join(f"<p><a href=x>Long, linked, text, number {i}, of, many</a></p>" for i in range(30)) + "</div>"
    assert html.main_text(f"<body>{menu}<div>{ARTICLE}</div></body>") == TEXT


def test_siblings_belong_to_the_article():
    page = f"<body><div><div>{ARTICLE}</div><div>{ARTICLE}</div><div><a href=x>next page</a></div></div></body>"
    assert html.main_text(page) == f"{TEXT}\n{TEXT}"


def test_every_page_of_the_fixture(spark):
    sf = "/root/testdata/sf0.1"
    docs = {lines(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    got = html.op8_tree_scoring(spark, sf).collect()
    assert len(got) == 2500
    for r in got:
        heading, _, rest = r.text.partition("\n")
        assert rest in docs and heading and r.n_chars == len(r.text)
        assert not re.search(r"</?(p|div|script|article)\b", r.text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "<p>x", 2), (None, "<p>" * 5000 + "deep", 3)], "page_id long, html string, n int")
    got = html.extract_text(df.withColumns({"text": F.lit("old"), "body": F.lit("b")}))
    assert got.columns == ["page_id", "n", "body", "text", "n_chars"]
    assert sorted((r.n, r.text, r.n_chars) for r in got.collect()) == [(1, "", 0), (2, "x", 1), (3, "deep", 4)]
    assert html.extract_text(df.limit(0)).count() == 0


LONG = ARTICLE + "".join(f"<p>Paragraph {i}, with commas, and many more words, so that it counts for more.</p>" for i in range(4))
LONG_TEXT = "\n".join([TEXT, *(f"Paragraph {i}, with commas, and many more words, so that it counts for more." for i in range(4))])
LEAD = "A lead, which says in a sentence what the article is about."


@pytest.mark.parametrize("wrap", ["<body>{}</body>", "<main>{}</main>", "<body><div id=page>{}</div></body>"])
def test_two_articles_of_unequal_length(wrap):
    both = f"<article>{LONG}</article><article>{ARTICLE}</article>"
    assert html.main_text(wrap.format(both)) == f"{LONG_TEXT}\n{TEXT}"
    apart = f"<div><article>{ARTICLE}</article></div><div><article><div>{LONG}</div></article></div>"
    assert html.main_text(wrap.format(apart)) == f"{TEXT}\n{LONG_TEXT}"


def test_other_articles_stay_out():
    teaser = "<article><p><a href=x>Some, other, story, to, read, next</a></p></article>"
    comment = f"<article class='comment'>{ARTICLE}</article>"
    assert html.main_text(f"<main><article>{LONG}</article>{teaser}{comment}</main>") == LONG_TEXT


@pytest.mark.parametrize(
    "before, after, text",
    [
        ("<h1>Heading</h1>", "", f"Heading\n{LONG_TEXT}"),
        (f"<h1>Heading</h1><p>{LEAD}</p>", "<p>The end.</p>", f"Heading\n{LEAD}\n{LONG_TEXT}\nThe end."),
        (f"<div><h1>Heading</h1><p>{LEAD}</p></div>", "", f"Heading\n{LEAD}\n{LONG_TEXT}"),
        (f"{LEAD}", "", f"{LEAD}\n{LONG_TEXT}"),
        ("<nav><p>Home, start.</p></nav><h1>Heading</h1>", "<p><a href=x>Next story.</a></p><ul><li>Tag.</ul>", f"Heading\n{LONG_TEXT}"),
        ("<h1>Heading</h1>", "<aside><p>About, the author.</p></aside><div class=share><p>Share, it.</p></div>", f"Heading\n{LONG_TEXT}"),
    ],
)
def test_heading_and_lead_beside_the_article(before, after, text):
    for wrap in ("<body><main>{}</main></body>", "<body>{}</body>"):
        assert html.main_text(wrap.format(f"{before}<article>{LONG}</article>{after}")) == text
    inner = f"<body><p>Site, name</p><main>{before}<div class=row><article>{LONG}</article></div>{after}</main></body>"
    assert html.main_text(inner) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div id=wrap><div>{LONG}</div><div><p>That was all.</p></div></div>", f"{LONG_TEXT}\nThat was all."),
        (f"<div id=wrap><div>{LONG}</div><div><table><tr><td>a<td>1</table></div></div>", f"{LONG_TEXT}\na\n1"),
        (f"<div id=wrap><div><h1>Title</h1></div><div>{LONG}</div></div>", f"Title\n{LONG_TEXT}"),
        (f"<body><div><h1>Title</h1></div><div>{LONG}</div></body>", f"Title\n{LONG_TEXT}"),
        (f"<body><div><h1><a href=/>Site</a></h1></div><div>{LONG}</div><div><h2>Later</h2></div></body>", LONG_TEXT),
        (f"<article>{LONG}<p class=share>Shares fell, in sharp trading.</p></article>", f"{LONG_TEXT}\nShares fell, in sharp trading."),
        (f"<article>{LONG}<p class=advert>Buy, now.</p><div class=share><p>Share, it.</p></div></article>", LONG_TEXT),
        (f"<div id=wrap><div>{LONG}</div><div class=related><p>More, stories, here.</p></div><div><a href=x>Next</a></div></div>", LONG_TEXT),
    ],
)
def test_nothing_beside_the_container_is_lost(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p title="x > y">a</p>', "a"),
        ("<p title='x>Hello</p><p>World</p>", "Hello\nWorld"),
        ("<p>1 < 2 and <3</p>", "1 < 2 and <3"),
        ("a<!-- never closed <p>b", "a"),
        ("<p>a</p><!doctype x", "a"),
        ("<p>a</p ><p>b</", "a\nb</"),
        ("<p>x<br/>y<a href='q\">z</p>", "x yz"),
    ],
)
def test_broken_tags(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        '<a "' * 250_000, "<a '\"" * 200_000, "<div>x y z, " * 80_000, "<div>" * 100_000 + "</p>" * 100_000 + "deep",
        "<div>" * 80_000 + "<li></li>" * 60_000, "<ul><li><ul>" + "<div>" * 80_000 + "<li></li>" * 60_000, "<" * 1_000_000,
        "<!--" * 250_000, "<p a=\"b> c\"d" * 80_000, "<h1>t</h1>" * 80_000, "<script>" * 120_000, "<!x" * 300_000, "</a" * 300_000,
        "<div><h1>x</h1>" * 60_000, "<td><div>" * 100_000, "<a href='x>\"" * 90_000 + ">",
    ],
)
def test_a_hostile_megabyte_takes_little_time(page):
    import time

    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 4
