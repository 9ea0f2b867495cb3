"""Main text where menus, adverts, comments and the like stand inside the article, with weights fitted on the table and without a fit."""

import re
from collections import Counter

import pytest

from graphweave.llm import html_text

DATA = "/root/testdata/sf0.01"
ONE, TWO = (" ".join(f"{w}{i}" for i in range(60)) for w in ("first", "second"))
BOTH = f"{ONE}\n\n{TWO}"
OTHER = " ".join(f"other{i}" for i in range(80))
INSIDE = [
    "<script>var tracked = 1; send(tracked);</script>", "<style>p { margin: 0 }</style>", "<noscript>turn it on</noscript>", "<template><p>row</p></template>", "<svg><text>label</text></svg>",
    f"<nav>{OTHER}</nav>", f"<form><label>Mail</label><input>{OTHER}</form>", f"<aside><p>{OTHER}</p></aside>", "<button>Share</button>", "<select><option>one<option>two</select>", f"<footer><p>{OTHER}</p></footer>",
    f"<div class='ad'>{OTHER}</div>", f"<div class='comments'><p>{OTHER}</p></div>", f"<div class=\"user-comments\"><p>{OTHER}</p></div>", f"<div id=left-sidebar>{OTHER}</div>",
    f"<div class='cookie-banner'>{OTHER}</div>", f"<section class='related-posts'><p>{OTHER}</p></section>", f"<div class='ad-slot'>{OTHER}</div>", f"<div class='newsletter_signup'>{OTHER}</div>",
    f"<section class='comments'><article class='comment'><h3>Reader</h3><p>{OTHER}</p></article></section>", "<ul class='breadcrumb'><li><a href=x>Home</a></ul>", f"<div role=navigation>{OTHER}</div>",
]


@pytest.fixture(scope="module")
def fitted(spark):
    return html_text.fit_weights(spark.read.parquet(f"{DATA}/pages.parquet"))


@pytest.fixture(params=["fitted", "defaults"])
def weights(request, fitted):
    return fitted if request.param == "fitted" else html_text.Weights()


@pytest.mark.parametrize("piece", INSIDE)
def test_pieces_inside_the_article(weights, piece):
    for around in ("<article>{}</article>", "<main><div class='entry-content'>{}</div></main>", "<div class='page'><h1></h1>{}</div>"):
        page = f"<body><nav>menu here</nav>{around.format(f'<p>{ONE}</p>{piece}<p>{TWO}</p>')}<footer>the end</footer></body>"
        assert html_text.main_text(page, weights) == BOTH


@pytest.mark.parametrize("piece", INSIDE)
def test_pieces_beside_the_article(weights, piece):
    page = f"<body>{piece}<article><h1>Head</h1><p>{ONE}</p><p>{TWO}</p></article>{piece}</body>"
    assert html_text.main_text(page, weights) == f"Head\n\n{BOTH}"


def test_many_comments_do_not_part_the_article(weights):
    page = f"<body><article><p>{ONE}</p><div class='comments'>{f'<p>{OTHER}</p>' * 60}</div><p>{TWO}</p></article></body>"
    assert html_text.main_text(page, weights) == BOTH


def test_listed_names_that_hold_the_whole_article(weights):
    assert html_text.main_text(f"<body><article><p class='comment'>{ONE}</p></article></body>", weights) == ONE
    assert html_text.main_text(f"<body><article><p class='legal'>{ONE}</p><p class='legal'>{TWO}</p></article></body>", weights) == BOTH


def test_links(weights):
    links = "".join(f"<a href='/{i}'>topic {i}</a> | " for i in range(80))
    for menu in (links, f"<div>{links}</div>", f"<ul>{'<li><a href=x>topic</a>' * 80}</ul>"):
        assert html_text.main_text(f"<body>{menu}<article><p>{ONE}</p></article></body>", weights) == ONE
        assert html_text.main_text(f"<body>{menu}<div><p>{ONE}</p><p>{TWO}</p></div></body>", weights) == BOTH
    # Links in sentences and lists of the article are its text.
    page = f"<body><article><p>{ONE} <a href=x>a link</a></p><ul><li><a href=y>Source one</a><li><a href=z>Source two</a></ul></article></body>"
    assert html_text.main_text(page, weights) == f"{ONE} a link\n\nSource one\n\nSource two"


@pytest.mark.parametrize(("name", "want"), [
    ("ad", True), ("comments", True), ("left-sidebar", True), ("cookie-banner", True), ("user_comments", True), ("site-footer", True), ("ad-slot", True), ("post-comments", True), ("main-nav", True),
    ("has-sidebar", False), ("no-comments", False), ("article-header", False), ("entry-footer", False), ("post-title", False), ("content", False), ("adhoc", False), ("ad-free", False), ("load", False),
])
def test_listed_names(name, want):
    assert html_text.listed(name) is want


def words(text):
    return Counter(re.findall(r"\w+", text))


@pytest.mark.parametrize("label", [True, False])
def test_table_pages_with_pieces_put_into_their_articles(spark, weights, label):
    """Precision and recall of words on the table's pages, with elements put into their articles, with and without the label elements."""
    right = taken = wanted = 0
    for i, r in enumerate(spark.read.parquet(f"{DATA}/pages.parquet").collect()):
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        want = words("\n\n".join(filter(None, (" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)))))
        blocks = article.split("</p>")
        at = len(blocks) // 2
        page = r["html"].replace(article, "</p>".join([*blocks[:at], INSIDE[i % len(INSIDE)] + blocks[at], *blocks[at + 1 :]]))
        got = words(html_text.main_text(page if label else html_text._LABEL.sub("", page), weights))
        right, taken, wanted = right + (got & want).total(), taken + got.total(), wanted + want.total()
    assert right >= 0.95 * taken and right >= 0.95 * wanted


def test_query_gives_the_paragraphs_of_every_page(spark):
    """The registered query: on the table's pages, whose articles hold nothing else, the blocks of the article element."""
    got = {r["page_id"]: r for r in html_text.query(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])[1].replace("<br>", " ")
        blocks = (" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        text = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]
