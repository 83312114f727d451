import pytest

from chromloom.llm import html_text

ARTICLE = (
    "<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
    "<div class='ad'>Buy now, this is an advert of some length.</div>{start}<h1>Title &amp; more</h1><p>First   paragraph,\n with <b>bold</b> text that is "
    "long enough.<br><p>Second &lt;para&gt; &#8212; it has an entity &eacute; too.</p>{end}<footer>&copy; all rights</footer></body></html>")
WANT = "Title & more\nFirst paragraph, with bold text that is long enough.\nSecond <para> — it has an entity é too."


def run(spark, rows, schema="page_id long, url string, html string"):
    return {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(spark.createDataFrame(rows, schema)).collect()}


def test_layouts():
    for start, end in [("<article>", "</article>"), ("<main><div class=post-17>", "</div></main>"), ("<div id=content>", "</div>"), ("", "")]:
        assert html_text.extract(ARTICLE.format(start=start, end=end)) == WANT


def test_noise_inside_the_article():
    page = ARTICLE.format(
        start="<div class='wrap'><aside>An aside with a good many words in it, not to be kept.</aside><article>",
        end="<form><p>Your name</p><input></form><div class='commentList' id=c><p>A reader's comment, long enough to look like prose.</p></div>"
            "<ul class=related-posts><li><a href=1>Another story with a title</a><li><a href=2>One more story with a title</a></ul></article></div>"
            "<div role='complementary'><p>A sidebar paragraph that is long enough to count.</p></div><p hidden>hidden text of some length is not read</p>")
    assert html_text.extract(page) == WANT


def test_long_words_of_noise_names_stay():
    assert html_text.extract("<div class='header-adapter loading'><p>Some words that are a real text.</p></div>") == "Some words that are a real text."


def test_heads_of_the_site_and_of_the_article():
    page = "<body><div class='header'><p>A site name and a motto of some length.</p></div>{}<p>The text of the page, long enough to count.</p>{}</body>"
    assert html_text.extract(page.format("", "")) == "The text of the page, long enough to count."
    own = page.format("<article><header class='header'><h1>Its title</h1></header>", "</article>")
    assert html_text.extract(own) == "Its title\nThe text of the page, long enough to count."


def test_lists_tables_and_broken_markup():
    assert html_text.extract("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>x<p>y</article>") == "one\ntwo\na\nb\nx\ny"
    assert html_text.extract("a < b and c > d") == "a < b and c > d"
    assert html_text.extract("<p>one</div>two<p>three<!-- no --> end<!-- open") == "one\ntwo\nthree end"
    assert html_text.extract("<p>x</p><script>if (a<b) {") == "x"
    assert html_text.extract("<p title='a>b' data-x=\"<p>\">in</p>") == "in"


def test_hosts_vote(spark):
    """A page whose own best container is a box follows its host's path."""
    page = "<body><div class=box-{n}><p>{box}</p></div><div class='story s{n}'><p>{body}</p></div></body>"
    body = "This is the story of the page and it is long enough to count as prose. " * 3
    rows = [(k, "http://h.example/a", page.format(n=k, box="Short box.", body=body)) for k in range(9)]
    rows.append((9, "https://H.example/b", page.format(n=9, box="A box text which is longer than all of the story on this page. " * 2, body="This is the story of this page, at half the length of the box or some more than that.")))
    rows.append((10, "http://other.example/b", rows[-1][2]))
    got = run(spark, rows)
    assert all(got[k][0] == body.strip() for k in range(9))
    winners = {r.host: r.paths for r in html_text.winning_paths(spark.createDataFrame([("h.example", r[2]) for r in rows[:9]], "host string, html string")).collect()}
    assert winners == {"h.example": ["/body/div.s.story"]}


def test_edges(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {k} of a very long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, None, None), (2, "http://a/", ""), (3, "no host", "<p>text &amp; so on</p>"), (4, "http://a/", "<script>x</script>"),
            (5, "http://a/", long), (6, None, "plain"), (6, None, "plain")]
    got = run(spark, [(*r, "t", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[4] == ("", 0)
    assert got[3] == ("text & so on", 12) and got[6] == ("plain", 5)
    assert got[5][0].count("\n") == 19_999
    assert run(spark, []) == {}


def test_all_pages_against_their_markup(spark):
    """The given pages hold one article of h1 and p: its text by plain regular expressions."""
    import html
    import re

    from __spark_entry__ import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in queries()["op3_main_text"](spark, "/root/testdata/sf0.001").collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


PROSE = "A sentence of the article that is long enough to count as prose, number {}."


def test_headline_and_lead_outside_the_body_container(spark):
    body = "".join(f"<p>{PROSE.format(k)}</p>" for k in range(12))
    want = "Headline\nThe lead of it.\n" + "\n".join(PROSE.format(k) for k in range(12))
    starts = [
        ("<article><h1>Headline</h1><p>The lead of it.</p><div class=body>", "</div></article>"),
        ("<main><div class=hero><h1>Headline</h1><p>The lead of it.</p></div><div class=body>", "</div></main>"),
        ("<div class=story><h1>Headline</h1><p>The lead of it.</p><div class=body>", "</div></div>"),
        ("<div class=post><header><h1>Headline</h1><p>The lead of it.</p></header><div class=body>", "</div></div>"),
        ("<h1>Headline</h1><p>The lead of it.</p><div class=body>", "</div><h3>More</h3><ul><li><a href=1>Another story to read</a></ul>"),
    ]
    rows = []
    for n, (start, end) in enumerate(starts):
        page = f"<body><nav>Menu</nav><div class=menu><a href=/>Home page of the site</a></div>{start}{body}{end}<footer>end</footer></body>"
        assert html_text.extract(page) == want
        rows += [(10 * n + k, f"http://h{n}.example/{k}", page) for k in range(4)]
    assert {t for t, _ in run(spark, rows).values()} == {want}


def test_sections_of_an_article_are_kept_whatever_the_host_votes_for(spark):
    """Nine pages have one section only; the tenth has a second one of another class."""
    first, second = ("".join(f"<p>{PROSE.format(k)}</p>" for k in range(*r)) for r in ((0, 6), (6, 10)))
    for tag in ("article", "main", "div class=wrap"):
        page = f"<body><{tag}><section class=one>{first}</section>{{}}</{tag.split()[0]}></body>"
        rows = [(k, "http://h.example/a", page.format("")) for k in range(9)] + [(9, "http://h.example/b", page.format(f"<section class=two>{second}</section>"))]
        got = run(spark, rows)
        assert got[0][0] == "\n".join(PROSE.format(k) for k in range(6))
        assert got[9][0] == "\n".join(PROSE.format(k) for k in range(10))


def test_site_header_and_side_column_stay_out():
    body = "".join(f"<p>{PROSE.format(k)}</p>" for k in range(12))
    page = ("<body><div class=page><header><h1>The site</h1><p>Its motto, which is the same on every page.</p></header><div id=sidebar-x><p>Side text of "
            f"some length that is no article.</p></div><div class=content><h1>Headline</h1>{body}</div></div></body>")
    assert html_text.extract(page) == "Headline\n" + "\n".join(PROSE.format(k) for k in range(12))


def test_names_made_from_headings_are_no_noise_inside_the_article():
    inner = ("<h1>A study</h1><h2 id=search-methods>Search methods</h2><p>How the papers of the study were found and read.</p><h2 id=related-work>Related work</h2>"
             "<p id=notice-period>The period of notice is three months from the first.</p><div class=social-history><p>The social history of the town, told at length.</p></div>"
             "<section id=discussion><p>What the results mean, discussed at some length.</p></section><div class='alert warning'><p>A warning of the text itself, not of the site.</p></div>")
    want = ("A study\nSearch methods\nHow the papers of the study were found and read.\nRelated work\nThe period of notice is three months from the first.\n"
            "The social history of the town, told at length.\nWhat the results mean, discussed at some length.\nA warning of the text itself, not of the site.")
    noise = ("<div class=related-posts><p>Another story that is worth to be read as well.</p></div><div class='ad-slot'>Buy this now, it is cheap and good.</div>"
             "<ol class='commentlist'><li>A comment of a reader, some words long.</ol><div id=comments><p>One more comment of a reader, some words long.</p></div>"
             "<div class=share-buttons>Share it</div><p class=newsletter>Subscribe to our letter, it is for free.</p>")
    for tag in ("article", "main", "div class=text"):
        more = noise if tag != "div class=text" else noise.replace(" id=comments", " class=comments")
        assert html_text.extract(f"<body><nav>Menu</nav><{tag}>{inner}{more}</{tag.split()[0]}><footer>end</footer></body>") == want
    for name in ("class=ad", "id=comments-area", "class=site-search", "role=banner"):
        assert html_text.extract(f"<body><div {name}><p>A box beside the article with a few words.</p></div><article>{inner}</article></body>") == want


def test_captions_formulas_and_lists_of_links_are_kept():
    page = ("<body><ul><li><a href=/a>The first page of the site</a><li><a href=/b>The second page of the site</a></ul><article><p>The text of the page, long enough to count.</p>"
            "<figure><img src=x><figcaption>A caption of the figure.</figcaption></figure><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here.</p>"
            "<audio src=y>A spoken word</audio><h2>References</h2><ol><li><a href=1>The first work that is cited</a><li><a href=2>The second work that is cited</a></ol></article></body>")
    assert html_text.extract(page) == (
        "The text of the page, long enough to count.\nA caption of the figure.\nWe have x=2 here.\nA spoken word\nReferences\nThe first work that is cited\nThe second work that is cited")


READER = "A reader says that this is a fine piece of work."
NOISE = [
    "<div class=notice><p>We changed our terms of use, please read them again.</p></div>", "<div role=alert>Our site will be down on Sunday for some hours, sorry.</div>",
    f"<section class=discussion><h3>Discussion</h3><div class=comment><p>{READER}</p></div></section>", f"<section class=discussion><p>{READER}</p><form>Say it</form></section>",
    "<p class=cookie-notice>We use cookies to make this site better for you all.</p>", f"<div class=user-comments><p>{READER}</p></div>",
    f"<section id=comments><p>{READER}</p></section>", "<div id=sidebar><p>Side text of some length that is no part of the article.</p></div>",
    "<div id=footer><p>Footer text of some length that is no part of it.</p></div>", "<div id=ad-slot><p>Buy this now, it is cheap and good for everyone here.</p></div>",
    "<div class=links><a href=1>Home</a> <a href=2>News</a> <a href=3>Sports</a></div>", "<ul><li><a href=1>Home of it</a><li><a href=2>All the news</a></ul>",
    "<div class=share-buttons>Share it</div>",
]
OWN = {
    "<p class=share>{}</p>": "The share of the workers in what they made has fallen for years.",
    "<section class=search><p>{}</p></section>": "The search for the lost ship took them all over the seas.",
    "<section id=discussion><p>{}</p></section>": "What the results mean, discussed at some length.",
    "<div class='alert warning'><p>{}</p></div>": "A warning of the text itself, and not one of the site.",
    "<section id=notice><p>{}</p></section>": "The notice that was nailed to the door, word for word.",
}


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("noise", NOISE)
def test_noise_at_either_end_of_an_article(tag, noise):
    body, want = "".join(f"<p>{PROSE.format(k)}</p>" for k in range(6)), "\n".join(PROSE.format(k) for k in range(6))
    assert html_text.extract(f"<body><{tag}>{body}{noise}</{tag}></body>") == want
    assert html_text.extract(f"<body><{tag}>{noise}{body}</{tag}></body>") == want


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("markup", sorted(OWN))
def test_prose_under_a_doubtful_name_stays(tag, markup):
    body = "".join(f"<p>{PROSE.format(k)}</p>" for k in range(6))
    page = f"<body><{tag}>{body}{markup.format(OWN[markup])}</{tag}></body>"
    assert html_text.extract(page) == "\n".join(PROSE.format(k) for k in range(6)) + "\n" + OWN[markup]


def test_an_article_of_links_only():
    page = "<body><nav>m</nav><article><p><a href=1>All of the first paragraph is a link.</a></p><p><a href=2>And the second one as well.</a></p></article></body>"
    assert html_text.extract(page) == "All of the first paragraph is a link.\nAnd the second one as well."


def test_what_a_host_repeats_and_boxes_beside_the_voted_one(spark):
    """Doubtful texts that different pages of a host repeat go, and stay on a host with one page or
    copies of it; a second box stays where a fair part of the host's pages fills it."""
    alert = "<div class=alert><p>This text stands under a doubtful name and is repeated.</p></div>"
    links = "<ul><li><a href=1>A first link to somewhere</a><li><a href=2>A second link to somewhere</a></ul>"
    page = "<body><article><h1>Head {k}</h1><p>{a}</p>" + alert + links + "<p>{b}</p></article></body>"
    rows = [(k, "http://many.example/", page.format(k=k, a=PROSE.format(k), b=PROSE.format(-k))) for k in range(5)]
    rows += [(10 + k, "http://one.example/", rows[0][2]) for k in range(5)]
    two = "<body><div class=first>{}</div><div class=second><p>{}</p></div><div class=box>{}</div></body>"
    part = lambda k: "".join(f"<p>{PROSE.format(k + i)}</p>" for i in range(5))
    rows += [(20 + k, "http://two.example/", two.format(part(k), PROSE.format(k + 5), "Short box.")) for k in range(9)]
    rows.append((29, "http://two.example/", two.format(part(1), PROSE.format(6), "<p>A box with a long text, as on this page alone it has one of those.</p>")))
    got = {k: t for k, (t, _) in run(spark, rows).items()}
    for k in range(5):
        assert got[k] == f"Head {k}\n{PROSE.format(k)}\n{PROSE.format(-k)}"
        assert got[10 + k].split("\n") == ["Head 0", PROSE.format(0), "This text stands under a doubtful name and is repeated.",
                                           "A first link to somewhere", "A second link to somewhere", PROSE.format(0)]
    for k in range(9):
        assert got[20 + k] == "\n".join(PROSE.format(k + i) for i in range(6))
    assert got[29] == "\n".join(PROSE.format(1 + i) for i in range(6))
