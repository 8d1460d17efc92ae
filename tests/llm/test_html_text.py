from tidemark.llm.html_text import extract_main_text, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p>First  <b>bold\n text</b> of the page, long enough.</p><p>Second one&nbsp;here.</article>"


def test_parts_that_are_not_the_article():
    page = (f"<html><head><title>t</title><script>var a='<p>';</script></head><body><header><h1>Site</h1></header>"
            f"<nav><ul><li><a href=x>menu</a></ul></nav><div class='ad'>Buy this now, it is a long advert text.</div>{ARTICLE}"
            f"<section id=comments><p>A reader says something long, very long indeed, in a comment.</p></section>"
            f"<aside>side</aside><form><p>Your name</p></form><div class='cookie-notice'>We use cookies.</div>"
            f"<footer>&copy; foot</footer></body></html>")
    want = "Title & more\nFirst bold text of the page, long enough.\nSecond one here."
    assert main_text(page) == want
    assert main_text(page[:page.index("<section")]) == want          # a page cut off


def test_density_finds_unmarked_content():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(40))
    text = "".join(f"<p>Sentence {i} of a longer text that goes on for quite a while, as texts do.</p>" for i in range(6))
    page = f"<body><div><ul>{links}</ul></div><div id=x><div>{text}</div></div><div><ul>{links}</ul></div></body>"
    got = main_text(page)
    assert got.startswith("Sentence 0") and got.count("\n") == 5 and "link" not in got


def sentences(a, z, tag="p"):
    return "".join(f"<{tag}>Sentence {i} of a longer text that goes on for quite a while, as texts do.</{tag}>" for i in range(a, z))


def test_content_beside_the_best_container():
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30)) + "</ul></div>"
    for around in ("", menu):
        page = (f"<body>{around}<div id=c><h1>T</h1><p>Intro</p><div>{sentences(0, 6)}</div><blockquote>A <i>quoted</i> line."
                f"</blockquote>Loose <b>text</b> here.<p>End</p></div><h3>More</h3>{around}</body>")
        got = main_text(page).split("\n")
        assert got[:2] == ["T", "Intro"] and got[2].startswith("Sentence 0") and got[7].startswith("Sentence 5")
        assert got[8:] == ["A quoted line.", "Loose text here.", "End"]


def test_an_article_over_two_wrappers():
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30)) + "</ul></div>"
    for around in ("", menu):
        page = (f"<body>{around}<div><div>{sentences(0, 7)}</div></div><section><div>{sentences(7, 12)}</div></section>"
                f"{around}</body>")
        got = main_text(page).split("\n")
        assert len(got) == 12 and all(x.startswith(f"Sentence {i} ") for i, x in enumerate(got))


def test_names_are_evidence_not_a_verdict():
    want = [f"Sentence {i}" for i in range(5)]
    starts = lambda page: [x[:10] for x in main_text(page).split("\n")]
    for name in ("content-sidebar-wrap", "layout sidebar-right", "post comments-open", "sidebar", "page-menu widgets"):
        assert starts(f"<body><div class='{name}'><div>{sentences(0, 5)}</div></div><div class=ad>Buy this.</div></body>") == want
        assert starts(f"<body><div class='{name}'><article>{sentences(0, 5)}</article></div><div>{sentences(5, 9)}</div></body>") == want
    assert starts(f"<body><form action=x><input name=v><div>{sentences(0, 5)}</div></form></body>") == want
    for name in ("cookie-notice", "ad", "site-search", "sidebar-right", "post-comments", "siteFooter", "related_links"):
        page = f"<body><div>{sentences(0, 5)}</div><div class='{name}'><p>Something long enough to be taken for a text here.</p></div></body>"
        assert starts(page) == want, name
    comments = f"<section id=comments>{sentences(5, 30)}</section>"
    assert starts(f"<body><article>{sentences(0, 5)}</article>{comments}</body>") == want
    mostly = "".join(f"<p><a href=/{i}>A link of many words, number {i}, that goes on and on and on.</a> New.</p>" for i in range(30))
    assert starts(f"<body><div class=related>{mostly}</div><div>{sentences(0, 5)}</div></body>") == want


def test_headings_sections_and_formulas_of_an_article():
    page = ("<article><h2 id=search>Search</h2>" + sentences(0, 3) + "<section id='related-work'><h2 id='related-work'>Related"
            "</h2><p>Earlier ones.</p></section><section id='social-structure'><p>Bees.</p></section><p id='search-algorithms'>Trees."
            "</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>")
    got = main_text(page).split("\n")
    assert got[0] == "Search" and got[4:] == ["Related", "Earlier ones.", "Bees.", "Trees.", "So x=2 holds."]


def test_tolerance():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<script>x") == ""
    assert main_text("plain &lt; text") == "plain < text"
    assert main_text("<p>a<p>b<br>c<div>d</div>") == "a\nb c\nd"
    assert main_text("<!-- x --><p>a<!-- y --> b</p><!-- z") == "a b"
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("</p></div>x<li>y<li>z") == "x\ny\nz"
    assert main_text('<p title="a > b">t</p><p title="open>u</p>').startswith("t")


def test_rows(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (3, "u", ""), (1, "u", ARTICLE), (4, "u", "<p>" + "w " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F
    out = extract_main_text(df.withColumn("text", F.lit("clash")).withColumn("id", F.lit(0))).collect()
    assert sorted(r["n_chars"] for r in out) == sorted(len(main_text(h)) for _, _, h in rows)
    assert {r["page_id"]: r["url"] for r in out}[2] is None
    assert extract_main_text(df.where("false")).collect() == []


def test_reader_comments_go_whatever_their_markup_and_size():
    text, talk = sentences(0, 4), sentences(10, 40)
    want = [f"Sentence {i}" for i in range(4)]
    inner = "".join(f"<article class='comment'><p>Reader {i} says a lot of things in a long comment, indeed very long.</p></article>" for i in range(30))
    blog = "".join(f"<li><article class='comment-body'><p>Reader {i} says a lot of things, indeed.</p></article></li>" for i in range(30))
    plain = "".join(f"<article><p>Reader {i} says a lot of things in a long comment, indeed.</p></article>" for i in range(30))
    pages = [f"<article>{text}<section class='comments'>{inner}</section></article>",
             f"<main><article>{text}</article><div id='comments'><ol>{blog}</ol></div></main>",
             f"<main><article>{text}</article><div id=comments>{plain}</div></main>",
             f"<article>{text}<div class='post-comments'>{talk}</div></article>",
             f"<div><div>{text}</div><div id='comments'>{talk}</div></div>",
             f"<div><div>{text}</div><div class='comment-list'>{plain}</div></div>",
             f"<article>{text}</article>{inner}"]
    for page in pages:
        assert [x[:10] for x in main_text(f"<body>{page}</body>").split("\n")] == want, page[:200]
    # a wrapper that has such a name but holds the only article
    wrapped = f"<body><div class='content comments'><article>{text}</article></div></body>"
    assert [x[:10] for x in main_text(wrapped).split("\n")] == want


def test_a_teaser_beside_the_article_is_not_the_article():
    card = "<article class='card'><h3><a href=/x>Another story of the day</a></h3><p>Its first sentence, which is quite long, as such sentences are.</p></article>"
    page = f"<body><div><article><h1>Story</h1>{sentences(0, 5)}</article>{card}</div></body>"
    got = main_text(page).split("\n")
    assert got[0] == "Story" and len(got) == 6
    both = f"<body><div><article>{sentences(0, 5)}</article><article>{sentences(5, 9)}</article></div></body>"
    assert len(main_text(both).split("\n")) == 9


def test_deep_and_crossed_pages_in_linear_time():
    import time
    n = 100_000
    pages = ["<div>" * n + "text" + "</div>" * n, "<b>" * n + "<div>text" + "</b>" * n, "<p><table>" + "<span>" * n + "<h1>x</h1>" * 1000,
             "<a>" + "<div>" * n + "</a>" * n, "<ul>" + "<li>" * n + "text", "<main>" + "<i><p>t" * n]
    for page in pages:
        at = time.perf_counter()
        assert "t" in main_text(page) or "x" in main_text(page) or not main_text(page)
        assert time.perf_counter() - at < 6, page[:40]
