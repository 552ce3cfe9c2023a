import pytest

from jobframe.llm import html_extract as hx

TREE = hx.grow(*hx.labelled_rows())
LONG = "This is a paragraph of the main text that has quite a few words in it so that it is long enough. "

PAGES = [
    ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(1);</script></head><body>'
     '<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><!-- <p>no</p> -->'
     '<div class="ad">Buy this thing right now please.</div><article><h1>The Head</h1><p><b>First &amp; one.<br>'
     '<p>Sh is.</p><p>A\n  long\tone &quot;x&quot; &lt;3&gt;</p></article><footer>&copy; me &middot; words here.</footer>',
     'The Head\nFirst & one.\nSh is.\nA long one "x" <3>'),
    ('<body><header><h2>Site name</h2></header><div class="cookie-notice"><p>We use cookies on this site, dear reader.'
     '</p></div><main><h1>Title</h1><p>' + LONG + '</p><aside><p>' + LONG + '</p></aside><form><label>Your name</label>'
     '<input><button>Go</button></form><p>Short end.</p><section id="comments"><p>' + LONG + '</p></section></main>'
     '<div class="sidebar"><p>' + LONG + '</p></div>', "Title\n" + LONG.strip() + "\nShort end."),
    ('<div><a href=x>Home</a> <a href=y>News</a> <a href=z>More</a></div><div><p>' + LONG + '</p><p>' + LONG * 2 +
     '</p></div><ul><li><a href=1>One link</a><li><a href=2>Two link</a></ul>', LONG.strip() + "\n" + (LONG * 2).strip()),
    ('<article><p>cut off in the middle of an entity &am', "cut off in the middle of an entity &am"),
    ('<article><h1>Unclosed</h1><p>a <script>never ends <p>b</p>', "Unclosed\na"),
    ('<article><p>quote <a href="x>y">link</a> 1 < 2 and 3 > 2</p></article>', "quote link 1 < 2 and 3 > 2"),
    ("<p hidden>" + LONG + "</p><article>é &#233;&#xe9; &nbsp; x</article>", "é éé x"),
    ('<body class="home has-sidebar"><form id="aspnet"><div class="layout-sidebar"><article class="post"><div class="entry-header">'
     '<h1>Head</h1></div><p>Body text.</p><div id="ad1">Buy.</div><div class="sideBar">Side.</div></article><div>Other words here.'
     '</div></div></form><section id="comments"><article>Nice one.</article><article class="comment-body">Me too.</article></section>'
     '<aside><article><p>' + LONG + '</p></article></aside>', "Head\nBody text."),
    ("", ""), (None, ""), ("   \n ", ""), ("<br><br>", ""),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text_of_page(k):
    assert hx.main_text(PAGES[k][0], TREE) == PAGES[k][1]


def test_tree_agrees_with_its_table():
    x, y = hx.labelled_rows()
    assert sum(hx.classify(TREE, r) == b for r, b in zip(x, y)) >= len(y) - 1


def test_extract_every_row(spark):
    rows = [(k, f"u{k}", p, k) for k, (p, _) in enumerate(PAGES)]
    rows += [(None, None, PAGES[0][0], 0), (3, "u3", PAGES[3][0], 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text bigint")
    got = hx.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[0 if r["page_id"] is None else r["page_id"]][1]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert hx.extract(df.limit(0)).count() == 0


def test_long_page_is_read_whole():
    page = "<article>" + f"<p>{LONG}</p>" * 20000 + "<p>the end</p></article>"
    text = hx.main_text(page, TREE)
    assert text.count("\n") == 20000 and text.endswith("the end")
    assert hx.main_text("<" * 200_000, TREE) is not None
    assert hx.main_text('<a "' * 50_000, TREE) is not None


def test_pages_of_the_table(spark):
    import re

    for r in hx.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(
            spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        import html

        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))
        assert r["text"].split("\n") == [x for x in (" ".join(html.unescape(p).split()) for p in parts) if x]


NESTED = ["svg", "math", "object", "button", "select", "video", "audio", "canvas", "template"]
CLOSED = [(f'<article><p>one <{n} class="i"/> two</p><p>three</p></article>', n) for n in hx.DROPPED.split("|")]


@pytest.mark.parametrize("page, name", CLOSED)
def test_element_that_ends_in_its_start_tag_takes_nothing_with_it(page, name):
    assert hx.main_text(page, TREE).split() == ["one", "two", "three"]
    assert hx.main_text(page.replace("three", f"three <{name}>gone</{name}>"), TREE).split() == ["one", "two", "three"]


@pytest.mark.parametrize("name", NESTED)
def test_unclosed_element_is_its_tag_alone(name):
    page = f"<article><p>one</p><{name} a=b>x<p>two</p><p>three</p></article>"
    assert hx.main_text(page, TREE).split() == ["one", "x", "two", "three"]
    later = f"<article><p>one</p><{name}>x<p>two</p><{name}>gone</{name}><p>three</p></article>"
    assert hx.main_text(later, TREE).split() == ["one", "x", "two", "three"]
    inner = f"<article><p>one</p><{name}>x<{name}>y</{name}>z</{name}><p>three</p></article>"
    assert hx.main_text(inner, TREE).split() == ["one", "three"]


@pytest.mark.parametrize("name", sorted(hx.RAW_TEXT))
def test_raw_text_runs_to_its_end_tag_or_the_page_end(name):
    assert hx.main_text(f"<article><p>one</p><{name}>x <p>two</p>", TREE) == "one"
    assert hx.main_text(f"<article><p>one</p><{name}>x <svg> y</{name}><p>two</p></article>", TREE) == "one\ntwo"
    assert hx.main_text(f"<article><p>one</p><{name} src=/a/>x</{name}><p>two</p></article>", TREE) == "one\ntwo"


def test_names_that_only_begin_like_a_dropped_element():
    page = '<article><p>one</p><svg-icon n="x"></svg-icon><p>two</p><button-bar>b</button-bar><p>three</p></article>'
    assert hx.main_text(page, TREE).split() == ["one", "two", "b", "three"]
    assert hx.main_text("<article><svg><title>Icon</svg><p>two</p></article>", TREE) == "two"


LONGS = [LONG * 2 + f"Number {k}." for k in range(4)]
RUN = "".join(f"<p>{x}</p>" for x in LONGS)
MISLEADING = [
    '<div id="page" class="no-sidebar"><div class="entry-content">{}</div></div>',
    '<div class="container has-sidebar">{}</div>',
    '<div class="article-body ad-free">{}</div>',
    '<article class="post comments-open">{}</article>',
    '<div id="header-wrap"><div id="content">{}</div></div>',
    '<div id="header-wrap">{}</div>',
    '<form><div class="sidebar-layout">{}</div></form>',
    '<div class="with-footer without-menu">{}</div>',
]


@pytest.mark.parametrize("page", MISLEADING)
def test_names_alone_take_no_article(page):
    assert hx.main_text("<body>" + page.format(RUN) + "</body>", TREE) == "\n".join(LONGS)


@pytest.mark.parametrize("page", [
    '<div class="cookie-notice">{}</div>', '<div class="sidebar">{}</div>', '<section id="comments">{}</section>',
    '<div class="comment-list">{}</div>', "<footer>{}</footer>", "<nav>{}</nav>", "<aside>{}</aside>",
    '<div class="site-footer">{}</div>', '<div class="ad">{}</div>'])
def test_surroundings_stay_out_even_if_long(page):
    body = "<article><h1>Head</h1><p>" + LONG + "</p></article>"
    assert hx.main_text("<body>" + body + page.format(RUN) + "</body>", TREE) == "Head\n" + LONG.strip()


def test_densities_and_neighbours_decide():
    lines = [f"Six words stand here in line{k}." for k in range(6)]
    assert hx.main_text("".join(f"<p>{x}</p>" for x in lines), TREE) == "\n".join(lines)
    links = "".join(f'<li><a href="{k}">Read next: {k}</a></li>' for k in range(3))
    assert hx.main_text(f"<article>{RUN}<ul>{links}</ul></article>", TREE) == "\n".join(LONGS)
    thread = "".join(f"<p>Reader {k}</p><p>{x}</p>" for k, x in enumerate(LONGS))  # the same texts between short lines
    assert hx.main_text(f'<div class="comments-wrapper">{thread}</div>', TREE) == ""
    x, y = hx.labelled_rows()
    used = set()

    def walk(tree):
        if not isinstance(tree, int):
            used.add(hx.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(TREE)
    assert {"place", "words", "links"} <= used and used & {"prev_words", "prev_links"} and used & {"next_words", "next_links"}
    assert all({r[0] for r, b in zip(x, y) if b == side} >= {-1, 0, 1, 2} for side in (0, 1))


def slow_blocks(page):
    """Blocks by a parser of whole events: (text, words, words in links), for pages whose tags are closed."""
    from html.parser import HTMLParser

    out, text, link, state = [], [], [], {"drop": 0, "a": False}

    def close():
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), len(words), len(" ".join(link).split())))
        text.clear()
        link.clear()

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in hx.DROPPED.split("|"):
                if tag in hx.BLOCK_TAGS and not state["drop"]:
                    close()
                state["drop"] += 1
            elif not state["drop"]:
                if tag in hx.BLOCK_TAGS:
                    close()
                    state["a"] = False
                elif tag == "a":
                    state["a"] = True
                elif tag == "br":
                    text.append(" ")

        def handle_endtag(self, tag):
            if tag in hx.DROPPED.split("|"):
                state["drop"] -= 1
            elif not state["drop"]:
                if tag in hx.BLOCK_TAGS:
                    close()
                    state["a"] = False
                elif tag == "a":
                    state["a"] = False

        def handle_data(self, data):
            if not state["drop"]:
                text.append(data)
                if state["a"]:
                    link.append(data)

    parser = Parser(convert_charrefs=True)
    parser.feed(page)
    parser.close()
    close()
    return out


def test_blocks_and_features_against_a_slow_version(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r["html"]]
    pages += ["<body>" + p.format(RUN) + "</body>" for p in MISLEADING]
    same = 0
    for page in pages:
        want = slow_blocks(page)
        got = [b[:3] for b in hx.blocks(page)]
        if page.count("<script") == page.count("</script") and page.rstrip().endswith("</html>") or "LONG" in page:
            assert got == want
        same += got == want
    assert same >= 0.9 * len(pages)
