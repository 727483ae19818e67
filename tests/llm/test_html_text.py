import random
import time

import pytest
from cases import prose

from rankfold.llm import html_text

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One\n  two<br><p>Three &lt;3 &#233;</p><aside>no</aside><div id="comments">no</div>'
    "<form><p>no</p></form></article><footer>&copy; host</footer></body></html>"
)


def text_of(page):
    return "\n".join(html_text.parse(page)[1])


def test_article_without_boilerplate():
    assert text_of(PAGE) == "Head & more\nOne two\nThree <3 é"


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []), ("plain  text", ["plain text"]), ("a<p>b<p>c", ["a", "b", "c"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("3 < 4 & 5 > 2", ["3 < 4 & 5 > 2"]),
        ("<p title='x>y'>a</p><script>if (a<b) x", ["a"]), ("<div hidden>a</div><div style='display: none'>b</div>c", ["c"]), ("</p></div>x<", ["x<"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]), ("<header>no</header><p>a</p>", ["a"]), ('<p class="x" id=\'sidebar\'>no</p>b', ["b"]),
    ],
)
def test_pages_without_declared_content(page, blocks):
    declared, found, _ = html_text.parse(page)
    assert not declared and found == blocks


def test_declared_but_empty_content_is_empty():
    assert text_of("<p>x</p><article></article>") == ""
    assert text_of("<p>x</p><div role=main><p>y</div>") == "y"


def test_templates_of_a_host_go(spark):
    box = "<div><p>Subscribe now</p><p>Every day</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{box}<p>Text {i}</p><p>Tail {i}</p></body>", 1) for i in range(8)]
    rows += [(50 + i, f"https://b.example/{i}", f"<body>{box}<p>Other {i}</p></body>", 1) for i in range(2)]
    copies = [(100 + i, "https://a.example/copy", "<body><p>copied page</p></body>", 1) for i in range(9)]
    odd = [(200, None, "<p>no url", 1), (201, "x", None, 1), (None, "https://a.example/n", "<article>n</article>", 1), (1, "https://a.example/1", rows[1][2], 1)]
    pages = spark.createDataFrame(rows + copies + odd, "page_id bigint, url string, html string, text int")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows + copies + odd) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Text 3\nTail 3" and text[1] == "Text 1\nTail 1"
    assert text[51] == "Subscribe now\nEvery day\nOther 1"  # two pages are not many
    assert text[105] == "copied page" and text[200] == "no url" and text[201] == "" and text[None] == "n"


def test_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p><a href="/x?id=ad-12">a</a> b</p><p title="a hidden bay">c</p></article>', "a b\nc"),
        ('<body class="page no-sidebar"><div class="with-sidebar"><article class="post comments-open"><h1 class="entry-header">a</h1>b</article></div>', "a\nb"),
        ('<body class="sidebar"><div class="widget"><article class="ad"><h1 class="header">a</h1><p class="ad">no</p></article></div>', "a"),
        ('<div class="sidebar"><article>teaser</article></div><article>a</article>', "a"),
        ('<div class="sidebar"><article>teaser</article></div><main>a</main>', "a"),
        ('<main>x<div class="widget"><article>a</article></div></main>', "a"),
    ],
)
def test_names_delete_only_what_they_name(page, text):
    assert text_of(page) == text


def test_boxes_inside_the_main_content_go_and_copied_articles_stay(spark):
    box = "<div><p>Buy this now</p><p>At our shop</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<article><h1>Head {i}</h1>{box}<p>{prose(i, 40)}</p></article>") for i in range(7)]
    words = prose(60, 120).split(" ")
    for i in range(8):  # near copies: each has another word changed
        near = " ".join(f"w{i}" if k == 10 * i else w for k, w in enumerate(words))
        rows.append((100 + i, f"https://a.example/n{i}", f"<article><h1>Shared head</h1><p>{near}</p><p>Shared end</p></article>"))
    rows += [(200 + i, "https://a.example/c", "<article><h1>Copied</h1><p>text</p></article>") for i in range(9)]
    text = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert text[3] == f"Head 3\n{prose(3, 40)}" and text[205] == "Copied\ntext"
    assert all(text[100 + i].startswith("Shared head\n") and text[100 + i].endswith("\nShared end") for i in range(8))


def test_large_hosts_lose_their_templates(spark):
    rows = [(i, f"https://a.example/{i}", f"<body>{'<div>Menu of few pages</div>' if i < 6 else ''}<p>{prose(i, 12)}</p></body>") for i in range(700)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: prose(i, 12) for i in range(700)}


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_dominating_menus_go(spark):
    menu = "<div>" + "".join(f"<span>{w}</span> " for w in prose(70, 300).split(" ")) + "</div>"
    box = f"<div><p>{prose(71, 200)}</p><p>{prose(72, 200)}</p></div>"
    long_box = f"<section>{prose(73, 400)}</section>"
    foot = f"<div><p>{prose(74, 100)}</p></div>"
    rows = [(i, "https://menu.example/", f"<body>{menu}<p>{prose(i, 25)}</p>{foot}</body>") for i in range(30)]
    rows += [(100 + i, "https://box.example/", f"<article><h1>Head {i}</h1>{box}<p>{prose(100 + i, 25)}</p>{long_box}</article>") for i in range(30)]
    text = extracted(spark, rows)
    assert all(text[i] == prose(i, 25) for i in range(30))
    assert all(text[100 + i] == f"Head {i}\n{prose(100 + i, 25)}" for i in range(30))


def test_sentences_that_articles_share_stay(spark):
    rows = [
        (i, "https://a.example/", f"<article><h1>Head {i}</h1><h2>Method</h2><p>{prose(i, 60)}</p><div>Shared note</div><ul><li>{prose(50 + i, 9)}<li>Yes</ul>"
         "<p>We thank the reviewers.</p></article>")
        for i in range(6)
    ]
    text = extracted(spark, rows)
    assert all(text[i] == f"Head {i}\nMethod\n{prose(i, 60)}\nShared note\n{prose(50 + i, 9)}\nYes\nWe thank the reviewers." for i in range(6))


def test_sections_of_near_copies_stay(spark):
    """Sixty copies of an article, each with other words changed in one of its paragraphs."""
    section = f"<section><h2>Shared</h2><p>{prose(80, 30)}</p><p>{prose(81, 30)}</p></section>"
    paragraphs = [prose(90 + k, 50).split(" ") for k in range(6)]
    rows, expected = [], {}
    for i in range(60):
        own = [" ".join(f"changed{i}" if k == i % 6 and j == i % 50 else w for j, w in enumerate(p)) for k, p in enumerate(paragraphs)]
        rows.append((i, "https://a.example/", f"<article><h1>Shared head</h1>{section}{''.join(f'<p>{p}</p>' for p in own)}</article>"))
        expected[i] = "\n".join(["Shared head", "Shared", prose(80, 30), prose(81, 30), *own])
    rows += [(100 + i, "https://a.example/", f"<article><p>{prose(200 + i, 60)}</p></article>") for i in range(20)]
    text = extracted(spark, rows)
    assert {i: text[i] for i in expected} == expected


def test_random_hosts_match_brute_force(spark):
    """Pages of random parts: a container of two blocks goes where five different pages of its host
    hold it, a paragraph on pages that declare no main content, nothing else."""
    r = random.Random(4)
    boxes = [[prose(300 + i, 4), prose(320 + i, 5)] for i in range(8)]
    lines = [prose(340 + i, 6) for i in range(8)]
    pages = []
    for i in range(150):
        parts = [("own", [prose(1000 + i, 30)])]
        parts += [("box", boxes[b]) for b in r.sample(range(8), r.randrange(3))] + [("line", [lines[b]]) for b in r.sample(range(8), r.randrange(3))]
        r.shuffle(parts)
        pages.append((i, r.choice(["a", "b", "c", "d"]), r.random() < 0.5, parts))
    pages += [(500 + i, *pages[i][1:]) for i in range(40)]  # copies

    def html(declared, parts):
        body = "".join(f"<div><p>{p[0]}</p><p>{p[1]}</p></div>" if kind == "box" else f"<p>{p[0]}</p>" for kind, p in parts)
        return f"<article>{body}</article>" if declared else f"<body>{body}</body>"

    holders = {}
    for _, host, declared, parts in pages:
        for kind, p in parts:
            if kind == "box" or not declared:
                holders.setdefault((host, kind, tuple(p)), set()).add(str(parts))
            if kind == "box" and not declared:
                for line in p:
                    holders.setdefault((host, "line", (line,)), set()).add(str(parts))
    gone = {k for k, v in holders.items() if len(v) >= 5}
    expected = {}
    for i, host, declared, parts in pages:
        left = []
        for kind, p in parts:
            if (host, kind, tuple(p)) in gone and (kind == "box" or not declared):
                continue
            left += [line for line in p if declared or (host, "line", (line,)) not in gone]
        expected[i] = "\n".join(left)
    text = extracted(spark, [(i, f"https://{host}.example/{i}", html(declared, parts)) for i, host, declared, parts in pages])
    assert text == expected and any(k[1] == "line" for k in gone) and any(k[1] == "box" for k in gone) and len(gone) < len(holders)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 40_000 + "x", "<b>" * 40_000 + "x<p>y" * 2000, "<p>" * 40_000, "<main>" * 20_000 + "x", "<ul><li>" * 20_000 + "x", "x<div>" * 20_000, "<td><b>" * 20_000 + "</p>" * 20_000],
)
def test_deep_pages_take_seconds(page):
    start = time.time()
    declared, blocks, subtrees = html_text.parse(page)
    assert time.time() - start < 8 and len(subtrees) <= 60_000


def test_deep_and_long_pages(spark):
    rows = [(i, "https://a.example/", "<div>" * 3000 + f"<p>deep {i}" * 300) for i in range(6)] + [(10, "https://a.example/", f"<p>{prose(7, 60_000)}</p>")]
    text = extracted(spark, rows)
    assert text[10] == prose(7, 60_000) and text[3] == "\n".join(["deep 3"] * 300)
