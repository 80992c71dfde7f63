"""Main-text extraction on pages whose article is known."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factgrid.llm import html

LINE = "This is a fairly long sentence of the article with many words in it."


def alone(page):
    paths, _, _ = html.votes(page)
    return html.main_text(page, paths[0][0] if paths else None)


def test_names_that_only_contain_a_boilerplate_word_keep_their_text():
    assert alone(f"<body><div class='elementor-widget-text-editor'><p>{LINE}</p></div></body>") == LINE
    assert alone(f"<body><div class='comments-policy-article'><p>{LINE}</p></div></body>") == LINE
    assert alone(f"<body><article><p>{LINE}</p><p class='share-price'>A</p><p class=social-science>B</p></article></body>") == f"{LINE} A B"
    for name in ("site-footer-wrap", "comment-list", "article-comments", "cookieNotice", "ad", "post-sidebar", "widget_text"):
        assert alone(f"<body><div class=x><p>{LINE}</p></div><div class='{name}'><p>{LINE * 9}</p></div></body>") == LINE, name


@pytest.mark.parametrize("depth", [401, 1000, 20_000])
def test_deep_nests(depth):
    page = "<body>" + "<div>" * depth + "<p>deep text</p>" + "</div>" * depth + f"<p>after text {LINE}</p></body>"
    assert alone(page) == f"deep text after text {LINE}"
    assert alone("<body>" + "<b>" * depth + f"{LINE}<p>next") == f"{LINE} next"


def test_long_page():
    paragraphs = [f"{LINE} {i}" for i in range(20_000)]
    assert alone("<body><nav>x</nav><article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article>") == " ".join(paragraphs)


def test_only_boilerplate_and_odd_markup():
    assert alone("<nav><a href=1>x</a></nav><footer>y</footer>") == ""
    assert alone("<div class=sidebar><p>all there is</p></div>") == "all there is"
    assert alone("<body><p>a<select><option>b</body></p>") == "a"
    assert alone(f"<title>My head | Site</title><body><h1>My head</h1><div class=txt><p>{LINE}</p></div></body>") == f"My head {LINE}"
    assert alone(f"<body><p>{LINE}</p><p style='display: none'>no</p><p hidden>no</p></body>") == LINE


VOCABULARY = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa", "no", "vi") for b in ("ra", "den", "sol", "mir", "tak", "pol", "gus", "lan", "wer", "zin")]


def site(rng, host, pages):
    """Pages of one layout with their articles' text: ``(url, html, text)``."""
    say = lambda a, b: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(a, b)))
    menu = "".join(f"<li><a href=/{i}>{say(1, 3)}</a></li>" for i in range(rng.randrange(4, 9)))
    foot, notice, name, layout = say(5, 20), say(8, 25), say(1, 3), rng.randrange(6)
    for i in range(pages):
        title = say(3, 9)
        parts = [say(8, 70) for _ in range(rng.randrange(2, 9))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        ad, side, reply, tease = say(4, 30), say(10, 40), say(20, 120), "".join(f"<li><a href=/r{k}>{say(3, 8)}</a></li>" for k in range(4))
        head = f"<html><head><title>{title} - {name}</title><style>p{{}}</style><script>if (a < b) c('</p>')</script></head>"
        comments = f"<section id=comments><h3>{say(1, 3)}</h3><article class=comment><p>{reply}</p></article></section>"
        page = [
            f"{head}<body><header>{name}</header><nav><ul>{menu}</ul></nav><main><article><h1>{title}</h1>{body}</article>{comments}</main><aside>{side}</aside><footer>{foot}</footer></body>",
            f"{head}<body class='home blog'><div id=page><div class='site-header'>{name}</div><ul class=main-menu>{menu}</ul><div class='post hentry post-{i}'><h1 class=entry-title>{title}</h1><div class=entry-content>{body}</div></div>"
            f"<div id=comments class=comments-area><p>{reply}</p></div><div class='widget-area sidebar'><p>{side}</p></div><div id=site-footer>{foot}</div></div></body>",
            f"{head}<body><div class='el-notice-bar-x'>{notice}</div><ul>{menu}</ul><div class=c1><h1>{title}</h1><div class='elementor-widget-text-editor'>{body}</div></div><div class=advert><p>{ad}</p></div><div class=zz9>{foot}</div></body>",
            f"{head}<body><table><tr><td class=left><ul>{menu}</ul></td><td class=story><h1>{title}</h1>{body}<ul>{tease}</ul></td></tr></table><div class=footer>{foot}</div></body>",
            f"{head}<body><div class=wrap><div class=teasers-{i}><ul>{tease}</ul></div><div class=text><h1>{title}</h1>{'<br><br>'.join(parts)}<form><p>{say(3, 9)}</p><input></form></div><div class='cookie-consent'><p>{notice}</p></div></div></body>",
            f"{head}<body><nav>{menu}</nav><div role=main><div class=article__body><header class=article-header><h1>{title}</h1></header>{'<div></div>'.join(f'<div class=para>{p}</div>' for p in parts)}</div></div><div class=ad-slot>{ad}</div><footer><p>{foot}</p></footer></body>",
        ][layout]
        yield f"http://{host}/{i}", page, " ".join([title, *parts])


def test_generated_sites(spark):
    rng = random.Random(11)
    made = [x for h in range(24) for x in site(rng, f"h{h}.example.com", rng.choice((1, 3, 12, 30)))]
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(made)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    common = sum((Counter(got[i].split()) & Counter(t.split())).total() for i, (_, _, t) in enumerate(made))
    recall, precision = common / sum(len(t.split()) for _, _, t in made), common / sum(len(t.split()) for t in got.values())
    exact = sum(got[i] == t for i, (_, _, t) in enumerate(made)) / len(made)
    print(f"token recall {recall:.4f}, precision {precision:.4f}, whole pages {exact:.3f} of {len(made)}")
    assert recall >= 0.99 and precision >= 0.97


def test_copies_on_a_host_keep_their_article(spark):
    page = f"<body><div class=a><p>{LINE}</p><p>second {LINE}</p></div><div class=zz9>the end</div></body>"
    rows = [(i, f"http://h/{i}", page) for i in range(10)] + [(10 + i, f"http://h/x{i}", page.replace("article", f"text{i}").replace("the end", f"x{i}")) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__x", F.lit(1))).collect()}
    assert got[0] == got[9] == f"{LINE} second {LINE}"


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.extract_pages(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("pages", [1, 3, 4, 60])
def test_repeated_headings_of_an_article_stay(spark, pages):
    """What many pages of a host say inside their article is the article's, however many pages there are."""
    one = "<body><nav>menu</nav><article><h1>T{0}</h1><h2>Background</h2><p>{1} {0}</p><h2>Results</h2><p>Read on. {1}</p></article><footer>f</footer></body>"
    assert extracted(spark, [one.format(i, LINE) for i in range(pages)]) == [f"T{i} Background {LINE} {i} Results Read on. {LINE}" for i in range(pages)]


def test_forms_and_widgets_around_the_page(spark):
    body = f"<nav><a href=1>Home</a></nav><div class=story><h1>Head</h1><p>{LINE}</p><p>More. {LINE}</p></div><div id=footer>imprint</div>"
    want = f"Head {LINE} More. {LINE}"
    assert alone(f"<body><form id=aspnetForm><input type=hidden>{body}</form></body>") == want
    assert alone(f"<body><form id=aspnetForm><main>{body}</main></form></body>") == want
    assert alone(f"<body><a href=#c>Skip to content</a><div class=widget>{body}</div></body>") == want
    assert alone(f"<body><p>Skip to content</p><div class='widget'><article><h1>Head</h1><p>{LINE}</p><p>More. {LINE}</p></article></div></body>") == want
    assert alone(f"<body>{body}<form><p>Your name</p><input><button>Send</button></form></body>") == want
    assert alone(f"<body>{body}<div class=comments><article class=comment><p>{LINE * 9}</p></article></div></body>") == want
    assert alone(f"<body>{body}<div class=comment-list><p>{LINE * 90}</p></div></body>") == want  # what readers write is never the frame


def test_columns_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, "http://h/1", f"<p>{LINE}</p>", "x", 5), (1, None, None, None, None)], "page_id long, url string, html string, TEXT string, N_Chars long")
    got = html.extract_pages(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"] and sorted(r.text for r in got.collect()) == ["", LINE]
