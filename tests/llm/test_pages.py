import numpy as np
from pyspark.sql import functions as F

from tests.llm.plain import PAGE_SCHEMA
from vitrina.llm.urls import LETTERS, N_SYMBOLS, filter_urls, ratio_model
from vitrina.llm.wrappers import content_paths, extract_text, merge, page_wrapper

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGE_SCHEMA)


def test_rules(spark):
    rows = [
        (1, "http://a.example.net/en/1?x#y"), (2, "https://example.net/de/1"), (3, "HTTP://Shop.Example.COM/de/x"),
        (4, "http://b.org/fr/"), (5, "http://b.org/fr"), (6, "http://badnet/en/"), (7, None), (8, ""), (9, "no scheme/fr/"),
        (10, "ftp://x.net"), (11, "x://net/?q=://a/b"), (12, "http://ÀÉ.net/q"), (13, "http://myexample.com/de/"),
        (14, "http://user@a.example.com:80/de/"), (1, "http://a.example.net/en/1?x#y"),
    ]
    got = {r["page_id"]: r for r in filter_urls(pages(spark, [(i, u, "") for i, u in rows]), RULES).collect()}
    view = {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()}
    assert view[1] == ("a.example.net", "/en/1", "example.net/en/") and got[1]["verdict"] == "allow"
    assert view[2] == ("example.net", "/de/1", "net/") and got[2]["verdict"] == "block"
    assert view[3] == ("shop.example.com", "/de/x", "example.com/de/")
    assert view[4][2] == "org/fr/" and view[5] == ("b.org", "/fr", None)
    assert view[6] == ("badnet", "/en/", None)
    assert view[7] == view[8] == view[9] == ("", "", None)
    assert view[10] == ("x.net", "", None) and view[11] == ("net", "/", "net/")
    assert view[12] == ("ÀÉ.net", "/q", "net/") and view[13][2] is None
    assert view[14] == ("user@a.example.com:80", "/de/", None)
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and len(got) == len(set(r[0] for r in rows))


def test_ratio_learns_from_the_rules(spark):
    rng = np.random.default_rng(4)

    def name(letters):
        return "".join(rng.choice(list(letters), 12))

    rows = [(k, f"http://{name('aeiou')}.org/fr/{name('aeiou')}", "") for k in range(150)]
    rows += [(1000 + k, f"http://{name('xzkqw')}.net/{name('xzkqw')}", "") for k in range(150)]
    rows += [(2000 + k, f"http://{name('aeiou')}.com/fr/{name('aeiou')}", "") for k in range(40)]
    rows += [(3000 + k, f"http://{name('xzkqw')}.com/{name('xzkqw')}", "") for k in range(40)]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages(spark, rows), RULES).collect()}
    assert all(got[2000 + k] == "allow" and got[3000 + k] == "block" for k in range(40))
    assert filter_urls(pages(spark, []), RULES).count() == 0


def test_model_is_a_distribution(spark):
    """Sums of a context's probabilities, by a plain version of the mixture."""
    text = "abracadabra"
    codes = [0, 0, 0, *[LETTERS.index(c) + 1 for c in text], 0]
    grams: dict[int, int] = {}
    for i in range(len(codes) - 3):
        g = 0
        for c in codes[i : i + 4]:
            g = g * N_SYMBOLS + c
        grams[g] = grams.get(g, 0) + 1

    def chance(context, c):
        if not context:
            seen = {x: sum(n for g, n in grams.items() if g % N_SYMBOLS == x) for x in range(N_SYMBOLS)}
            base = 1 / N_SYMBOLS
        else:
            k = len(context)
            tail = 0
            for x in context:
                tail = tail * N_SYMBOLS + x
            seen = {x: sum(n for g, n in grams.items() if g % N_SYMBOLS ** (k + 1) == tail * N_SYMBOLS + x) for x in range(N_SYMBOLS)}
            base = chance(context[1:], c)
        n, t = sum(seen.values()), sum(v > 0 for v in seen.values())
        return (seen[c] + t * base) / (n + t) if n else base

    table = spark.createDataFrame([(g, n, 0) for g, n in grams.items()], "gram long, yes long, no long")
    got = {r["gram"]: r["ratio"] for r in ratio_model(table).collect()}
    for g, ratio in got.items():
        digits = [g // N_SYMBOLS**k % N_SYMBOLS for k in (3, 2, 1, 0)]
        want = np.log(chance(digits[:3], digits[3])) - np.log(1 / N_SYMBOLS)
        assert abs(ratio - want) < 1e-9


ARTICLE = "<article><h1>Title &amp; more</h1><p>First  <b>part</b>\n<br>of it.<p>Second&nbsp;&eacute; <i>x</i>y.</p>{extra}</article>"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href=/>Home {n}</a></li></ul></nav><div class='ad'>Buy <div>now</div></div><!-- <p>no</p> -->"
    "<aside>side {n}</aside>{article}<form><p>mail</p></form><div id='comments'><p>Nice {n}</p></div><footer>&copy; {n}</footer></body></html>"
)
TEXT = "Title & more\n\nFirst part of it.\n\nSecond é xy."


def test_extract(spark):
    rows = [(k, f"http://H{k % 2}.org/{k}", PAGE.format(n=k, article=ARTICLE.format(extra=""))) for k in range(6)]
    rows += [
        (10, "http://h1.org/q", PAGE.format(n=9, article=ARTICLE.format(extra="<aside>a</aside><ul><li>one<li>two</ul>"))),
        (11, "http://h1.org/cut", PAGE.format(n=9, article=ARTICLE.format(extra="")).split("</article>")[0]),
        (12, None, None), (13, "http://h1.org/", ""), (14, "odd", "plain < text"), (15, "http://one.org/", "<p>a<p>b<table><tr><td>c<td>d</table>"),
        (16, "http://deep.org/", "<div>" * 5_000 + "<p>deep</p>"), (17, "http://h0.org/2", PAGE.format(n=2, article=ARTICLE.format(extra=""))),
        (18, "http://m.org/1", "<main><p>m</p><nav>n</nav></main><p>out</p>"), (19, "http://s.org/", "<script>alert('x')"),
    ]
    rows.append(rows[0])
    got = extract_text(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == TEXT for k in (0, 1, 2, 3, 4, 5, 11, 17))
    assert text[10] == TEXT + "\n\none\n\ntwo"
    assert text[12] == text[13] == text[19] == "" and text[16] == "deep" and text[18] == "m"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(pages(spark, [])).count() == 0


def test_text_without_an_article(spark):
    """Only slots count: what all pages of the host share is the template's."""
    page = "<body><div>Welcome to the site</div><div><p>{a}</p><p>{b}</p></div></body>"
    rows = [(k, f"http://t.org/{k}", page.format(a=f"text {k}", b=f"more {k}")) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_text(pages(spark, rows)).collect()}
    assert got[2] == "text 2\n\nmore 2"


def test_wrapper_groups():
    one = page_wrapper("<ul><li>a<li>b<li>c</ul><p>x</p>")
    ul = one[4][0]
    assert ul[0] == "ul" and [k[0] for k in ul[4]] == ["li"] and ul[4][0][2]
    two = page_wrapper("<ul><li>a</ul><hr><h2>t</h2><p>y</p>")
    both = merge(one, two)
    assert [(k[0], k[1]) for k in both[4]] == [("ul", False), ("h2", True), ("p", False)]
    assert both[4][2][4][0][3] is None and merge(one, one)[4][1][4][0][3] == "x"
    assert content_paths(both)[2] == ["h2", "p", "ul/li"]


def test_page_of_open_paragraphs_is_linear():
    assert len(page_wrapper("<p>x" * 50_000)[4]) == 1


def test_labels_do_not_drop_the_article(spark):
    body = (
        "<body><div class='site-content has-sidebar'><article><div class='page-header'><h1 id='login'>Title {n}</h1></div>"
        "<h2 id='social-impact'>Impact</h2><section id='related-work'><p data-id='nav' data-class='ad'>Work {n}</p></section>"
        "<div class='share big'>Tweet</div></article></div>"
        "<div class='comments'><article><p>Nice {n}</p></article></div></body>"
    )
    rows = [(k, f"http://side.org/{k}", body.format(n=k)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in extract_text(pages(spark, rows)).collect()}
    assert got == {k: f"Title {k}\n\nImpact\n\nWork {k}" for k in range(3)}
