import itertools
import json
import random

from colloquy.llm.dom import parse
from colloquy.llm.wrapper import Page, extract_text, host_of, match_trees

SHAPE = "page_id long, url string, html string, host string, text string, reference string"


def extracted(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "a", "b", "c") for i, u, h in rows], SHAPE)
    return {r["page_id"]: r for r in extract_text(pages).collect()}


def test_markup(spark):
    html = (
        "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>"
        "<nav><ul><li>Home<li>More</ul></nav><div class='ad top'>Buy</div><div id=cookie-notice>Cookies</div>"
        "<article><header><h1>A &amp; B</h1></header><p>One <b>two</b>,\n three<br>four<p>Fünf&nbsp;&#x2014; six"
        "<script>var x='</p>';</script><div>a<span>b</span>c</div><aside>Side</aside><form><p>Mail</p></form>"
        "<table><tr><td>x<td>y</table><!-- <p>no</p> --><section class=comments><p>First!</p></section></article>"
        "<footer>&copy;</footer></body></html>"
    )
    got = extracted(spark, [(1, "http://a.b/c", html), (2, None, None), (3, "", ""), (4, "x", "just <i>text</i> &lt;b&gt;")])
    assert got[1]["text"] == "A & B\nOne two, three four\nFünf — six\nabc\nx\ny"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "just text <b>"


def test_template_without_semantic_markup(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(30):
        host = "Shop.example.com" if k < 20 else f"alone{k}.example.com"
        own = [f"Paragraph {rng.random()} of page {k}" for _ in range(1 + k % 4)]
        extra = "<div>Only here</div>" if k % 5 == 0 else ""
        html = (
            f"<body><div><p>Welcome to our shop</p>{extra}</div><div>" + "".join(f"<p>{p}</p>" for p in own)
            + "</div><div><p>Call us any time</p></div></body>"
        )
        rows.append((k, f"https://{host}/p{k}", html))
        want[k] = (["Only here"] if extra else []) + own
    got = extracted(spark, rows + [rows[0]])
    for k in range(20):
        assert got[k]["text"] == "\n".join(want[k])
    assert got[25]["text"].startswith("Welcome to our shop")  # nothing to compare it with


def test_copies_do_not_make_an_article_template(spark):
    rows = [(k, f"http://same.example.com/{k}", "<body><article><p>The same text</p></article></body>") for k in range(20)]
    assert {r["text"] for r in extracted(spark, rows).values()} == {"The same text"}


def blog(k, article):
    """A page whose template has more blocks than its article, none of which names itself."""
    template = "".join(f"<li>Link {n}</li>" for n in range(10))
    return f"http://blog.example.com/{k}", f"<body><ul>{template}</ul><div>{''.join(f'<p>{p}</p>' for p in article)}</div></body>"


def test_template_larger_than_the_article(spark):
    want = {k: [f"Paragraph {n} of page {k}" for n in range(3)] for k in range(12)}
    got = extracted(spark, [(k, *blog(k, article)) for k, article in want.items()])
    assert {k: r["text"] for k, r in got.items()} == {k: "\n".join(article) for k, article in want.items()}


def test_copies_vote_once(spark):
    # Fewer than LEAST_PAGES different pages: what the 20 copies say is no template.
    few = [(k, *blog(k, ["The same text"])) for k in range(20)] + [(k, *blog(k, [f"Text {k}"])) for k in (20, 21)]
    assert all(r["text"].endswith(("The same text", f"Text {k}")) for k, r in extracted(spark, few).items())
    # Enough of them: the copies keep their article, the others lose their template.
    many = few + [(k, *blog(k, [f"Text {k}"])) for k in range(22, 32)]
    assert {k: r["text"] for k, r in extracted(spark, many).items()} == {
        k: "The same text" if k < 20 else f"Text {k}" for k in range(32)
    }


def brute_match(a, b):
    """Size of the largest simple tree matching of (label, children) trees."""
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for x in itertools.combinations(a[1], n):
            for y in itertools.combinations(b[1], n):
                parts = [brute_match(u, v) for u, v in zip(x, y)]
                best = max(best, sum(parts))
    return best + 1


def flat(tree):
    labels, parents = [], []

    def walk(node, parent):
        labels.append(node[0])
        parents.append(parent)
        me = len(labels) - 1
        for child in node[1]:
            walk(child, me)

    walk(tree, -1)
    return json.dumps([labels, parents])


def test_matching_is_largest_and_keeps_order():
    rng = random.Random(9)

    def tree(depth):
        return rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []

    for _ in range(60):
        a, b = ("r", [tree(1), tree(1)]), ("r", [tree(1), tree(1), tree(0)])
        got = match_trees(flat(a), flat(b))
        assert len(got) == brute_match(a, b)
        assert len({*got.values()}) == len(got) and [got[k] for k in sorted(got)] == sorted(got.values())


def test_hosts_and_odd_pages(spark):
    assert host_of("HTTP://u@Ex.com:80/x") == "ex.com" and host_of("nonsense") == host_of(None) == ""
    deep = "<div>" * 3000 + "deep" + "</p></div><"
    assert Page(deep).text(set()) == "deep <" or "deep" in Page(deep).text(set())
    assert parse("<a href='x").tag == "html"
    assert extracted(spark, []) == {}
