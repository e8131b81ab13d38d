from terranet.llm import site_tree as S


def text(html, low=frozenset()):
    return S.main_text(S.parse(html), low)


def test_marked_up_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
      <div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
      <!-- <p>hidden</p> --><div class="ad">Buy</div><div class="left sidebar"><p>Side</p></div>
      <main><article class="post"><header><h1>Title &eacute;&amp</h1></header><p>One <b>two</b>three<br>four&nbsp;five
      <p>Second &lt;b&gt;<ul><li>a<li>b</ul><form><label>x</label></form><div class="social-share">Tweet</div></article>
      <section id="comments"><article class="comment"><p>nice!</p></article></section></main>
      <aside>rel</aside><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Title é&\n\nOne twothree four five\n\nSecond <b>\n\na\n\nb"


def test_bad_markup():
    assert text("<article><p><b>bold<br><p>next</p></article><footer>f") == "bold\n\nnext"
    assert text("<article><p>a < b & c > d</p><p>cut of") == "a < b & c > d\n\ncut of"
    assert text("<article><p>end <di") == "end"
    assert text("<article><p title='a > b'>x</p><p title=\"un'quoted>y</p>") == "x\n\ny"
    assert text("<article><p>one</div></p>two</article>") == "one\n\ntwo"
    assert text("") == "" and text("plain &#233; text") == "plain é text"
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<script>never ends <p>x</p>") == ""
    assert text("<p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><p>d</p>") == "d"


def test_names_of_wrappers_and_anchors():
    inner = "<article><h1>Title</h1><p>One two three four</p><p>Five six</p></article>"
    for wrap in ("<div class='layout sidebar-left'>", "<div class='page modal-open'>", "<form id='aspnetForm'>", "<form id=aspnetForm><div class='search sidebar'>", "<aside>"):
        end = "</div></form>" if wrap.count("<") == 2 else f"</{wrap[1:].split()[0].strip('>')}>"
        side = "<div class='sidebar'><p>Side</p></div><nav><a>Menu</a></nav>"
        assert text(f"<p>Logo</p>{wrap}{side}{inner}<div id=comments><p>A very long comment, longer than anything else</p></div>{end}") == "Title\n\nOne two three four\n\nFive six"
        assert text(f"{wrap}{side}<p>One two three four</p><p>Five six seven</p>{end}") == ("" if wrap == "<aside>" else "One two three four\n\nFive six seven")
        assert text(f"<main>{wrap}{inner}{end}<aside>x</aside></main>") == "Title\n\nOne two three four\n\nFive six"
    assert text(f"{inner}<div class=related><article><p>Teaser</p></article></div>") == "Title\n\nOne two three four\n\nFive six"
    assert text("<main><p>One two three</p><div class='related-posts'><article><p>Teaser</p></article></div></main>") == "One two three"
    assert text("<article hidden><p>a</p></article><p>b</p>") == "b"
    assert text("<article><p>a</p><section id=discussion><h2 id=related-work>b</h2><p>c</p></section><h2 id='social-contract'>d</h2>"
                "<div class=section id=search><p>e</p></div><div class='share-buttons'>f</div><section id=comments>g</section></article>") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("<p>a</p><div class='social-contract'><p>b</p></div><div class='sidebar-left'>c</div>") == "a\n\nb"


def test_links_in_the_main_text_stay():
    page = "<h2><a href=x>Linked heading</a></h2><p>Text</p><p><a href=y>A paragraph that is a link</a></p><ol><li><a href=z>Reference</a></li></ol>"
    assert text(page) == "Linked heading\n\nText\n\nA paragraph that is a link\n\nReference"
    low = {b.node for b in S.parse(page).blocks if b.text == "Reference"}
    assert text(page, low) == "Linked heading\n\nText\n\nA paragraph that is a link"


SCHEMA = "page_id long, url string, html string, text string, low int, host string"


def site(spark):
    found = []
    for i in range(12):
        found.append((i, f"http://one.example/{i}", f"<div class=top><p>Welcome to our site</p></div><div class=box><p>Story {i} tells {i * 7}</p></div>"
                                                   "<ul><li><a>Home</a><li><a>About</a></ul><div class=end>All rights</div>"))
    found += [(20, "http://alone.example/", "<div class=top><p>Welcome to our site</p></div><p>Only page</p>"), (21, None, "<p>no url</p>"), (22, "u", None),
              (23, "u", ""), (0, "http://one.example/0", found[0][2])]
    found += [(30 + i, "http://copies.example/", "<article><p>Same story</p></article>") for i in range(5)]
    return spark.createDataFrame([(*r, "t", 1, "h") for r in found], SCHEMA)


def test_importance_removes_what_all_pages_have(spark):
    got = {r["page_id"]: r["text"] for r in S.extracted_pages(site(spark)).collect()}
    assert all(got[i] == f"Story {i} tells {i * 7}" for i in range(12))
    assert got[20] == "Welcome to our site\n\nOnly page" and got[21] == "no url" and got[22] == got[23] == ""
    assert all(got[30 + i] == "Same story" for i in range(5))
    assert S.extracted_pages(site(spark)).count() == 12 + 5 + 5
    assert S.extracted_pages(site(spark).limit(0)).count() == 0


def test_importance_of_nodes(spark):
    tree = S.style_tree(site(spark)).collect()
    assert all(-1e-9 <= r["importance"] <= 1 + 1e-9 for r in tree)
    page = S.parse("<div class=top><p>Welcome to our site</p></div><div class=box><p>Story</p></div>")
    host = site(spark).filter("page_id = 1").select(S._host("url").alias("h")).first()["h"]
    of = {r["node"]: r["importance"] for r in tree if r["host"] == host}
    assert of[page.blocks[0].node] < 0.05 and of[page.blocks[1].node] > 0.9


def brute_importance(pages, discount=S.DEPTH_DISCOUNT):
    """Importance of every branch of a host's pages, from the definitions."""
    import math
    from collections import Counter, defaultdict
    seen, parent = defaultdict(list), {}
    for html in pages:
        page = S.parse(html)
        about = tuple(b.text for b in S.body_blocks(page) or page.blocks)
        for node, (up, children) in page.layouts.items():
            parent[node] = up
            if children:
                seen[node, False].append((tuple(c for k, c in enumerate(children) if not k or children[k - 1] != c), about))
            texts = tuple(b.text for b in page.blocks if b.node == node)
            if texts:
                seen[node, True].append((texts, about))
    weight, whole = defaultdict(float), defaultdict(float)
    for (node, content), values in seen.items():
        counts = [n if len({a for v, a in values if v == value}) > 1 else 1 for value, n in Counter(v for v, _ in values).items()]
        n = sum(counts)
        entropy = 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in counts) / math.log(n)
        w, at = n * (1.0 if content else 1 - discount), node
        while at:
            weight[at], whole[at] = weight[at] + w, whole[at] + w * entropy
            w, at = w * discount, parent[at]
    return {node: whole[node] / weight[node] for node in weight}


def test_importance_equals_brute_force(spark):
    import random
    rng = random.Random(2)
    pages = []
    for i in range(60):
        host = rng.choice("abc")
        body = "".join(rng.choice(["<p>same</p>", f"<p>{rng.randrange(5)}</p>", f"<div class=x><div><p>{i}</p></div></div>", "<ul><li>a<li>b</ul>", "<section><p>s</p>t</section>"])
                       for _ in range(rng.randrange(1, 6)))
        pages.append((i, f"http://{host}/{i}", rng.choice(["<article>{}</article>", "<div class=q>{}</div>"]).format(body)))
    pages += [(100 + k, "http://a/x", pages[0][2]) for k in range(4)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts = {r["h"]: r["host"] for r in frame.selectExpr("url", "substring(url, 8, 1) as h").select("h", S._host(S.F.col("url")).alias("host")).distinct().collect()}
    got = {(r["host"], r["node"]): r["importance"] for r in S.style_tree(frame).collect()}
    want = {(code, node): x for name, code in hosts.items() for node, x in brute_importance([h for _, u, h in pages if u[7] == name]).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_boxes_that_all_articles_repeat_go(spark):
    page = "<article><h2>Facts</h2><p>Story {0}</p><div class=zz>Read our other stories</div><div class=own>Box {0}</div></article>"
    found = [(i, "http://one.example/", page.format(i)) for i in range(8)] + [(20 + i, "http://two.example/", page.format(1)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in S.extracted_pages(spark.createDataFrame(found, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Facts\n\nStory {i}\n\nBox {i}" for i in range(8))
    assert all(got[20 + i] == "Facts\n\nStory 1\n\nRead our other stories\n\nBox 1" for i in range(8))


def test_deep_page(spark):
    found = [(1, "http://deep/", "<div>" * 100_000 + "deep"), (2, "http://deep/", "<p>flat")]
    got = {r["page_id"]: r["text"] for r in S.extracted_pages(spark.createDataFrame(found, "page_id long, url string, html string")).collect()}
    assert got == {1: "deep", 2: "flat"}
