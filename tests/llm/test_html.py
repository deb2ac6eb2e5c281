from gridloom.llm import html_templates, queries

SCHEMA = "page_id long, url string, html string, site long, keys string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "t") for r in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: r.text for r in html_templates.extract(pages(spark, rows)).collect()}


def test_fixed_rules(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li>menu</ul></nav><header>top</header><div class="cookie-notice">cookies</div>
    <article><h1>Head &amp; line</h1><p>One <b>bold</b>\n   word&nbsp;here<br>more<p>Two<ul><li>a<li>b</ul><!-- no --><div class="ad">buy</div>
    <form><input>ask</form><section class="comments"><p>said</p></section></article><aside>side</aside><footer>foot</footer></body>"""
    assert texts(spark, [(1, "http://a.example/1", html)]) == {1: "Head & line\n\nOne bold word here more\n\nTwo\n\na\n\nb"}


def test_template_subtrees_of_a_host(spark):
    """No article element: what recurs on the host's pages goes, on other hosts it stays."""
    page = lambda i: f"<body><div><div>Site name</div><div>Slogan</div></div><div><p>Own text {i}</p></div><div><p>Closing words</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(8)] + [(9, "https://b.example/9", page(9))]
    got = texts(spark, rows)
    assert [got[i] for i in range(8)] == [f"Own text {i}" for i in range(8)]
    assert got[9] == "Site name\n\nSlogan\n\nOwn text 9\n\nClosing words"


def test_joined_templates(spark, monkeypatch):
    page = lambda i: f"<body><div>Slogan</div><div><p>Own text {i}</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(8)] + [(9, "https://b.example/9", page(9)), (10, None, "<p>x"), (11, None, None)]
    want = texts(spark, rows)
    monkeypatch.setattr(html_templates, "BROADCAST_HASHES", -1)
    assert texts(spark, rows) == want and want[3] == "Own text 3"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "http://h/", "plain text  only"), (4, "x", "<div><p>open <i>tags"), (5, "x", "<" * 50), (6, "x", "<p a='>'>q</p>"), (None, "x", "<p>n</p>"), (7, "x", "<div>" * 3000 + "deep"), (8, "x", "<p>" + "long " * 200000)]
    rows += [(9, "y", "<p>twice</p>")] * 6
    got = html_templates.extract(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    own = {r.page_id: r for r in got.collect()}
    assert own[1].text == own[2].text == "" and own[3].text == "plain text only" and own[4].text == "open tags" and own[6].text == "q" and own[7].text == "deep"
    assert own[8].n_chars == 200000 * 5 - 1 and own[9].text == "twice" and own[None].text == "n"
    assert html_templates.extract(pages(spark, [])).count() == 0


def test_whole_table(spark, sf):
    got = queries.op1_html_extraction(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count() and got.where("n_chars > 0").count() > 40
    assert got.where("text like '%track(%' or text like '%&copy%' or text like '%©%'").count() == 0


def test_wrappers_do_not_delete_the_article(spark):
    body = "<article><h1>Head</h1><p>Text</p></article>"
    kept = [f"<div id='page' class='site {c}'>{body}</div>" for c in ("right-sidebar", "has-sidebar", "no-ads", "legal-news", "social-science", "has-header", "legal", "cookies overlay")]
    kept += [f"<form action='/'>{body}</form>", f"<form><div class='no-ads'>{body}</div><p>ask</p></form>", f"<div class='sidebar'>x<main>{body}</main></div>", f"{body}<aside><article>side</article></aside>"]
    kept += [f"{body}<div class='{c}'><article>other</article></div>" for c in ("comments", "comment-list", "related-posts", "footer", "sidebar", "ad-box")]
    kept += ["<div class='legal-news'><h1>Head</h1><p>Text</p></div>", f"{body}<nav><main>menu</main></nav>"]
    kept += [f"<article><h1>Head</h1><p>Text</p><div class='{c}'>no</div></article>" for c in ("ad", "cookie-notice", "ad-container", "site-footer", "share_buttons", "x sidebar")]
    got = texts(spark, [(i, f"http://h{i}.example/", h) for i, h in enumerate(kept)])
    assert {i: t for i, t in got.items() if t != "Head\n\nText"} == {}


def test_inline_elements():
    """Dropped inline elements go without parting the paragraph; class words that articles use stay."""
    cases = {
        "<p>one <span class='advert'>buy <span>now</span> cheap</span> two</p>": "one two",
        "<p><a class='skip' href='#m'>Skip</a>one <button>x</button>two <label>l</label>three</p>": "one two three",
        "<p>a <svg width=1><text>t</text></svg>b <math><mi>x</mi></math> c <svg/>d</p>": "a b x c d",
        "<article><p class='legal'>law</p><p class='tags'>words</p><div class='related'>more</div></article>": "law\n\nwords\n\nmore",
        "<div><span class='ad'>never closed</div><p>kept</p>": "kept",
        "<div><a class='advert'><div>block <b>in</b> it</div> tail</a> after</div>": "after",
        "<p>x <select><option>1<option>2</select> y <object>o</object>z</p>": "x y z",
        "<p>a<!-- <span class='ad'> -->b <span class='notice-bar'>n</span></p>": "ab",
        "<p>plain <span class='no-ads'>kept</span></p>": "plain kept",
    }
    for html, want in cases.items():
        assert html_templates.main_text(html_templates.parse(html)) == want, html


def test_whole_pages_by_counting(spark):
    """Every page of a table as by counting subtrees in one process."""
    from collections import Counter

    folder = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    trees = [html_templates.parse(h or "") for _, _, h in rows]
    sites, seen = Counter(), Counter()
    for (site, digest), keys in {(html_templates.host(u), t.digest): {n.digest for n in html_templates.candidates(t)} for (_, u, h), t in zip(rows, trees) if h}.items():
        sites[site] += 1
        seen.update((site, k) for k in keys)
    want = []
    for (i, u, h), t in zip(rows, trees):
        site = html_templates.host(u)
        for n in html_templates.candidates(t) if h else []:
            n.dropped = seen[site, n.digest] >= 4 and seen[site, n.digest] >= 0.5 * sites[site]
        text = html_templates.main_text(t) if h else ""
        want.append((i, u, text, len(text)))
    assert sorted(map(tuple, html_templates.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect())) == sorted(want)
