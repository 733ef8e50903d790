import random

import pytest

from vectorvote.llm import html_text as h


def dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_common():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 25))] for _ in "ab")
        got = sorted(h.common(a, b))
        assert len(got) == dp(a, b) and is_subsequence([a[k] for k in got], b)
    a, b = ([r.randint(0, 9) for _ in range(9000)] for _ in "ab")
    got = sorted(h.common(a, b))
    whole = int(h._scores(a, b)[-1])
    assert len(got) == whole and is_subsequence([a[k] for k in got], b)


def text(page):
    got = h.lines(page)
    keep = h.main_lines([len(x.text) for x in got], [x.kind for x in got], [h._key(x) for x in got], [])
    return " ".join(got[k].text for k in keep)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>t</title></head><body><nav>m</nav><article><h1>A</h1><p><b>x<br><p>y  z</p></article><footer>f</footer>", "A x y z"),
        ("<p>a<p>b<div class='site-banner'>ad</div><ul><li>1<li>2</ul>c", "a b 1 2 c"),
        ("<article><p>q</p><section class=comments><p>first!</p></section><script>var s='</p>';</script><!-- c --><p>&lt;b&gt; &amp &am &#233; &nbsp;e", "q <b> & &am é e"),
        ("<main><aside>no</aside><form>no<input></form><p>yes <em>in</em>line</p></main>tail", "yes inline"),
        ("<body>plain <style>x{}</style>text <div hidden>h</div><noscript>n</noscript>", "plain text"),
        ("<header>Top</header><article><header><h1>T</h1></header><p>b</article>", "T b"),
        ("a < b <", "a < b <"),
        ("<body class='has-sidebar'><main id=main class='with-comments'><div class='entry-header'><h1>T</h1></div><p>b<div id='comments'>c</div><div class=shareBar>s</div></main>", "T b"),
        ("<div class='cookie-notice'>k</div><div class='no-ads'>text</div><table><tr><td>1<td>2<tr><td>3</table>", "text 1 2 3"),
        ("<p>cut <a href='", "cut"),
        ("", ""),
        (None, ""),
    ],
)
def test_lines(page, want):
    assert text(page) == want


def brute(pages):
    """The operator's text for every (page_id, host, path, html), in plain Python: all pages in order, lines aligned by dynamic programming."""
    parsed = [(i, host, path, h.lines(page)) for i, host, path, page in sorted(pages, key=lambda x: x[1:3] + x[:1])]
    own = lambda x: [(y.path, y.text) for y in x[3] if y.kind != h.TEMPLATE]
    runs = []
    for x in parsed:
        if runs and runs[-1][0][1] == x[1] and own(runs[-1][0]) == own(x):
            runs[-1].append(x)
        else:
            runs.append([x])
    out = {}
    for at, run in enumerate(runs):
        page = run[0]
        name = lambda y: y.path if y.kind == h.TEMPLATE else (y.path, y.text)
        near = [o[0] for k, o in enumerate(runs) if 0 < abs(k - at) <= h.NEAR and o[0][1] == page[1] and own(o[0]) != own(page)]
        votes = [0] * len(page[3])
        for o in near:
            a, b = [name(y) for y in page[3]], [name(y) for y in o[3]]
            for k in h.common([hash(v) for v in a], [hash(v) for v in b]):
                votes[k] += 1
        n = len(near)
        left = [(y, v) for y, v in zip(page[3], votes) if y.kind == h.PLAIN and v < max(n, 1) / 2 or y.kind == h.MAIN and not (n >= 3 and v == n)]
        main, plain = ([y.text for y, _ in left if y.kind == kind] for kind in (h.MAIN, h.PLAIN))
        text = main if main and sum(map(len, main)) >= sum(map(len, plain)) else plain
        for x in run:
            out[x[0]] = " ".join(text)
    return out


def test_against_brute_force(spark):
    """Marked and unmarked pages, shared and own lines, copies, hosts of one page, hosts over several partitions."""
    r = random.Random(5)
    rows = []
    for k in range(260):
        host, n = f"h{r.choice('aaaabbc')}.org" if k < 250 else f"lone{k}.org", r.randint(0, 5)
        body = "".join(f"<p>{r.choice(['shared one', 'shared two', f'own {k} {j} ' * 3])}</p>" for j in range(n))
        box = r.choice(["<article>%s</article>", "<div>%s</div>", "<div><article>%s</article></div>", "<main><div class=ad>x</div>%s</main>"]) % body
        page = f"<nav>m{k % 3}</nav><div>Site line</div>{box}<p>Join us</p><footer>f{k}</footer>"
        rows.append((k, host, f"/{r.randint(0, 60):02d}", page))
        if r.random() < 0.2:
            rows += [(1000 + 10 * k + j, host, rows[-1][2], page) for j in range(r.randint(1, 6))]
    df = spark.createDataFrame([(i, f"http://{host}{path}", page) for i, host, path, page in rows], "page_id long, url string, html string").repartition(5)
    assert {x.page_id: x.text for x in h.extract(df).collect()} == brute(rows)


def test_passes_over_ends(spark, monkeypatch):
    monkeypatch.setattr(h, "END_PAGES", 30)
    rows = [(k, "h.org", f"/{k // 2:03d}", f"<div>Site</div><p>own {k}</p><p>{'odd' if k % 2 else 'even'}</p>") for k in range(120)] + [(500 + k, "h.org", "/900", "<div>Site</div><p>copy</p>") for k in range(9)]
    df = spark.createDataFrame([(i, f"http://{host}{path}", page) for i, host, path, page in rows], "page_id long, url string, html string").repartition(5)
    got = {x.page_id: x.text for x in h.extract(df).collect()}
    assert len(got) == 129 and got == brute(rows)


def test_what_pages_share_goes_also_where_the_article_is_marked(spark):
    rows = [(k, f"http://h.org/{k:02d}", f"<article><p>Story {k} as told.</p><p>Write to us.</p></article>") for k in range(8)]
    mostly = [(100 + k, f"http://t.org/{k:02d}", "".join(f"<div>template {j}</div>" for j in range(30)) + f"<p>story {k}</p>") for k in range(8)]
    cards = [(200 + k, f"http://c.org/{k:02d}", f"<div><p>{f'the long body of {k} ' * 9}</p></div><article>card {k}</article>") for k in range(8)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows + mostly + cards, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert (got[k], got[100 + k], got[200 + k]) == (f"Story {k} as told.", f"story {k}", (f"the long body of {k} " * 9).strip())


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, "<div>" * 60_000 + "</p>" * 150_000, "<b>" * 60_000 + "<ul></ul>" * 80_000, "<svg/>" * 160_000, "<head>" * 160_000, "<p>" * 300_000, "<script>" * 120_000, "<x><p>" * 160_000, "<a class='" + "ad " * 330_000, "<!-- " * 200_000, "<td><table>" * 90_000, "&" * 1_000_000, "<" * 1_000_000, "<select>x</select>" * 55_000, "<p><div>" * 125_000],
)
def test_parsing_takes_linear_time(page):
    import time

    began = time.process_time()
    h.lines(page)
    assert time.process_time() - began < 8


def test_deep_and_unclosed():
    got = h.lines("<div>" * 1000 + "deep" + "</div>" * 1000 + "<p>after")
    assert [x.text for x in got] == ["deep", "after"] and got[1].path == h.lines("<p>x")[0].path


def test_differencing(spark):
    page = "<body><div>Site name</div><p>{}</p><p>{}</p><div>All rights kept</div></body>"
    rows = [(k, f"http://h.org/a/{k}", page.format(f"story {k} is told", f"and ends {k} here")) for k in range(40)]
    rows += [(100, "http://other.org/x", page.format("alone", "end")), (101, None, None), (102, "http://h.org/a/5", rows[5][2]), (102, "http://h.org/a/5", rows[5][2]), (103, "no url", ""), (104, "http://h.org/z", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").repartition(5)
    got = sorted(((r.page_id, r.text) for r in h.extract(df).collect()))
    want = {k: f"story {k} is told and ends {k} here" for k in range(40)} | {100: "Site name alone end All rights kept", 101: "", 103: "", 104: ("w " * 100_000).strip()}
    assert [x for x in got if x[0] not in (5, 102)] == sorted((k, v) for k, v in want.items() if k != 5)
    assert sum(x[0] in (5, 102) for x in got) == 3 and all("story 5 is told and ends 5 here" in x[1] for x in got if x[0] in (5, 102))
    assert h.extract(df.limit(0)).count() == 0
