"""Operator 3: wrapper induction against plain layouts, a brute-force form and renamed pages."""

import re

import pytest

from panelia.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=x>{n}</a></ul></nav><div class="ad">Buy {n}</div><div id=wrap><article><h1>Title &amp; {n}</h1><p><b>Lead   {n}.<br><p>Second &eacute; para
 {n}</p><aside>side</aside><div class="box">Fixed words of the site</div><p>Last <a href="/x">link</a> {n}</article></div>
<section id="comments"><p>Nice {n}</p></section><form><p>Mail</p></form><footer>&copy; all {n}</footer>{tail}"""


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id long, url string, html string, wrapper string, host int")


def test_html_extract(spark):
    rows = [(k, f"http://h{k % 2}.example.com/{k}", PAGE.format(n=f"n{k}", tail="</body></html>" if k % 3 else "")) for k in range(24)]
    rows += [(50, "http://h0.example.com/c", rows[0][2]), (51, "http://alone.example.org/", "<p>One</p>two<p>three")]
    rows += [(52, None, "<main><p>x&lt;y</main>"), (53, "http://h0.example.com/", None), (54, "u", ""), (54, "u", "")]
    pages = table(spark, rows)
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract_main_text(pages).collect()}
    for k in range(24):
        want = f"Title & n{k}\nLead n{k}.\nSecond é para n{k}\nLast link n{k}"  # the fixed box is template
        assert got[k] == (want, len(want))
    assert got[50] == got[0] and got[51][0] == "One\ntwo\nthree" and got[52][0] == "x<y" and got[53] == got[54] == ("", 0)
    assert H.extract_main_text(pages).count() == len(rows)
    assert H.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="comment-free"><article><p>x</p></article></div>', "x"),
        ('<article><section class="notice-of-meeting"><p>Body</p></section></article>', "Body"),
        ('<article><h2 id="related-work">Related</h2><p class="ad-hoc">y</p></article>', "Related\ny"),
        ("<main><p>intro</p><article>card</article><p>outro</p></main>", "intro\ncard\noutro"),
        ("<main><h1>T</h1><p>lead</p><article>rest</article></main>", "T\nlead\nrest"),
        ("<div id=content>the whole text</div><article>tea</article>", "the whole text"),
        ("<article></article><div class=ad>buy</div>", ""),
        ("<a <b <c", "<a <b <c"),
        ("no tags &amp; one line", "no tags & one line"),
    ],
)
def test_layouts(page, want):
    assert H.main_text(H.parse(page)) == want


def test_deep_and_wide_pages():
    for page in ("<div>" * 100_000 + "x", "<div>" * 100_000 + "x" + "</div>" * 100_000, "<div><p>" * 20_000 + "x", "<p>x" + "<div></div>" * 50_000):
        assert H.main_text(H.parse(page)) == "x"
        tree = H.folded(H.parse(page))
        assert len(H.aligned(tree, H.read(H.written(tree))[0])) == len(tree)
    assert H.main_text(H.parse("<h2>a</h2><p>b</p>" * 20_000)).count("\n") == 39_999
    assert H.main_text(H.parse('<a "' * 50_000)) == '<a "' * 49_999 + '<a "'


def test_wrappers_decide_where_nothing_is_named(spark):
    """Pages of one host of the given table with all telling names taken away: what menus, adverts
    and footers are can only be seen by holding the pages against each other."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("url LIKE '%//blog.tionsh.example.com/%'")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert len(rows) > 200

    def renamed(html):
        for a, b in (("<nav>", "<div id=u1>"), ("</nav>", "</div>"), ('<div class="ad">', "<div class=u2>"), ("<article>", "<div id=u3>"), ("</article>", "</div>"), ("<footer>", "<div id=u4>"), ("</footer>", "</div>")):
            html = html.replace(a, b)
        return html

    want = {i: "\n".join(H.blocks(H.parse(re.search("(?s)<article>.*</article>", h)[0]))) for i, _, h in rows}
    got = {r.page_id: r.text for r in H.extract_main_text(table(spark, [(i, u, renamed(h)) for i, u, h in rows])).collect()}
    assert got == want
    plain = {i: "\n".join(H.blocks(H.parse(renamed(h)))) for i, _, h in rows}
    assert all(plain[i] != want[i] for i in want)  # nothing but the wrapper tells them apart


def brute_size(a, b):
    weight = H.alike(a, b)

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), (size := brute_size(x[0], y[0])) and size + best(x[1:], y[1:]))

    return weight and weight + best(a.children, b.children)


def test_tree_matching_against_recursion():
    import random

    rng = random.Random(8)

    def tree(depth):
        marks = frozenset(rng.sample(["m", "n"], rng.randint(0, 1)))
        slot = H.Slot(rng.choice(["div", "p", "ul"]), marks, False)
        slot.children = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return slot

    for _ in range(150):
        a, b = H.numbered(tree(3)), H.numbered(tree(3))
        pairs = H.aligned(a, b)
        assert sum(H.alike(x, y) for x, y in pairs) == brute_size(a[0], b[0])
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        assert H.matching(a[0], b[0], {}) == brute_size(a[0], b[0])
        for m in (H.merged([a, b]),):
            assert [s.number for s in m] == list(range(len(m)))
            assert H.written(H.read(H.written(m))[0]) == H.written(m)


def test_induction_against_exact_counts(spark):
    """A small host whose slots vary in known ways: the verdict of each slot by plain counting."""
    few = ["red offer", "blue offer"]
    page = "<body><div id=top>{top}</div><div id=c><h1>{h}</h1><p>{p}</p><div class=box>{few}</div><p>{q}</p></div><div id=end>{end}</div></body>"
    rows = []
    for k in range(60):
        text = f"word{k} " * 30
        rows.append((k, "http://one.example/x", page.format(top="Menu of the site", h=f"head {k}", p=text, few=few[k % 2], q=f"and {k}", end=f"short {k}")))
    rows += [(100 + k, u, h) for k, (_, u, h) in enumerate(rows[:20])]  # copies prove nothing
    got = {r.page_id: r.text for r in H.extract_main_text(table(spark, rows)).collect()}
    slots = {}
    for _, _, html in rows:
        parts = dict(zip(("top", "h", "p", "few", "q", "end"), re.findall(">([^<>]+)<", html)))
        for name, text in parts.items():
            slots.setdefault(name, {}).setdefault(text, set()).add(parts["p"])
    mains = len(slots["p"])
    fixed = {n for n, values in slots.items() if len(values) <= max(1, H.POOL * mains)}
    assert fixed == {"top", "few"}
    for i, _, html in rows:
        parts = dict(zip(("top", "h", "p", "few", "q", "end"), re.findall(">([^<>]+)<", html)))
        # the end varies, but stands beside the element that holds the text
        assert got[i] == "\n".join(parts[n].strip() for n in ("h", "p", "few", "q") if n not in fixed)


def page_texts(spark, rows):
    return {r.page_id: r.text for r in H.extract_main_text(table(spark, rows)).collect()}


def test_articles_keep_their_constant_parts(spark):
    """Headings, lead-ins and table heads that every page repeats belong to an article; a box that
    every page repeats is template, within an article and beside it."""
    page = (
        "<div id=m><a href=/>Home</a></div><h2>Summary</h2><article><h1>Title {k}</h1><h2>Summary</h2><p>text {k} {w}</p><h2>Details</h2><p>In short:</p><p>more {k} {w}</p>"
        "<table><tr><th>Name<th>Size<tr><td>n{k}<td>{k}</table><div class=box><p>Fixed words</p></div><p class=share>Share this</p></article><h2>Details</h2>"
    )
    rows = [(k, f"http://a/{k}", page.format(k=k, w="word " * k)) for k in range(40)]
    got = page_texts(spark, rows)
    for k in range(40):
        w = (" word" * k).strip()
        first, second = f"text {k} {w}".strip(), f"more {k} {w}".strip()
        assert got[k] == "\n".join([f"Title {k}", "Summary", first, "Details", "In short:", second, "Name", "Size", f"n{k}", str(k)])


@pytest.mark.parametrize("pages", [1, 40])
def test_lists_of_links_within_the_text(spark, pages):
    page = (
        "<div id=top><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></div><div id=c><h1>T {k}</h1><p>first {k} {w}</p><ul><li><a href=1>one {k}</a><li><a href=2>two {k}</a></ul>"
        "<p>last {k}</p><ul class=related><li><a href=3>else {k}</a></ul></div><div id=end><ul><li><a href=/x>Terms</a></ul></div>"
    )
    got = page_texts(spark, [(k, f"http://b/{k}", page.format(k=k, w="word " * (k + 9))) for k in range(pages)])
    for k in range(pages):
        assert got[k] == f"T {k}\nfirst {k}" + " word" * (k + 9) + f"\none {k}\ntwo {k}\nlast {k}"


@pytest.mark.parametrize("pages", [1, 2, 3, 4, 9])
@pytest.mark.parametrize("name", ["banner post", "widget", "header"])
def test_small_hosts_with_misleading_classes(spark, pages, name):
    page = "<div class=site>Logo</div><div class='ad'>Buy now</div><div class='{name}'><h1>T {k}</h1><p>the text of article {k} goes on {w}</p></div><div class=footer>Imprint</div>"
    got = page_texts(spark, [(k, f"http://c/{k}", page.format(k=k, name=name, w=f"and{k} " * 20)) for k in range(pages)])
    for k in range(pages):
        assert got[k] == f"T {k}\nthe text of article {k} goes on" + f" and{k}" * 20
