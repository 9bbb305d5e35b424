"""Neighbour search and page extraction against brute force."""

import html.parser
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import ann, html_text

VECTORS = "vec_id long, embedding array<float>, label int, q string, node string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q", "n", "v") for i, v in rows], VECTORS)


def exact(rows, k, step):
    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and fine(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % step == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] * 8) for i in range(60)]  # copies
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0, 2.0]), (None, [1.0] * 8)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 5 == 0, 10).collect()
    want = exact([r for r in rows if r[0] != 306], 10, 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    for q, rows_ in found.items():
        assert [r for r, _, _ in rows_] == list(range(1, 11))
        assert [s for _, _, s in rows_] == pytest.approx([s for _, s in want[q]], abs=1e-6)
        assert [v for _, v, _ in rows_] == [v for v, _ in want[q]]


def test_each_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(4, 6, 6, 3)[i % 4]).astype("<f4").tolist()) for i in range(200)]
    found = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 5 == 0, 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = {}
    for n in (3, 4, 6):
        want |= exact([r for r in rows if len(r[1]) == n], 7, 5)
    assert {q: [v for _, v in sorted(near)] for q, near in found.items()} == {q: [v for v, _ in near] for q, near in want.items()}


def test_few_and_none(spark):
    got = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5)]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).select("query_id", "vec_id").collect()
    want = exact([(r["vec_id"], list(r["embedding"])) for r in df.select("vec_id", "embedding").collect()], 20, 20)
    pairs = {(r["query_id"], r["vec_id"]) for r in got}
    hits = sum((q, v) in pairs for q, near in want.items() for v, _ in near)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_repeated_ids_stand_for_their_least_vector(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).astype("<f4").tolist()) for i in range(30)]
    again = [(i, [x + 1.0 for x in v]) for i, v in rows[:5]] + rows[5:8]
    got = ann.nearest(vectors(spark, rows + again), F.col("vec_id") % 5 == 0, 4).orderBy("query_id", "rank").collect()
    want = exact(rows, 4, 5)
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, v) for q in sorted(want) for v, _ in want[q]]


def test_recall_beyond_the_blocks(spark):
    """Blocks of about 3 % of the nodes: the descent has to find the rest."""
    rng = np.random.default_rng(1)
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], dtype=np.float32)
    x = np.concatenate([x, x])
    x = (x + rng.normal(size=x.shape) * x.std() * 0.5).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, block=128).select("query_id", "vec_id").collect()
    want = exact(rows, 20, 100)
    pairs = {(r["query_id"], r["vec_id"]) for r in got}
    assert sum((q, v) in pairs for q, near in want.items() for v, _ in near) / sum(map(len, want.values())) >= 0.9


def test_external_queries_use_entry_nodes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8)).astype("<f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    packed = spark.createDataFrame([(i, bytearray(np.r_[v, np.float32(0)].astype("<f4").tobytes())) for i, v in enumerate(x)], "node long, vec binary").cache()
    edges = ann.neighbour_graph(packed, 500, k=12, rounds=4)
    asked = rng.normal(size=(10, 8)).astype("<f4")
    queries = spark.createDataFrame([(i, bytearray(np.r_[v, np.float32(0)].astype("<f4").tobytes()), None) for i, v in enumerate(asked)], "q long, qvec binary, node long")
    found = ann.graph_search(queries, packed, edges, 500, beam=64, width=32).collect()
    best = {q: max((r["s"], r["node"]) for r in found if r["q"] == q)[1] for q in range(10)}
    assert sum(best[q] == int(np.argmax(x @ asked[q])) for q in range(10)) >= 9


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>no</title>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("  plain   words ", "plain words"),
    (page("<nav><ul><li>menu</li></ul></nav><article><h1>Title</h1><p>One &amp; two<br>three</p><p>four</p></article><footer>foot</footer>"), "Title\n\nOne & two three\n\nfour"),
    (page("<article><p><b>Open <br><p>Next<p>Last</article><div class='ad'>buy</div>"), "Open\n\nNext\n\nLast"),
    (page("<main><header>h</header><p>text</p><aside>side</aside><form>f<input></form><section class='comments'><p>me too</p></section><div id=\"cookie-notice\">ok?</div></main>"), "text"),
    (page("<article>a<script>var t='</p>';</script>b<!-- <p>x</p> --><style>p{}</style>c</article>"), "abc"),
    (page("<div class='shadow'>kept</div><div class='site-header'>gone</div>"), "kept"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    (page("<article><p>a&nbsp;b &lt;i&gt; &#233;&eacute;</p></article>"), "a b <i> éé"),
]


def kept(found):
    """Main blocks if there are any, else loose ones."""
    return "\n\n".join([t for kind, t in found if kind == html_text.MAIN_TEXT] or [t for kind, t in found if kind == html_text.LOOSE])


@pytest.mark.parametrize("source,want", CASES)
def test_blocks(source, want):
    found = html_text.blocks(source or "")
    assert kept(found) == want


MARKED = [
    ("<html class='no-sidebar search'><body class='single has-sidebar search'><main class='search share-enabled'><p>text</p></main></body></html>", "text"),
    ("<body><div class='sidebar'><div class='no-sidebar'><article class='related'>x</article><article>text</article></div></div></body>", "x\n\ntext"),
    ("<article><h2 id='social-impact'>One</h2><h2 class='social'>Two</h2><section id='related-work'>three</section><p data-id='ad' title=\"class='ad'\">four</p></article>", "One\n\nTwo\n\nthree\n\nfour"),
    ("<article>text<section class='comments'><article>me too</article></section><ol class='comment-list comments'><li><article class='comment'>no</article></ol></article>", "text"),
    ("<div class='search'><div role='main' class='search'>text</div><div role='navigation'>gone</div></div>", "text"),
    ("<article><p class='ad'><b>x<p>text<p class='ad'><a>y<h2>more</h2><p class='ad'><i>z<div>rest</div></article>", "text\n\nmore\n\nrest"),
    ("<article><ul><li class='ad'><b>x<li>one<li class='ad'>y<ul><li>z</ul></ul><table><tr><td class='ad'><b>x<td>two<tr><td>three</table><dl><dt class='ad'>x<dd>four</dl></article>", "one\n\ntwo\n\nthree\n\nfour"),
    ("<head><title>no</title><body><p>text <span class='ad-1'>x</span> after", "text\n\nafter"),
]


@pytest.mark.parametrize("source,want", MARKED)
def test_marks_hide_nothing_of_the_main_text(source, want):
    found = html_text.blocks(source)
    assert kept(found) == want


CONTRACT = [
    ("<form id=aspnetForm><div class='ad'>buy</div><main><p>text</p></main></form>", "text"),
    ("<article><header><h1>Title</h1><p>lede</p></header><p>text</p><header>by someone</header></article>", "Title\n\nlede\n\ntext"),
    ("<header><h1>Site</h1></header><article><p>text</p></article>", "text"),
    *[(f"<article><p>text</p><{tag} class='{name}'><p>gone</p></{tag}></article>", "text") for tag, name in (
        ("article", "comment"), ("div", "comment-body"), ("div", "comments-area"), ("ol", "commentlist"), ("div", "ad-container"), ("ins", "adsbygoogle"), ("div", "sponsored-content"),
        ("div", "social-share-buttons"), ("div", "newsletter-signup"), ("div", "related-posts"), ("section", "comments"), ("div", "cookie-notice"), ("section", "related"), ("div", "comment-4711"))],
    *[(f"<article><p>text</p><{tag}>stays</{end}></article>", "text\n\nstays") for tag, end in (
        ("section id='related'", "section"), ("div id='search'", "div"), ("p id='form'", "p"), ("p class='alert'", "p"), ("li class='reply'", "li"), ("div class='has-sidebar'", "div"), ("div class='social-impact'", "div"), ("div class='no-comments'", "div"))],
    ("<article><section id='comments'>gone</section><p>text</article>", "text"),
    ("<p title=don't>Hello <b>it's</b> done</p>", "Hello it's done"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p></article>", "Let x=2 be."),
    ("<article><p data-x='a>b' class=\"c>d\">a < b and 1<2</p></article>", "a < b and 1<2"),
    ("<article><p>before <a href=\"never closed>link</a> and after</p></article>", "before link and after"),
    ("<article><p>a <em class='ad'>b</em> c<!-- open", "a\n\nc"),
    ("<article>one<script>x</scripty></script >two<style>y</style/>three</article>", "onetwothree"),
]


@pytest.mark.parametrize("source,want", CONTRACT)
def test_main_text_by_contract(source, want):
    assert kept(html_text.blocks(source)) == want


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"x ", "<a href=\"x> text \" ", "<div>", "<div><li></li>", "<!--", "<!", "<script>", "</script ", "<a =", "</x>", "<b><p>", "<td><b>", "<article>", "<header><h1>", "<table><p>", "<p a='", "<", "<form><li>", "</div><div>"])
@pytest.mark.parametrize("start", ["", "<p><table><td>", "<li><ul>", "<script>"])
def test_malformed_pages_take_time_in_proportion(piece, start):
    began = time.process_time()
    html_text.blocks(start + piece * (250_000 // len(piece)) + ">")
    assert time.process_time() - began < 2


class Reader(html.parser.HTMLParser):
    """Text by the given pages' own rules, read by Python's parser: an article's paragraphs and headings, and nothing else."""

    def __init__(self):
        super().__init__()
        self.inside, self.texts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.texts.append("")
        elif tag == "br":
            self.texts[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.texts.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.texts[-1] += data

    def text(self):
        return "\n\n".join(filter(None, (" ".join(t.split()) for t in self.texts)))


def test_exact_text_of_every_given_page(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(rows).collect()}
    for r in rows.collect():
        reader = Reader()
        reader.feed(r["html"] or "")
        reader.close()
        assert got[r["page_id"]] == reader.text()


def test_the_array_decides_on_telltale_text_of_articles(spark):
    shared = "our partners bring you these fine offers every day"
    rows = [(i, f"http://h.example/{i}", f"<article><p>text {i}</p><div class='sponsored-by-us'>{shared if i < 3 else f'own words number {i} in a box of that class'}</div></article>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got == {i: f"text {i}" if i < 3 else f"text {i}\n\nown words number {i} in a box of that class" for i in range(5)}


def brute_cover(streams, run, pages):
    where = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            where.setdefault(tuple(s[i : i + run]), set()).add(p)
    out = []
    for s in streams:
        flags = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(where[tuple(s[i : i + run])]) >= pages:
                flags[i : i + run] = [True] * run
        out.append(flags)
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        streams = [rng.integers(0, 4, rng.integers(0, 30)).tolist() for _ in range(rng.integers(0, 6))]
        for run, pages in ((2, 2), (3, 2), (4, 3)):
            assert [c.tolist() for c in html_text.repeated_cover(streams, run, pages)] == brute_cover(streams, run, pages)
    x = rng.integers(0, 3, 200)
    order, rank = html_text.suffix_array(x)
    assert order.tolist() == sorted(range(200), key=lambda i: x[i:].tolist()) and rank[order].tolist() == list(range(200))


def test_host_boilerplate_goes_unless_vouched_for(spark):
    shared = "all pages of this host repeat these very words here"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{shared}</div><div>unique number {i} of the pages</div></body>") for i in range(5)]
    rows += [(10 + i, f"http://h.example/a{i}", f"<body><article><p>{shared}</p></article></body>") for i in range(3)]
    rows += [(20, None, None), (20, None, None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, loose string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert all(got[i] == f"unique number {i} of the pages" for i in range(5))
    assert all(got[10 + i] == shared for i in range(3)) and got[20] == ""
    assert html_text.main_text(pages).count() == len(rows) and html_text.main_text(pages.limit(0)).count() == 0


def test_loose_text_beside_an_article_stays_in_page_order(spark):
    shared = "all pages of this host repeat these very words here"
    own = {i: [" ".join(f"{w}{i}" for w in words.split()) for words in ("the long main text that no element vouches for", "a teaser", "some more text after the teaser")] for i in range(4)}
    rows = [(i, f"http://h.example/{i}", page(f"<div>{t}</div><div>{shared}</div><article>{card}</article><div>{more}</div>")) for i, (t, card, more) in own.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got == {i: "\n\n".join(texts) for i, texts in own.items()}


def test_boilerplate_is_counted_over_the_whole_host(spark):
    def body(own, shared):
        return f"<div>{shared}</div><div>" + " ".join(f"w{own}x{k}" for k in range(12)) + "</div>"

    rare, twice = "these very words occur on three of all the pages", "but those here lie on just two pages and stay"
    shared = {7: rare, 300: rare, 555: rare, 20: twice, 400: twice}
    rows = [(i, f"http://h.example/{i}", body(i, shared.get(i, f"only{i}"))) for i in range(600)]
    rows += [(1000, "http://other.example/", body(1000, rare)), (1001, "http://other.example/", body(1001, twice))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (256, 16, 1):
        got = {r["page_id"]: r["text"] for r in html_text.main_text(pages, group_pages=size).collect()}
        assert len(got) == 602 and all(got[i].startswith(f"w{i}x0 ") for i in (7, 300, 555)), size
        assert all(got[i].startswith(twice) for i in (20, 400, 1001)) and got[1000].startswith(rare), size
        assert got[8].startswith("only8\n\nw8x0 "), size


@pytest.mark.parametrize("common,own", [(20, 10), (19, 11), (8, 40), (100, 1)])
def test_only_repeated_runs_of_a_block_go(spark, common, own):
    shared = " ".join(f"s{k}" for k in range(common))
    rows = [(i, "http://h.example/", " ".join(f"a{i}x{k}" for k in range(own)), " ".join(f"b{i}x{k}" for k in range(own))) for i in range(4)]
    pages = spark.createDataFrame([(i, url, f"{a} <b>{shared}</b><br> {b}") for i, url, a, b in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()} == {i: f"{a} {b}" for i, _, a, b in rows}


def test_runs_across_borders():
    known = {}

    def left(blocks, *runs):
        hashes = np.sort(np.concatenate([html_text.run_hashes(r.split(" "), 4, known) for r in runs]))
        return html_text.unique_text(blocks, [html_text.LOOSE] * len(blocks), hashes, 4, known)

    assert left(["home", "about us", "contact", "own a b c"], "home about us contact") == "own a b c"  # whole blocks
    assert left(["x y home", "about us", "contact z"], "home about us contact") == "x y home\n\ncontact z"  # parts stay
    assert left(["a b c", "d e", "f g h"], "a b c d", "e f g h") == "d e"  # two runs that each cover half of a block
    assert left(["a b c d e", "f g"], "a b c d e f") == "f g"
    assert left(["f a b c d e g"], "a b c d e") == "f g"


def test_every_page_of_the_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = html_text.main_text(pages)
    assert got.count() == pages.count() and got.where("text = '' or text like '%<p>%'").count() == 0


def brute_text(pages, run, least):
    """Whole texts: per host, runs on ``least`` distinct pages go from loose blocks."""
    found = {}
    for i, url, source in pages:
        found[i] = ((url or "").split("/")[2] if url else "", html_text.blocks(source or ""))

    def stream(b):
        return [w for kind, t in b if kind != html_text.MAIN_TEXT for w in t.split(" ")]

    where = {}
    for host, b in found.values():
        s, own = stream(b), repr(b)
        for i in range(len(s) - run + 1):
            where.setdefault((host, tuple(s[i : i + run])), set()).add(own)
    out = {}
    for page_id, (host, b) in found.items():
        s = stream(b)
        starts = {i for i in range(len(s) - run + 1) if len(where[host, tuple(s[i : i + run])]) >= least}
        stretches = []  # first and last of neighbouring starts
        for i in sorted(starts):
            if stretches and i == stretches[-1][1] + 1:
                stretches[-1][1] = i
            else:
                stretches.append([i, i])
        at, texts = 0, []
        for kind, t in b:
            words = t.split(" ")
            if kind == html_text.MAIN_TEXT:
                texts.append(t)
                continue
            n = len(words)
            if kind == html_text.LOOSE and not any(a <= at and z + run >= at + n for a, z in stretches):
                inside = {j for i in starts if at <= i and i + run <= at + n for j in range(i, i + run)}
                left = [w for j, w in enumerate(words, at) if j not in inside]
                if left:
                    texts.append(" ".join(left))
            at += n
        out[page_id] = "\n\n".join(texts)
    return out


def test_whole_pages_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(6)]
    shared = [" ".join(rng.choice(words, rng.integers(4, 12))) for _ in range(4)]
    rows = []
    for i in range(60):
        body = ""
        for _ in range(rng.integers(0, 6)):
            text = shared[rng.integers(0, 4)] if rng.random() < 0.5 else " ".join(rng.choice([*words, f"own{i}"], rng.integers(1, 9)))
            body += rng.choice(["<div>{}</div>", "<p>{}", "<nav>{}</nav>", "<article>{}</article>", "{}<br>"]).format(text)
        rows.append((i, [None, "http://a.example/x", "https://b.example/"][i % 3], body or None))
    rows += [(100 + i, url, body) for i, url, body in rows[:20]]  # the same pages again, on the same hosts
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_text(rows, 4, 3)
    for size in (256, 5):
        assert {r["page_id"]: r["text"] for r in html_text.main_text(pages, 4, 3, size).collect()} == want


def test_repeated_rows_of_a_page_are_one_page(spark):
    text = "a page of which the table holds three rows and no other"
    pages = spark.createDataFrame([(i, "http://h.example/p", f"<div>{text}</div>") for i in (1, 2, 3, 3)], "page_id long, url string, html string")
    assert [(r["page_id"], r["text"]) for r in html_text.main_text(pages).orderBy("page_id").collect()] == [(i, text) for i in (1, 2, 3, 3)]


def test_menus_of_other_pages_count(spark):
    menu = "home news sports weather about contact help imprint"
    rows = [(i, "http://h.example/p", f"<nav>{menu}</nav><article>text {i}</article>") for i in range(3)] + [(9, "http://h.example/q", f"<div>{menu}</div><div>own words</div>")]
    pages = spark.createDataFrame(rows[1:] + rows[:1], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages, min_pages=2).collect()} == {0: "text 0", 1: "text 1", 2: "text 2", 9: "own words"}


def test_very_long_pages(spark):
    body = " ".join(f"x{k}" for k in range(200_000))
    pages = spark.createDataFrame([(1, "http://h.example/", f"<div>{body}</div>"), (2, "http://h.example/", f"<article>{body}</article>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()} == {1: body, 2: body}
