"""Vector searches against brute force, and main text of pages."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxbar.llm import html_wrapper, kmeans_tree, maxscore

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "c") for i in range(120)]
    rows += [(200 + i, [1.0, 0.5, 0.0, 0.0], "c") for i in range(150)]  # copies, queries among them
    rows += [(400, None, "c"), (401, [NAN, 1.0], "c"), (402, [INF, 1.0], "c"), (403, [0.0, 0.0, 0.0, 0.0], "c"), (None, [1.0] * 4, "c"), (500, [None, 1.0], "c")]
    rows += [(600, [2.0], "c"), (600, [2.0], "c"), (700, [], "c"), (800, [0.5, -0.25, 3.0, -7.0], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string").withColumn("rep", F.lit(1)).withColumn("ids", F.lit("x"))


def plain(rows, k, every, weigh, keep):
    vs = sorted({(r.vec_id, tuple(weigh(x) for x in r.embedding)) for r in rows if r.vec_id is not None and r.embedding is not None and None not in r.embedding and all(map(math.isfinite, r.embedding)) and keep(r.embedding)})
    out = {}
    for q, x in vs:
        if q % every == 0:
            out[q] = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vs if i != q)[:k]  # noqa: B905
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_exact_top_k(spark, odd_vectors):
    for df, every in ((odd_vectors, 50), (spark.read.parquet(f"{SF}/embeddings.parquet"), 50)):
        want = plain(df.collect(), 5, every, lambda x: math.floor(256 * float(x)), lambda v: True)
        assert by_query(maxscore.exact_top_k(df)) == want
        assert by_query(maxscore.exact_top_k(df, block=2, shard=16)) == want
    assert maxscore.exact_top_k(odd_vectors.limit(0)).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(0, [3e13, 1.0]), (1, [1.0, 2.0]), (2, [3e13, 5.0]), (3, [-3e13, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = by_query(maxscore.exact_top_k(df, every=50))[0]
    exact = lambda v: [math.floor(256 * x) for x in v]
    want = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(exact(rows[0][1]), exact(v), strict=True)))), i) for i, v in rows[1:])
    assert found == want


def test_nearest_neighbours_recall(spark, odd_vectors):
    for df in (spark.read.parquet(f"{SF}/embeddings.parquet"), odd_vectors):
        want = plain(df.collect(), 20, 20, float, any)
        found = by_query(kmeans_tree.nearest_neighbours(df, leaf_size=16, block=32 if df is odd_vectors else 8))
        assert found.keys() == want.keys() and all(len(found[q]) == len(want[q]) for q in want)
        hit = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
        assert hit >= 0.9 * sum(map(len, want.values()))
        for q, top in found.items():
            assert [s for s, _ in top] == pytest.approx(sorted(s for s, _ in top)) and q not in {i for _, i in top}
    few = kmeans_tree.nearest_neighbours(odd_vectors.where("vec_id < 8"))
    assert by_query(few).keys() == {0} and few.count() == 7
    assert kmeans_tree.nearest_neighbours(odd_vectors.limit(0)).count() == 0


def test_visits_follow_the_nearest_centres():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    tree = kmeans_tree.Tree.fit(x, 24)
    assert sorted(tree.visits(x[0])) == list(range(tree.leaves)) and (tree.leaf_of(x) < tree.leaves).all()


def test_registered_parameters_at_a_larger_size(spark, monkeypatch):
    """Recall against brute force, and that queries read only part of the leaves."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").unionByName(spark.read.parquet("/root/testdata/check_s/embeddings.parquet").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    kept = {}
    real = kmeans_tree.materialize
    monkeypatch.setattr(kmeans_tree, "materialize", lambda d, name: kept.setdefault(name, real(d, name)))
    found = by_query(kmeans_tree.nearest_neighbours(df))
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0][::5]
    scores = x[asked] @ x.T
    hit = total = 0
    for q, row in zip(asked, scores, strict=True):
        row[ids == ids[q]] = -np.inf
        least = np.sort(row)[-20]
        top = found[ids[q]]
        assert len(top) == 20
        hit += sum(-s >= least - 1e-9 for s, _ in top)
        total += 20
    leaves = kept["leaves"].select("leaf").distinct().count()
    read = np.mean([len(r.leaves) for r in kept["routed"].collect()])
    assert hit >= 0.9 * total and leaves > 100 and read < 0.7 * leaves


# Pages


def text_of(html):
    blocks = html_wrapper.Page(html).blocks
    return "\n".join(blocks[i][1] for i in html_wrapper.by_tags([b[2] for b in blocks]))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=/>x</a></nav><article><h1>T&eacute;</h1><p><b>one<br>two<p>three\n\tfour</p><ul><li>a<li>b</ul></article><footer>f</footer>", "Té\none two\nthree four\na\nb"),
        ("<div class='ad'>no</div><article>a<script>var t='</p>';</script>b<!-- c -->d<style>p{}</style></article>", "abd"),
        ("<article><p>x</p><div class=\"comments\"><p>no</p></div><aside>no</aside><form>no</form><div class=cookie-notice>no</div></article>", "x"),
        ("<header><h1>Site</h1></header><article><header><h2>Head</h2><span>by me</span></header><p>&lt;b&gt; &#8364; &am</p></article>", "Head\n<b> € &am"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<p>own words here</p><ul><li><a>link</a></ul><div style='display:none'>no</div>", "own words here"),
        ("<article><p class='x>broken</p><p>y</p></article>", "broken\ny"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<title>no</title><article><p>\xa0 a \xa0</p><p> </p></article>", "a"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


def test_raw_elements_end_where_the_page_says():
    html = "<TITLE>İstanbul</Title><article><p>İlk</p><script>x='İ'</SCRIPT><p>son</p></article>"
    assert text_of(html) == "İlk\nson"
    assert text_of("<script></ſcript>no</script><p>yes</p>") == "yes"


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert text_of("<article>" + "<p>w" * 5000 + "</article>").count("w") == 5000
    text_of("<" * 50_000), text_of("<a " + '"' * 50_001)


def test_tree_matching_aligns_slots():
    shape = lambda h: html_wrapper.Page(h).shape()[0]
    a, b = shape("<div><h1>x</h1><p>y</p></div>"), shape("<div><h1>x</h1><ul><li>n</ul><p>y</p><p>z</p></div>")
    merged = html_wrapper.Template(html_wrapper.induce([a, b]))
    assert sorted(merged.keys) == sorted(["", "div", "h1", "ul", "li", "p"])
    assert len(merged.match(html_wrapper.Template(b))) == 6


def test_template_texts_go(spark):
    page = "<body><div><h1>Title {0}</h1><p>Body {0} words</p><p class=s>Read our terms of use</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)] + [(9, "http://other.example/", page.format(9)), (10, None, None)]
    rows += [(20 + i, "http://copies.example/", page.format("same")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("body", F.lit(2)).withColumn("text", F.lit(3))
    for fan in (32, 1 + 1):
        found = {r.page_id: r for r in html_wrapper.extract_main_text(df, fan=fan).collect()}
        assert found[3].text == "Title 3\nBody 3 words" and found[3].n_template == 1 and found[3].by_template and not found[9].by_template
        assert found[9].text.endswith("terms of use") and found[22].text.endswith("terms of use") and found[10].text == "" and found[10].n_chars == 0
    assert html_wrapper.extract_main_text(df.limit(0)).count() == 0


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_wrapper.extract_main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        import html as entities

        blocks = [" ".join(entities.unescape(re.sub(r"<(br|/?b)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_varying_slots_choose_the_content(spark):
    """Hosts without <article> and without names that tell: what varies most is the content, wherever it lies."""
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    page = "<body><div class=x1><p>{ad}</p></div><div class=x2><p>Welcome to the site</p><table><tr><td><div><h2>{title}</h2>{body}</div></td></tr></table></div><div class=x3><p>{ad}</p><p>All rights reserved</p></div></body>"
    rows, want = [], {}
    for i in range(12):
        title, body = words(5), [words(40) for _ in range(int(rng.integers(1, 5)))]
        rows.append((i, "http://plain.example/", page.format(ad=words(3), title=title, body="".join(f"<p id=p{i}-{k}>{b}</p>" for k, b in enumerate(body)))))
        want[i] = "\n".join([title, *body])
    rows.append((50, "http://plain.example/odd", "<body><section><p>another layout altogether</p></section></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in html_wrapper.extract_main_text(df).collect()}
    for i, text in want.items():
        assert found[i].text == text and found[i].n_template == 4 and found[i].by_template
    assert found[50].text == "another layout altogether"
    # Without the template the tags find all of it.
    alone = html_wrapper.extract_main_text(df, min_pages=1000).where("page_id = 3").first()
    assert "Welcome" in alone.text and not alone.by_template


def test_template_is_at_work_on_the_pages(spark):
    found = html_wrapper.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    own = [r for r in found if r.by_template]
    assert len(own) > 0.2 * len(found) and all(r.n_template > 0 and r.text for r in own)


def test_subject_words_in_class_names_stay():
    text = "<article><div class='popular-science'><p>one</p></div><div id=learn-more-text><p>two</p></div><div class='popular-posts'><p>no</p></div><div class='ad-slot-3'>no</div><p class=commentList>no</p></article>"
    assert text_of(text) == "one\ntwo"


def test_many_siblings_and_deep_nesting_stay_linear():
    import time

    began = time.perf_counter()
    rows = "".join(f"<tr id=r{i} class=c{i % 5000}><td>x{i}</td></tr>" for i in range(20_000))
    one, two = (html_wrapper.Page(f"<article><table>{r}</table></article>").shape()[0] for r in (rows, rows[len("<tr id=r0 class=c0><td>x0</td></tr>") :]))
    assert len(html_wrapper.Template(one).match(html_wrapper.Template(two))) > 20_000
    assert text_of("<div>" * 60_000 + "x" + "</div>" * 60_000) == "x"
    assert text_of("<article>" + "<li><div>" * 30_000 + "y").count("y") == 1
    assert time.perf_counter() - began < 20


def test_greedy_alignment_keeps_order():
    shape = lambda n: "-1 \n" + "\n".join(f"0 k{i % 97}" for i in n)
    one, two = html_wrapper.Template(shape(range(3, 600))), html_wrapper.Template(shape(range(50, 700)))
    pairs = one.match(two)
    order = [pairs[y] for y in two.children[0] if y in pairs]
    assert order == sorted(order) and len(order) > 500 and all(one.keys[x] == two.keys[y] for y, x in pairs.items())
