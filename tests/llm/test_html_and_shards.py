import duckdb
import pytest
from pyspark.sql import functions as F

from isoframe.llm import sharding, style_tree

PAGE = """<html><head><title>T</title></head><body><header>Site</header><nav>menu</nav><div class="cookie-notice">We use</div>
<main><article><h1>Head</h1><p>One &amp; two<br>three <a href=x>link</a><p><b>Open<br><aside>side</aside><div class="ad-box">Buy</div>
<ul><li>a<li>b</ul><form><p>Name</p></form><table><tr><td>x<td>y</table><p>Last<script>x</script> words &lt;b&gt;</p>
<div id="comments"><p>Reader</p></div></article></main><footer>f</footer><p"""


def test_declared_parts():
    assert style_tree.text_of(PAGE, "h", {}) == "\n\n".join(["Head", "One & two three link", "Open", "a", "b", "x", "y", "Last words <b>"])
    assert style_tree.text_of("a < b & c", "", {}) == "a < b & c"


def test_repeated_branches_go(spark):
    page = "<div class=top><p>Welcome to our site</p></div><div class=body>{}</div><div class=end><span>All rights</span></div>"
    rows = [(k, "http://h.example/a", page.format("".join(f"<p>Story {k} part {j}</p>" for j in range(k % 5 + 1)))) for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in style_tree.extract(pages).collect():
        assert r.text == "\n\n".join(f"Story {r.page_id} part {j}" for j in range(r.page_id % 5 + 1))
        assert r.n_chars == len(r.text)


def texts_of(spark, pages: list[str]) -> list[str]:
    rows = [(k, "http://h.example/a", page) for k, page in enumerate(pages)]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    return [r.text for r in got.orderBy("page_id").collect()]


def test_repeated_blocks_in_articles_go(spark):
    page = "<article><h1>Title {k}</h1><div class=box><p>Thanks for reading</p></div><section>Share this{body}</section><div class=end>Our promise</div></article>"
    got = texts_of(spark, [page.format(k=k, body=f"<p>Story {k} one</p><p>Story {k} two</p>") for k in range(20)])
    assert got == [f"Title {k}\n\nStory {k} one\n\nStory {k} two" for k in range(20)]


def test_words_around_an_article_do_not_cost_it(spark):
    page = "<div class=wrap>Welcome to our site<div class=in>Today<article>Reading time<p>Story {k}</p></article></div>The end</div>"
    assert texts_of(spark, [page.format(k=k) for k in range(20)]) == [f"Story {k}" for k in range(20)]


def test_copies_of_an_article_stay_whole(spark):
    page = "<div class=count>{k} readers</div><article><h1>Title</h1><p>Story</p></article>"
    assert texts_of(spark, [page.format(k=k) for k in range(5)]) == ["Title\n\nStory"] * 5


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a/b", "<p>x"), (3, "http://a/b", "<p>x"), (3, "http://a/b", "<p>x"), (4, "u", "<div>" * 300 + "deep")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, key string, low string")
    got = style_tree.extract(pages).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} | {None: "x"} == {1: "", 2: "", None: "x", 3: "x", 4: "deep"}
    assert style_tree.extract(pages.where("page_id > 99")).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body class='has-sidebar no-comments'><article>one", "one"),
        ("<article class='post comment-enabled'>one</article>", "one"),
        ("<div class='content header-fixed'>one</div>", "one"),
        ("<article>a<div class='site-header'>b</div><div class=adBox>c</div><p id=comments-2>d</p>e</article>", "a\n\ne"),
        ("<article><p class=it's>Hello there don't go</p>", "Hello there don't go"),
        ("<article><p title=\"a>b\" class='x>y'>in</p><p data-class=nav>out", "in\n\nout"),
        ("<article><p>a</p><select><option>1</select>b<select><option>2<p>rest</article>", "a\n\nb2\n\nrest"),
        ("<article>a<script>if (a</b) '</p>'</script>b<svg/>c<style>x", "abc"),
        ("<article>a<p =x = y>b</article></section></section>c", "a\n\nb"),
        ("<div>" * 10_000 + "deep" + "</div></p>" * 10_000 + "<p>end", "deep\n\nend"),
        ("<article>" + "<div>" * 10_000 + "<p>deep", "deep"),
        ("<a " * 50_000 + "x", ""),
    ],
)
def test_markup_as_browsers_read_it(html, want):
    assert style_tree.text_of(html, "h", {}) == want


def site():
    """Undeclared pages, and articles with undeclared blocks that the host repeats."""
    story = lambda k, j: f"<p>Story {k} has part {j} of its own</p>"
    body = lambda k: "".join(story(k, j) for j in range(k % 4 + 1))
    plain = "<div class=x1><p>Home</p><p>News</p></div><div class=y>{}</div><div class=z><i>All rights</i></div>"
    framed = "<div class=q>top</div><article><h1>Title {}</h1>{}<div class=k><span>Read more on our site</span></div></article>"
    return [("http://a/1", plain.format(body(k))) for k in range(12)] + [("http://b/1", framed.format(k, body(k))) for k in range(12)]


def brute_importance(pages):
    """Presentation and content entropy of each node of the sites' trees, counted page by page."""
    import math
    from collections import Counter

    seen = {}
    for url, html in dict.fromkeys(pages):
        for node in style_tree.below(style_tree.parse(html, style_tree.host_of(url))):
            about = seen.setdefault(node.path, {}).setdefault(html, (set(), set()))
            about[0].add("|".join("#" if isinstance(c, str) else c.name for c in node.children))
            about[1].update(c for c in node.children if isinstance(c, str))
    out = {}
    for path, of_page in seen.items():
        m = len(of_page)
        if m < 2:
            out[path] = 1.0
            continue
        shapes = Counter(frozenset(s) for s, _ in of_page.values())
        presentation = -sum(n / m * math.log(n / m, m) for n in shapes.values())
        texts = Counter(t for _, own in of_page.values() for t in own)
        total = sum(texts.values())
        content = 1 - sum(n * math.log(n) for n in texts.values()) / (total * math.log(m)) if texts else 1.0
        out[path] = (1 - style_tree.GAMMA) * presentation + style_tree.GAMMA * content
    return out


def test_importance_matches_brute_force_and_decides(spark):
    pages = site()
    rows = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    want = brute_importance(pages)
    _, found = style_tree.node_importance(rows.selectExpr("page_id as key", "url", "html"), "url", "html")
    got = {r.node: r.importance for r in found.collect()}
    assert got == {style_tree.signed(k): pytest.approx(v, abs=1e-9) for k, v in want.items()}
    texts = {r.page_id: r.text for r in style_tree.extract(rows).collect()}
    ignored = [style_tree.text_of(h, style_tree.host_of(u), {}) for u, h in pages]
    low = {style_tree.signed(k): v for k, v in want.items()}
    assert texts == {k: style_tree.text_of(h, style_tree.host_of(u), low) for k, (u, h) in enumerate(pages)}
    assert all(texts[k] != ignored[k] for k in range(24))
    assert not any(x in t for t in texts.values() for x in ("Home", "All rights", "Read more")) and all("part 0 of its own" in t for t in texts.values())


SIZES = dict(small=1 << 14, fan=4, target=1 << 18, arrival_docs=64, segment=4)


def test_layout_matches_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = sharding.compacted(spark.read.parquet(path), **SIZES).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = con.execute(sharding.sql(**SIZES)).df()
    key = list(want.columns)
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
    assert (got.version == 2).any() and got.run.nunique() > 3


def test_versions_and_conflicts(spark, odd_docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", **SIZES)
    assert store.append(odd_docs) == 1 and store.append(odd_docs.where("doc_id > 5")) == 2
    n = store.read(2).count()
    assert store.read(1).count() == odd_docs.count() and n == odd_docs.count() + odd_docs.where("doc_id > 5").count()
    last = store.compact()
    assert store.read(last).count() == n and store.read(1).count() == odd_docs.count()
    assert odd_docs.columns == store.read(last).columns
    with pytest.raises(sharding.CommitConflict):
        store.commit(store.manifest(), last)
    assert store.versions() == list(range(1, last + 1))


def test_any_names_ids_and_schemas(spark, odd_docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", **SIZES)
    wide = [(1 << 62, "a"), ((1 << 63) - 1, "b"), (-(1 << 63), "c"), (None, "d"), (5, None), (5, "x" * 40_000)]
    docs = spark.createDataFrame(wide, "doc_id bigint, text string")
    for name in ("run", "shard_bytes", "shard_rows", "row", "arrival", "isoframe_version", "isoframe_arrival", "target_run"):
        docs = docs.withColumn(name, F.lit(name))
    store.append(docs)
    store.append(docs.drop("run").withColumn("more", F.lit(1)))
    store.append(docs.where("doc_id = 5"))
    last = store.compact()
    rows = store.read(last).collect()
    assert len(rows) == 14 and {r.target_run for r in rows} == {"target_run"} and sum(r.run is None for r in rows) == 6
    assert sorted(str(r.doc_id) for r in store.read(1).collect()) == sorted(str(i) for i, _ in wide)
    assert store.vacuum() > 0 and store.versions() == [last] and store.read().count() == 14
    assert store.vacuum() == 0


def test_sparse_ids_share_arrivals(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", **SIZES)
    ids = spark.range(2000).select((F.xxhash64("id")).alias("doc_id"), F.lit("text").alias("text"))
    store.append(ids)
    assert store.manifest().count() < 80 and store.read().count() == 2000


def test_empty_table(no_docs):
    assert sharding.compacted(no_docs).count() == 0
