"""Search, archives, page text and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hamming_topk as ham
from quarry.llm import html_text, oracle, queries, warc


def sign_code(vector, bits=64):
    """The signs of a vector as a string of 0 and 1."""
    return "".join("1" if x is not None and x > 0 else "0" for x in [*vector, *[0.0] * bits][:bits])


def brute_topk(rows, k, bits=64):
    codes = [(i, int(sign_code(v, bits), 2)) for i, v in rows if v is not None]
    want = {}
    for q, qc in set(codes):
        if q is not None and q % 100 == 0:
            near = sorted(((qc ^ c).bit_count(), i is None, i or 0) for i, c in codes)[:k]
            want.setdefault(q, []).append([(d, None if none else i) for d, none, i in near])
    return {q: sorted(v) for q, v in want.items()}


def found_topk(df, k, bits=64):
    got = {}
    for r in sorted(ham.hamming_topk(df, F.col("vec_id") % 100 == 0, k=k, bits=bits).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    return {q: [v] for q, v in got.items()}


@pytest.mark.parametrize(("k", "bits"), [(10, 64), (3, 40), (2, 96)])
def test_hamming_topk(spark, k, bits):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, bits)).astype(np.float32)
    vectors = [base[rng.integers(40)] * rng.choice([-1, 1, 1, 1, 1, 1, 1], bits) for _ in range(400)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(500, None), (600, []), (None, [1.0] * 64), (7, [1.0] * 64), (7, [1.0] * 64), (700, [float("nan"), None] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found_topk(df, k, bits) == brute_topk(rows, k, bits)
    assert ham.hamming_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hamming_topk_with_copies_and_ties(spark):
    """A third of the rows share a code, many tie at the k-th distance, and few rows are all returned."""
    rows = [(i, [1.0] * 64) for i in range(200)] + [(1000 + i, [1.0] * i + [-1.0] + [1.0] * (63 - i)) for i in range(64)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found_topk(df, 10) == brute_topk(rows, 10)
    assert found_topk(df.where("vec_id = 100 OR vec_id > 1060"), 10) == brute_topk([r for r in rows if r[0] == 100 or r[0] > 1060], 10)


def test_hamming_rounds_leave_far_rows_alone(spark):
    """On clustered codes the rounds end before most rows are verified; no round takes all rows."""
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 1 << 62, 200)
    codes = [int(h) ^ sum(1 << int(b) for b in rng.integers(0, 62, 2)) for h in np.repeat(heads, 50)]
    codes = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "vec_id long, w0 long")
    asked = codes.where("vec_id % 1000 = 0").select(F.col("w0").alias("qw0"), F.lit(None).cast("int").alias("kth"))
    met = ham._met(asked, ham._posted(codes, ["w0"], 4), 0, 2, ["w0"], 4)
    close = met.where("distance <= 4").count()
    assert close >= 10 * 50 and met.count() < 0.2 * 10 * 10000


def pages(spark):
    copy = "<p>" + "same " * 40 + "</p>"
    rows = [(5, "http://a/é\n", copy), (3, None, copy), (9, "u", copy), (None, "v", copy), (1, "w", "short"), (2, "w", "short"), (4, "x", None), (6, "y", ""), (-7, "z", "é" * 80), (8, "z", "é" * 80), (11, "big", "b" * 300000), (3, "again", copy)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    df = pages(spark)
    archives = warc.write_archives(df, archive_bytes=400)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=repr)
    want = []
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    for i, p in rows:
        ids = [j for j, q in rows if q == p and j is not None] if len(p) >= 100 else []
        lead = min(ids, default=None)
        revisit = lead is not None and i != lead
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    assert got == sorted(want, key=repr)
    for a in archives.collect():
        assert gzip.decompress(a.archive).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    payload = {r.payload_digest: r.payload for r in warc.read_archives(archives, with_payload=True).where("payload IS NOT NULL").collect()}
    assert all(hashlib.sha256(p).hexdigest() == d for d, p in payload.items())
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_reader_notices_damage():
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc.page_record(1, "u", b"abc", digest, None)
    assert [r["page_id"] for r in warc.read_archive(good * 2)] == [1, 1]
    with pytest.raises(ValueError):
        list(warc.read_archive(warc.page_record(1, "u", b"abd", digest, None)))
    with pytest.raises(ValueError):
        list(warc.read_archive(good[:-9]))
    two = gzip.compress(gzip.decompress(good) * 2)
    with pytest.raises(ValueError):
        list(warc.read_archive(two))


def test_warc_files(spark, tmp_path):
    """Archives as files: whole gzip members to other tools, streamed by the reader, the same after a second run."""
    archives = warc.write_archives(pages(spark), archive_bytes=2000)
    for _ in range(2):
        warc.export_archives(archives, str(tmp_path))
    files = sorted(tmp_path.iterdir())
    assert len(files) == archives.count() and all(f.name.endswith(".warc.gz") and gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1") for f in files)
    found = 0
    for f in files:
        with f.open("rb") as stream:
            found += sum(1 for _ in warc.read_archive(stream))
    assert found == pages(spark).count()
    again = warc.read_archives(warc.open_archives(spark, str(tmp_path)))
    assert sorted(map(str, again.collect())) == sorted(map(str, warc.read_archives(archives).collect()))


def test_html_main_text():
    f = html_text.main_text
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div><article><header><h1>He<b>ad</b></h1></header><p>One &amp;amp; two\n three<br>four<p>Short</p><aside>Side</aside><!-- <p>no</p> --><form>f</form><p>&eacute;&#233; x</p><div id="comments">rude</div></article><footer>&copy; end</footer>'
    assert f(page) == "Head One &amp; two three four Short éé x"
    assert f(None) == f("") == "" and f("just text") == "just text"
    assert f("<nav>never closed <p>kept</p>") == "never closed kept"
    assert f("<div>" + "<a href=x>l</a> " * 5 + "</div><p>" + "long text " * 20 + "</p>") == ("long text " * 20).strip()
    assert f('<p title="a>b">x</p><p title="open>y</p>') == "x y"
    assert html_text.stretches([0, 5, 0, 7, 0, 0, 0, 3], window=3) == [(1, 4), (7, 8)]


def test_html_windows_decide_on_pages_with_articles_too():
    f = html_text.main_text
    story = "<p>" + "long story " * 20 + "</p>"
    want = ("long story " * 20).strip()
    links = '<div><a href="/a">one</a></div><div><a href="/b">two</a></div><div><a href="/c">three</a></div>'
    assert f(f'<div class="post">{story}</div><article class="card"><p>Teaser</p></article>') == f"{want} Teaser"
    assert f(f'<div class="post">{story}</div><article class="comment"><p>{"rude words " * 90}</p></article>') == want
    assert f(f'<article class="comment"><p>rude</p></article><article>{story}</article>{links}<p>2026</p>') == want
    assert f(f"<p>Shop</p>{links}<article>{story}</article>{links}<p>2026</p>") == want
    assert f(f"<article>{story}{links}<p>End</p></article>") == f"{want} one two three End"
    assert html_text.article([5, 0, 0, 0, 50, 0, 0, 0, 5, 50, 0, 0, 0, 9]) == (4, 10) and html_text.article([5]) == (0, 1) and html_text.article([]) == (0, 0)


def test_html_wrappers_of_the_article_stay():
    f = html_text.main_text
    story = "long story " * 20
    want = story.strip()
    for wrapper in ('div class="content-sidebar-wrap"', 'div class="has-sidebar"', 'div class="sidebar"', 'form', 'div id="menu"', 'div class="widget" role="dialog"'):
        for inner in ("main", "article", "div"):
            assert f(f'<{wrapper}><{inner}><p>{story}</p></{inner}></{wrapper.split()[0]}><div class="ad">Buy</div>') == want, (wrapper, inner)
    assert f(f'<article><div class="article-header"><h1>Title</h1></div><section id="cookies"><h2 id="related-work">Work</h2><p class="notice-period">Month</p></section><div class="header"><h1>x</h1></div><p>{story}</p></article>') == f"Title Work Month x {want}"
    assert f(f'<article class="comment"><h1>Own</h1><p>{story}</p></article>') == f"Own {want}"
    hidden = '<div class="ad-banner">A</div><div class="x sidebar">B</div><div class="site-footer">C</div><ul class="comment-list"><li>D</li></ul><section class="related-posts"><article>E</article></section><div class="cookie-banner">F</div><p class="ad">G<p>'
    assert f(f"<article><p>{story}</p></article>{hidden}") == want


def test_html_short_parts_of_the_article_stay():
    f = html_text.main_text
    story = "<p>" + "long story " * 200 + "</p>"
    want = ("long story " * 200).strip()
    lead, end = "<div><div><p>Lead.</p></div></div>", "<div><div><p>End.</p></div></div>"
    assert f(f"<div>{lead}<div><div>{story}</div></div>{end}</div>") == f"Lead. {want} End."
    assert f(f'{lead}<div class="ad"><p>Buy</p><p>it</p></div>{story}<div class="ad">now</div>{end}') == f"Lead. {want} End."
    links = '<div><a href="/a">one</a></div><div><a href="/b">two</a></div><div><a href="/c">three</a></div>'
    assert f(f"<p>Shop</p>{links}{lead}{story}{end}{links}<p>2026</p>") == f"Lead. {want} End."


@pytest.mark.parametrize("page", ["<a" * 9000, '<a"' * 9000, '<a "' * 9000 + ">", "<a \"x>" * 9001, "<!" * 9000, "<!--" * 9000, "<svg>" * 9000, "<h1>a</h1>" * 3000 + "<div class=promo>b</div>" * 3000, "<div>a" * 9000, "<p class" + " " * 90000 + ">"])
def test_html_long_hostile_pages_end(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 3


def test_html_broken_quotes_and_comments():
    assert html_text.main_text('<p>one <b title="x>two</b> three</p><p>four</p>') == "one two three four"
    assert html_text.main_text("<p>one</p><!-- > two") == "one"
    assert html_text.main_text("<p>one</p><!-- <p>two</p>") == "one"
    assert html_text.main_text('<p title="a > b">one</p>') == "one"


class PlainReader(HTMLParser):
    """The text of a page by the standard parser: blocks by element, what is no article by a plain list."""

    AWAY = {"nav", "footer", "aside", "form", "script", "style"}
    BLOCKS = {"p", "div", "h1", "h2", "ul", "li", "article", "main", "section", "blockquote", "td", "tr", "table", "body", "html", "br", "header", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.own, self.gone = [], "", 0

    def cut(self):
        if self.own.split():
            self.blocks.append(" ".join(self.own.split()))
        self.own = ""

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag in self.AWAY or self.gone or "ad" in classes or "comments" in classes:
            self.cut()
            self.gone += tag not in ("br", "img")
        elif tag in self.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        if self.gone:
            self.gone -= 1
        elif tag in self.BLOCKS:
            self.cut()

    def handle_data(self, data):
        if not self.gone:
            self.own += data


def test_html_text_is_that_of_a_plain_reader():
    """Random pages: an article of nested blocks, with menus, adverts, scripts and comments in and around it."""
    rng = random.Random(11)
    words = "river stone bright &amp; morning window caf&eacute; letters home &lt;b&gt; seven 5 &#233; walk".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
    away = lambda: rng.choice(['<nav><a href="/x">Menu</a> <b>x</b></nav>', '<div class="ad"><p>Buy now</p></div>', "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", '<div class="comments"><p>First!</p></div>', "<aside><p>More</p></aside>", "<form>Name <b>here</b></form>", "<!-- <p>hidden</p> -->", "<footer>(c)</footer>"])

    def block(depth):
        kind = rng.random()
        if kind < 0.15:
            return away()
        if kind < 0.6 or depth > 3:
            return f"<p>{text()} <b>{text()}</b> <a href='/y'>{text()}</a>{'<br>' * rng.randint(0, 1)}\n {text()}</p>"
        tag = rng.choice(["div", "section", "blockquote", "ul"])
        inner = "".join(f"<li>{text()}</li>" if tag == "ul" else block(depth + 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag} title=\"a > b\">{inner}</{tag}>"

    for _ in range(200):
        body = "".join(block(0) for _ in range(rng.randint(1, 6)))
        page = f"<html><head><title>T</title></head><body>{away()}{away()}<article><h1>{text()}</h1>{body}<p>{text()}</p></article>{away()}</body></html>"
        plain = PlainReader()
        plain.feed(page.replace("<title>T</title>", ""))
        plain.close()
        plain.cut()
        assert html_text.main_text(page) == " ".join(plain.blocks), page


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.doc.text, r.text) for r in html_text.extract_text(df).collect()) == [("t", ""), ("t", "a")]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_pipeline_is_its_stages(spark, tables):
    import corpus_pipeline
    from tests_llm_plain import plain_pipeline

    want, clean = plain_pipeline(spark, tables)
    got = corpus_pipeline.run(spark, tables)
    assert got.select("doc_id").distinct().count() == len(want)
    assert {r.doc_id: r.doc_tokens for r in got.collect()} == want
    assert len(clean) > 0


def test_stages_take_odd_rows(spark, odd_docs):
    import tempfile
    from pathlib import Path

    import corpus_pipeline

    folder = Path(tempfile.mkdtemp())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    for rows in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(folder))
            if name != "packing":
                assert out.columns == rows.columns
            if name in ("line dedup",):
                assert out.count() == rows.count()
            out.count()


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_queries_match_their_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    df = queries.queries()[name](spark, tables)
    columns = sorted(df.columns)
    want = con.sql(oracle.ORACLES[name])
    assert sorted(want.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(want.select(order).fetchall(), key=repr)
