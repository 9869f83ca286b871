"""WARC archives, URL rules and page text."""

import gzip
import hashlib
import html
import io
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from profitloom.llm import htmltext, urlfilter, warc
from profitloom.llm.common import table

PAGES = "page_id long, url string, html string, payload int, `_digest` string"
LONG = "x" * 100
ROWS = [
    (5, "http://a.com/é?q", LONG), (3, None, LONG), (3, "u", LONG), (9, "http://a\r\nb", LONG), (1, "u", "short"),
    (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 100), (8, "u", "z" * 3_000_000), (None, "u", LONG),
    (None, "u", "n" * 200), (None, "u", "n" * 200),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d") for r in rows], PAGES)


def test_paths_as_spark_spells_them():
    same = ["/tmp/x", "file:///tmp/x", "hdfs://host:9000/x", "gs://b/x", "s3://b/x"]
    assert [warc.arrow_path(p) for p in same] == same
    assert warc.arrow_path("s3a://bucket/a/b.gz") == "s3://bucket/a/b.gz"
    assert warc.arrow_path("dbfs:/a/b") == warc.arrow_path("dbfs:///a/b") == "/dbfs/a/b"
    store, name = warc.file_system("s3a://bucket/a/b.gz?region=eu-west-1")
    assert store.type_name == "s3" and name == "bucket/a/b.gz"


def test_archives_come_back(spark):
    manifest = warc.write_archives(pages(spark, ROWS).repartition(3))
    got = warc.read_archives(spark, manifest).collect()
    assert len(got) == len(ROWS)
    first = {LONG: 3, "é" * 100: 7, "z" * 3_000_000: 8}
    want = []
    for page, _, payload in ROWS:
        raw = (payload or "").encode()
        head = first.get(payload)
        back = head if head is not None and page != head else None
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if back else "response", back))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["payload"] is None if r["refers_to"] else hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got)


def test_empty_table(spark):
    assert warc.read_archives(spark, warc.write_archives(pages(spark, []))).count() == 0


def archive(*payloads):
    return b"".join(warc.page_record(i, "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))


def test_each_record_is_a_member_and_reading_is_sequential():
    data = archive(b"one", b"", b"three\r\n\r\nx" * 100_000)
    found = list(warc.records(io.BytesIO(data)))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == [b"one", b"", b"three\r\n\r\nx" * 100_000]
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3


@pytest.mark.parametrize("harm", ["cut", "digest", "length"])
def test_broken_archives_are_refused(harm):
    data = archive(b"one", b"two")
    if harm == "cut":
        data = data[:-5]
    else:
        raw = gzip.decompress(data)
        raw = raw.replace(b"two", b"tWo") if harm == "digest" else re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %d" % (int(m[1]) + 1), raw)
        parts = raw.split(b"WARC/1.1\r\n")[1:]
        data = b"".join(gzip.compress(b"WARC/1.1\r\n" + p) for p in parts)
        assert raw != gzip.decompress(archive(b"one", b"two"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data)))


RULES = urlfilter.UrlRules(("com/", "www.example.com/en/"), ("example.com/en/", "net/es/", "net/fr/"), ("spam",))
URLS = {
    "http://a.com": ("a.com", "", None, "allow"),
    "http://a.com/x?y#z": ("a.com", "/x", "com/", "allow"),
    "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
    "https://m.example.com/en": ("m.example.com", "/en", "com/", "allow"),
    "https://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"),
    "x://a.b.net/fr/?": ("a.b.net", "/fr/", "net/fr/", "block"),
    "x://a.net/en/http://b.com/": ("a.net", "/en/http://b.com/", None, "allow"),
    "x://www.spam-farm.org/a": ("www.spam-farm.org", "/a", None, "block"),
    "x://spam.com/a": ("spam.com", "/a", "com/", "allow"),
    "x://antispam.org/": ("antispam.org", "/", None, "allow"),
    "a.com/x": ("", "", None, "allow"),
    "://?x": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://é.com/\n/x": ("é.com", "/\n/x", "com/", "allow"),
    "http://" + "a." * 60 + "com/" + "y" * 50_000: ("a." * 60 + "com", "/" + "y" * 50_000, "com/", "allow"),
}


def test_urls_are_judged_by_the_longest_rule(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(None, "http://a.com/x?y#z", "")]
    got = urlfilter.judge(pages(spark, rows), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = rows[r["page_id"]][1] if r["page_id"] is not None else rows[-1][1]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[url], url
    assert urlfilter.judge(pages(spark, []), RULES).count() == 0


def test_a_listed_word_counts_in_every_label(spark):
    hosts = {
        "a.spam": True, "spam": True, "x-spam": True, "b.spam-x": True, "spam.org": True, "a.x-spam.org": True,
        "x\n.spam": True, "spam.": True, "a.antispam": False, "spams": False, "a.spam8": False, "-": False, ".": False,
    }
    got = urlfilter.judge(pages(spark, [(i, f"x://{h}", "") for i, h in enumerate(hosts)]), RULES).collect()
    assert {r["host"]: r["verdict"] == "block" for r in got} == hosts


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(60_000).selectExpr("concat('k', id) as _key")
    listed = spark.range(0, 60_000, 3).selectExpr("concat('k', id) as _key")
    cascade = urlfilter.build_cascade(spark, universe, listed, bits_per_key=2, hashes=1)
    assert len(cascade.levels) > 3
    wrong = universe.where(cascade.holds(F.col("_key")) != (F.substring("_key", 2, 9).cast("long") % 3 == 0))
    assert wrong.count() == 0
    nothing = urlfilter.build_cascade(spark, universe, listed.limit(0))
    assert universe.where(nothing.holds(F.col("_key"))).count() == 0


def test_slices_of_keys_change_no_row(spark, monkeypatch):
    rows = [(i, u, "") for i, u in enumerate([*URLS, *URLS])] + [(None, "http://x-spam.net/es/1", "")] * 3
    rows += [(1000 + i, f"http://h{i}.p{i % 9}.example.com/en/{i}", "") for i in range(500)]
    want = sorted(map(str, urlfilter.judge(pages(spark, rows), RULES).collect()))
    monkeypatch.setattr(urlfilter, "LEVEL_BYTES", 1 << 10)
    assert sorted(map(str, urlfilter.judge(pages(spark, rows), RULES).collect())) == want


def test_a_host_of_very_many_labels(spark):
    long = "a." * 5_000 + "b.spam.example.com"
    start = time.time()
    got = urlfilter.judge(pages(spark, [(1, f"http://{long}/en/x", ""), (2, f"http://{'c.' * 5_000}spam.d/", "")]), RULES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "block")} and time.time() - start < 150


def article(page: str) -> str:
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    out = []
    for part in re.split(r"<(?:h1|/h1|p|/p)>", found[1] if found else ""):
        text = " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", " ", part)).split())
        if text:
            out.append(text)
    return "\n".join(out)


def test_text_of_the_given_pages_is_the_article(spark):
    rows = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: article(r["html"]) for r in rows.collect()}
    got = htmltext.extract(rows).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


WEIGHTS = np.array([-5.5, 2.4, -1.8, 0.45, 0.84])
PARA = "A sentence of a good many words stands here, long enough to read as prose."


@pytest.mark.parametrize(("page", "text"), [
    ("", ""),
    ("just text & more &amp; &lt;b&gt;", ""),
    (f"<article><header>By me</header><h1>T &eacute;</h1><p>{PARA}<br>x\n y<form><p>mail</form><aside>side</aside></article>", f"By me\nT é\n{PARA} x y"),
    (f"<header>Site</header><div class='content'><p>Be.</p><p>{PARA}</p></div><div id='comments'><p>{PARA}</p></div>", f"Be.\n{PARA}"),
    (f"<div class='cookie-notice'>{PARA}</div><main><p>{PARA}</p><script>if (a<b) x('</p>')</script><style>p{{}}</style></main><!-- <p>no</p> -->", PARA),
    (f"<body><ul class=menu><li><a href=x>Home</a></li></ul><p>{PARA}</p><p>Ok.</p><p>{PARA}</p><footer>end</footer>", f"{PARA}\nOk.\n{PARA}"),
    (f"<article><p>{PARA}</p><div class=ad>Buy</div><p>1 < 2 and <b>bold</b>text &am", f"{PARA}\n1 < 2 and boldtext &am"),
    ("<p" * 3000, ""),
    ("<article>" + "<div>" * 3000 + "deep", "deep"),
    (f"<article><p>{PARA} <math><mi>x</mi></math> end</p><noscript>kept</noscript></article><noscript>Switch scripts on</noscript>", f"{PARA} x end\nkept"),
    ("<article><p hidden>no</p><p>yes &nbsp; it\tis</p>", "yes it is"),
])
def test_page_text(page, text):
    assert htmltext.main_text(page, WEIGHTS) == text


SIDE = f"<div class=sidebar><p>{PARA}</p></div>"
LINKS = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='page has-sidebar'>{LINKS}<article><h1>T</h1><p>{PARA}</p></article>{SIDE}</div><footer>{PARA}</footer>", f"T\n{PARA}"),
    (f"<div id='with-nav'><main><h1>T</h1><p>{PARA}</p></main>{SIDE}</div><p>short</p>", f"T\n{PARA}"),
    (f"<body><form action=x>{LINKS}<div id=wrap><article><header>By me</header><h1>T</h1><p>{PARA}</p></article></div>{SIDE}</form>", f"By me\nT\n{PARA}"),
    (f"<form><div class='with-nav'><div class=content><h2>T</h2><p>{PARA}</p></div></div>{LINKS}</form>", f"T\n{PARA}"),
    (f"<form>{LINKS}<p>{PARA}</p><p>{PARA}</p></form>", f"{PARA}\n{PARA}"),
    (f"<main><article><p>{PARA}</p></article><div id=comments><article class=comment-body><p>{PARA} {PARA}</p></article></div></main>", PARA),
    (f"<article><p>{PARA}</p><p>{PARA}</p></article><div class=comments><p>{PARA} {PARA}</p><p>{PARA}</p></div>", f"{PARA}\n{PARA}"),
    (f"<div class=related>{PARA}</div><form><p>Your mail</p></form><div hidden><article>{PARA}</article></div>", ""),
])
def test_a_wrapper_does_not_decide(page, text):
    assert htmltext.main_text(page, WEIGHTS) == text


def test_rows_of_every_kind(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", f"<article>{PARA}</article>"), (3, "u", f"<article>{PARA}</article>"), (None, "u", "<p>" + "word " * 50_000)]
    got = htmltext.extract(pages(spark, rows)).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got)[1:] == [(1, ""), (2, ""), (3, PARA), (3, PARA)]
    assert htmltext.extract(pages(spark, [])).count() == 0


def test_cut_is_the_smallest():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 7
        source, sink = rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 9), rng.integers(0, n, 9), rng.integers(0, 4, 9)) if a != b]

        def cost(side):
            return sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.max_flow_side(n, source.tolist(), sink.tolist(), edges)) == best


MENU = "<p><a href=x>Home</a></p><p><a href=y>News</a></p><p><a href=z>More</a></p>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div><h1>Title</h1><p>{PARA}</p></div>", f"Title\n{PARA}"),
    (f"<body><div><h1>Title</h1><p>{PARA}</p><p>{PARA}</p></div>", f"Title\n{PARA}\n{PARA}"),
    (f"<body><div>{MENU}</div><div><h2>Title</h2><p>{PARA}</p><p>So.</p><p>{PARA}</p></div><div><h2>More</h2>{MENU}</div>", f"Title\n{PARA}\nSo.\n{PARA}"),
])
def test_the_cut_labels_blocks_of_pages_whose_tags_say_nothing(page, text):
    assert htmltext.main_text(page, WEIGHTS) == text
    blocks = htmltext.blocks_of(page)
    assert all(b.score == 0 for b in blocks)
    # The model alone calls the title and the short paragraph boilerplate.
    model = [b.text for b in blocks if np.dot(htmltext.features(b), WEIGHTS) > 0]
    assert set(model) == {PARA}


def test_deep_and_long_pages_take_time_in_proportion():
    seconds = []
    for size in (4_000, 32_000):
        deep = "<div>word here" * size
        lists = "<article><ul>" + "<div>" * size + "<li>a" * size + "</p></b></td>" * size
        flat = f"<div><h1>T</h1><p>{PARA}</p><p>{PARA}</p></div>" * (size // 4)
        start = time.time()
        assert htmltext.main_text(f"<article>{deep}", WEIGHTS).count("\n") == size - 1
        assert htmltext.main_text(lists, WEIGHTS).count("a") == size
        assert htmltext.main_text(flat, WEIGHTS).count(PARA) == size // 2
        seconds.append(time.time() - start)
    assert seconds[1] < 20 * seconds[0] + 2
