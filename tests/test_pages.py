"""Parsed pages, icons by ordered fallback, order statistics, preferences."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.functions import html, page
from fathom.operators import icons, order, prefs
from fathom.operators.buckets import BucketTable
from fathom.plans.api import Engine

PAGE = (
    "<!doctype html><html><head><TITLE> A &amp; B </TITLE><title>second</title><meta property='og:title' content=\"\"><meta name=description content='plain'>"
    '<meta property="og:description" content="  Of &lt;1&gt; "><link rel="icon" href="/f.ico" sizes="16x16"><link rel=apple-touch-icon href=/a.png><link rel="icon" href="s.svg" type="image/svg+xml"></head>'
    "<body><nav>menu</nav><h1>One <b>two</b></h1><h2>ONE two</h2><h2>three<h1> </h1><p>words &eacute; here<script>no()</script> and there"
)


def test_one_parse_gives_all_signals():
    got = page.signals_of(PAGE, "https://site.example/deep/page?x=1")
    assert got["title"] == "A & B" and got["og_title"] is None and got["meta_description"] == "Of <1>" and got["site_name"] is None
    assert got["headings"] == ["One two", "three"] and got["icon_url"] == "https://site.example/deep/s.svg" and got["n_links"] == 3
    assert got["excerpt"].endswith("words é here and there")
    assert page.signals_of(None, None) == page.signals_of("", "x") == {**dict.fromkeys(page.FIELDS), "n_links": 0}


def test_both_routes_choose_the_same_icon(spark):
    draw = random.Random(5)
    rels, sizes, kinds = ["icon", "shortcut icon", "apple-touch-icon", "mask-icon", "stylesheet", "ICON"], ["", "16x16", "180x180", "any", "32x32 64x64", "x", "48x"], ["", "image/svg+xml", "image/png"]
    rows = []
    for i in range(300):
        links = [f'<link rel="{draw.choice(rels)}" href="{draw.choice(["/a.png", "/b.svg?v=1", "https://c.example/d.ico", "data:image/png,x"])}" sizes="{draw.choice(sizes)}" type="{draw.choice(kinds)}">' for _ in range(draw.randint(0, 4))]
        rows.append((i, "https://site.example/deep/page", "".join(links)))
    df = spark.createDataFrame(rows, "id int, url string, html string")
    by_pattern = {r.id: r.icon for r in df.select("id", html.resolve(html.best_icon(html.links(F.col("html"))), F.col("url")).alias("icon")).collect()}
    parsed = {r.id: r.icon_url for r in page.with_signals(df).collect()}
    assert by_pattern == parsed and len(set(parsed.values())) > 3


def test_pages_that_the_parser_refuses(spark, monkeypatch):
    rows = [(1, "https://a.example/", "<title>ok</title><h1>x</h1>", "kept"), (2, "https://a.example/", None, None), (3, None, "", "kept")]
    got = page.with_signals(spark.createDataFrame(rows, "id int, url string, html string, title string").drop("title")).orderBy("id").collect()
    assert [(r.title, r.headings, r.n_links) for r in got] == [("ok", ["x"], 0), (None, None, 0), (None, None, 0)]
    # a parser that refuses every page leaves the patterns
    names = page._SCHEMA.names

    def refused(pages, bases):
        import pandas as pd

        return pd.DataFrame([{"parsed": False, "n_links": 0}] * len(pages), columns=names, dtype=object).where(lambda d: d.notna(), None)

    monkeypatch.setattr(page, "_parsed", F.pandas_udf(refused, page._SCHEMA, F.PandasUDFType.SCALAR))
    row = page.with_signals(spark.createDataFrame([(1, "https://site.example/deep/page", PAGE.replace("name=description", "name='description'"))], "id int, url string, html string")).first()
    assert (row.title, row.meta_description, row.icon_url, row.n_links) == ("A & B", "Of <1>", "https://site.example/deep/s.svg", 3)
    assert page.with_signals(spark.createDataFrame([], "url string, html string")).count() == 0


# --- icons

RECORD = "id string, url string, canonical_url string, date_added long, icon_url string"


def records(spark, *rows):
    return spark.createDataFrame([(str(i), u, u, i, icon) for i, u, icon in rows], RECORD)


def store(spark, path, *rows):
    table = BucketTable(spark, str(path / "icons"), key="origin", buckets=4)
    table.create(spark.createDataFrame(list(rows), icons.ICONS))
    return table


def site(**pages):
    """A transport: addresses by name to (kind, body); all others are missing."""
    known = {k.replace("__", "."): v for k, v in pages.items()}

    def transport(address):
        if address not in known:
            raise OSError("HTTP 404")
        return 200, *known[address]

    return transport


PNG = ("image/png", b"\x89PNG")


def asked(spark, made):
    return {r.origin: (r.via, r.asked, r.declared_url) for r in made.collect()}


def test_once_an_origin_and_misses_are_kept(spark, tmp_path):
    rows = records(spark, (1, "https://good.test/a", None), (2, "https://good.test/b", None), (3, "https://bad.test/x", None), (4, "chrome://extensions", None))
    table, web = store(spark, tmp_path), site(**{"https://good.test/favicon.ico": PNG})
    got = asked(spark, icons.capture(icons.origins(rows), web))
    assert got == {
        "https://good.test": ("root", ["https://good.test/favicon.ico"], ""),
        "https://bad.test": ("none", ["https://bad.test/favicon.ico", "https://bad.test/"], ""),
    }
    assert icons.sync(rows, table, web, rounds=3) == {"fetched": 1, "missing": 1}
    held = {r.origin: r for r in table.read().collect()}
    assert bytes(held["https://good.test"].bytes) == PNG[1] and bytes(held["https://bad.test"].bytes) == b"" and held["https://bad.test"].sync_version == 3
    before = table.versions()
    assert icons.sync(rows, table, web) == {"fetched": 0, "missing": 0} and table.versions() == before
    assert icons.stats(table.read()).first().asDict() == {"total": 2, "has_bytes": 1, "negative": 1}


def test_order_of_the_fallback(spark):
    page_ = ("text/html; charset=utf-8", b'<head><link rel="icon" href="/assets/icon-32.png" sizes="32x32"></head>')
    rows = records(
        spark,
        (1, "https://declared.test/page", "https://declared.test/img/fav.png"),
        (2, "https://declared.test/other", "https://declared.test/later.png"),
        (3, "https://modern.test/deep/page", None),
        (4, "https://same.test/", "https://same.test/assets/icon-32.png"),
        (5, "https://large.test/", "https://large.test/i.png"),
        (6, "https://text.test/", None),
    )
    web = site(
        **{
            "https://declared.test/img/fav.png": PNG,
            "https://modern.test/": page_,
            "https://modern.test/assets/icon-32.png": PNG,
            "https://same.test/": page_,
            "https://large.test/i.png": ("image/png", bytes(131_073)),
            "https://large.test/favicon.ico": ("image/png", bytes(131_072)),
            "https://text.test/favicon.ico": ("text/html", b"none"),
            "https://text.test/": ("application/json", page_[1]),
        }
    )
    assert asked(spark, icons.capture(icons.origins(rows), web, parallel=2)) == {
        "https://declared.test": ("declared", ["https://declared.test/img/fav.png"], "https://declared.test/img/fav.png"),
        "https://modern.test": ("page", ["https://modern.test/favicon.ico", "https://modern.test/", "https://modern.test/assets/icon-32.png"], "https://modern.test/assets/icon-32.png"),
        # what the root page declares and was tried already is not asked for again
        "https://same.test": ("none", ["https://same.test/assets/icon-32.png", "https://same.test/favicon.ico", "https://same.test/"], "https://same.test/assets/icon-32.png"),
        "https://large.test": ("root", ["https://large.test/i.png", "https://large.test/favicon.ico"], "https://large.test/i.png"),
        "https://text.test": ("none", ["https://text.test/favicon.ico", "https://text.test/"], ""),
    }


def test_misses_are_tried_again_for_a_reason(spark, tmp_path):
    miss = lambda origin, version, declared: (origin, b"", "", False, version, declared)
    table = store(
        spark,
        tmp_path,
        miss("https://old.test", None, None),
        miss("https://spa.test", 3, "https://spa.test/a.png"),
        miss("https://calm.test", 3, "https://calm.test/a.png"),
        ("https://kept.test", b"x", "image/png", True, 1, ""),
    )
    rows = records(spark, (1, "https://old.test/p", None), (2, "https://spa.test/", "https://spa.test/new.png"), (3, "https://calm.test/", "https://calm.test/a.png"), (4, "https://kept.test/", "https://kept.test/new.png"))
    web = site(**{"https://spa.test/new.png": PNG, "https://kept.test/new.png": PNG, "https://calm.test/a.png": PNG})
    assert icons.sync(rows, table, web) == {"fetched": 1, "missing": 1}
    assert icons.sync(rows, table, web) == {"fetched": 0, "missing": 0}
    held = {r.origin: bytes(r.bytes) for r in table.read().collect()}
    assert held == {"https://old.test": b"", "https://spa.test": PNG[1], "https://calm.test": b"", "https://kept.test": b"x"}


# --- order statistics


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_order_statistic_equals_sorting(spark, share):
    draw = random.Random(7)
    groups = {"hot": [draw.choice([0, 5, 10**15, -(10**12)]) if i % 3 else draw.randrange(10**9) for i in range(3000)], "one": [4], "ties": [7] * 50, None: [draw.randrange(-50, 50) for _ in range(101)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("empty", None)]
    got = order.order_statistic(spark.createDataFrame(rows, "k string, v long"), "v", share, ("k",)).collect()
    assert {r.k: (r.n, r.total, r.most, r.at) for r in got} == {k: (len(v), sum(v), max(v), sorted(v)[min(len(v) - 1, int(len(v) * share))]) for k, v in groups.items()}


def test_order_statistic_of_all_rows(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("v"))
    assert order.order_statistic(rows, "v", 0.95).first().at == 9500
    assert order.order_statistic(rows.limit(0), "v", 0.95).count() == 0
    with pytest.raises(ValueError):
        order.order_statistic(rows, "v", 1.5)


# --- preferences

NODES = "id string, parent_id string, title string, url string, date_added long"


def test_prefs_are_coerced(spark):
    cases = {
        None: (True, []),
        "nothing": (True, []),
        "{}": (True, []),
        '{"crawlEnabled": false, "excludedFolderIds": ["12", 3, null, "34"]}': (False, ["12", "34"]),
        '{"crawlEnabled": "false", "excludedFolderIds": "12"}': (True, []),
        '{"crawlEnabled": 0}': (True, []),
        "[1]": (True, []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", prefs.sanitized(F.col("m")).alias("p"))
    assert {r.m: (r.p.crawl_enabled, r.p.excluded) for r in df.collect()} == cases
    assert prefs.Prefs.of({"crawlEnabled": False, "excludedFolderIds": ["1", 2]}) == prefs.Prefs(False, ("1",))
    assert prefs.Prefs.of(None) == prefs.Prefs.of({"excludedFolderIds": "1"}) == prefs.Prefs()


def test_engine_follows_its_prefs(spark):
    nodes = spark.createDataFrame([("r", None, "", None, 0), ("f", "r", "In", None, 0), ("g", "r", "Out", None, 0), ("h", "g", "Deep", None, 0), ("1", "f", "a", "https://a.example/", 1), ("2", "h", "b", "https://b.example/", 2)], NODES)
    empty = "id string, url string, canonical_url string, title string, folder_path string, date_added long, composite_text string, content_hash string, status string, tags array<string>, model_version string"
    vectors = spark.createDataFrame([("1", [1.0]), ("2", [1.0])], "id string, vector array<double>")
    engine = Engine(spark, spark.createDataFrame([], empty), vectors).ingest_tree(nodes)
    ids = lambda e: sorted(r.id for r in e.records.collect())
    assert ids(engine) == ["1", "2"] and engine.crawl_waves().count() == 2
    less = engine.set_prefs({"crawlEnabled": False, "excludedFolderIds": ["g"]}, nodes)
    assert ids(less) == ["1"] and [r.id for r in less.vectors.collect()] == ["1"] and less.crawl_waves().count() == 0
    assert ids(less.set_prefs({}, nodes)) == ["1", "2"]
    reset = less.reset()
    assert ids(reset) == [] and reset.vectors.count() == 0 and reset.prefs == prefs.Prefs() and reset.clicks is None
