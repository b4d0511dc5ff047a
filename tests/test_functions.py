"""Expected values of the engine's functions and rules."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import html, text, url
from fathom.operators import crawl, library, search, store, tags
from fathom.operators.buckets import BucketTable
from fathom.streaming import changes


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_tokenize(spark):
    assert one(spark, "Gold Prices, gold! a x1", text.tokenize) == ["gold", "prices", "x1"]
    assert one(spark, None, text.tokenize) == []


def test_content_hash(spark):
    def fnv(s):
        h = 14695981039346656037
        units = s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = ((h ^ (units[i] << 8 | units[i + 1])) * 1099511628211) % 2**64
        return f"{h:016x}"

    for s in ("", "a", "hello world", "日本 é 😀", "x" * 500):
        assert one(spark, s, text.content_hash) == fnv(s)


def test_canonical_url(spark):
    for raw, wanted in (
        ("https://WWW.Example.com/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("https://example.com/?ref=x", "https://example.com/"),
        ("  not a url ", "not a url"),
    ):
        assert one(spark, raw, url.canonical) == wanted


def test_url_tokens(spark):
    assert one(spark, "https://www.example.com/some-Path/12345/deadbeef99/guide.html", url.tokens) == ["example", "some", "path", "guide"]


def test_html(spark):
    page = "<html><head><TITLE> A &amp; B </TITLE><meta property='og:title' content=\"Og &lt;1&gt;\"><meta name=description content='plain'>" '<link rel="icon" href="/f.ico" sizes="16x16"><link rel=apple-touch-icon href=/a.png><link rel="icon" href="/s.svg" type="image/svg+xml"></head>'
    assert one(spark, page, html.title) == "A & B"
    assert one(spark, page, lambda c: html.meta(c, "og:title")) == "Og <1>"
    assert one(spark, page, lambda c: html.best_icon(html.links(c))) == "/s.svg"
    assert html.excerpt_of("<body><nav>no</nav><article>Read <b>me</b><script>x</script></article>tail</body>") == "Read me"


def test_marks(spark):
    got = one(spark, "Gold & golden <rug>", lambda c: text.mark_matches(c, F.array(F.lit("gold"))))
    assert got == "<match>Gold</match> &amp; <match>golden</match> &lt;rug&gt;"


def test_cap_and_distinct(spark):
    assert one(spark, " a b  c ", lambda c: text.cap_words(c, 2)) == "a b"
    assert one(spark, "x", lambda c: text.distinct_ignoring_case(F.array(F.lit("News"), F.lit(" news "), F.lit("b")))) == ["News", "b"]


def test_feedback_rules(spark):
    assert one(spark, "x", lambda c: search.position_weight(F.lit(13))) == 1.5
    assert one(spark, "x", lambda c: search.position_weight(F.lit(3))) == 1.0
    assert abs(one(spark, "x", lambda c: search.recency(F.lit(search.HALF_LIFE_MS))) - 0.5) < 1e-12
    a, b = F.array(F.lit("gold"), F.lit("prices"), F.lit("now")), F.array(F.lit("gold"), F.lit("prices"))
    assert abs(one(spark, "x", lambda c: search.jaccard(a, b)) - 2 / 3) < 1e-12


def test_boost_is_a_bounded_permutation(spark):
    hits = spark.createDataFrame([(1, 1, str(i), 1.0 - i / 10, "title") for i in range(5)], "query_id long, rank int, id string, score double, reason string")
    names = spark.createDataFrame([(str(i), f"t{i}") for i in range(5)], "id string, title string")
    signals = spark.createDataFrame([(1, "4", 1.1)], "query_id long, id string, signal double")
    out = search.boosted(hits, signals, names).collect()
    assert sorted(r.id for r in out) == [str(i) for i in range(5)]
    assert max(r.score / (1.0 - int(r.id) / 10) for r in out) <= 1.275 + 1e-9


def test_weights():
    w = search.Weights.of({"floor": 0.2, "sharpness": -1, "limit": "x", "blend": float("nan")})
    assert (w.floor, w.sharpness, w.limit, w.blend) == (0.2, 5.0, 150, 0.6)


def test_folder_scope(spark):
    rows = spark.createDataFrame([("Bar / Work",), ("Bar / Work / Q3",), ("Bar / Workspace",)], "p string")
    assert [r.p for r in rows.where(search.in_folder(F.col("p"), "Bar / Work")).collect()] == ["Bar / Work", "Bar / Work / Q3"]


def test_crawl_rules(spark):
    rows = [(0, "dead", "HTTP 503", 100), (2, "dead", "HTTP 503", 100), (0, "dead", "HTTP 404", 100), (0, "full", None, 100)]
    out = crawl.classify(spark.createDataFrame(rows, "attempts int, status string, detail string, ts long")).collect()
    assert [(r.kind, r.not_before) for r in out] == [("deferred", 30100), ("failed", None), ("failed", None), ("done", None)]


def test_topics_rules():
    assert [tags.choose_k(n) for n in (50, 1347, 10000)] == [6, 26, 30]
    old = {"stamp": "s", "embedded": 1000, "enriched": 1000}
    assert [tags.needs_rebuild(old, "s", n, 1000) for n in (1050, 1101, 880)] == [False, True, True]
    assert tags.needs_rebuild(None, "s", 1, 1) and tags.needs_rebuild(old, "t", 1000, 1000)


def test_host_rules(spark):
    urls = ["https://github.com/a/issues/1", "https://gist.github.com/x", "https://google.com/maps/a", "https://m.cars.com/", "https://none.example/"]
    out = tags.host_tags(spark.createDataFrame([(u,) for u in urls], "canonical_url string")).collect()
    assert [r.heuristic for r in out] == [["dev-repos", "dev-help"], ["dev-repos", "dev-tools"], ["travel"], ["automotive"], []]


def test_tree(spark):
    rows = [("0", None, "", None), ("1", "0", "Bar", None), ("10", "1", "leaf", "https://a.example"), ("11", "1", "Dev", None), ("110", "11", "x", "https://b.example"), ("2", "0", "Other", None)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, title string, url string")
    assert {(r.id, r.path) for r in library.flatten(nodes).where("is_leaf").collect()} == {("10", "Bar"), ("110", "Bar / Dev")}
    assert {(r.id, r.n) for r in library.folder_counts(nodes).collect()} == {("0", 2), ("1", 2), ("11", 1)}
    assert library.flatten(nodes, ["11"]).where("is_leaf").count() == 1


def test_second_pass_writes_nothing(spark):
    a = spark.createDataFrame([("1", "u", "u", "t", "f"), ("2", "v", "v", "s", "f")], "id string, url string, canonical_url string, title string, folder_path string")
    assert library.diff(a, a).where("action <> 'unchanged'").count() == 0
    assert store.upsert(a, a).exceptAll(a).count() == 0


def test_debounce_and_bounce_streams_equal_batch(spark, tmp_path):
    rows = [(1, "t", 0.0), (2, "t", 0.3), (3, "t", 2.0), (4, "u", 0.1)]
    batch = spark.createDataFrame(rows, "event_id long, tab string, s double").select("event_id", "tab", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    want = {(r.tab, r.n) for r in changes.debounce(batch, "tab").collect()}
    assert want == {("t", 2), ("t", 1), ("u", 1)}
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = changes.debounce(stream, "tab", late="0 seconds").writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.tab, r.n) for r in spark.table("bursts").collect()} == want
    opens = batch.withColumnRenamed("event_id", "click_id")
    # only the first close after an open counts, here the one of its own moment
    assert {(r.click_id, r.closed == r.opened) for r in changes.bounces(opens, batch.select("tab", "ts"), "1 seconds").collect()} == {(i, True) for i in range(1, 5)}
    assert [(r.click_id, r.closed > r.opened) for r in changes.bounces(opens.where("click_id <> 2"), batch.where("event_id in (2, 3)").select("tab", "ts"), "1 seconds").orderBy("click_id").collect()] == [(1, True), (3, False)]


def test_cdc_stream(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), buckets=4)
    table.create(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string"))
    rows = [("1", "new", 1, "changed"), ("1", "newer", 2, "changed"), ("2", "b", 3, "removed"), ("3", "c", 4, "created")]
    spark.createDataFrame(rows, "id string, title string, seq long, op string").coalesce(1).write.parquet(str(tmp_path / "changes"))
    feed = spark.readStream.schema("id string, title string, seq long, op string").parquet(str(tmp_path / "changes"))
    changes.run_cdc(feed, table, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == {("1", "newer"), ("3", "c")}


def test_segments(spark):
    from fathom.functions import text

    rows = spark.createDataFrame([("The quick fox, foxes", ["fo", "the"]), ("plain", []), ("", ["a"])], "t string, q array<string>")
    got = [[(x.text, x.hit) for x in r.s] for r in rows.select(text.segments(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got == [[("The", True), (" quick ", False), ("fox", True), (", ", False), ("foxes", True)], [("plain", False)], []]


def test_meta_in_single_quotes(spark):
    from fathom.functions import html

    page = spark.createDataFrame([("<meta name='description' content='hello'>",), ('<meta property="description" content="hi">',)], "h string")
    assert [r[0] for r in page.select(html.meta(F.col("h"), "description")).collect()] == ["hello", "hi"]


def test_ids_are_strings_and_lengths_are_checked(spark):
    from fathom.operators import search, store

    vectors = spark.createDataFrame([("abc", [1.0, 0.0], "m"), ("b", [1.0, 0.0], "m")], "id string, vector array<double>, model_version string")
    asked = spark.createDataFrame([(0, "x", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    assert [r.id for r in search.nearest(vectors, asked, 2).orderBy("rank").collect()] == ["abc", "b"]
    bad = spark.createDataFrame([("odd", [1.0], "m")], vectors.schema)
    for run in (lambda: search.nearest(vectors.union(bad), asked, 2).collect(), lambda: store.upsert_vectors(vectors, bad, "m", 2).collect()):
        with pytest.raises(Exception, match="odd"):
            run()


def test_sweep_counts_queries_without_a_hit(spark):
    from fathom.operators import sweep

    records = spark.createDataFrame([("a", "alpha beta", "https://x.org/one", "https://x.org/one", "", [], [])], "id string, title string, url string, canonical_url string, folder_path string, tags array<string>, headings array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([(0, "alpha", [1.0, 0.0]), (1, "gamma", [0.0, 1.0])], "query_id long, text string, vector array<double>")
    expected = spark.createDataFrame([(0, ["x.org"], 5), (1, ["x.org"], 5)], "query_id long, expect array<string>, k int")
    assert {(r.hits, r.mrr) for r in sweep.sweep(records, vectors, queries, expected).collect()} == {(1, 0.5)}


def test_signals_reach_search_hits_tags_and_rebuilt_records(spark):
    kind = "id string, title string, url string, canonical_url string, folder_path string, date_added long, status string, meta_description string, site_name string, excerpt string, headings array<string>, tags array<string>, learned_tags array<string>, tag_model_version string"
    own = ("a", "plain", "https://x.org/one", "https://x.org/one", "", 1, "full", "walnut tables", "Timber", "words", ["oak"], ["t"], ["birch wood"], "v1")
    bare = ("b", "", "https://x.org/two", "https://x.org/two", "", 1, "pending", None, None, "a snippet", None, None, None, None)
    records = spark.createDataFrame([own, bare], kind)
    asked = spark.createDataFrame([(0, "walnut"), (1, "timber"), (2, "oak"), (3, "birch")], "query_id long, text string")
    got = {r.query_id: (r.id, r.lex_reason, round(r.lex, 6)) for r in search.lexical(records, asked).collect()}
    assert got == {0: ("a", "description", 0.35), 1: ("a", "description", 0.35), 2: ("a", "description", 0.35), 3: ("a", "tag", 0.65)}
    hits = {r.id: (r.description, r.tags) for r in search.hit_row(records).collect()}
    assert hits == {"a": ("walnut tables", ["t", "birch wood"]), "b": ("a snippet", [])}
    composed = library.with_composite(records)
    texts = {r.id: r.t for r in composed.select("id", tags.tag_text(composed).alias("t")).collect()}
    assert texts["a"] == "plain\nwalnut tables\nTimber" and texts["b"].startswith("x.org\na snippet")
    # renamed: signals and tags stay, the tag stamp goes; a new row is pending and has no signals
    now = records.withColumn("title", F.lit("renamed")).unionByName(records.limit(1).withColumn("id", F.lit("c")))
    made = {r.id: r for r in library.rebuild(now, records).collect()}
    assert made["a"].meta_description == "walnut tables" and made["a"].tags == ["t"] and made["a"].tag_model_version is None
    assert made["c"].status == "pending" and made["c"].meta_description is None and made["c"].tags == [] and "learned_tags" not in made["a"].asDict()


def test_outcomes_merge_signals_and_drop_stamps(spark):
    kind = "id string, title string, url string, folder_path string, status string, meta_description string, model_version string, tag_model_version string"
    records = spark.createDataFrame([(i, "mine", "https://x.org/p", "", "pending", "kept", "m", "t") for i in "abc"], kind)
    rows = [("a", 1, 1, "full", "first", "one"), ("a", 2, 2, "meta_only", None, "two"), ("b", 1, 3, "dead", None, None)]
    outcomes = spark.createDataFrame(rows, "id string, ts long, event_id long, status string, title string, meta_description string")
    got = {r.id: r for r in crawl.merge_outcome(records, outcomes).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.title, a.og_title, a.meta_description, a.status, a.model_version, a.tag_model_version) == ("mine", "first", "two", "meta_only", None, None)
    assert (b.meta_description, b.status, b.model_version, b.tag_model_version) == ("kept", "dead", "m", "t")
    assert (c.status, c.model_version) == ("pending", "m")


def test_upsert_keeps_the_last_write(spark):
    table = spark.createDataFrame([("1", 0), ("2", 0)], "id string, n long")
    told = spark.createDataFrame([("1", 9, 1), ("1", 5, 3), ("1", 7, 2), ("3", 1, 1), ("3", 2, 1)], "id string, n long, seq long")
    for seq, first in (("seq", 5), (None, 9)):
        for order in (F.asc("n"), F.desc("n")):
            got = store.upsert(table, told.orderBy(order), seq=seq)
            assert {(r.id, r.n) for r in got.collect()} == {("1", first), ("2", 0), ("3", 2)}
