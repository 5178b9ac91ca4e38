import pytest
from pyspark.sql import functions as F

from loomlake.operators import filters, graph, ranking, store


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(
        [(1, "a", '{"x": 5, "t": ["p", "q"]}'), (2, None, '{"x": "5"}'), (3, "b", '{"x": null, "o": {"b": 1, "a": 2}}'), (4, "b", None), (5, "c", '{"x": true, "d": "2024-02-01T00:00:00Z"}')],
        "id int, source string, metadata string",
    )


@pytest.mark.parametrize(
    "document, ids",
    [
        ({}, {1, 2, 3, 4, 5}),
        ({"source": "b"}, {3, 4}),
        ({"source": {"$ne": "b"}}, {1, 2, 5}),
        ({"source": None}, {2}),
        ({"source": ["b"]}, set()),
        ({"source": {"$in": []}}, set()),
        ({"metadata.x": 5}, {1}),
        ({"metadata.x": True}, {5}),
        ({"metadata.x": {"$gt": 1}}, {1}),
        ({"metadata.x": {"$gt": "1"}}, {2}),
        ({"metadata.x": None}, {3, 4}),
        ({"metadata.x": {"$exists": True}}, {1, 2, 3, 5}),
        ({"metadata.t": "p"}, {1}),
        ({"metadata.t": ["p", "q"]}, {1}),
        ({"metadata.t": ["q", "p"]}, set()),
        ({"metadata.o": {"a": 2, "b": 1}}, {3}),
        ({"metadata.d": {"$lt": {"$date": "2024-03-01"}}}, {5}),
        ({"$not": {"metadata.x": 5}}, {2, 3, 4, 5}),
        ({"$nor": [{"source": "b"}, {"metadata.x": 5}]}, {2, 5}),
        ({"$and": []}, {1, 2, 3, 4, 5}),
        ({"$or": []}, set()),
    ],
)
def test_filter(rows, document, ids):
    assert {r.id for r in rows.where(filters.compile_filter(document)).collect()} == ids


@pytest.mark.parametrize("document", [{"nope": 1}, {"source": {"$gt": "a"}}, {"source": {"$like": "a"}}, {"$xor": []}, {"$and": {}}])
def test_filter_errors(document):
    with pytest.raises(filters.FieldError):
        filters.parse(document)


def test_filter_hash():
    a, b = filters.parse({"$or": [{"source": "a"}, {"title": "b"}]}), filters.parse({"$or": [{"title": "b"}, {"source": "a"}]})
    assert filters.canonical_hash(a) == filters.canonical_hash(b) != filters.canonical_hash(filters.parse({"source": "a"}))


def test_store(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [1])], "id int, sources array<int>")
    assert [tuple(r) for r in store.forget(rows, "sources", spark.createDataFrame([(1,)], "id int")).select("id", "sources").collect()] == [(1, [2])]
    with pytest.raises(ValueError):
        store.page(rows, "id", "id", 0)


def test_paths_and_mmr(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "src int, dst int")
    assert {tuple(r.path) for r in graph.directed_paths(e, 1, 3, 3).collect()} >= {(1, 3), (1, 2, 3)}
    c = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.0]), (0, 3, 0.8, [0.0, 1.0])], "query_id int, id int, score double, embedding array<double>")
    assert [r.id for r in ranking.mmr(c, 2, 0.5).orderBy("rank").collect()] == [1, 3]


def test_equal_scores(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "channel string, id int, score double")
    assert {r.n for r in df.select(ranking.min_max(F.col("score"), "channel").alias("n")).collect()} == {1.0}


def test_stream(spark, tmp_path):
    from loomlake.streaming import events

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_long_chains_are_one_component(spark):
    chain = spark.range(40).selectExpr("id AS src", "id + 1 AS dst").union(spark.createDataFrame([(100, 100), (101, 102)], "src long, dst long"))
    got = {r.id: r.component for r in graph.connected(chain).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == 100 and got[101] == got[102] == 101
    assert graph.connected(chain.limit(0)).count() == 0


def test_pagerank_stops_by_tolerance_and_by_order(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 0, 2.0), (3, 1, 0.0)], "src long, dst long, weight double")
    d, out = 0.85, {0: [(1, 1.0)], 1: [(2, 1.0)], 2: [(0, 1.0)], 3: [(0, 2 / 3), (1, 1 / 3)]}
    r = dict.fromkeys(range(4), 0.25)
    for _ in range(200):
        r = {v: (1 - d) * 0.25 + d * sum(r[u] * w for u, arcs in out.items() for x, w in arcs if x == v) for v in r}
    got = {x.id: x["rank"] for x in graph.pagerank(e, rounds=60, tolerance=1e-6).collect()}
    assert all(abs(got[k] - r[k]) < 1e-4 for k in r)
    best = graph.pagerank(e, rounds=60, stable_top=2).orderBy(F.col("rank").desc()).limit(2).collect()
    assert [x.id for x in best] == sorted(r, key=lambda k: -r[k])[:2]


def test_search_takes_empty_texts_and_repeated_terms(spark):
    from loomlake.operators import lexical

    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None), (5, "delta delta")], "id long, text string")
    once = {r.id: r.score for r in lexical.search(docs, "id", lexical.words(F.col("text")), ["beta"], 9).collect()}
    twice = {r.id: r.score for r in lexical.search(docs, "id", lexical.words(F.col("text")), ["beta", "beta"], 9).collect()}
    assert set(once) == {1, 2} and all(abs(twice[k] - 2 * once[k]) < 1e-9 for k in once)
    assert lexical.search(docs.limit(0), "id", lexical.words(F.col("text")), ["beta"], 9).count() == 0


def test_chunkers_keep_sizes_and_overlaps(spark):
    from loomlake.functions import chunking

    body = "word " * 900 + "\n\n" + "x" * 5000
    docs = spark.createDataFrame([(1, body), (2, None), (3, "  "), (4, "short")], "id long, text string")
    got = chunking.fixed_chunks(docs, "id", "text").orderBy("id", "chunk_index").collect()
    assert {r.id for r in got} == {1, 4} and all(len(r.content) <= 2048 for r in got)
    assert not got[0].content.endswith("wor") and got[0].content[-100:] in got[1].content
    got = chunking.recursive_chunks(docs, "id", "text", 64, 8).where("id = 1").orderBy("chunk_index").collect()
    assert len(got) > 10 and [r.chunk_index for r in got] == list(range(len(got)))
    assert all(len(r.content) <= 64 * 5 + 4 * 8 + 5 for r in got if "x" not in r.content)


def test_relative_ranges():
    from datetime import datetime

    from loomlake.functions.temporal import resolve_range

    now = datetime(2024, 6, 12, 15, 30)
    day = lambda *x: datetime(*x)
    assert resolve_range("yesterday", now) == (day(2024, 6, 11), day(2024, 6, 11, 23, 59, 59, 999999))
    assert resolve_range("last 3 weeks", now)[0] == day(2024, 5, 22, 15, 30) and resolve_range("2 months ago", now)[0] == day(2024, 4, 13, 15, 30)
    assert resolve_range("Q4 2023", now) == (day(2023, 10, 1), day(2023, 12, 31, 23, 59, 59))
    assert resolve_range("February 2024", now) == (day(2024, 2, 1), day(2024, 2, 29, 23, 59, 59))
    assert resolve_range("this week", now) == (day(2024, 6, 10), now) and resolve_range("2023", now)[1] == day(2023, 12, 31, 23, 59, 59)
    assert resolve_range("nothing of the kind", now) is None


def test_event_patterns_fail_closed(spark):
    from loomlake.operators import patterns

    df = spark.createDataFrame([("Click", 5, ["a", "b"]), (None, None, None)], "t string, n int, tags array<string>")
    hit = lambda p: [bool(r[0]) for r in df.select(patterns.matches(p, {"t": F.col("t"), "n": F.col("n"), "tags": F.col("tags")})).collect()]
    assert hit({}) == [True, True] and hit({"t": [{"exists": False}]}) == [False, True]
    assert hit({"t": [{"equals-ignore-case": "CLICK"}]}) == [True, False] and hit({"t": [{"wildcard": "C?i*"}]}) == [True, False]
    assert hit({"n": [{"numeric": [">", 1, "<", 5]}]}) == [False, False] and hit({"tags": [{"contains-all": ["b", "a"]}]}) == [True, False]
    assert hit({"t": [{"unknown": 1}]}) == [False, False] and hit({"gone": [1]}) == [False, False]
    assert hit({"t": [{"anything-but": {"prefix": "X"}}]}) == [True, False]


def test_office_files(spark, tmp_path):
    import zipfile

    from loomlake.sources.readers import binary

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>one &amp; two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p></w:d>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="q"><sheets><sheet name="Second" r:id="r2"/><sheet name="First" r:id="r1"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="r1" Target="worksheets/sheet1.xml"/><x Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<s><si><t>name</t></si></s>")
        z.writestr("xl/worksheets/sheet1.xml", '<w><row><c t="s"><v>0</v></c><c><v>4.5</v></c></row></w>')
        z.writestr("xl/worksheets/sheet2.xml", '<w><row><c t="inlineStr"><is><t>in line</t></is></c></row></w>')
    (tmp_path / "c.xls").write_bytes(b"legacy")
    got = {r.path.rpartition("/")[2]: r.text for r in binary(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "one & two\nthree", "b.xlsx": "Second\nin line\nFirst\nname\t4.5", "c.xls": ""}


def test_forget_keeps_rows_without_sources(spark):
    rows = spark.createDataFrame([(1, [1, 2], {"a": 1}), (2, [1], None), (3, [], {"b": 2}), (4, None, None)], "id int, sources array<int>, m map<string,int>")
    got = {r.id: (r.sources, r.m) for r in store.forget(rows, "sources", spark.createDataFrame([(1,)], "id int")).collect()}
    assert got == {1: ([2], {"a": 1}), 3: ([], {"b": 2}), 4: (None, None)}


def test_filter_split_and_bounds():
    node = filters.parse({"occurred_at": {"$gte": "2024-01-05", "$lt": "2024-02-01"}, "source": "a", "$or": [{"title": "x"}, {"metadata.k": 1}]})
    pushed, rest = filters.split(node, {"occurred_at", "source", "title"})
    assert {x.path[0] for x in filters.leaves(pushed)} == {"occurred_at", "source"} and {x.path[0] for x in filters.leaves(rest)} == {"title", "metadata"}
    low, high = filters.date_bounds(node, "occurred_at")
    assert (low.month, high.month) == (1, 2) and filters.date_bounds(node, "created_at") == (None, None)
    assert filters.report(node, {"source"}) == {"pushed_keys": ["source"], "post_filtered_keys": ["metadata.k", "occurred_at", "title"]}
    assert filters.split(filters.parse({}), {"source"}) == (filters.Group("and", ()), filters.Group("and", ()))
    assert filters.parse({"$or": [{"$or": [{"source": "a"}, {"source": "b"}]}, {"source": "c"}]}) == filters.parse({"$or": [{"source": "a"}, {"source": "b"}, {"source": "c"}]})
