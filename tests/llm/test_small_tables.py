"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnlake.llm import language_fusion, length_histogram, license_scan, line_frequency, piece_lattice, run_index, source_mix, token_groups, url_rules, vector_approx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and " * 3000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a.com", 0), (3, "   \n\t", "de", None, 5), (4, "Hello world", "en", "a.com", 11), (4, "Hello world", "en", "a.com", 11),
        (None, "no number", "fr", "b.org", 9), (6, LONG, "en", "b.org", len(LONG)), (7, LONG, None, "", len(LONG)), (8, "▁ \U0001f600 ü\0", "xx", "a.com", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clash(odd):
    """Columns with names that operators make themselves."""
    names = ("n_words", "size", "key", "hash", "id", "component", "node", "words", "host", "range", "spans", "signatures", "found", "x", "line", "h", "s", "target", "kept", "times", "copy", "row", "l", "n", "raw")
    names += ("_hash", "_id", "_spans", "_copy", "_text", "_mix_source", "_mix_times", "_lid_host", "_lid_prior", "_lid_text", "text_", "said", "sl", "sn", "plan_source", "plan_times", "_kept", "HI")
    return odd.select("*", *(F.lit("theirs").alias(n) for n in names))


def values(rows, columns):
    plain = lambda x: round(x, 6) if isinstance(x, float) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x
    return sorted(([plain(r[c]) for c in columns] for r in rows), key=repr)


RUNS = {
    "quality": lambda d: line_frequency.quality(d, max_docs=1),
    "cleaned": lambda d: line_frequency.without_frequent_lines(d, max_docs=1),
    "mix": source_mix.mix,
    "mixed": source_mix.mixed_documents,
    "licence": license_scan.scan,
    "lengths": lambda d: length_histogram.context_limits(length_histogram.histogram(d)),
    "language": language_fusion.fuse,
    "pieces": lambda d: piece_lattice.digests(d, ["doc_id"]),
    "jaccard": token_groups.join,
    "removals": run_index.removals,
    "deduplicated": run_index.deduplicated,
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, clash, name):
    mine, theirs = RUNS[name](odd), RUNS[name](clash)
    rows = mine.collect()
    assert values(rows, mine.columns) == values(theirs.collect(), mine.columns)
    if name in ("quality", "licence", "language", "pieces", "jaccard", "removals", "deduplicated", "mix", "cleaned"):
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 4, 6, 7, 8]


def test_values_of_odd_rows(odd):
    of = lambda name, *columns: {r["doc_id"]: tuple(r[c] for c in columns) for r in RUNS[name](odd).collect()}
    assert of("quality", "n_words", "word_chars", "base_failed") == {1: (0, 0, True), 2: (0, 0, True), 3: (0, 0, True), 4: (2, 10, True), None: (2, 8, True), 6: (6000, 21000, True), 7: (6000, 21000, True), 8: (3, 4, True)}
    assert of("licence", "n_words", "detections") == {1: (0, []), 2: (0, []), 3: (0, []), 4: (2, []), None: (2, []), 6: (6000, []), 7: (6000, []), 8: (3, [])}
    assert of("jaccard", "n_shingles", "component_id") == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), None: (1, None), 6: (2, 6), 7: (2, 6), 8: (1, 8)}
    found = of("removals", "n_bytes", "n_removed", "n_spans")
    assert found == {1: (0, 0, 0), 2: (0, 0, 0), 3: (5, 0, 0), 4: (11, 0, 0), None: (9, 0, 0), 6: (27000, 27000, 1), 7: (27000, 27000, 1), 8: (12, 0, 0)}
    assert {k: v[0] for k, v in of("mix", "size").items()} == {1: 0, 2: 0, 3: 0, 4: 2, None: 2, 6: 6000, 7: 6000, 8: 3}
    assert {k: [w["restored"] for w in v[0]] for k, v in of("pieces", "ways").items() if k in (1, 2)} == {1: [True], 2: [True]}
    assert {k: v[0].kept for k, v in of("language", "lid").items() if k in (1, 2, 3, 6)} == {1: False, 2: False, 3: False, 6: True}


def test_texts_of_a_million_letters(spark):
    rows = [(1, "x" * 1_000_000, "en", "a"), (2, "".join(chr(97 + i * i % 23) for i in range(1_000_000)), "en", "a"), (3, "some words of a long text " * 40_000, "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], DOCS)
    of = lambda name, *columns: [tuple(r[c] for c in columns) for r in RUNS[name](docs).orderBy("doc_id").collect()]
    assert of("quality", "n_words", "word_chars", "kept") == [(1, 1_000_000, False), (1, 1_000_000, False), (240_000, 800_000, False)]
    assert of("mix", "size") == [(1,), (1,), (240_000,)] and of("licence", "n_words") == [(1,), (1,), (240_000,)]
    assert of("jaccard", "n_shingles") == [(1,), (1,), (6,)] and all(r[0].kept for r in of("language", "lid"))
    assert of("removals", "n_bytes", "n_removed", "n_spans") == [(1_000_000, 1_000_000, 1), (1_000_000, 1_000_000, 1), (1_040_000, 1_040_000, 1)]
    assert [r[0] for r in of("deduplicated", "text")] == ["", "", ""]
    assert RUNS["lengths"](docs).agg(F.sum("n_docs")).first()[0] == 3
    assert all(len(r[0]) == 3 and all(w["restored"] for w in r[0]) for r in of("pieces", "ways"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.com/"), "text").alias("url"))
    assert {r["verdict"] for r in url_rules.judge(pages, url_rules.mine(pages.withColumn("blocked", F.lit(True)))).collect()} == {"block"}


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(odd, name):
    assert RUNS[name](odd.where("false")).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, clash, stage):
    assert stage(spark, odd.where("false"), "").count() == 0
    mine, theirs = stage(spark, odd, ""), stage(spark, clash, "").collect()
    assert values(mine.collect(), mine.columns) == values(theirs, mine.columns)
    if stage is not corpus_pipeline.encoded:
        assert mine.columns == odd.columns and set(theirs[0].asDict()) == set(clash.columns)
        assert all(r[c] == "theirs" for r in theirs for c in set(clash.columns) - set(odd.columns))


def test_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://Ex.COM"), (5, "http://EXAMPLE.com/en/7?x"), (6, "http://example.com/en/8"), (7, "http://a.net/de/#x"), (8, "http://x.example.net/de/8"), (8, "http://net?/de/"), (9, "a://b://org/es/"), (10, "http://org/es"), (11, "http://notorg/es/1"), (12, "http://xcom/en/1")]
    pages = spark.createDataFrame([(*u, "theirs") for u in urls], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    found = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, url_rules.mine(none)).collect()}
    assert found == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "ex.com", "", None, "allow"), (5, "example.com", "/en/7", "example.com/en/7", "allow"),
        (6, "example.com", "/en/8", "com/en/", "block"), (7, "a.net", "/de/", "net/de/", "block"), (8, "x.example.net", "/de/8", "example.net/de/8", "block"), (8, "net", "", None, "allow"),
        (9, "b:", "//org/es/", None, "allow"), (10, "org", "/es", None, "allow"), (11, "notorg", "/es/1", None, "allow"), (12, "xcom", "/en/1", None, "allow"),
    }
    assert url_rules.judge(pages.where("false"), url_rules.mine(none)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, [1.0, 0.0]), (7, []), (None, [1.0, 1.0]), (8, [-0.001, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    frame = vector_approx.scaled(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, vec string"))
    found = {}
    for r in vector_approx.top_k(frame.where("vec_id % 50 = 0"), frame, 9).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found[0] == [(5, 65536), (6, 65536), (9, 65536), (9, 65536), (50, 32768), (7, 0), (8, -256)]
    assert found[50] == [(0, 32768), (5, 32768), (6, 32768), (9, 32768), (9, 32768), (7, 0), (8, -128)]
    assert vector_approx.top_k(frame.where("false"), frame, 5).count() == 0 and vector_approx.top_k(frame, frame.where("false"), 5).count() == 0
