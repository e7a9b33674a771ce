"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from cityloom.llm import decontaminate, langid, mixing, neardup, quality, substring, tokencount, toxicity, urlfilter, warc

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} x{k}" for k in range(60_000))
PASSAGE = " ".join(f"p{k}" for k in range(30))

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", None, "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, PASSAGE, "fr", None, 1),
    (7, "before " + PASSAGE + " after", "fr", "c", 1),
    (7, "before " + PASSAGE + " after", "fr", "c", 1),
    (None, PASSAGE, "fr", "c", 1),
    (8, "日本語 ünïcödé 🙂🙂 'tis <|endoftext|>", None, "é", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def _clash(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in ("N_Words", "score", "size", "node", "u", "key", "h", "doc", "ref", "taken")})


def test_url_filter(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://NET/a"), (5, "http://x.Example.NET/en/1?q"), (None, "ftp://a.org/fr/"), (6, "http://é.com/de/#x")]
    urls += [(6, "http://é.com/de/#x"), (7, "http://example.com/de/" + "a" * 5000), (8, "http://h?x=/y"), (9, "a://b://c/d")]
    pages = spark.createDataFrame([(i, u, "own") for i, u in urls], "page_id long, url string, host string")
    out = urlfilter.filter_urls(pages)
    assert out.columns == ["page_id", "url", "path", "host", "rule", "verdict", "score"] or set(out.columns) == {"page_id", "url", "host", "path", "rule", "verdict", "score"}
    got = {(r.page_id, r.url): r for r in out.collect()}
    assert out.count() == len(urls)
    assert (got[1, None].host, got[1, None].path, got[1, None].rule) == ("", "", None)
    assert (got[5, urls[4][1]].rule, got[5, urls[4][1]].verdict, got[5, urls[4][1]].host) == ("example.net/en/", "allow", "x.example.net")
    assert (got[4, urls[3][1]].rule, got[4, urls[3][1]].verdict) == ("net/", "block")
    assert (got[8, urls[9][1]].host, got[8, urls[9][1]].path) == ("h", "")
    assert (got[9, urls[10][1]].host, got[9, urls[10][1]].path) == ("b:", "//c/d")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urlfilter.filter_urls(pages.limit(0)).collect() == []
    only = urlfilter.filter_urls(pages.where("page_id = 4")).collect()[0]
    assert (only.verdict, only.score) == ("block", None)


def test_language(docs, none):
    model = langid.fit(docs)
    out = langid.identify(_clash(docs), model)
    got = out.collect()
    assert len(got) == len(ROWS) and "N_Words" in out.columns and out.schema["score"].dataType.simpleString() == "double"
    for r in got:
        assert r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert langid.identify(none, model).collect() == []
    empty = langid.fit(none)
    assert {(r.lang_pred, r.rejected) for r in langid.identify(docs, empty).collect()} == {("und", True)}


def test_token_counts(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    known = Tokenizer.from_file(path)
    rows = tokencount.token_counts(_clash(docs), path).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(known.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert tokencount.token_counts(none, path).collect() == []


def test_substring(docs, none):
    out = substring.remove_repeats(_clash(docs))
    got = {(r.doc_id, r.source): r for r in out.collect()}
    assert out.count() == len(ROWS) and "n_words" in out.columns and "N_Words" not in out.columns
    assert (got[6, None].n_words, got[6, None].n_removed) == (30, 0)
    assert got[7, "c"].text == "before after" and got[7, "c"].n_removed == 30  # equal rows keep the same
    assert got[None, "c"].text == "" and got[None, "c"].n_removed == 30  # a null id comes last
    assert got[2, None].text is None and got[5, "b"].text == LONG
    assert substring.remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, cover=(0, 1, 2))


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(_clash(docs), labels)
    got = quality.judge(_clash(docs), rules).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert (by[2].n_words, by[2].base_failed, by[2].kept) == (0, True, False)
    assert by[5].n_words == 120_000 and by[8].word_chars == len("日本語ünïcödé🙂🙂'tis<|endoftext|>") and by[8].n_symbols == 4
    assert quality.fit(none, labels) == [] and quality.judge(none, []).collect() == []


def test_mix(docs, none):
    drawn = mixing.draw(mixing.measure(_clash(docs)))
    rows = drawn.collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken <= 2 * r.size and r.taken == sum(p.n for p in r.pieces) for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [r.target, r.source_size, 0, 0])
        t[2], t[3] = t[2] + r.taken, t[3] + r.size
    assert all(abs(t[0] - t[2]) <= 0.5 and t[1] == t[3] for t in by.values())
    named = docs.withColumns({c: F.lit(f"own {c}") for c in ("__source", "__order", "__AT", "__bucket", "__n", "__tie")})
    again = mixing.draw(mixing.measure(named)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in again) == sorted((r.doc_id or 0, r.taken) for r in rows) and again[0]["__AT"] == "own __AT"
    assert mixing.draw(mixing.measure(none)).collect() == [] and mixing.shards(mixing.draw(mixing.measure(none))).collect() == []
    pieces = mixing.shards(drawn).collect()
    assert sum(len(p.text.split()) for p in pieces) == sum(r.taken for r in rows)


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "Lazy DOG"), (None, "quick"), (1, PASSAGE)], "item_id long, text string")
    got = decontaminate.report(_clash(docs), items).collect()
    by = {(r["__doc"], r.n_words): r for r in got}
    assert len(got) == len(ROWS)  # repeated rows and rows without an id, too
    assert by[1, 12].n_hit == 2 and by[1, 12].item_list == ["4"]
    assert by[7, 32].n_hit == 30 and by[7, 32].item_list == ["1"]
    assert by[2, 0].n_hit == 0 and by[2, 0].item_list == []
    kept = decontaminate.keep_clean(_clash(docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 8] and kept.columns == _clash(docs).columns
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.report(none, items).collect() == []
    blocks = decontaminate.report(docs, items, block_items=1).select("__doc", "n_words", "n_hit", "item_list")
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, decontaminate.report(docs, items).select(*blocks.columns).collect()))


def test_neardup(docs, none):
    got = {r.doc_id: r.class_id for r in neardup.duplicate_classes(_clash(docs)).collect()}
    assert got == {k: k for k in range(1, 9)} | {7: 6}
    kept = neardup.keep_first(_clash(docs))
    assert kept.columns == _clash(docs).columns and kept.count() == len(ROWS) - 2
    assert neardup.duplicate_classes(none).collect() == [] and neardup.keep_first(none).collect() == []


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(_clash(docs), labels)
    got = toxicity.score(_clash(docs), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score(none, model).collect() == []
    flat = toxicity.fit(none, labels)
    assert {r.predicted for r in toxicity.score(docs, flat).collect()} == {0}


def test_warc(spark):
    pages = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nEvil: 1", None), (4, "u", ""), (None, "n", "x"), (5, "é", "日本" * 100_000), (2, None, "x")]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (r.page_id or "", r.url or ""))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (None, "revisit", "2"), ("1", "revisit", "2"), ("2", "response", None), ("2", "response", None),
        ("3", "revisit", "4"), ("4", "response", None), ("5", "response", None),
    ]
    assert got[4].url == pages[2][1] and got[6].payload.decode() == pages[5][2] and got[6].payload_bytes == 600_000
    assert warc.round_trip(df.limit(0)).collect() == []
    far = {r.record_type for r in warc.round_trip(df, min_bytes=10).collect()}
    assert far == {"response"}
