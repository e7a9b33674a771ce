"""Registered queries on the smallest tables: reference SQL where there is some, brute force or held-out accuracy elsewhere."""

import duckdb
import pytest

import corpus_pipeline
from cityloom.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
MIDDLE = "/root/testdata/sf0.01"


def _sql(folder, query):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(query).fetch_df()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_reference_sql(spark, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), _sql(small, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    strip = lambda rs: [r.replace(".0,", ",").replace(".0)", ")") for r in rs]
    assert strip(rows(got)) == strip(rows(want))


def test_operators_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmarks", "mixture"]


def test_url_rules(spark, small):
    rows = QUERIES["op1_url_filter"](spark, small).collect()
    assert len(rows) == _sql(small, "SELECT count(*) AS n FROM pages").n[0]
    for r in rows:
        fits = [
            (h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
            if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)
        ]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, r.verdict))
        assert (r.rule, r.verdict) == (rule, verdict)


def test_languages_held_out(spark):
    got = QUERIES["op2_language_id"](spark, MIDDLE).toPandas().merge(_sql(MIDDLE, "SELECT doc_id, lang FROM documents"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.rejected.mean() < 0.01


def test_toxicity_held_out(spark):
    got = QUERIES["op9_toxicity"](spark, MIDDLE).toPandas().merge(_sql(MIDDLE, "SELECT doc_id, toxic FROM labels"), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.7 and held[held.toxic == 0].predicted.mean() < 0.02


def test_quality_keeps_the_good(spark):
    got = QUERIES["op5_quality_rules"](spark, MIDDLE).toPandas().merge(_sql(MIDDLE, "SELECT doc_id, quality FROM labels"), on="doc_id")
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.98 and judged[judged.quality == 0].kept.mean() < 0.2


def test_mix_meets_the_targets(spark, small):
    got = QUERIES["op6_source_mix"](spark, small).toPandas().merge(_sql(small, "SELECT doc_id, source FROM documents"), on="doc_id")
    again = QUERIES["op6_source_mix"](spark, small).toPandas().set_index("doc_id").taken.sort_index()
    assert (again == got.set_index("doc_id").taken.sort_index()).all() and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.5).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()


def test_nearest_vectors(spark, small):
    got = QUERIES["op11_nearest_vectors"](spark, small).toPandas()
    want = _sql(small, """SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings c
        ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, c.vec_id) <= 10""")
    both = got.merge(want, on=["query_id", "vec_id"])
    assert len(got) == len(want) and len(both) >= 0.9 * len(want) and ((both.score - both.d).abs() < 1e-12).all()


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        sizes.append(docs.count())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 190
    mixed = QUERIES["pipeline"](spark, small)
    words = docs.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) AS n").first().n
    assert abs(mixed.selectExpr("sum(n) AS n").first().n - 1.5 * words) < 20
