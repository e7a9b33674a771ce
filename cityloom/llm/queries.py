"""Queries that apply each operator to its whole table, and reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from cityloom.llm import ann, decontaminate, langid, merkle, mixing, neardup, quality, spelling, substring, tokencount, toxicity, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 3 == 1


@_query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    judged = urlfilter.filter_urls(_table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@_query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.fit(docs.where(~_held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


@_query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(_table(spark, folder, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


@_query(
    "op4_substring_dedup",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
low AS (SELECT k, min({'d': doc_id, 'i': i}) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j
         FROM win JOIN low USING (k) WHERE m.d <> doc_id OR m.i <> i)),
one AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS body, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, folder, "documents"), with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op8_minhash_neardup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    classes = neardup.duplicate_classes(_table(spark, folder, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


@_query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.fit(docs, _table(spark, folder, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept")


@_query("op6_source_mix")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.measure(_table(spark, folder, "documents")).select("doc_id", "source", "size")
    return mixing.draw(sizes).select("doc_id", "size", "source_size", "target", "taken")


@_query(
    "op7_decontamination",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, ws[i:i+12] AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM b WHERE len(ws) > 0)),
ln AS (SELECT DISTINCT len(k) AS n FROM bw),
dw AS (SELECT doc_id, i, n, ws[i:i+n-1] AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ln WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        F.nullif(F.col("__doc"), F.lit(-(2**63))).alias("doc_id"), "n_words", "n_hit",
        F.size("item_list").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_list", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@_query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs.where(~_held_out()), _table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", "predicted")


@_query(
    "op10_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    back = warc.round_trip(pages)
    kind = pages.schema["page_id"].dataType
    return back.select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)
    )


@_query("op11_nearest_vectors")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    index = ann.calibrate(ann.build(vectors))
    return ann.search(index, vectors.where(F.col("vec_id") % 100 == 0))


@_query(
    "op12_spelling_variants",
    r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hex AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS x FROM runs),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
            lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) AS h FROM hex),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM hashed),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gone AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b USING (i, v) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN w b ON a.v = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN w b ON a.v = b.word),
near AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
best AS (SELECT word, other AS form, other_n AS form_n FROM pairs WHERE other_n >= 10 * n
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
walk AS (SELECT word, word AS root FROM w UNION ALL SELECT walk.word, best.form FROM walk JOIN best ON best.word = walk.root),
ends AS (SELECT word, root FROM walk ANTI JOIN best ON best.word = walk.root)
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM w JOIN ends USING (word) LEFT JOIN near USING (word) LEFT JOIN best USING (word)
""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


@_query(
    "op13_merkle_manifest",
    """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
         coalesce(strlen(lang) || ':' || lang, '-')) AS a, coalesce(strlen(text) || ':' || text, '-') AS b FROM documents),
leaf AS (SELECT doc_id, lang, sha256(concat(a, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), b)) AS h,
         sha256(concat(a, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-'), b)) AS changed FROM f),
lv AS (SELECT lang, 0 AS lvl, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, h FROM leaf
       UNION ALL
       SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY lang, lvl, n, i // 2),
top AS (SELECT 0 AS lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, lang, h FROM lv WHERE n = 1
        UNION ALL
        SELECT lvl + 1, i // 2, (n + 1) // 2, NULL, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, n, i // 2),
sub AS (SELECT lang, i, h AS subroot FROM top WHERE lvl = 0),
one AS (SELECT h AS root FROM top WHERE n = 1),
mine AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS i FROM leaf),
step AS (SELECT m.doc_id, s.lvl, s.i % 2 AS side, s.h FROM mine m JOIN lv s ON s.lang IS NOT DISTINCT FROM m.lang AND s.n > 1 AND s.i = xor(m.i >> s.lvl, 1)
         UNION ALL
         SELECT m.doc_id, 1000 + s.lvl, s.i % 2, s.h FROM mine m JOIN sub ON sub.lang IS NOT DISTINCT FROM m.lang JOIN top s ON s.n > 1 AND s.i = xor(sub.i >> s.lvl, 1)),
rungs AS (SELECT m.doc_id, s.lvl FROM mine m JOIN (SELECT DISTINCT lang, lvl FROM lv WHERE n > 1) s ON s.lang IS NOT DISTINCT FROM m.lang
          UNION ALL SELECT m.doc_id, 1000 + s.lvl FROM mine m, (SELECT DISTINCT lvl FROM top WHERE n > 1) s),
proof AS (SELECT doc_id, list({'side': coalesce(side, 1), 'h': coalesce(h, '')} ORDER BY lvl) AS p FROM rungs LEFT JOIN step USING (doc_id, lvl) GROUP BY doc_id),
bad AS (SELECT doc_id, xor(list_reduce(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT)),
            lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))), 4294967295), 4294967295) % 7 = 0 AS bad FROM leaf),
done AS (SELECT m.doc_id, m.h AS leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.h), ''), '')) AS proof_sha256,
         coalesce(list_reduce(list_transform(p, lambda x: {'side': x.side, 'h': x.h}), lambda acc, x: {'side': 0, 'h': sha256(CASE WHEN x.side = 0 THEN x.h || acc.h ELSE acc.h || x.h END)},
                  {'side': 0, 'h': CASE WHEN bad THEN changed ELSE m.h END}).h, CASE WHEN bad THEN changed ELSE m.h END) AS folded_root
         FROM mine m JOIN sub ON sub.lang IS NOT DISTINCT FROM m.lang CROSS JOIN one LEFT JOIN proof USING (doc_id) JOIN bad USING (doc_id))
SELECT *, folded_root = root AS verified FROM done
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    proven = merkle.manifest(_table(spark, folder, "documents"))
    wrong = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    start = F.when(wrong, F.col("tampered")).otherwise(F.col("leaf"))
    return proven.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.proof_text(F.col("left"), F.col("right")), 256).alias("proof_sha256"),
        merkle.fold(start, F.col("left"), F.col("right")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
