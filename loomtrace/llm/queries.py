"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import token_files

    return token_files(_read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import url_verdicts

    return url_verdicts(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    return exact_topk(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_lm_scoring, op3_language_id, op4_pii, op5_url_filter, op6_token_counts, op7_decontamination, op8_jaccard_join, op9_best_fit_packing, op10_exact_topk)}

_TREE = ["host", "t1", "t2", "t3"]


def _level(name: str, keys: list[str], parent: list[str], up: str) -> str:
    """One level of the template tree: its shares, the pool of similar branches, and scores."""
    k = ", ".join(keys)
    on = " AND ".join(f"l.{p} = u.{p}" for p in parent) or "true"
    src = f"""
    {name}_l AS (SELECT l.*, n > 0 AND abs(bad / n - up) > 2 * sqrt(up * (1 - up) / n) AS alone FROM (
        SELECT l.*, u.score AS up FROM (SELECT {k}, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM t GROUP BY {k}) l JOIN {up} u ON {on}) l),"""
    if not parent:
        return src + f"""
    {name} AS (SELECT {k}, (CASE WHEN alone THEN bad ELSE 0 END + 5 * up) / (CASE WHEN alone THEN n ELSE 0 END + 5) AS score FROM {name}_l),"""
    pk = ", ".join(parent)
    on2 = " AND ".join(f"l.{p} = p.{p}" for p in parent)
    sel = ", ".join("l." + x for x in keys)
    return src + f"""
    {name}_p AS (SELECT {pk}, sum(n) AS n, sum(bad) AS bad FROM {name}_l WHERE NOT alone GROUP BY {pk}),
    {name} AS (SELECT {sel}, (CASE WHEN alone THEN l.bad ELSE coalesce(p.bad, 0) END + 5 * up) / (CASE WHEN alone THEN l.n ELSE coalesce(p.n, 0) END + 5) AS score
        FROM {name}_l l LEFT JOIN {name}_p p ON {on2}),"""


SQL = {
    "op5_url_filter": """
    WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    g AS (SELECT *, string_split(regexp_replace(regexp_replace(path, '[0-9]+', '*', 'g'), '^/', ''), '/') AS x FROM h),
    b AS (SELECT page_id, host, path, coalesce(x[1], '') AS s1, coalesce(x[2], '') AS s2, coalesce(array_to_string(x[3:], '/'), '') AS s3, TRY_CAST(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT) AS num FROM g),
    known AS (SELECT doc_id AS num, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    nodes AS (SELECT host, s1, s2, s3, count(*) AS pages, sum(CASE WHEN k.num IS NULL THEN 0 ELSE 1 END) AS n, sum(coalesce(k.bad, 0)) AS bad FROM b LEFT JOIN known k ON b.num = k.num GROUP BY host, s1, s2, s3),
    w1 AS (SELECT host FROM nodes GROUP BY host HAVING count(DISTINCT s1) >= 20 AND sum(pages) < 2 * count(DISTINCT s1)),
    n1 AS (SELECT n.*, CASE WHEN w.host IS NULL THEN n.s1 ELSE '*' END AS t1 FROM nodes n LEFT JOIN w1 w ON n.host = w.host),
    w2 AS (SELECT host, t1 FROM n1 GROUP BY host, t1 HAVING count(DISTINCT s2) >= 20 AND sum(pages) < 2 * count(DISTINCT s2)),
    n2 AS (SELECT n.*, CASE WHEN w.host IS NULL THEN n.s2 ELSE '*' END AS t2 FROM n1 n LEFT JOIN w2 w ON n.host = w.host AND n.t1 = w.t1),
    w3 AS (SELECT host, t1, t2 FROM n2 GROUP BY host, t1, t2 HAVING count(DISTINCT s3) >= 20 AND sum(pages) < 2 * count(DISTINCT s3)),
    t AS (SELECT n.*, CASE WHEN w.host IS NULL THEN n.s3 ELSE '*' END AS t3 FROM n2 n LEFT JOIN w3 w ON n.host = w.host AND n.t1 = w.t1 AND n.t2 = w.t2),
    root AS (SELECT (coalesce(sum(bad), 0) + 1.0) / CAST(coalesce(sum(n), 0) + 2.0 AS DOUBLE) AS score FROM nodes),""" + "".join(_level(f"l{k}", _TREE[: k + 1], _TREE[:k], f"l{k - 1}" if k else "root") for k in range(4)) + """
    refused AS (SELECT DISTINCT t.host, s1, s2, s3 FROM t JOIN l3 ON t.host = l3.host AND t.t1 = l3.t1 AND t.t2 = l3.t2 AND t.t3 = l3.t3 WHERE score > 0.5),
    o AS (SELECT b.page_id, b.host, b.path, CASE WHEN r.host IS NULL THEN 'allow' ELSE 'block' END AS judged,
        CASE WHEN (b.host = 'www.example.com' OR ends_with(b.host, '.www.example.com')) AND starts_with(b.path, '/en/') THEN 'www.example.com/en/'
             WHEN (b.host = 'example.com' OR ends_with(b.host, '.example.com')) AND starts_with(b.path, '/en/') THEN 'example.com/en/'
             WHEN (b.host = 'net' OR ends_with(b.host, '.net')) AND starts_with(b.path, '/es/') THEN 'net/es/'
             WHEN (b.host = 'net' OR ends_with(b.host, '.net')) AND starts_with(b.path, '/fr/') THEN 'net/fr/'
             WHEN (b.host = 'com' OR ends_with(b.host, '.com')) AND starts_with(b.path, '/') THEN 'com/' END AS rule
        FROM b LEFT JOIN refused r ON b.host = r.host AND b.s1 = r.s1 AND b.s2 = r.s2 AND b.s3 = r.s3)
    SELECT page_id, host, path, rule, CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE judged END AS verdict FROM o
""",
    "op8_jaccard_join": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS x FROM w),
    n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n FROM s),
    e AS (SELECT doc_id, unnest(x) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
    both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(v, u) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.v, b.b FROM reach r JOIN both_ways b ON r.u = b.a)
    SELECT n.doc_id, n.n AS n_shingles, min(r.u) AS component_id FROM n JOIN reach r ON n.doc_id = r.v GROUP BY n.doc_id, n.n
""",
    "op10_exact_topk": """
        WITH v AS (
          SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
    """,
}
