"""The queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.llm import centroids, decontam, filter_audit, html_text, minhash, mixing, neighbours, personal_data, quality, secrets, sharding, url_filter, warc
from chromloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


# --- 1: near duplicates ----------------------------------------------------------------------

DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x20\x09-\x0D]+') AS a FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) > 1 THEN list_transform(range(1, len(a)), lambda k: concat(a[k], ' ', a[k + 1]))
                      ELSE a END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT p, q FROM o JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * c >= 80 * (a.n + b.n - c)),
    e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
    r(p, q) AS (SELECT p, p FROM e UNION SELECT r.p, e.q FROM r JOIN e ON e.p = r.q),
    m AS (SELECT p, min(q) AS c FROM r GROUP BY p)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id,
       d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.p = d.doc_id
"""


@query("op1_near_duplicates", DEDUP_SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), n_words=2)


# --- 2: quality classifier -------------------------------------------------------------------


@query("op2_quality_trees")
def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


# --- 3: HTML extraction ----------------------------------------------------------------------


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# --- 4: WARC ---------------------------------------------------------------------------------


@query("op4_warc_round_trip")
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


# --- 5: benchmark decontamination ------------------------------------------------------------


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# --- 6: mixing -------------------------------------------------------------------------------

#: Fixed values of the production mix: whole-number weights of domains and languages.
MIX_WEIGHTS = {"domain": {"web": 4, "books": 3, "forums": 2, "news": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 70, 2, 17
DOMAINS = ["web", "books", "forums", "news"]


def mix_levels():
    """Domain (by the number that ends the source's name), language, source."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1)
    domain = F.when(number == "", F.lit("other")).otherwise(
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.pmod(number.cast("int"), F.lit(len(DOMAINS))) + 1))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_query(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in sorted(MIX_WEIGHTS.get(level, {}).items()))
    return f"CAST(CASE {level} {cases} ELSE 1.0 END AS DOUBLE)" if cases else "CAST(1.0 AS DOUBLE)"


def _fill_sql(depth: int) -> str:
    """Water-filling of one level: budgets of the parents to ``g{depth}``."""
    levels = ["domain", "lang", "source"]
    node, family = levels[:depth], levels[: depth - 1]
    of, by = ", ".join(node), ("PARTITION BY " + ", ".join(family)) if family else ""
    parent = f"JOIN g{depth - 1} USING ({', '.join(family)})" if family else "CROSS JOIN root"
    return f"""
    n{depth} AS (SELECT {of}, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS room, {_weight_sql(levels[depth - 1])} AS w
                 FROM leaves GROUP BY {of}),
    s{depth} AS (SELECT {of}, room, w, b, room / w AS r,
        coalesce(sum(room) OVER ({by} ORDER BY room / w, {levels[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS taken,
        sum(w) OVER ({by} ORDER BY room / w, {levels[depth - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM n{depth} {parent}),
    v{depth} AS (SELECT *, (b - taken) / rest AS level FROM s{depth}),
    o{depth} AS (SELECT {(', '.join(family) + ',') if family else ''} max(level) AS flat FROM v{depth} WHERE r > level {('GROUP BY ' + ', '.join(family)) if family else ''}),
    g{depth} AS (SELECT {of}, CASE WHEN flat IS NULL THEN room ELSE least(room, w * flat) END AS b
                 FROM v{depth} LEFT JOIN o{depth} {('USING (' + ', '.join(family) + ')') if family else 'ON true'})"""


MIX_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
             ELSE ['web', 'books', 'forums', 'news'][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4 + 1] END AS domain,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
    root AS (SELECT CAST(sum(tokens) * {MIX_PERCENT} // 100 AS DOUBLE) AS b FROM d),
    {','.join(_fill_sql(k) for k in (1, 2, 3))},
    goals AS (SELECT domain, lang, source, CAST(floor(b) AS BIGINT) AS goal, CAST(tokens AS BIGINT) AS total
              FROM g3 JOIN leaves USING (domain, lang, source)),
    cut AS (SELECT *, CASE WHEN total > 0 THEN goal // total ELSE 0 END AS whole FROM goals),
    run AS (SELECT d.*, whole, goal - whole * total AS over, sum(d.tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY substr(md5(concat_ws(':', '{MIX_SEED}', CAST(whole + 1 AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 16), d.tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN cut USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens,
       CAST(whole + CASE WHEN whole < {MIX_EPOCHS} AND upto <= over THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run
"""


@query("op6_mix_sources", MIX_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_query(read_table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "copies")


# --- 7: nearest neighbours -------------------------------------------------------------------


@query("op7_nearest_multiprobe")
def op7_nearest_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


# --- 8: secret scan --------------------------------------------------------------------------


@query("op8_scan_secrets")
def op8_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 9: sharding -----------------------------------------------------------------------------

N_SHARDS = 40


@query("op9_shard_lpt")
def op9_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), N_SHARDS).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# --- 10: URL filter --------------------------------------------------------------------------

#: Fixed rules of the contract.
RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]

#: The production list: pages that a referral link led to. Other spellings of such a URL are blocked too.
LISTED = r"[?&]ref="

URL_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query, url FROM pages),
    q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&') AS kept FROM p),
    c AS (SELECT *, concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '(/|\.html)$', ''),
               CASE WHEN kept <> '' THEN concat('?', kept) ELSE '' END) AS key,
           CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM q),
    l AS (SELECT DISTINCT key FROM c WHERE regexp_matches(url, '[?&]ref=') AND key <> '')
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM c
"""


@query("op10_filter_urls", URL_SQL)
def op10_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.col("url").rlike(LISTED)).select("url")
    return url_filter.filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


# --- 11: personal data -----------------------------------------------------------------------


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.scan(docs).select("doc_id", *personal_data.COLUMNS)


# --- 12: filter interaction audit ------------------------------------------------------------

AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS fails,
            coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN first USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
    c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o(o) AS (SELECT '' UNION ALL SELECT o || x FROM o, letters WHERE NOT contains(o, x)),
    s AS (SELECT o AS filter_order, k AS step, o[k] AS x, o[1:k - 1] AS before FROM o, range(1, 6) r(k) WHERE length(o) = 5),
    p AS (SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS hit,
            translate(fails, before, '') <> fails AS gone FROM c, s),
    t AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
            coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
            coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost
          FROM p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


# --- 13: centroid clustering -----------------------------------------------------------------


def _round_sql(k: int) -> str:
    """One round: all vectors to the nearest centroid, then floors of the means."""
    return f"""
    m{k} AS MATERIALIZED (SELECT row, any_value(v.a) AS a, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.a[i] - c.a[i]) * (v.a[i] - c.a[i]))), 'c': c.c}}) AS b
        FROM v, c{k} c GROUP BY row),
    c{k + 1} AS MATERIALIZED (WITH s AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(a) AS x, generate_subscripts(a, 1) AS j FROM m{k}) GROUP BY ALL),
        f AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS a FROM s GROUP BY c)
        SELECT o.c, coalesce(f.a, o.a) AS a FROM c{k} o LEFT JOIN f USING (c))"""


CENTROID_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS a
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, a) - 1 AS c, a
        FROM (SELECT sha256(concat('3:', vec_id)) AS h, a FROM v ORDER BY h, a LIMIT 8)),
    {','.join(_round_sql(k) for k in range(10))},
    m AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.a[i] - c.a[i]) * (v.a[i] - c.a[i]))), 'c': c.c}}) AS b
        FROM v, c10 c GROUP BY row)
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.a, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM m JOIN c10 c ON c.c = m.b.c
"""


@query("op13_centroid_clusters", CENTROID_SQL)
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))
