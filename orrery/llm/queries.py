"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, differencing, hosts, mixing, packing, passages, periodic, quality, repeats, secrets, simhash, topk, wavelet
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_quality_rules")
def op1(spark, sf_dir):
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


_UNIFORM = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':0' || CASE WHEN j = 0 THEN '' ELSE ':' || CAST(j AS VARCHAR) END), 1, 13)) AS BIGINT) / power(16, 13)"


@query("op9_mix_sources", f"""
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN sum(chars) OVER () / sum(CAST(chars > 0 AS INTEGER)) OVER () / chars ELSE 1 END AS whole FROM sizes
), parts AS (SELECT source, CAST(greatest(ceil(whole / {mixing.PART_RATE}), 1) AS BIGINT) AS parts, whole FROM rates),
cdf AS (
  SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, whole / parts AS rate FROM parts), unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS t(k)
), drawn AS (
  SELECT d.doc_id, d.source, {_UNIFORM} AS u FROM documents d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source, unnest(range(0, p.parts)) AS t(j)
), counted AS (
  SELECT d.doc_id, count(*) AS n FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.upto <= d.u GROUP BY d.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(copy AS INTEGER) AS copy,
       md5(CAST(d.doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR) || ':order-0') AS mix_key
FROM documents d JOIN counted c ON c.doc_id = d.doc_id, unnest(range(0, c.n)) AS t(copy)
""")
def op9(spark, sf_dir):
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def _level(name: str, groups: str, parents: str) -> str:
    """A level's posterior from its groups (name, parent, n, bad) and its parents (name, a, b)."""
    return f"""
{name}_m AS (SELECT g.*, p.a / (p.a + p.b) AS m FROM {groups} g JOIN {parents} p ON p.name = g.parent),
{name}_t AS (SELECT parent, sum(n) AS n, sum(n * n) AS nn, count(*) AS g,
  sum(CASE WHEN n > 0 THEN n * power(bad / n - m, 2) / (m * (1 - m)) ELSE 0 END) AS s FROM {name}_m GROUP BY parent),
{name}_k AS (SELECT coalesce(least(greatest(CASE WHEN x > 0 AND y > 0 THEN y / x - 1 ELSE 10000 END, 1), 10000), 10000) AS k
  FROM (SELECT sum(s) - sum(g - 1) AS x, sum(CASE WHEN n > 0 THEN n - nn / n ELSE 0 END) - sum(g - 1) AS y FROM {name}_t)),
{name} AS (SELECT name, parent, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM {name}_m, {name}_k)"""


_PART = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULES = sorted(hosts.RULES, key=lambda r: (len(r.rule), len(r.host), r.rule), reverse=True)
_SUFFIX = " ".join(f"WHEN host = '{x}' OR ends_with(host, '.{x}') THEN '{x}'" for x in sorted(hosts.SUFFIXES, key=len, reverse=True))


@query("op10_url_filters", f"""
WITH own AS (
  SELECT *, TRY_CAST(regexp_extract(path, '{hosts.DOCUMENT}', 1) AS BIGINT) AS document FROM (
    SELECT page_id, coalesce(translate({_PART.format(1)}, '{hosts.UPPER}', '{hosts.LOWER}'), '') AS host, coalesce({_PART.format(2)}, '') AS path FROM pages)
), outcome AS (
  SELECT doc_id AS document, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), h AS (
  SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM own LEFT JOIN outcome USING (document) GROUP BY host
), s AS (SELECT *, CASE {_SUFFIX} ELSE split_part(host, '.', -1) END AS suffix FROM h),
r AS (SELECT *, split_part(left(host, greatest(length(host) - length(suffix) - 1, 0)), '.', -1) AS label FROM s),
host_g AS (SELECT host AS name, CASE WHEN label = '' THEN host ELSE label || '.' || suffix END AS parent, suffix, n, bad FROM r),
domain_g AS (SELECT parent AS name, suffix AS parent, sum(n) AS n, sum(bad) AS bad FROM host_g GROUP BY 1, 2),
top_g AS (SELECT parent AS name, '' AS parent, sum(n) AS n, sum(bad) AS bad FROM domain_g GROUP BY 1),
root AS (SELECT '' AS name, {hosts.PRIOR[0]} + coalesce(sum(bad), 0) AS a, {hosts.PRIOR[1]} + coalesce(sum(n - bad), 0) AS b FROM top_g),
{_level('tops', 'top_g', 'root')}, {_level('domains', 'domain_g', 'tops')}, {_level('hosts_p', 'host_g', 'domains')},
rated AS (SELECT name, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM hosts_p)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{r.rule}'" for r in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{r.verdict}'" for r in _RULES)} WHEN low > (SELECT a / (a + b) FROM root) THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 6) AS bad_rate, round(low, 6) AS lower_bound
FROM own LEFT JOIN rated ON rated.name = own.host
""")
def op10(spark, sf_dir):
    """A page is the document that its url names, and is blocked when its host's lower bound passes the overall rate."""
    return hosts.judge_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), document=hosts.document_of(F.col("url")), lift=1.0)


@query("op3_wavelet_tokens")
def op3(spark, sf_dir):
    return wavelet.read_docs(spark, wavelet.write_tokens(read_table(spark, sf_dir, "documents")))


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op8_simhash_dedup")
def op8(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op2_secret_scan")
def op2(spark, sf_dir):
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query("op6_topk_search", f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5
""")
def op6(spark, sf_dir):
    return topk.nearest(read_table(spark, sf_dir, "embeddings"))


@query("op7_substring_dedup", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS win FROM w, unnest(range(1, len(words) - 48)) AS t(pos)
), f AS (SELECT win, min(doc_id) AS low FROM s GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (
    SELECT s.doc_id, unnest(range(s.pos, s.pos + 50)) AS p FROM s JOIN f USING (win) WHERE s.doc_id > f.low) GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text FROM (
    SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, coalesce(places, []) AS places FROM w LEFT JOIN gone USING (doc_id))
  WHERE NOT list_contains(places, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op7(spark, sf_dir):
    return passages.remove_passages(read_table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op11_karmarkar_karp_packing")
def op11(spark, sf_dir):
    return differencing.pack(read_table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    return periodic.run_report(periodic.periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=periodic.repeat_tail))


_NEAREST = """SELECT v.r, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM v, c{0} AS c GROUP BY v.r"""


def _round(k: int) -> str:
    """Centroids after round ``k`` from those before it."""
    return f"""
a{k} AS MATERIALIZED ({_NEAREST.format(k - 1)}),
s{k} AS (SELECT best.c AS c, i, CAST(sum(v.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN v USING (r), range(1, {clusters.DIMENSIONS} + 1) AS t(i) GROUP BY 1, 2),
c{k} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{k - 1} o LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY c) n USING (c)),"""


@query("op13_centroid_clusters", f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {clusters.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v)
  WHERE c < {clusters.CLUSTERS}
),{"".join(_round(k) for k in range(1, clusters.ROUNDS + 1))}
last AS MATERIALIZED ({_NEAREST.format(clusters.ROUNDS)})
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN c{clusters.ROUNDS} AS c ON c.c = best.c
""")
def op13(spark, sf_dir):
    return clusters.cluster(read_table(spark, sf_dir, "embeddings")).drop("centroid")
