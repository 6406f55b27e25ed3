"""Queries of the operators in this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, infill, line_dedup, mixing, ngram_join, ogg, quality, runs, sharding, topk, url_filter, warc
from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_read(spark, sf_dir, "documents"), f"{Scratch(spark, 'op1').root}/store")
    where = F.regexp_extract("file", "[^/]+/[^/]+$", 0).alias("file")
    return out.select("row.doc_id", F.octet_length("row.text").cast("long").alias("n_bytes"), F.sha2(F.col("row.text").cast("binary"), 256).alias("text_sha256"), where, "tier", "file_rows", "file_bytes")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_jaccard_components(_read(spark, sf_dir, "documents"), num=3, den=4)
    return found.select("doc_id", "n_shingles", "component_id")


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.length("row.text").cast("long").alias("n_chars"), F.sha2(F.col("row.text").cast("binary"), 256).alias("text_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_sources(_read(spark, sf_dir, "documents")))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.encode_media(_read(spark, sf_dir, "documents")))


def op6_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    archives = f"{scratch.root}/archives"
    warc.write_archives(_read(spark, sf_dir, "pages"), archives, scratch)
    return warc.resolved(warc.read_archives(spark, archives, scratch=scratch))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i:
        substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_read(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(_read(spark, sf_dir, "documents"), bpe.default_rules()))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


OP10_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), OP10_RULES)


OP10_SQL = """
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
found AS (SELECT url, trim(replace(coalesce(nullif(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''>\\s]*)', 1), ''),
    regexp_extract(tag, '(?is)[;,]\\s*url\\s*=\\s*["'']?\\s*([^"''>]+)', 1)), '&amp;', '&')) AS link
  FROM tags WHERE regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b|\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
links AS (SELECT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^?#]*?://[^/?#]*)', 1) || link
    ELSE regexp_extract(url, '^([^?#]*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^[^?#]*?://[^/?#]*(/(?:[^/?#]*/)*)', 1), ''), '/') || link END AS target
  FROM found WHERE link <> ''),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT target FROM links),
cut AS (SELECT url, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) END AS rest FROM urls),
parts AS (SELECT url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1), '') AS query FROM cut),
rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
nodes AS (SELECT parts.url, host, path, host || path || query AS node, rule, verdict FROM parts LEFT JOIN fits ON fits.url = parts.url),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM links JOIN nodes a ON a.url = links.url JOIN nodes b ON b.url = links.target),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON t.a = r.b),
bad AS (SELECT r.a AS node FROM reach r JOIN nodes n ON n.node = r.b GROUP BY r.a
  HAVING count(*) FILTER (n.verdict = 'block') > 0 AND count(*) FILTER (n.verdict = 'allow') = 0)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule,
  coalesce(n.verdict, CASE WHEN n.node IN (SELECT node FROM bad) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN nodes n ON n.url = p.url
"""

def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.planted(_read(spark, sf_dir, "documents")), least=24, times=3)
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), runs.strongest().alias("r"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * r.length) div r.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "r.start", "r.length", "r.period", milli, "runs_sha256", "collapsed_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(_read(spark, sf_dir, "documents"), unit="word", seed=42, rate=50, spm_rate=80)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chars = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n", "form", *chars, digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substring(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substring(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substring(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substring(h, 25, 8))::BIGINT % 100 AS s FROM t),
f AS (SELECT *, CASE WHEN text = '' OR c >= 50 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN s < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS q FROM d)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f
"""


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = F.lit(r"\### Assistant: </turn> ok")
    hostile = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), quoted)
    out = chat.format_conversations(rows.union(hostile))
    turns, texts = chat.read_turns(F.col("formatted")), chat.trained_texts(F.col("segments"))
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    read = out.select("conv_id", F.transform(turns, line).alias("lines"), F.array_join(texts, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("lines").cast("long").alias("n_turns"), digest(F.array_join("lines", "")).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")


OP13_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
w AS (SELECT *, lag(role) OVER c IS DISTINCT FROM role AS begins, row_number() OVER c AS k FROM r
  WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>') AS t,
  replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>') AS o FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(t) + 6 + CASE WHEN begins THEN length(o) + 14 ELSE 0 END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_ogg_media": op5_ogg_media,
    "op6_warc_chain": op6_warc_chain,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_formatting": op13_chat_formatting,
}
ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": OP2_SQL, "op6_warc_chain": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op10_url_filters": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_chat_formatting": OP13_SQL}
