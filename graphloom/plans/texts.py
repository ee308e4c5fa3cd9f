"""Queries on files, chunks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import chunks as C
from graphloom.plans.registry import Catalogue, table
from graphloom.sources import files as S

query = Catalogue()
QUERIES, SQL = query.queries, query.sql

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BODY = r"regexp_replace(text, '\A(?:---|\+\+\+)\n(?s:.*?)\n(?:---|\+\+\+)\n', '')"


def _tok(x):
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')"


FILES = f"f AS (SELECT source_file, text AS content, sha256(text) AS sha256, len({_tok('coalesce(text, $$$$)')}) AS token_count FROM documents)".replace("$$$$", "''")


def files(spark, d):
    return S.manifest(table(spark, d, "documents").select("source_file", F.col("text").alias("content")))


@query(f"WITH {FILES} SELECT source_file, sha256, token_count FROM f")
def src_manifest(spark, d):
    return files(spark, d).select("source_file", "sha256", "token_count")


@query(f"""WITH {FILES}, cur AS (SELECT source_file, sha256 FROM f WHERE token_count > 20), old AS (SELECT source_file, CASE WHEN token_count % 5 = 0 THEN 'x' ELSE sha256 END AS sha256 FROM f WHERE token_count % 7 <> 0), done AS (SELECT DISTINCT source_file FROM chunks)
SELECT source_file, CASE WHEN o.sha256 IS NULL THEN 'new' WHEN c.sha256 IS NULL THEN 'deleted' WHEN c.sha256 <> o.sha256 THEN 'modified' WHEN source_file NOT IN (SELECT source_file FROM done WHERE source_file IS NOT NULL) THEN 'unextracted' ELSE 'same' END AS change FROM cur c FULL JOIN old o USING (source_file)""")
def src_incremental_diff(spark, d):
    """Against an earlier manifest made of the same files, with some missing and some altered."""
    f = files(spark, d)
    old = f.where("token_count % 7 <> 0").select("source_file", F.when(F.col("token_count") % 5 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return S.changes(f.where("token_count > 20"), old, table(spark, d, "chunks").select("source_file"))


@query("SELECT source_file, CASE WHEN regexp_matches(source_file, '(^|/)\\.') THEN 'skipped' WHEN lower(regexp_extract(source_file, '\\.([^./]+)$', 1)) IN ('md', 'markdown') THEN 'markdown' WHEN lower(regexp_extract(source_file, '\\.([^./]+)$', 1)) IN ('html', 'htm', 'xhtml') THEN 'html' WHEN lower(regexp_extract(source_file, '\\.([^./]+)$', 1)) IN ('txt', 'text') THEN 'text' ELSE 'other' END AS route FROM documents")
def src_route(spark, d):
    return table(spark, d, "documents").select("source_file", S.route(F.col("source_file")).alias("route"))


@query("""WITH u AS (SELECT doc_id, source_file, doc_id % 3 AS q, CASE doc_id % 4 WHEN 0 THEN '/./x/../' || source_file WHEN 1 THEN '/' || regexp_replace(source_file, '\\.[^./]*$', '') WHEN 2 THEN '/' || regexp_replace(source_file, '[^/]*$', '') ELSE '' END AS path FROM documents),
b AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN 'index' WHEN doc_id % 4 = 2 THEN source_file[:length(source_file) - length(regexp_extract(source_file, '[^/]*$'))] || 'index' WHEN doc_id % 4 = 1 THEN regexp_replace(source_file, '\\.[^./]*$', '') ELSE 'x/' || source_file END AS base FROM u)
SELECT doc_id, CASE WHEN q = 0 THEN regexp_replace(base, '\\.[^./]*$', '') || '-' || left(sha1('v=' || doc_id), 8) || '.html' WHEN doc_id % 4 = 0 THEN regexp_replace(base, '\\.[^./]*$', '') || '-' || left(sha1(path), 8) || '.html' ELSE base || '.html' END AS page,
CASE WHEN doc_id % 4 = 0 THEN CASE WHEN q = 0 THEN regexp_replace(base, '\\.[^./]*$', '') || '-' || left(sha1('v=' || doc_id), 8) || '.md' ELSE base END ELSE CASE WHEN q = 0 THEN base || '-' || left(sha1('v=' || doc_id), 8) || '.pdf' ELSE base || '.pdf' END END AS file FROM b""")
def src_url_local_path(spark, d):
    """Addresses made of the files' names: with their ending, without it, folders and the bare host, a third with a query; kept as pages and as PDF."""
    docs, name, k = table(spark, d, "documents"), F.col("source_file"), F.col("doc_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/./x/../"), name)).when(k == 1, F.concat(F.lit("/"), F.regexp_replace(name, r"\.[^./]*$", ""))).when(k == 2, F.concat(F.lit("/"), F.regexp_replace(name, "[^/]*$", ""))).otherwise("")
    url = F.concat(F.lit("https://user@Notes.example:8080"), path, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("?v="), F.col("doc_id").cast("string"))).otherwise(""))
    return docs.select("doc_id", S.local_path(url, F.lit("text/html; charset=utf-8")).alias("page"), S.local_path(url, F.lit("application/pdf")).alias("file"))


@query()
def src_html_to_md(spark, d):
    """Every document written as HTML and read back."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", S.html_to_markdown(S.markdown_to_html(F.col("text"))).alias("markdown"))


@query(f"SELECT doc_id, {_BODY} AS body FROM documents")
def chk_frontmatter(spark, d):
    return table(spark, d, "documents").select("doc_id", C.without_frontmatter(F.col("text")).alias("body"))


WINDOWS = f"""t AS (SELECT source_file, {_tok(_BODY)} AS t FROM documents WHERE text IS NOT NULL),
ch AS (SELECT source_file, (token_start // 180)::INTEGER AS chunk_index, array_to_string(t[token_start + 1 : token_start + 200], ' ') AS text, token_start::INTEGER AS token_start, least(token_start + 200, len(t))::INTEGER AS token_end FROM (SELECT *, unnest(range(0, greatest(len(t) - 20 - 1, 0) + 1, 180)) AS token_start FROM t))"""


@query(f"WITH {WINDOWS} SELECT * FROM ch")
def chk_windows(spark, d):
    return C.chunk(table(spark, d, "documents").select("source_file", F.col("text").alias("content")), 200, 20)


@query(f"WITH {FILES} SELECT source_file, greatest(1, ceil((token_count - 20) / 180.0))::INTEGER AS n FROM f")
def chk_count(spark, d):
    return files(spark, d).select("source_file", C.chunk_count(F.col("token_count"), 200, 20).alias("n"))


def _chunk_sizes(spark, d):
    c = C.chunk(table(spark, d, "documents").select("source_file", F.col("text").alias("content")), 200, 20)
    return c.select("source_file", "chunk_index", (F.col("token_end") - F.col("token_start")).cast("long").alias("tokens"))


def _packed(source, group, order):
    return f"""RECURSIVE {source}, i AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM it),
p({group}, k, used, batch) AS (SELECT {group}, k, tokens, 0 FROM i WHERE k = 1 UNION ALL SELECT i.{group}, i.k, CASE WHEN p.used + i.tokens <= 450 OR p.used = 0 THEN p.used + i.tokens ELSE i.tokens END, CASE WHEN p.used + i.tokens <= 450 OR p.used = 0 THEN p.batch ELSE p.batch + 1 END FROM i JOIN p ON i.{group} IS NOT DISTINCT FROM p.{group} AND i.k = p.k + 1)"""


@query("WITH " + _packed(WINDOWS + ", it AS (SELECT source_file, chunk_index, token_end - token_start AS tokens FROM ch)", "source_file", "chunk_index") + " SELECT source_file, chunk_index, tokens, batch FROM p JOIN i USING (source_file, k)")
def chk_pack_per_file(spark, d):
    return C.pack(_chunk_sizes(spark, d), ["source_file"], ["chunk_index"], "tokens", 450)


@query("WITH " + _packed(WINDOWS + ", it AS (SELECT 0 AS one, source_file, chunk_index, token_end - token_start AS tokens FROM ch)", "one", "source_file, chunk_index").replace("450", "4000") + " SELECT source_file, chunk_index, tokens, batch FROM p JOIN i USING (one, k)")
def chk_pack_pooled(spark, d):
    return C.pack_pooled(_chunk_sizes(spark, d), ["source_file", "chunk_index"], "tokens", 4000)


@query("WITH " + _packed(WINDOWS + ", it AS (SELECT source_file, chunk_index, token_end - token_start AS tokens FROM ch)", "source_file", "chunk_index") + " SELECT source_file, batch, source_file AS files, string_agg(source_file || '::' || (chunk_index + 1), ',' ORDER BY chunk_index) AS chunks, CAST(sum(tokens) AS BIGINT) AS total FROM p JOIN i USING (source_file, k) GROUP BY 1, 2")
def chk_batch_map(spark, d):
    p = C.pack(_chunk_sizes(spark, d), ["source_file"], ["chunk_index"], "tokens", 450).withColumn("file", F.col("source_file"))
    return C.batch_map(p, ["source_file", "batch"], "file", "chunk_index", "tokens")


_GROUPS = "it AS (SELECT regexp_replace(source_file, '/?[^/]*$', '') AS folder, regexp_replace(regexp_replace(regexp_replace(source_file, '^.*/', ''), '\\.[^.]*$', ''), '[_\\- ]*\\d+$', '') AS stem, source_file, token_count AS tokens FROM f WHERE token_count <= 450)"


@query("WITH " + _packed(FILES + ", " + _GROUPS, "folder", "stem, source_file") + " SELECT source_file, batch FROM p JOIN i USING (folder, k) UNION ALL SELECT source_file, -1 FROM f WHERE token_count > 450")
def chk_concat_map(spark, d):
    return C.concat_groups(files(spark, d).select("source_file", "token_count"), 450).select("source_file", "batch")


@query("WITH " + _packed(FILES + ", " + _GROUPS, "folder", "stem, source_file") + " SELECT folder, batch, sha256(string_agg('--- SOURCE: ' || source_file || ' ---\n' || coalesce(content, ''), '\n\n' ORDER BY stem, source_file)) AS content FROM p JOIN i USING (folder, k) JOIN f USING (source_file) GROUP BY 1, 2")
def chk_virtual_files(spark, d):
    f = files(spark, d)
    v = C.virtual_files(C.concat_groups(f.select("source_file", "token_count"), 450), f.select("source_file", "content"))
    return v.select("folder", "batch", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query(f"WITH {FILES} SELECT CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS files FROM f")
def chk_corpus_tokens(spark, d):
    return files(spark, d).agg(F.sum("token_count").alias("tokens"), F.count("*").alias("files"))


@query("SELECT doc_id, array_to_string(" + _tok("text") + "[1:12], ' ') AS head FROM documents")
def chk_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", C.truncated(F.col("text"), 12).alias("head"))
