"""Document queries: chunking, identities and corpus figures over `documents`; `conversations` stand for blocks in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import est_tokens, truncate_utf8
from ..operators import chunking as C
from .catalogue import query, table

PIECES = """pieces0 AS (SELECT doc_id, CASE WHEN length(text) <= 512 THEN [text] ELSE list_transform(range(0, length(text), 448), lambda i: substr(text, CAST(i AS BIGINT) + 1, 512)) END AS ps FROM documents),
pieces1 AS (SELECT doc_id, list_filter(ps, lambda p: length(regexp_replace(p, '\\s', '', 'g')) > 0) AS ps FROM pieces0),
pieces AS (SELECT doc_id, unnest(ps) AS piece, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS seq FROM pieces1)"""
UID = "{0} || '-fixed-L' || {1} || '-' || lpad(CAST({2} AS VARCHAR), 5, '0') || '-' || substr(sha1({0} || '|fixed|' || {1} || '|' || {2}), 1, 16)"
TOKENS = "CAST(length(regexp_replace({0}, '[^一-鿿]', '', 'g')) + (length({0}) - length(regexp_replace({0}, '[^一-鿿]', '', 'g'))) // 3 AS INTEGER)"


def docs(spark, d):
    return table(spark, d, "documents")


@query("chunk_fixed", f"WITH {PIECES} SELECT doc_id, seq, CAST(length(piece) AS INTEGER) AS chars, sha1(piece) AS digest FROM pieces")
def chunk_fixed(spark, d):
    return C.chunk_fixed(docs(spark, d)).select("doc_id", "seq", F.length("piece").alias("chars"), F.sha1("piece").alias("digest"))


@query("chunk_uid", f"WITH {PIECES} SELECT doc_id, seq, {UID.format(chr(39) + 'd' + chr(39) + ' || doc_id', 1, 'seq')} AS chunk_uid FROM pieces")
def chunk_uid(spark, d):
    from ..functions.text import chunk_uid as uid

    return C.chunk_fixed(docs(spark, d)).select("doc_id", "seq", uid(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("fixed"), F.lit(1), F.col("seq")).alias("chunk_uid"))


@query("est_tokens", f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def est_tokens_(spark, d):
    return docs(spark, d).select("doc_id", est_tokens(F.col("text")).alias("tokens"))


@query(
    "truncate_utf8",
    """WITH h AS (SELECT doc_id, text, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 61 THEN text ELSE decode(unhex(substr(x, 1, 2 * CASE WHEN substr(x, 123, 1) NOT IN ('8', '9', 'A', 'B') THEN 61 WHEN substr(x, 121, 1) NOT IN ('8', '9', 'A', 'B') THEN 60 WHEN substr(x, 119, 1) NOT IN ('8', '9', 'A', 'B') THEN 59 ELSE 58 END))) END AS cut, n > 61 AS truncated FROM h""",
)
def truncate(spark, d):
    return docs(spark, d).select("doc_id", truncate_utf8(F.col("text"), 61).alias("cut"), (F.octet_length(F.encode("text", "UTF-8")) > 61).alias("truncated"))


@query("content_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "group_parents",
    """WITH RECURSIVE b AS (SELECT conv_id AS doc, turn AS seq, CASE WHEN role = 'system' THEN 'table' ELSE 'text' END AS kind, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS heading, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT doc, seq, i, kind <> 'table' AS open, heading, CAST(chars AS BIGINT) AS chars, 0 AS parent FROM b WHERE i = 1
UNION ALL SELECT b.doc, b.seq, b.i, b.kind <> 'table', CASE WHEN x.fresh THEN b.heading ELSE f.heading END, CAST(CASE WHEN x.fresh THEN 0 ELSE f.chars END + b.chars AS BIGINT), f.parent + CASE WHEN x.fresh THEN 1 ELSE 0 END
  FROM f JOIN b ON b.doc = f.doc AND b.i = f.i + 1, LATERAL (SELECT b.kind = 'table' OR NOT f.open OR f.heading <> b.heading OR f.chars + b.chars > 3000 AS fresh) AS x)
SELECT doc, seq, parent FROM f""",
)
def group_parents(spark, d):
    """Turns stand for blocks: system turns for tables, length classes for headings."""
    blocks = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), F.when(F.col("role") == "system", "table").otherwise("text").alias("kind"),
        F.when(F.length("text") > 400, "long").otherwise("short").alias("heading"), F.length("text").cast("long").alias("chars"),
    )
    return C.group_parents(blocks)


@query(
    "chunk_document",
    f"""WITH {PIECES}, d AS (SELECT 'd' || doc_id AS k, source AS h, text, doc_id FROM documents),
p AS (SELECT {UID.format('k', 0, 0)} AS chunk_uid, 0 AS level, CAST(NULL AS VARCHAR) AS parent_uid, 0 AS seq, {TOKENS.format('text')} AS token_count, CASE WHEN starts_with(text, h) THEN text ELSE h || chr(10) || text END AS content FROM d),
c0 AS (SELECT k, seq, CASE WHEN starts_with(piece, h) THEN piece ELSE h || chr(10) || piece END AS body FROM pieces JOIN d USING (doc_id)),
c AS (SELECT {UID.format('k', 1, 'seq')} AS chunk_uid, 1 AS level, {UID.format('k', 0, 0)} AS parent_uid, seq, {TOKENS.format('body')} AS token_count, body AS content FROM c0)
SELECT chunk_uid, level, parent_uid, seq, token_count, md5(content) AS digest FROM (SELECT * FROM p UNION ALL SELECT * FROM c)""",
)
def chunk_document(spark, d):
    keyed = docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_key"), F.col("source").alias("heading"), "text")
    return C.chunk_document(keyed).withColumn("digest", F.md5("content")).drop("content")


TURNS = """b AS (SELECT 'k' || conv_id AS doc, CAST(turn AS INTEGER) AS seq, CASE WHEN role = 'system' THEN 'table' ELSE 'text' END AS kind, CASE WHEN length(text) > 400 THEN 'long' ELSE 'short' END AS heading, coalesce(text, '') AS text, CAST(turn // 3 + 1 AS INTEGER) AS page,
  CASE WHEN turn % 4 = 0 THEN '元' END AS unit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn IS NOT NULL),
f AS (SELECT doc, seq, i, kind <> 'table' AS open, heading, CAST(length(text) AS BIGINT) AS chars, 0 AS parent FROM b WHERE i = 1
UNION ALL SELECT b.doc, b.seq, b.i, b.kind <> 'table', CASE WHEN x.fresh THEN b.heading ELSE f.heading END, CAST(CASE WHEN x.fresh THEN 0 ELSE f.chars END + length(b.text) AS BIGINT), f.parent + CASE WHEN x.fresh THEN 1 ELSE 0 END
  FROM f JOIN b ON b.doc = f.doc AND b.i = f.i + 1, LATERAL (SELECT b.kind = 'table' OR NOT f.open OR f.chars + length(b.text) > 3000 AS fresh) AS x),
g AS (SELECT b.doc, f.parent, arg_min(kind, b.seq) AS kind, arg_min(b.heading, b.seq) AS heading, arg_min(CASE WHEN unit IS NULL THEN '-' ELSE unit END, b.seq) AS u, string_agg(text, chr(10) ORDER BY b.seq) AS text, min(page) AS page_start, max(page) AS page_end FROM b JOIN f ON f.doc = b.doc AND f.seq = b.seq GROUP BY 1, 2),
cut AS (SELECT *, CASE WHEN kind = 'table' OR length(text) <= 512 THEN [text] ELSE list_filter(list_transform(range(0, length(text), 448), lambda i: substr(text, CAST(i AS BIGINT) + 1, 512)), lambda p: length(regexp_replace(p, '\\s', '', 'g')) > 0) END AS ps FROM g WHERE kind = 'text' OR length(text) <= 2048 OR length(text) - length(replace(text, chr(10), '')) < 3),
each AS (SELECT doc, parent, kind, heading, u, page_start, page_end, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM cut WHERE NOT (kind = 'text' AND length(regexp_replace(text, '\\s', '', 'g')) = 0)),
kids AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY parent, k) - 1 AS INTEGER) AS seq, CASE WHEN starts_with(piece, heading) THEN piece ELSE heading || chr(10) || piece END AS body FROM each)"""


@query(
    "assemble_chunks",
    f"""WITH RECURSIVE {TURNS} SELECT {UID.format('doc', 0, 'parent')} AS chunk_uid, doc AS doc_key, CAST(NULL AS VARCHAR) AS parent_uid, 0 AS level, CAST(parent AS INTEGER) AS seq, kind AS chunk_type, heading AS heading_path, page_start, page_end, nullif(u, '-') AS unit, {TOKENS.format('text')} AS token_count,
md5(CASE WHEN starts_with(text, heading) THEN text ELSE heading || chr(10) || text END) AS digest FROM g
UNION ALL SELECT {UID.format('doc', 1, 'seq')}, doc, {UID.format('doc', 0, 'parent')}, 1, seq, kind, heading, page_start, page_end, nullif(u, '-'), {TOKENS.format('body')}, md5(body) FROM kids""",
)
def assemble_chunks(spark, d):
    """Turns stand for blocks of several headings, pages and units, system turns for tables."""
    turns = table(spark, d, "conversations").select(
        F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("doc_key"), F.col("turn").cast("int").alias("seq"), F.when(F.col("role") == "system", "table").otherwise("text").alias("kind"), "text",
        F.when(F.length("text") > 400, "long").otherwise("short").alias("heading_path"), F.floor(F.col("turn") / 3 + 1).cast("int").alias("page_start"), F.floor(F.col("turn") / 3 + 1).cast("int").alias("page_end"), F.when(F.col("turn") % 4 == 0, "元").alias("unit"),
        F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("statement_type"), F.array().cast("array<string>").alias("flags"),
    )
    out = C.assemble(turns, "fixed")
    return out.select("chunk_uid", "doc_key", "parent_uid", "level", "seq", "chunk_type", "heading_path", "page_start", "page_end", "unit", "token_count", F.md5("content").alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    """Rows only: the splitter is a loop whose depth the text decides."""
    return C.chunk_recursive(docs(spark, d))


@query("embed_cost", "SELECT doc_id, round(n_chars / 1000.0::DOUBLE * 0.0005::DOUBLE, 8) AS cost FROM documents")
def embed_cost(spark, d):
    return docs(spark, d).select("doc_id", F.round(F.col("n_chars") / 1000.0 * F.lit(0.0005), 8).alias("cost"))


@query("corpus_profile", f"SELECT lang, count(*) AS docs, count(*) FILTER (n_chars < 20) AS near_empty, max(n_chars) AS longest, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS tokens, count(*) FILTER (contains(text, '|')) AS with_tables FROM documents GROUP BY 1")
def corpus_profile(spark, d):
    return docs(spark, d).groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(F.col("n_chars") < 20).alias("near_empty"), F.max("n_chars").alias("longest"),
        F.sum(est_tokens(F.col("text"))).alias("tokens"), F.count_if(F.col("text").contains("|")).alias("with_tables"),
    )


@query("strategy_counts", "SELECT source AS strategy, count(*) AS n FROM documents GROUP BY 1")
def strategy_counts(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("strategy")).agg(F.count("*").alias("n"))


@query("list_documents", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 50")
def list_documents(spark, d):
    """A listing is limited by nature: the 50 largest of a language."""
    return docs(spark, d).where("lang = 'fr'").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("available_corpus", "SELECT DISTINCT lang AS company_code, source AS company_name FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def available_corpus(spark, d):
    ready = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return docs(spark, d).join(ready, "doc_id", "left_semi").select(F.col("lang").alias("company_code"), F.col("source").alias("company_name")).distinct()
