"""Cutting documents into parents and children, as expressions over arrays of one document's blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_uid, est_tokens
from ..sources.shared import spread
from .folds import running
from .tables import split_table

CHUNK_SIZE, OVERLAP, PARENT_CHARS = 512, 64, 3000


def fixed_pieces(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of `size` characters, each `size - overlap` after the one before; a short text whole; blank pieces go."""
    step = max(size - overlap, 1)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.filter(F.when(F.length(text) <= size, F.array(text)).otherwise(cut), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s", ""))) > 0)


def chunk_fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, seq (from 0), piece."""
    return spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(fixed_pieces(F.col("text"), size, overlap)).alias("seq", "piece"))


def group_parents(blocks: DataFrame, by_heading: bool = True, limit: int = PARENT_CHARS) -> DataFrame:
    """blocks (doc, seq, kind, heading, chars) get the number of their parent: a table stands alone; text goes on while its
    heading stays and the parent keeps within `limit` characters (one longer block makes a parent by itself). The check of
    the limit comes before the heading is noted, so the fold runs over each document's own blocks in order."""

    def step(state, kind, heading, chars):
        goes_on, held, length, n = state
        new = kind == "table" or not goes_on or (by_heading and held is not None and held != heading) or length + chars > limit
        n += new
        return (kind != "table", heading if new else held, (0 if new else length) + chars, n), n

    rows = blocks.select("doc", "seq", "kind", "heading", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    return running(rows, ["doc"], ["seq"], ["kind", "heading", "chars"], (False, None, 0, -1), step, "parent", "int").select("doc", "seq", "parent")


#: What a parsed block has.
BLOCK = "doc_key string, seq int, kind string, text string, heading_path string, page_start int, page_end int, unit string, currency string, statement_type string, flags array<string>"
_OWN = ("heading_path", "unit", "currency", "statement_type", "flags")


def _headed(text: Column) -> Column:
    """A heading is written before the text once."""
    bare = (F.length("heading_path") == 0) | F.col("heading_path").isNull() | F.startswith(text, F.col("heading_path"))
    return F.when(bare, text).otherwise(F.concat(F.col("heading_path"), F.lit("\n"), text))


def assemble(blocks: DataFrame, strategy: str = "heading", size: int = CHUNK_SIZE, overlap: int = OVERLAP, parent_child: bool = True, table_atomic: bool = True) -> DataFrame:
    """Blocks (BLOCK) become parents (level 0; none without parent_child) and their children (level 1): chunk_uid, doc_key, parent_uid,
    level, seq, chunk_type, heading_path, page_start, page_end, unit, currency, statement_type, table_flags, strategy, token_count,
    content. Blocks are grouped by group_parents, by heading if that is the strategy; a group takes all but its pages from its first block. Children of a table are pieces of whole rows,
    of up to four times the size, if tables are atomic; other text is cut at fixed places or recursively. Parents and children are each numbered through a
    document. A summary table is a type of its own. Blocks without a document or number are left out."""
    rows = blocks.select(*(F.col(c).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in BLOCK.split(", ")))).where("doc_key is not null and seq is not null")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    grouped = group_parents(rows.select(F.col("doc_key").alias("doc"), "seq", "kind", F.col("heading_path").alias("heading"), F.length("text").alias("chars")), strategy == "heading")
    owned = rows.join(grouped.select(F.col("doc").alias("doc_key"), "seq", "parent"), ["doc_key", "seq"])
    head = F.min_by(F.struct("kind", *_OWN), "seq").alias("h")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")  # of one parent
    groups = owned.groupBy("doc_key", "parent").agg(head, body.alias("text"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")).select("doc_key", "parent", "text", "page_start", "page_end", "h.*")
    summary = (F.col("kind") == "table") & F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "summary_table")
    groups = groups.withColumn("chunk_type", F.when(summary, "table_summary").otherwise(F.col("kind")))
    cut = fixed_pieces(F.col("text"), size, overlap) if strategy == "fixed" else recursive_pieces(size, overlap)(F.col("text"))
    pieces = F.when((F.col("kind") == "table") & F.lit(table_atomic), split_table(F.col("text"), size * 4)).otherwise(cut)
    groups = groups.withColumn("pieces", pieces)
    before = Window.partitionBy("doc_key").orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("first", F.coalesce(F.sum(F.size("pieces")).over(before), F.lit(0)))
    uid = lambda level, seq: chunk_uid(F.col("doc_key"), F.lit(strategy), F.lit(level), seq)
    parent_uid = uid(0, F.col("parent")) if parent_child else F.lit(None).cast("string")
    shared = ["chunk_type", "heading_path", "page_start", "page_end", "unit", "currency", "statement_type", F.coalesce("flags", F.array().cast("array<string>")).alias("table_flags"), F.lit(strategy).alias("strategy")]
    each = groups.select("*", F.posexplode("pieces").alias("at", "piece")).withColumn("seq", (F.col("first") + F.col("at")).cast("int")).withColumn("body", _headed(F.col("piece")))
    children = each.select(uid(1, F.col("seq")).alias("chunk_uid"), "doc_key", parent_uid.alias("parent_uid"), F.lit(1).alias("level"), "seq", *shared, est_tokens(F.col("body")).alias("token_count"), F.col("body").alias("content"))
    if not parent_child:
        return children
    parents = groups.select(uid(0, F.col("parent")).alias("chunk_uid"), "doc_key", F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("level"), F.col("parent").alias("seq"), *shared, est_tokens(F.col("text")).alias("token_count"), _headed(F.col("text")).alias("content"))
    return parents.unionByName(children)


def chunk_document(docs: DataFrame, strategy: str = "fixed", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_key, heading, text), one block of text each, assembled: chunk_uid, level, parent_uid, seq, token_count, content."""
    nothing = {c: k for c, k in (x.split(" ", 1) for x in BLOCK.split(", "))}
    given = {"doc_key": F.col("doc_key"), "seq": F.lit(0), "kind": F.lit("text"), "text": F.col("text"), "heading_path": F.col("heading")}
    blocks = docs.select(*(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in nothing.items()))
    return assemble(blocks, strategy, size, overlap).select("chunk_uid", "level", "parent_uid", "seq", "token_count", "content")


# The order in which a recursive splitter tries its separators.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator that occurs, which stays at the start of the piece after it; pieces merge up to size,
    with an overlap of whole pieces; longer ones are split by the separators that are left."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[k], separators[k + 1 :]
    if sep:
        head, *tail = text.split(sep)
        parts = [p for p in [head, *(sep + t for t in tail)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size and rest:
            flush()
            held.clear()
            out += split_recursive(part, size, overlap, rest)
            continue
        if held and sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def recursive_pieces(size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Callable[[Column], Column]:
    """The recursive splitter over a column of texts, as arrays. Its depth depends on the text, so it runs in Python over Arrow batches."""

    def of(texts):
        return texts.map(lambda t: split_recursive(t or "", size, overlap))

    return F.pandas_udf(of, "array<string>")


def chunk_recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, seq, piece; rows that repeat a doc_id are numbered each by itself, and so are those without one."""
    return spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(recursive_pieces(size, overlap)(F.col("text"))).alias("seq", "piece"))
