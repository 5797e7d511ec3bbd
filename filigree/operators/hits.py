"""From questions to the hits that a model is shown: filters below the ranking, the mode of a search, reranking by a service's scores,
parents within a budget, citations.

Chunks here are rows of schema.TABLES["chunks"] with company_code and report_year; questions are (qid, text); hits (qid, id, score, rank), id
being the chunk_uid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import questions as Q
from . import retrieval as R

#: What a hit shows of its chunk.
OUTPUT_FIELDS = ("chunk_uid", "content", "doc_key", "company_code", "report_year", "period", "chunk_type", "statement_type", "unit", "heading_path", "page_start", "parent_uid")
SUMMARY_TYPE, SNIPPET = "table_summary", 160
MODES = ("dense", "sparse", "hybrid")


@dataclass
class Filters:
    """What a search is limited to; empty lists and None leave things open. years are those of the data, not of the filing."""

    company_codes: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    statement_type: str | None = None
    chunk_type: str | None = None

    def is_empty(self) -> bool:
        return not (self.company_codes or self.years or self.statement_type or self.chunk_type)

    def condition(self, strategy: str) -> Column:
        """One condition on chunks, to stand below any ranking. The strategy always takes part."""
        parts = [F.col("strategy") == strategy]
        if self.company_codes:
            parts.append(F.col("company_code").isin(self.company_codes))
        if self.years:
            parts.append(F.col("report_year").isin(sorted({y + k for y in self.years for k in range(Q.COVERS)})))
        if self.statement_type:
            parts.append(F.col("statement_type") == self.statement_type)
        if self.chunk_type:
            parts.append(F.col("chunk_type") == self.chunk_type)
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out


def allowed(codes: str = "codes", years: str = "years") -> Column:
    """The same for pairs of a question (with arrays of codes and years) and a chunk, where each question has filters of its own."""
    company = (F.size(codes) == 0) | F.array_contains(F.col(codes), F.col("company_code"))
    filed = Q.report_years(F.col(years))
    return company & ((F.size(filed) == 0) | F.array_contains(filed, F.col("report_year")))


def searches(chunks: DataFrame, questions: DataFrame, modes: Sequence[str], top_dense: int = 20, top_sparse: int = 20, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> dict[str, DataFrame]:
    """hits of each mode: dense (vectors (id, v) by asked (qid, v)), sparse (BM25), hybrid (both, fused by rank). Only what the modes need is
    done, and once for all of them. chunks (id, text) and vectors are filtered before."""
    for mode in modes:
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}; there are {', '.join(MODES)}")
        if mode != "sparse" and (vectors is None or asked is None):
            raise ValueError(f"mode {mode} needs vectors")
    out = {}
    if set(modes) != {"sparse"}:
        out["dense"] = R.dense(vectors, asked, top_dense)
        if {"dense", "hybrid"} <= set(modes):
            out["dense"] = materialise(out["dense"], "hits")
    if set(modes) != {"dense"}:
        out["sparse"] = R.bm25(chunks, questions, top_sparse or top_dense)
    if "hybrid" in modes:
        out["hybrid"] = R.fuse(out["dense"], out["sparse"], max(top_dense, top_sparse))
    return {mode: out[mode] for mode in modes}


def search(chunks: DataFrame, questions: DataFrame, mode: str, top_dense: int = 20, top_sparse: int = 20, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """hits of one mode."""
    return searches(chunks, questions, [mode], top_dense, top_sparse, vectors, asked)[mode]


def project(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the fields that are shown."""
    return hits.join(chunks.select(F.col("chunk_uid").alias("id"), *OUTPUT_FIELDS), "id").select("qid", "rank", "score", *OUTPUT_FIELDS)


def rerank(hits: DataFrame, scores: DataFrame | None, top_n: int | None = None, enabled: bool = True) -> DataFrame:
    """hits and degraded (array of marks) after a reranking service: scores (qid, idx, score), idx being the place of a hit from 0 in the order
    that the service was given. The service's scores take the place of the search's; what it says of places that are none is dropped. Disabled, each list is cut at
    top_n as it stands; so it is, with a mark, for questions that the service has not answered (no scores at all)."""
    keep = F.lit(True) if top_n is None else F.col("rank") <= top_n
    nothing = F.array().cast("array<string>")
    if not enabled:
        return hits.where(keep).withColumn("degraded", nothing)
    skipped = F.array(F.lit("rerank_skipped"))
    if scores is None:
        return hits.where(keep).withColumn("degraded", skipped)
    served = scores.select("qid").distinct()
    placed = hits.withColumn("idx", F.col("rank") - 1).drop("score", "rank").join(scores.select("qid", "idx", F.col("score").cast("double").alias("score")), ["qid", "idx"])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "idx")
    ranked = placed.withColumn("rank", F.row_number().over(order)).where(keep).drop("idx").withColumn("degraded", nothing)
    rest = hits.join(served, "qid", "left_anti").where(keep).withColumn("degraded", skipped)
    return ranked.select(*rest.columns).unionByName(rest)


def summary_rows(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id) of the summary tables of each question's companies; questions (qid, codes)."""
    tables = chunks.where(F.col("chunk_type") == SUMMARY_TYPE).select(F.col("chunk_uid").alias("id"), "company_code")
    of_some = questions.select("qid", F.explode("codes").alias("company_code")).join(tables, "company_code").select("qid", "id")
    return of_some.distinct()


def expand(hits: DataFrame, chunks: DataFrame, budget: int, enabled: bool = True, dedup: bool = True) -> DataFrame:
    """Hits (of project) become their parents, each once, in order of rank, as long as the budget of characters lasts; the first always goes in, one too long is passed over.
    A parent gives its own text, type and pages; where it has no unit, heading or page, the hit's stay. A hit without a parent stays as it is. seq, expanded and
    degraded (context_truncated:n, if n were passed over) come with the fields."""
    if not enabled:
        return hits.withColumn("seq", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).withColumn("expanded", F.lit(False)).withColumn("page_end", F.col("page_start")).withColumn("degraded", F.array().cast("array<string>"))
    parent = chunks.where("level = 0").select(F.col("chunk_uid").alias("p_uid"), F.col("content").alias("p_content"), F.col("unit").alias("p_unit"), F.col("chunk_type").alias("p_type"), F.col("heading_path").alias("p_heading"), F.col("page_start").alias("p_start"), F.col("page_end").alias("p_end"))
    hits = materialise(hits, "hits")  # read three times
    wanted = hits.select(F.col("parent_uid").alias("p_uid")).where("p_uid is not null").distinct()
    parent = parent.join(wanted, "p_uid", "left_semi")  # before the texts of other parents are gathered or shuffled
    joined = hits.join(parent, hits["parent_uid"] == parent["p_uid"], "left")
    filled = lambda p, c: F.coalesce(F.when(F.col(p).cast("string") != "", F.col(p)), F.col(c))
    there = F.col("p_uid").isNotNull()
    item = joined.select(
        "qid", "rank", "score", "doc_key", "company_code", "report_year", "period", "statement_type", there.alias("expanded"), F.coalesce("p_uid", "chunk_uid").alias("chunk_uid"),
        F.coalesce("p_content", "content").alias("content"), filled("p_unit", "unit").alias("unit"), F.coalesce("p_type", "chunk_type").alias("chunk_type"), filled("p_heading", "heading_path").alias("heading_path"),
        filled("p_start", "page_start").alias("page_start"), F.coalesce("p_end", "p_start", "page_start").alias("page_end"), F.when(~there, F.col("parent_uid")).alias("parent_uid"),
    )
    if dedup:
        item = item.withColumn("n", F.row_number().over(Window.partitionBy("qid", F.when(F.col("expanded"), F.col("chunk_uid")).otherwise(F.concat(F.lit("#"), F.col("rank").cast("string")))).orderBy("rank"))).where("n = 1").drop("n")
    # at most top-k entries a question
    listed = item.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.length("content").cast("long").alias("chars")))).alias("us"))
    fold = f"""aggregate(us, named_struct('used', 0L, 'kept', cast(array() as array<int>)), (a, u) -> if(size(a.kept) = 0 or a.used + u.chars <= {budget},
      named_struct('used', a.used + u.chars, 'kept', array_append(a.kept, u.rank)), a))"""
    folded = listed.select("qid", F.size("us").alias("all"), F.expr(fold)["kept"].alias("kept"))
    over = F.col("all") - F.size("kept")
    mark = F.when(over > 0, F.array(F.concat(F.lit("context_truncated:"), over.cast("string")))).otherwise(F.array().cast("array<string>"))
    kept = folded.select("qid", mark.alias("degraded"), F.posexplode("kept").alias("at", "rank")).select("qid", "rank", "degraded", (F.col("at") + 1).alias("seq"))
    return item.join(kept, ["qid", "rank"])


def citations(hits: DataFrame, order: str = "seq") -> DataFrame:
    """The sources of an answer, numbered from 1, with the first characters of each."""
    idx = F.row_number().over(Window.partitionBy("qid").orderBy(order)).alias("idx")
    return hits.select("qid", idx, "chunk_uid", "doc_key", "company_code", "report_year", F.col("page_start").alias("page"), F.col("heading_path").alias("heading"), "unit", "chunk_type", F.substring("content", 1, SNIPPET).alias("snippet"))


def context(hits: DataFrame, order: str = "seq") -> DataFrame:
    """qid, context: numbered paragraphs with their sources."""
    head = F.when(F.coalesce("heading_path", F.lit("")) == "", "（无章节信息）").otherwise(F.col("heading_path"))
    numbered = hits.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(order)))
    entry = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]（来源："), F.col("doc_key"), F.lit(" 第"), F.col("page_start").cast("string"), F.lit("页 · "), head, F.lit("）\n"), F.col("content"))
    listed = numbered.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))).alias("es"))  # at most top-k entries a question
    return listed.select("qid", F.array_join(F.transform("es", lambda x: x["e"]), "\n\n").alias("context"))


def retrieve(questions: DataFrame, chunks: DataFrame, strategy: str, filters: Filters | None = None, mode: str = "sparse", top_k: int = 20, top_n: int | None = None, budget: int = 12_000, vectors: DataFrame | None = None, asked: DataFrame | None = None, scores: DataFrame | None = None, reranked: bool = False, summary: bool = False) -> DataFrame:
    """The whole way of a tool call: filter, search, rerank, summary tables in front where asked for, parents. Hits of expand. vectors are (id, v) of chunk_uids;
    dense ids are longs, so vectors are joined by a number of their own: (id, chunk_uid, v)."""
    filters = filters or Filters()
    usable = chunks.where(filters.condition(strategy)).where("level = 1")
    numbered = None
    if vectors is not None:
        numbered = vectors.join(usable.select("chunk_uid"), "chunk_uid", "left_semi")
    texts = usable.select(F.col("chunk_uid").alias("id"), F.col("content").alias("text"))
    if mode == "sparse":
        hits = search(texts, questions, mode, top_k, top_k)
    else:
        ids = numbered.select("id", "chunk_uid")
        by_number = usable.join(ids, "chunk_uid").select("id", F.col("content").alias("text"))
        hits = search(by_number, questions, mode, top_k, top_k, numbered.select("id", "v"), asked).join(ids, "id").drop("id").withColumnRenamed("chunk_uid", "id")
    hits = hits.select("qid", "id", "score", "rank")
    if reranked:
        hits = rerank(hits, scores, top_n).drop("degraded")
    elif top_n is not None:
        hits = hits.where(F.col("rank") <= top_n)
    if summary:
        companies = questions.select("qid", F.array(*(F.lit(c) for c in filters.company_codes)).cast("array<string>").alias("codes"))
        hits = R.forced(hits, summary_rows(chunks.where(F.col("strategy") == strategy), companies))
    return expand(project(hits, chunks), chunks, budget)
