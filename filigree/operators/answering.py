"""A batch of questions from guard to verified answer, and the agent's loop over a model that the caller brings.

Each stage is a DataFrame for all questions; branches are filters, the only loop (one retry without years) is unrolled."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import questions as Q
from . import retrieval as R

SNIPPETS, SNIPPET_CHARS = 6, 1200
# Calls that were written as text, values that are computed, and how a tool says that it has nothing.
MALFORMED_CALL = re.compile(r'</?tool_call>|<\|tool_call\|>|^\s*\{\s*"(expression|company|query)"\s*:|\bcalculate\b|\bretrieve_report\b', re.M)
COMPUTED = re.compile(r"\d[\d,]*\.?\d*\s*%|百分之\s*\d")
NO_RESULT = ("未检索到", "未收录", "无法计算")
NOT_FOUND = "所提供资料中未找到相关数据。"


def answers(questions: DataFrame, chunks: DataFrame, corpus: DataFrame, top_n: int = 15, threshold: float = 0.010, year_column: str = "report_year") -> DataFrame:
    """questions (id, question), chunks (id, text, company_code, report_year), corpus (code, name, year): id, verdict, answer,
    citations. Without a model the answer is the best chunk's line that has most of the question's words; refusals say so."""
    guarded = questions.select("id", Q.guard(F.col("question")).alias("g")).select("id", "g.question", "g.refused")
    asked = guarded.where("not refused").select("id", "question")
    rules = Q.rule_analysis(asked, corpus).join(asked, "id")
    words = rules.select(F.col("id").alias("qid"), F.col("question").alias("text"))
    scores = R.bm25_scores(chunks.select("id", "text"), words)  # filtered before any ranking
    meta = chunks.select("id", "company_code", F.col(year_column).alias("report_year"))
    filters = rules.select(F.col("id").alias("qid"), "codes", Q.report_years(F.col("years")).alias("filed"))
    scored = scores.join(meta, "id").join(filters, "qid").where((F.size("codes") == 0) | F.array_contains("codes", F.col("company_code")))
    narrow = scored.where((F.size("filed") == 0) | F.array_contains("filed", F.col("report_year")))
    again = lambda df: R.top(df.select("qid", "id", "score"), "qid", F.round("score", 6), top_n)
    first = again(narrow)
    passed = R.relevance(words, first)
    failing = passed.where(F.col("relevance") < threshold).select("qid")  # only these are looked for again
    second = again(scored.join(failing, "qid", "left_semi"))
    verdict = R.gate(passed, R.relevance(words, second), threshold)
    chosen = first.join(verdict.where("verdict = 'generate'").select("qid"), "qid").unionByName(second.join(verdict.where("verdict = 'retry_generate'").select("qid"), "qid"))
    lines = chosen.where("rank <= 3").join(chunks.select("id", "text"), "id").join(words.select("qid", F.col("text").alias("q")), "qid").select("qid", "rank", "q", F.explode(F.split("text", "\n")).alias("line"))
    share = F.size(F.array_intersect(R.words(F.col("q")), R.words(F.col("line"))))
    best = lines.groupBy("qid").agg(F.max(F.struct(share.alias("n"), (-F.col("rank")).alias("r"), "line")).alias("b"))
    cited = chosen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("idx"), "id"))).alias("citations"))  # top_n a question
    made = verdict.join(best, "qid", "left").join(cited, "qid", "left")
    text = F.when((F.col("verdict") == "refuse") | F.col("b").isNull(), NOT_FOUND).otherwise(F.concat("b.line", F.lit("["), (-F.col("b.r")).cast("string"), F.lit("]")))
    done = made.select(F.col("qid").alias("id"), F.when(F.col("b").isNull(), "refuse").otherwise(F.col("verdict")).alias("verdict"), text.alias("answer"), F.coalesce(F.transform("citations", lambda c: c["id"]), F.array().cast("array<bigint>")).alias("citations"))
    refused = guarded.where("refused").select("id", F.lit("refuse").alias("verdict"), F.lit(NOT_FOUND).alias("answer"), F.array().cast("array<bigint>").alias("citations"))
    return done.unionByName(refused)


@dataclass
class Turn:
    """What a model says: text, and calls as (name, arguments)."""

    content: str = ""
    calls: list[tuple[str, dict]] = field(default_factory=list)
    cost: float = 0.0


@dataclass
class Outcome:
    answer: str
    degraded: list[str]
    steps: int
    pad: list[tuple[str, dict, str]]


def agent(question: str, model: Callable[[list[str], bool], Turn], tools: dict[str, Callable[..., str]], steps: int = Q.STEPS, errors: int = Q.ERRORS, budget: float = Q.COST) -> Outcome:
    """Calls tools as the model asks until it answers. Limits are looked at before each call: beyond them the model is told to
    answer with what there is, without tools. A call that was written as text counts as a failure and is asked for again; so does, once, a
    computed value without any calculation, and if it stays the answer is marked. An answer is never empty."""
    messages, degraded, pad = [question], [], []
    taken = failed = 0
    spent, forced, asked_again = 0.0, False, False
    while True:
        reason = "max_steps" if taken >= steps else "max_errors" if failed >= errors else "max_cost" if spent >= budget else None
        if reason and not forced:
            degraded.append(f"agent_forced_answer:{reason}")
            messages.append("answer now, without tools")
            forced = True
        turn = model(messages, not forced)
        spent += turn.cost
        if not turn.calls and not forced:
            if MALFORMED_CALL.search(turn.content):
                failed += 1
                messages.append("the last step wrote a call as text; call the tool, or answer")
                continue
            if COMPUTED.search(turn.content) and not any(name == "calculate" for name, _, _ in pad):
                if not asked_again:
                    asked_again = True
                    failed += 1
                    messages.append("the answer has a computed value, but nothing was calculated; use calculate, then answer")
                    continue
                degraded.append("agent_mental_arithmetic")
        if not turn.calls or forced:
            if not turn.content.strip():
                degraded.append("agent_empty_answer")
                return Outcome(NOT_FOUND, degraded, taken, pad)
            return Outcome(turn.content, degraded, taken, pad)
        for name, arguments in turn.calls:
            taken += 1
            try:
                result = tools[name](**arguments) if name in tools else f"no such tool: {name}; there are {', '.join(tools)}"
                failed += name not in tools or result.startswith(NO_RESULT)
            except Exception as problem:
                result, failed = f"failed: {problem}", failed + 1
            pad.append((name, arguments, result))
            messages.append(result)


def report_tool(search: Callable[[str, str, int], list[dict]], corpus: list[tuple[str, str, int]]) -> Callable[..., str]:
    """The tool that reads filings: (company, year, query) to an excerpt. A company is a code, or a name that has a known one in it or is in one;
    the year goes into the words that are searched for, as summary tables have it in their header. search (words, code, year) is the caller's."""
    names = [(name, code) for code, name, _ in corpus if name]

    def tool(company: str, year: int, query: str) -> str:
        code = company.strip()
        if code not in {c for c, _, _ in corpus}:
            code = next((c for n, c in names if n in company or company in n), None)
        if code is None:
            return f"未收录公司「{company}」。已收录：" + "、".join(f"{n}({c})" for c, n, _ in corpus)
        rows = search(f"{year}年{query}" if year else query, code, year)
        return excerpt(rows) if rows else f"未检索到 {company} {year}年 关于「{query}」的内容。"

    return tool


def calculate_tool(expression: str) -> str:
    """The tool that calculates: expression = value, or why not."""
    try:
        value = Q.calculate(expression)
    except ZeroDivisionError:
        return "无法计算：除数为零"
    except (ValueError, SyntaxError, OverflowError, TypeError) as problem:
        return f"无法计算：{problem}"
    shown = f"{value:,.2f}" if abs(value) >= 1000 else f"{value:,.4f}".rstrip("0").rstrip(".")
    return f"{expression} = {shown}"


#: The events of an answer, in the order in which they are sent.
EVENTS = ("stage", "token", "citations", "usage", "done")


def events(answers: DataFrame) -> DataFrame:
    """answers (id, verdict, answer, citations array): id, events, an ordered array of (seq, event, data as JSON): the stages, the answer in pieces of sentences, its sources,
    and the end. A refusal has no sources."""
    sentences = F.filter(F.regexp_extract_all("answer", F.lit("[^。！？\n]+[。！？\n]*"), F.lit(0)), lambda s: s != "")
    event = lambda kind, data: F.struct(F.lit(kind).alias("event"), data.alias("data"))
    stages = F.array(*(event("stage", F.to_json(F.struct(F.lit(s).alias("stage")))) for s in ("analyse", "retrieve", "answer")))
    tokens = F.transform(sentences, lambda s: event("token", F.to_json(F.struct(s.alias("text")))))
    sources = F.when((F.col("verdict") != "refuse") & (F.size("citations") > 0), F.array(event("citations", F.to_json(F.struct(F.col("citations").alias("ids")))))).otherwise(F.array().cast("array<struct<event:string,data:string>>"))
    done = F.array(event("done", F.to_json(F.struct(F.col("verdict").alias("verdict")))))
    numbered = F.transform(F.concat(stages, tokens, sources, done), lambda e, i: F.struct((i + 1).alias("seq"), e["event"].alias("event"), e["data"].alias("data")))
    return answers.select("id", numbered.alias("events"))


def excerpt(rows: list[dict]) -> str:
    """What the retrieval tool shows the agent: a few chunks, each with its page, unit and heading, cut to size."""
    unit = lambda r: f"（单位：{r['unit']}）" if r.get("unit") else ""
    return "\n\n".join(f"[第{r['page_start']}页{unit(r)} {r.get('heading_path') or ''}]\n{r['content'][:SNIPPET_CHARS]}" for r in rows[:SNIPPETS])


def report(summary: list[dict], latency: dict, cost: dict) -> str:
    """A run as Markdown, from its aggregated rows."""
    show = lambda v: "–" if v is None else f"{v:.1%}" if isinstance(v, float) else str(v)
    names = list(summary[0]) if summary else []
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)] if names else []
    lines += ["| " + " | ".join(show(row[n]) for n in names) + " |" for row in summary]
    return "\n".join([*lines, "", *(f"{k}: {v}" for k, v in {**latency, **cost}.items())])
