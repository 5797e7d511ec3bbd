"""Tables of filings as ragged arrays of cells, in Column functions and array folds; word geometry as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import running

BREAKDOWN_ROWS, SCOPE_PAGES, X_TOLERANCE, Y_TOLERANCE, COLUMN_HITS = 24, 4, 3.0, 4.0, 3


def cells(rows: Column) -> Column:
    """Every cell, cleaned."""
    return F.transform(F.flatten(rows), T.normalize_cell)


def is_numeric_table(rows: Column) -> Column:
    filled = F.filter(cells(rows), lambda c: c != "")
    return (F.size(filled) >= 4) & (F.size(F.filter(filled, T.is_numeric)) / F.size(filled) >= 0.2)


def numeric_cells(rows: Column) -> Column:
    return F.size(F.filter(cells(rows), T.is_numeric))


def merged_cells(rows: Column, skip_first: bool = False) -> Column:
    """Cells that hold two grouped numbers or more; the first column may be left out, where it gathers what fits nowhere."""
    body = F.transform(rows, lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))) if skip_first else rows
    return F.size(F.filter(cells(body), lambda c: T.count_matches(c, T.GROUPED_NUMBER) >= 2))


def year_labels(rows: Column) -> Column:
    """The most year labels in one of the first three rows: a header that is split over rows counts for little."""
    each = F.transform(F.slice(rows, 1, 3), lambda r: F.aggregate(r, F.lit(0), lambda n, c: n + T.count_matches(T.normalize_cell(c), T.YEAR_LABEL)))
    return F.coalesce(F.array_max(each), F.lit(0))


def multi_value_rows(rows: Column) -> Column:
    return F.size(F.filter(rows, lambda r: F.exists(r, lambda c: T.count_matches(T.normalize_cell(c), T.GROUPED_NUMBER) >= 2)))


def rebuilt_is_better(old: Column, new: Column) -> Column:
    return (numeric_cells(new) > numeric_cells(old)) & (merged_cells(new, True) < merged_cells(old)) & (year_labels(new) >= year_labels(old))


def is_summary(heading: Column, caption: Column, rows: Column) -> Column:
    where = F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.coalesce(caption, F.lit("")), F.array_join(F.flatten(F.slice(rows, 1, 2)), " "))
    return where.rlike(T.SUMMARY_TITLE) & (year_labels(rows) >= 2)


def inline_unit(rows: Column) -> Column:
    """struct(unit, currency, skip): a declaration in one of the first two rows, and how many rows it takes up (none if the
    row says more than that)."""
    line = lambda k: F.coalesce(F.array_join(F.transform(F.try_element_at(rows, F.lit(k)), T.normalize_cell), " "), F.lit(""))

    def of(k: int) -> tuple[Column, Column]:
        joined = line(k)
        unit, currency = T.found(joined, T.UNIT), T.found(joined, T.CURRENCY)
        residue = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, T.CURRENCY, ""), T.UNIT, ""), "^[ |　]+|[ |　]+$", "")
        skip = F.when(F.length(residue) < 4, F.lit(k)).otherwise(F.lit(0))
        return unit.isNotNull() | currency.isNotNull(), F.struct(unit.alias("unit"), currency.alias("currency"), skip.alias("skip"))

    (has1, first), (has2, second) = of(1), of(2)
    none = F.struct(F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("currency"), F.lit(0).alias("skip"))
    return F.when(has1, first).when(has2, second).otherwise(none)


def resolve_unit(rows: Column, above: Column, page: Column, inherited: Column) -> Column:
    """struct(unit, source) by the first step that knows: the table itself; the lines above, the nearest first; in brackets
    above; the page; in brackets on the page; the document. Steps after the second are for numeric tables."""
    numeric = is_numeric_table(rows)
    nearest = lambda pattern: F.try_element_at(F.filter(F.transform(F.reverse(above), lambda ln: T.found(ln, pattern)), lambda u: u.isNotNull()), F.lit(1))
    steps = [
        ("table_inline", inline_unit(rows)["unit"]),
        ("above", nearest(T.UNIT)),
        ("prose_above", F.when(numeric, nearest(T.PROSE_UNIT))),
        ("page", F.when(numeric, T.found(page, T.AMOUNT_UNIT))),
        ("prose_page", F.when(numeric, T.found(page, T.PROSE_UNIT))),
        ("inherited", F.when(numeric, inherited)),
    ]
    unit, source = F.coalesce(*(u for _, u in steps)), F.lit(None).cast("string")
    for name, u in reversed(steps):
        source = F.when(u.isNotNull(), name).otherwise(source)
    return F.struct(unit.alias("unit"), source.alias("source"))


def caption(above: Column) -> Column:
    """The nearest line above that is a title: no declaration, no tick box, no contents line, four characters at least."""
    good = lambda ln: ~(ln.rlike(T.UNIT) | ln.rlike(T.CURRENCY)) & ~ln.contains("适用") & (F.length(ln) >= 4) & ~ln.rlike(T.TOC)
    return F.substring(F.try_element_at(F.filter(F.reverse(above), good), F.lit(1)), 1, 60)


def year_breakdown(header: Column, body: Column) -> Column:
    """For each of the first rows a line with its values by year, newest first, where the header names two years or more,
    each once, and the row has numbers for two at least."""
    placed = F.transform(header, lambda c, i: F.struct(F.regexp_extract(c, T.YEAR, 1).try_cast("int").alias("year"), i.alias("i"), c.alias("c")))
    years = F.filter(placed, lambda x: x["year"].isNotNull() & ~x["c"].rlike(T.NOT_A_YEAR_COLUMN))
    newest = F.reverse(F.array_sort(F.transform(years, lambda x: F.struct(x["year"].alias("year"), x["i"].alias("i")))))
    distinct = F.size(F.array_distinct(F.transform(years, lambda x: x["year"])))

    def line(row: Column) -> Column:
        name = F.try_element_at(F.filter(row, lambda c: c != ""), F.lit(1))
        held = F.filter(newest, lambda y: T.is_numeric(F.coalesce(F.get(row, y["i"]), F.lit(""))))
        parts = F.transform(held, lambda y: F.concat(y["year"].cast("string"), F.lit("年="), F.get(row, y["i"])))
        return F.when(name.isNotNull() & ~name.rlike(T.YEAR) & (F.size(parts) >= 2), F.concat(F.lit("【按年份】"), name, F.lit("："), F.array_join(parts, "；")))

    lines = F.filter(F.transform(F.slice(body, 1, BREAKDOWN_ROWS), line), lambda x: x.isNotNull())
    return F.when((F.size(years) >= 2) & (distinct == F.size(years)), lines).otherwise(F.array().cast("array<string>"))


def merge_wrapped_labels(rows: str) -> Column:
    """Joins the rest of a label that was broken over rows to the label of the data row before it. `rows` is an SQL expression;
    the fold looks at the last row so far, as joined rows may go on."""
    value = f"rlike(c, r'{T.VALUE_CELL}')"
    wrapped = f"""size(a) > 0 and exists(element_at(a, -1), c -> {value}) and size(filter(r, c -> c <> '')) between 1 and 2
      and forall(filter(r, c -> c <> ''), c -> rlike(c, '{T.CJK}')) and not exists(r, c -> {value})"""
    label = f"array_position(transform(element_at(a, -1), c -> c <> '' and not {value}), true)"
    joined = "transform(element_at(a, -1), (c, i) -> if(i + 1 = {0}, concat(c, array_join(filter(r, c2 -> c2 <> ''), '')), c))".format(label)
    fold = f"""aggregate({rows}, cast(array() as array<array<string>>), (a, r) -> case
      when {wrapped} and {label} > 0 then array_append(slice(a, 1, size(a) - 1), {joined})
      else array_append(a, r) end)"""
    return F.expr(fold)


def clean_rows(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, T.normalize_cell))


def render(rows: Column, unit: Column, currency: Column, scope: Column, title: Column, heading: Column) -> Column:
    """Markdown with what a reader must know in the text itself: unit, scope, title; then the table and its years."""
    declared = F.array_compact(F.array(F.concat(F.lit("单位："), unit), F.concat(F.lit("币种："), currency)))
    top = F.array_compact(
        F.array(
            F.when(F.size(declared) > 0, F.concat(F.lit("【"), F.array_join(declared, "　"), F.lit("】"))),
            scope,
            F.coalesce(title, F.when(scope.isNull() & (F.coalesce(heading, F.lit("")) != ""), F.element_at(F.split(heading, " > "), -1))),
        )
    )
    width = F.array_max(F.transform(rows, F.size))
    full = F.transform(clean_rows(rows), lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    first = F.element_at(full, 1)
    blank = ~F.exists(first, lambda c: c != "")
    header = F.when(blank, F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("列"), i.cast("string")))).otherwise(first)
    body = F.when(blank, full).otherwise(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    years = year_breakdown(header, body)
    grid = F.concat(F.array(line(header), F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))), F.transform(body, line))
    tail = F.when(F.size(years) > 0, F.concat(F.array(F.lit("")), years)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, F.when(F.size(rows) > 0, F.concat(grid, tail)).otherwise(F.array().cast("array<string>"))), "\n")


def flags(columns: Column, top: Column, bottom: Column, page_height: Column, source: Column, summary: Column) -> Column:
    """wide (over 6 columns), bottom (within 80 of the foot), top (above 150), where the unit is from, summary_table."""
    return F.array_compact(
        F.array(
            F.when(columns > 6, "wide"),
            F.when(page_height - bottom < 80, "bottom"),
            F.when(top < 150, "top"),
            F.concat(F.lit("unit_src:"), source),
            F.when(summary, "summary_table"),
        )
    )


def split_table(text: Column, limit: int) -> Column:
    """A long table in pieces of whole rows, each with everything down to the separator row before it."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda ln: ln.rlike(r"^[\s]*[|\- ]*[\s]*$"))
    at = F.array_position(marked, True).cast("int")
    header = F.array_join(F.slice(lines, 1, F.greatest(at, F.lit(1))), "\n")
    body = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
    budget = F.greatest(F.lit(limit) - F.length(header), F.lit(limit // 2))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(False).alias("any"))

    def step(a: Column, row: Column) -> Column:
        over = a["any"] & (F.length(a["held"]) + 1 + F.length(row) > budget)
        return F.struct(
            F.when(over, F.array_append(a["done"], a["held"])).otherwise(a["done"]).alias("done"),
            F.when(over | ~a["any"], row).otherwise(F.concat(a["held"], F.lit("\n"), row)).alias("held"),
            F.lit(True).alias("any"),
        )

    folded = F.aggregate(body, start, step, lambda a: F.when(a["any"], F.array_append(a["done"], a["held"])).otherwise(a["done"]))
    whole = (F.length(text) <= limit) | (F.size(lines) < 4) | (at < 2)
    return F.when(whole, F.array(text)).otherwise(F.transform(folded, lambda p: F.concat(header, F.lit("\n"), p)))


def dominant_unit(pages: DataFrame, first_pages: int = 60) -> DataFrame:
    """pages (doc, page, text): the unit that the first pages declare most often; of equals the one that comes first."""
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    each = pages.where(F.col("page") <= first_pages).select("doc", "page", F.posexplode(F.concat(found(T.AMOUNT_UNIT), found(T.PROSE_UNIT))).alias("k", "unit"))
    counts = each.groupBy("doc", "unit").agg(F.count("*").alias("n"), F.min(F.struct("page", "k")).alias("first"))
    best = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "first"))
    return counts.withColumn("r", best).where("r = 1").select("doc", "unit", "n")


def heading_path(lines: DataFrame) -> DataFrame:
    """lines (doc, seq, line): the headings that hold at each line; a higher one ends the lower ones."""
    kind = lines.withColumn("kind", T.heading_kind(F.col("line"))).withColumn("short", F.substring("line", 1, 40))
    run = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda name, *by: F.last(F.when(F.col("kind") == name, F.col("short")), True).over(Window.partitionBy("doc", *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    numbered = kind.withColumn("ns", F.count_if(F.col("kind") == "section").over(run)).withColumn("nb", F.count_if(F.col("kind").isin("section", "subsection")).over(run))
    path = F.concat_ws(" > ", last("section", "ns"), last("subsection", "ns"), last("item", "ns", "nb"))
    return numbered.select("doc", "seq", "kind", path.alias("path"))


def inherited_scope(tables: DataFrame, pages: int = SCOPE_PAGES) -> DataFrame:
    """tables (doc, seq, page, heading, title): the statement title in force at each table. A title holds while the heading stays
    and for `pages` pages; once it has run out it is gone, also for a later table under the same heading."""
    own = F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), T.STATEMENT_SCOPE, 0), F.lit(""))

    def step(state, page, heading, title):
        scope, under, since = state
        if title is not None:
            return (title, heading, page), title
        if scope is not None and under == heading and page - since <= pages:
            return state, scope
        return (None, None, 0), None

    rows = tables.select("doc", "seq", "page", "heading", own.alias("own"))
    return running(rows, ["doc"], ["seq"], ["page", "heading", "own"], (None, None, 0), step, "scope", "string").select("doc", "seq", "scope")


def stitch(tables: DataFrame) -> DataFrame:
    """tables (doc, seq, page, columns, at_top, at_bottom) that go on across pages get one number: gaps and islands."""
    order = Window.partitionBy("doc").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    goes_on = F.coalesce(before("at_bottom") & F.col("at_top") & (before("columns") == F.col("columns")) & (F.col("page") == before("page") + 1), F.lit(False))
    return tables.withColumn("fresh", (~goes_on).cast("int")).select("doc", "seq", F.sum("fresh").over(order).cast("int").alias("chain"))


def stitched(tables: DataFrame, head: int = 3) -> DataFrame:
    """tables (doc, seq, page, columns, rows, text, at_top, at_bottom, flags): one row for each chain of stitch, with the text of its parts (of all
    but the first without their first `head` lines: unit, header and separator; a part that has no more adds nothing), its first and last page, its rows, and the flag
    cross_page where it has several parts."""
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, head + 1, F.greatest(F.size(lines) - head, F.lit(0))), "\n")
    part = tables.join(stitch(tables), ["doc", "seq"]).withColumn("rest", F.when(F.trim(rest) != "", rest))
    listed = F.array_sort(F.collect_list(F.struct("seq", "text", "rest")))
    grouped = part.groupBy("doc", "chain").agg(
        listed.alias("ps"), F.min("seq").alias("seq"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min_by("columns", "seq").alias("columns"), F.sum("rows").cast("int").alias("rows"),
        F.min_by(F.coalesce("flags", F.array().cast("array<string>")), "seq").alias("flags"), F.count("*").alias("n"),
    )
    text = F.array_join(F.array_compact(F.concat(F.array(F.get("ps", F.lit(0))["text"]), F.transform(F.slice("ps", 2, F.greatest(F.size("ps") - 1, F.lit(0))), lambda p: p["rest"]))), "\n")
    crossing = F.when(F.col("n") > 1, F.array_distinct(F.concat("flags", F.array(F.lit("cross_page"))))).otherwise(F.col("flags"))
    return grouped.select("doc", "seq", "page_start", "page_end", "columns", "rows", crossing.alias("flags"), text.alias("text"))


def numeric_columns(words: DataFrame, gap: float = X_TOLERANCE, hits: int = COLUMN_HITS) -> DataFrame:
    """words (page, x0, y0, x1, y1, word): clusters of the right edges of numbers, as (page, col from 1, left, right)."""
    numbers = words.where(F.col("word").rlike(r"^[-(（]?[0-9][0-9,]*\.?[0-9]*[)）%]?$"))
    order = Window.partitionBy("page").orderBy("x1", "y0", "x0")
    cluster = F.sum(F.coalesce((F.col("x1") - F.lag("x1").over(order) > gap).cast("int"), F.lit(0))).over(order)
    grouped = numbers.withColumn("c", cluster).groupBy("page", "c").agg(F.count("*").alias("n"), F.min("x0").alias("left"), F.max("x1").alias("right")).where(F.col("n") >= hits)
    return grouped.withColumn("col", F.row_number().over(Window.partitionBy("page").orderBy("c"))).select("page", "col", "left", "right")


def rebuild_table(words: DataFrame, columns: DataFrame, tolerance: float = X_TOLERANCE, row: float = Y_TOLERANCE) -> DataFrame:
    """(page, line, col, text): each word goes to the column that its middle lies in (column 0 takes the rest), and to a line:
    within `row` of the line's first word. Lines hang on their first word, so a page's words are folded in order of y."""
    middle = (F.col("x0") + F.col("x1")) / 2
    c = columns.select(F.col("page").alias("cp"), "col", "left", "right")
    several = columns.groupBy("page").agg(F.count("*").alias("k")).where("k >= 2").select("page")
    # the columns of a page are few
    placed = words.join(several, "page", "left_semi").join(c, (F.col("page") == F.col("cp")) & (middle >= F.col("left") - tolerance) & (middle <= F.col("right") + tolerance), "left")
    one = placed.groupBy("page", "x0", "y0", "x1", "word").agg(F.coalesce(F.min("col"), F.lit(0)).alias("col"))

    def step(state, y):
        first, n = state
        if first is None or abs(y - first) > row:
            first, n = y, n + 1
        return (first, n), n

    lines = running(one, ["page"], ["y0", "x0", "word", "col"], ["y0"], (None, 0), step, "line", "int")
    return lines.groupBy("page", "line", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda w: w["word"]), " ").alias("text"))
