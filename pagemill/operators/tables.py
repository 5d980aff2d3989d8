"""Tables on pages: cleaning, headers, key rows, summaries. All on the cell arrays of a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Words of summary rows.
SUMMARY_WORDS = r"(?i)合计|总计|小计|平均|均值|结论|关键|重点|total|summary|average|mean"
NUMBER = r"^[-+]?\d+(?:\.\d+)?%?$"


def clean_table(rows: Column) -> Column:
    """array<struct<idx,cells>>: cells collapsed, empty ones at the end cut, empty rows left out; idx from 1."""
    cells = F.transform(rows, lambda r, i: F.struct((i + 1).alias("idx"), F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))).alias("cells")))

    def cut(r: Column) -> Column:
        last = F.aggregate(F.transform(r["cells"], lambda c, i: F.when(c != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        return F.struct(r["idx"].alias("idx"), F.slice(r["cells"], 1, last).alias("cells"))

    return F.filter(F.transform(cells, cut), lambda r: F.size(r["cells"]) > 0)


def is_number(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit("")).rlike(NUMBER)


def has_header(clean: Column) -> Column:
    """Two rows, two cells in the first, not all numbers."""
    cells = F.filter(F.get(clean, F.lit(0))["cells"], lambda c: c != "")
    return (F.size(clean) >= 2) & (F.size(cells) >= 2) & ~F.forall(cells, is_number)


def header_names(cells: Column, width: Column) -> Column:
    """Names of all columns: a missing one is numbered, a repeated one gets its count."""
    named = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.nullif(F.get(cells, i), F.lit("")), F.concat(F.lit("列 "), (i + 1).cast("string"))))

    def count(h: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x == h))
        return F.when(n == 1, h).otherwise(F.concat(h, F.lit(" "), n.cast("string")))

    return F.transform(named, count)


def row_score(cells: Column) -> Column:
    full = F.filter(cells, lambda c: c != "")
    text = F.array_join(full, " ")
    return F.size(full) * 2 + F.least(F.length(text) / 30.0, F.lit(4.0)) + F.when(text.rlike(SUMMARY_WORDS), 3.0).otherwise(0.0) + F.when(text.rlike(r"\d"), 1.5).otherwise(0.0)


def key_rows(data: Column, headers: Column, most: int = 3) -> Column:
    """The rows with the highest score, the earlier of equals, in their order: row_index, label, reason, cells, values (column and value)."""
    scored = F.array_sort(F.transform(data, lambda r: F.struct((-row_score(r["cells"])).alias("s"), r["idx"].alias("idx"), r["cells"].alias("cells"))))
    best = F.array_sort(F.transform(F.slice(scored, 1, most), lambda r: F.struct(r["idx"].alias("idx"), r["cells"].alias("cells"))))

    def record(r: Column) -> Column:
        text = F.array_join(F.filter(r["cells"], lambda c: c != ""), " ")
        reason = F.when(text.rlike(SUMMARY_WORDS), "summary_or_signal_row").when(text.rlike(r"\d"), "numeric_data_row").otherwise("representative_data_row")
        label = F.coalesce(F.get(F.filter(r["cells"], lambda c: c != ""), F.lit(0)), F.concat(F.lit("第 "), r["idx"].cast("string"), F.lit(" 行")))
        return F.struct(r["idx"].alias("row_index"), label.alias("label"), reason.alias("reason"), r["cells"].alias("cells"), values(r["cells"]).alias("values"))

    def values(cells: Column) -> Column:
        each = F.transform(cells, lambda c, i: F.struct(F.coalesce(F.get(headers, i), F.concat(F.lit("列 "), (i + 1).cast("string"))).alias("column"), c.alias("value")))
        return F.filter(each, lambda x: x["value"] != "")

    return F.transform(best, record)


def _join(terms: Column, separator: str = "、") -> Column:
    return F.array_join(F.filter(F.transform(terms, lambda x: F.trim(x)), lambda x: x != ""), separator)


def key_row_text(r: Column, open_: str = "（", close: str = "）", separator: str = "，") -> Column:
    """label（column=value，…） of a key row: up to four values that aren't the label itself."""
    parts = F.transform(F.filter(F.slice(r["values"], 1, 4), lambda v: v["value"] != r["label"]), lambda v: F.concat(v["column"], F.lit("="), v["value"]))
    return F.when(F.size(parts) > 0, F.concat(r["label"], F.lit(open_), F.array_join(parts, separator), F.lit(close))).otherwise(r["label"])


def analyze_tables(tables: DataFrame) -> DataFrame:
    """tables (…, rows array<array<string>>) + has_header, headers, n_rows, width, key_rows, table_summary, table_conclusion, warning (empty_table)."""
    clean = tables.withColumn("_c", clean_table(F.coalesce("rows", F.array().cast("array<array<string>>"))))
    width = F.aggregate("_c", F.lit(0), lambda a, r: F.greatest(a, F.size(r["cells"])))
    shaped = clean.withColumn("width", width).withColumn("has_header", F.coalesce(has_header(F.col("_c")), F.lit(False)))
    data = shaped.withColumn("_d", F.when(F.col("has_header"), F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0)))).otherwise(F.col("_c")))
    headers = F.when(F.col("has_header"), header_names(F.col("_c")[0]["cells"], F.col("width"))).when(F.col("width") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("width"), F.lit(1))), lambda i: F.concat(F.lit("列 "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    named = data.withColumn("headers", headers).withColumn("n_rows", F.size("_d"))
    keyed = named.withColumn("key_rows", key_rows(F.col("_d"), F.col("headers")))
    n, many = F.col("n_rows").cast("string"), F.size("headers") > 4
    kinds = F.when(many, F.concat(F.lit("等 "), F.size("headers").cast("string"), F.lit(" 个维度"))).otherwise("这些维度")
    count = F.when(F.col("n_rows") > 0, F.concat(n, F.lit(" 条记录"))).otherwise("表头维度")
    summary = (
        F.when(F.size("_c") == 0, F.lit(None)).when(F.col("has_header"), F.concat(F.lit("表格围绕「"), _join(F.slice("headers", 1, 4)), F.lit("」"), kinds, F.lit("组织，主要用于对比或归纳 "), count, F.lit("。")))
        .otherwise(F.concat(F.lit("表格包含 "), n, F.lit(" 行、"), F.col("width").cast("string"), F.lit(" 列信息，主要用于并列展示相关条目。")))
    )
    labels = _join(F.transform("key_rows", lambda r: r["label"]))
    compared = F.concat(F.lit("表格重点比较 "), labels, F.lit("，差异主要落在「"), _join(F.slice("headers", 2, 3)), F.lit("」等维度；"), _join(F.transform("key_rows", lambda r: key_row_text(r)), "；"), F.lit("。"))
    conclusion = F.when(F.size("key_rows") == 0, F.lit(None)).when(F.col("has_header") & (F.size("headers") >= 2), compared).otherwise(F.concat(F.lit("表格中的 "), labels, F.lit(" 是需要优先关注的代表性条目。")))
    warning = F.when(F.size("_c") == 0, "empty_table")
    rest = [c for c in tables.columns if c not in ("has_header", "headers", "n_rows", "width", "key_rows", "table_summary", "table_conclusion", "warning")]
    return keyed.select(*rest, "has_header", "headers", "n_rows", "width", "key_rows", summary.alias("table_summary"), conclusion.alias("table_conclusion"), warning.alias("warning"))


def table_text(raw_rows: int = 3) -> Column:
    """Conclusion, summary, key rows and the first raw rows of an analysed table, as one text."""
    keys = F.array_join(F.transform(F.slice("key_rows", 1, 3), lambda r: key_row_text(r)), "；")
    raw = table_preview(F.col("rows"), raw_rows)
    parts = F.array(F.col("table_conclusion"), F.col("table_summary"), F.when(keys != "", F.concat(F.lit("关键行："), keys)), F.when(raw != "", F.concat(F.lit("原始表格片段："), raw)))
    return F.array_join(F.array_compact(parts), " / ")


def table_report(pages: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Per deck: pages, tables, those with summary and conclusion, key rows, and empty tables."""
    p = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages_total"))
    t = analyzed.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("tables_total"), F.count_if(F.col("table_summary").isNotNull()).alias("tables_with_summary"), F.count_if(F.col("table_conclusion").isNotNull()).alias("tables_with_conclusion"),
        F.sum(F.size("key_rows").cast("bigint")).alias("key_rows_total"), F.count_if(F.col("warning") == "empty_table").alias("empty_tables"),
    )
    return p.join(t, "deck_id", "left").na.fill(0)


def table_preview(rows: Column, most: int = 3) -> Column:
    lines = F.transform(F.slice(rows, 1, most), lambda r: F.array_join(F.filter(F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), " / ")
