"""Study items, question sets and their quality; figures, sections and texts of a study pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_int, clean_inline, contains_any, point_of, round_score, string_list

#: Types of questions in turn, their points, and the points of other types.
TURN = ("choice", "true_false", "short", "short")
POINTS = {"choice": 2, "true_false": 1, "short": 6, "essay": 10, "comprehensive": 15}
#: Words of importance, of applied and of figure questions, and names of types and levels.
MUST_ROLES, MUST = ["definition", "formula", "condition", "concept"], ["定义", "定理", "公式", "性质", "结论", "必须", "核心"]
KEY_ROLES, KEY = ["table_conclusion", "figure_explanation", "example", "code_example"], ["例", "步骤", "算法", "方法", "流程", "图", "表"]
FREQUENT = ["高频", "常见", "易错", "frequent", "common"]
APPLIED = ["为什么", "如何", "比较", "解释", "推导", "场景", "条件", "作用", "易错", "why", "how", "compare", "explain", "apply"]
FIGURES = ["图", "表", "公式", "流程", "截图", "figure", "table", "formula", "diagram"]
METHODS = ["公式", "计算", "步骤", "算法", "推导", "example", "例"]
#: Sentences of questions in turn and of distractors, with {} for the points and texts they name; what
#: marks a text cut in its middle, and what is said of a statement that is false.
ASKS = ("关于「{}」，哪一项最符合材料中的含义？", "判断：「{}」只要背下名称即可，不需要理解它解决的问题或使用场景。", "请用自己的话解释「{}」，并说明它为什么重要。", "围绕「{}」列出一个容易混淆或容易漏写的点。")
MISTAKEN, HALF_KNOWN = "把「{}」的作用误当成「{}」的主要含义。", "只记住相邻结论“{}”，但忽略它和「{}」的适用条件。"
DISTRACTORS = ("只背「{}」这个名称，但不能说明它解决的问题和限制。", "把「{}」理解成任何场景都成立的结论，忽略材料给出的条件。", "只记住最终结论，却不能解释「{}」与前后概念的关系。")
CUT_MARK = "\n\n...[notes truncated for prompt budget]...\n\n"
FALSE_BECAUSE, FALSE_TRAP = "错误。复习时应说明它的含义、作用和易错点：", "把概念当成孤立名词，是短期备考最常见的失分方式。"
BAD_DISTRACTORS = ["装饰", "无关", "不需要", "只需要记住名称", "只需背", "decoration", "unrelated"]
TYPE_NAMES = {
    "choice": "choice", "multiple_choice": "choice", "选择题": "choice", "tf": "true_false", "true_false": "true_false", "判断题": "true_false", "short": "short", "short_answer": "short", "简答题": "short",
    "essay": "essay", "论述题": "essay", "comprehensive": "comprehensive", "综合题": "comprehensive",
}
LEVEL_NAMES = {"必考": "must", "must": "must", "重点": "key", "key": "key", "高频": "frequent", "freq": "frequent", "frequent": "frequent", "了解": "background", "background": "background", "info": "background"}
WHY = {
    "must": "这类内容通常支撑定义、推导、公式或综合题。", "key": "这类内容常用于解释过程、比较概念或连接例子。", "frequent": "这类内容适合通过判断题和选择题检查是否混淆。", "background": "这类内容帮助理解上下文，复习时保持基本印象即可。",
}
LABELS = {"choice": "选择题", "true_false": "判断题", "short": "简答题", "essay": "论述题", "comprehensive": "综合题"}


def _named(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def _filled(sentence: str, *parts: Column) -> Column:
    """A sentence with a part in place of each {}."""
    said = sentence.split("{}")
    return F.concat(F.lit(said[0]), *[x for p, rest in zip(parts, said[1:], strict=True) for x in (p, F.lit(rest))])


def _holds(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def infer_importance(text: Column, role: Column) -> Column:
    """must, key or frequent by role and words; key where nothing says so."""
    r = F.lower(F.coalesce(role, F.lit("")))
    return F.when(r.isin(MUST_ROLES) | _holds(text, MUST), "must").when(r.isin(KEY_ROLES) | _holds(text, KEY), "key").when(_holds(F.lower(text), FREQUENT), "frequent").otherwise("key")


def normalize_type(c: Column) -> Column:
    return _named(TYPE_NAMES, F.lower(F.trim(F.coalesce(c, F.lit("")))), "short")


def normalize_importance(c: Column) -> Column:
    return _named(LEVEL_NAMES, F.lower(F.trim(F.coalesce(c, F.lit("")))), "key")


def pitfall(point: Column, role: Column) -> Column:
    return (
        F.when(F.coalesce(role, F.lit("")).contains("formula"), "不要只背公式，要能说明符号含义、适用条件和计算对象。").when(_holds(point, ["图", "流程", "结构"]), "不要只看图名，要能沿箭头或结构关系讲出因果链。")
        .otherwise("不要只背关键词，要能说明它解决的问题和使用场景。")
    )


def skip_text(c: Column) -> Column:
    """Texts that make no item: under three characters, numbers and dates, short addresses."""
    t = clean_inline(c)
    return (F.length(t) < 3) | t.rlike(r"(?U)^[\d\s/._:-]+$") | ((F.length(t) <= 12) & _holds(F.lower(t), ["email", "@", "http", "www"]))


def study_items(candidates: DataFrame, cap: int = 16) -> DataFrame:
    """(deck_id, priority, slide_id, element_id, text[, role]) → items of each deck by priority, one per point, up to the cap.

    Points are compared by their first 80 characters, lower case, without spaces. Items: pos, point, explanation,
    element_id, slide_id, priority, importance, why, pitfall. Arrays of one are exploded so that a text is cleaned,
    and its point found, once: filters on columns would be pushed down and repeat what makes them.
    """
    role = F.col("role") if "role" in candidates.columns else F.lit(None).cast("string")
    cleaned = candidates.select("deck_id", "priority", "slide_id", "element_id", role.alias("role"), F.explode(F.array(clean_inline(F.col("text")))).alias("explanation")).where("explanation <> ''")
    keyed = cleaned.select("*", F.explode(F.array(point_of(F.col("explanation")))).alias("point"))
    keyed = keyed.withColumn("key", F.substring(F.lower(F.regexp_replace("point", r"(?U)\s+", "")), 1, 80)).where("key <> ''")
    order = F.struct("priority", "slide_id", "element_id")
    once = keyed.groupBy("deck_id", "key").agg(F.min_by(F.struct("point", "explanation", "element_id", "slide_id", "priority", "role"), order).alias("f"), F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("o"))
    level = infer_importance(F.concat_ws(" ", "f.point", "f.explanation"), F.col("f.role"))
    first = once.withColumn("pos", rank - 1).where(F.col("pos") < cap).withColumn("importance", level)
    return first.select("deck_id", "pos", "f.point", "f.explanation", "f.element_id", "f.slide_id", "f.priority", "importance", _named(WHY, F.col("importance"), "").alias("why"), pitfall(F.col("f.point"), F.col("f.role")).alias("pitfall"))


def choice_options(items: DataFrame) -> DataFrame:
    """(deck_id, pos, options) of each item: its explanation, then three distractors.

    Distractors are two texts of each other item with another point, in order, until there are three; then fixed
    texts. A deck's items are few (study_items caps them) and folded as one array.
    """
    pool = items.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("pos", "point", "explanation"))).alias("pool"))
    point, answer = F.col("point"), F.coalesce(F.nullif("explanation", F.lit("")), F.col("point"))

    def middle(c: Column, limit: int = 52) -> Column:
        head, tail = int(limit * 0.7), int(limit * 0.3)
        return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, head)), F.lit(CUT_MARK), F.ltrim(F.right(c, F.lit(tail))))).otherwise(c)

    def wrong(x: Column) -> Column:
        first, second = _filled(MISTAKEN, x["point"], point), _filled(HALF_KNOWN, middle(x["explanation"]), point)
        return F.array_compact(F.array(first, F.when(x["explanation"] != "", second)))

    others = F.slice(F.filter("pool", lambda x: (x["point"] != "") & (x["point"] != point)), 1, 3)
    fallback = F.array(*[_filled(d, point) for d in DISTRACTORS])
    wrongs = F.slice(F.concat(F.flatten(F.transform(others, wrong)), fallback), 1, 3)
    return items.join(pool, "deck_id").select("deck_id", "pos", F.concat(F.array(answer), wrongs).alias("options"))


def questions(items: DataFrame, n: int = 8) -> DataFrame:
    """n questions a deck over its items in turn: choice, true_false, short, short; with options, answer, explanation and sources."""
    count = items.groupBy("deck_id").agg(F.count(F.lit(1)).alias("n_items"))
    slots = count.select("deck_id", "n_items", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).withColumn("pos", ((F.col("i") - 1) % F.col("n_items")).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, TURN)), ((F.col("i") - 1) % 4 + 1).cast("int"))
    turn, point, said = F.col("i") % 4, F.col("point"), F.coalesce(F.nullif("explanation", F.lit("")), F.col("point"))
    text = F.coalesce(*[F.when(turn == (i + 1) % 4, _filled(ask, point)) for i, ask in enumerate(ASKS)])
    answer = F.when(turn == 1, F.lit("0")).when(turn == 2, F.lit("false")).when(turn == 3, said).otherwise(F.coalesce(F.nullif("pitfall", F.lit("")), said))
    why = F.when(turn == 2, F.concat(F.lit(FALSE_BECAUSE), said)).otherwise(said)
    trap = F.when(turn == 2, F.lit(FALSE_TRAP)).otherwise(F.col("pitfall"))
    refs = F.when(F.col("slide_id") > 0, F.array(F.concat(F.lit("P"), F.col("slide_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    joined = slots.join(items, ["deck_id", "pos"]).join(choice_options(items), ["deck_id", "pos"]).withColumn("type", kind)
    return joined.select(
        "deck_id", F.format_string("q%d", "i").alias("question_id"), "i", "type", _named(POINTS, F.col("type"), 5).alias("points"), text.alias("question"), F.when(turn == 1, F.col("options")).alias("options"), answer.alias("answer"),
        why.alias("explanation"), trap.alias("pitfall"), refs.alias("source_refs"), "element_id", "point",
    )


def normalize_questions(raw: DataFrame, fallback: DataFrame, n: int = 8) -> DataFrame:
    """Questions of a model's answer (deck_id, json of an exam) in the form of ``questions``; decks without one keep the fallback.

    Unknown types become short, points and texts take defaults, an answer's index is clamped, and a choice with
    under two options becomes short.
    """
    shape = "struct<questions: array<struct<id: string, type: string, points: string, question: string, options: array<string>, answer: string, explanation: string, pitfall: string, source_refs: array<string>>>>"
    each = raw.select("deck_id", F.posexplode(F.slice(F.from_json("json", shape)["questions"], 1, n)).alias("p", "q"))
    given, options = normalize_type(F.col("q.type")), string_list(F.col("q.options"), 8)
    few = (given == "choice") & (F.size(options) < 2)
    kind = F.when(few, "short").otherwise(given)
    said = clean_inline(F.col("q.explanation"))
    index = F.least(F.greatest(as_int(F.col("q.answer")), F.lit(0)), F.size(options) - 1).cast("string")
    true = F.lower(F.trim(F.coalesce("q.answer", F.lit("")))).isin("true", "1", "yes", "y", "正确", "对").cast("string")
    answer = F.when(few, F.coalesce(F.nullif(clean_inline(F.col("q.answer")), F.lit("")), said)).when(kind == "choice", index).when(kind == "true_false", true).otherwise(clean_inline(F.col("q.answer")))
    rows = each.where("q is not null").select(
        "deck_id", F.coalesce(F.nullif(clean_inline(F.col("q.id")), F.lit("")), F.format_string("q%d", F.col("p") + 1)).alias("question_id"), (F.col("p") + 1).alias("i"), kind.alias("type"),
        as_int(F.col("q.points")).alias("_p"), F.col("q.points").try_cast("bigint").isNull().alias("_none"), given.alias("_g"), F.coalesce(F.nullif(clean_inline(F.col("q.question")), F.lit("")), F.lit("请解释本节核心知识点。")).alias("question"),
        F.when(kind == "choice", options).alias("options"), answer.alias("answer"), said.alias("explanation"), clean_inline(F.col("q.pitfall")).alias("pitfall"), string_list(F.col("q.source_refs"), 12).alias("source_refs"),
    )
    rows = rows.withColumn("points", F.when(F.col("_none"), _named(POINTS, F.col("_g"), 5)).otherwise(F.col("_p").cast("int")))
    columns = ["deck_id", "question_id", "i", "type", "points", "question", "options", "answer", "explanation", "pitfall", "source_refs"]
    rest = fallback.join(rows.select("deck_id").distinct(), "deck_id", "left_anti")
    return rows.select(*columns).unionByName(rest.select(*columns))


#: What a review's item says where the answer says nothing.
NO_SECTION, NO_POINT, NO_EXPLANATION = "核心知识点", "知识点", "需要结合原始笔记复习。"


def normalize_review(raw: DataFrame, fallback: DataFrame, most: int = 400) -> DataFrame:
    """Checklists of a model's answers (deck_id, json with review.checklist or checklist) → deck_id, pos, section, importance, point, explanation, why, pitfall, source_refs.

    Fields are cleaned, empty ones take defaults, importance is one of four levels. A deck whose answer is broken or
    has no item keeps its rows of fallback, which has the same columns.
    """
    item = "array<struct<section: string, importance: string, point: string, explanation: string, why: string, pitfall: string, source_refs: array<string>>>"
    parsed = F.from_json("json", f"struct<review: struct<checklist: {item}>, checklist: {item}>")
    each = raw.withColumn("_d", parsed).select("deck_id", F.posexplode(F.slice(F.coalesce("_d.review.checklist", "_d.checklist"), 1, most)).alias("pos", "x")).where("x is not null")
    said = lambda c, default="": F.coalesce(F.nullif(clean_inline(F.col(f"x.{c}")), F.lit("")), F.lit(default))
    level = _named(LEVEL_NAMES, F.lower(F.trim(F.coalesce("x.importance", F.lit("")))), "key")
    rows = each.select(
        "deck_id", "pos", said("section", NO_SECTION).alias("section"), level.alias("importance"), said("point", NO_POINT).alias("point"), said("explanation", NO_EXPLANATION).alias("explanation"),
        said("why").alias("why"), said("pitfall").alias("pitfall"), string_list(F.col("x.source_refs"), 12).alias("source_refs"),
    )
    return rows.unionByName(fallback.join(rows.select("deck_id").distinct(), "deck_id", "left_anti").select(*rows.columns))


def figure_notes(tables: DataFrame, images: DataFrame, cap: int = 200) -> DataFrame:
    """Tables (element_id, text) and images that aren't ignored, with a text, as notes of each deck in the order of pages, up to the cap."""
    t = tables.select("deck_id", "slide_id", F.lit(0).alias("_k"), "element_id", F.lit("table").alias("kind"), clean_inline(F.col("text")).alias("explanation"), F.concat(F.lit("P"), F.col("slide_id").cast("string"), F.lit(" 表格")).alias("title"), F.lit(None).cast("string").alias("path"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    said = clean_inline(F.coalesce(some("figure_explanation"), some("visual_summary"), some("ocr_text"), some("caption")))
    title = F.coalesce(F.nullif(clean_inline(F.col("caption")), F.lit("")), F.concat(F.lit("P"), F.col("slide_id").cast("string"), F.lit(" 图示")))
    i = images.where(~F.coalesce("ignored", F.lit(False))).select("deck_id", "slide_id", F.lit(1).alias("_k"), "element_id", F.lit("image").alias("kind"), said.alias("explanation"), title.alias("title"), "path")
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id", "_k", "element_id"))
    both = t.unionByName(i).where("explanation <> ''").withColumn("pos", rank).where(F.col("pos") <= cap)
    return both.select("deck_id", "slide_id", "pos", "element_id", "kind", "title", "explanation", "path", F.concat(F.lit("P"), F.col("slide_id").cast("string")).alias("source_ref"))


def attach_figures(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """asked + image_refs: ids of up to two image notes of its source pages; else, if it speaks of figures, the deck's first one; null without.

    A question that has refs already (a column image_refs) keeps them. Equi-joins on deck and source page.
    """
    own = F.col("image_refs") if "image_refs" in asked.columns else F.lit(None).cast("array<string>")
    pics = notes.where((F.col("kind") == "image") & (F.coalesce("path", F.lit("")) != ""))
    refs = asked.select("deck_id", "question_id", F.explode("source_refs").alias("source_ref")).distinct()
    rank = F.row_number().over(Window.partitionBy("deck_id", "question_id").orderBy("pos"))
    near = refs.join(pics.select("deck_id", "source_ref", "pos", "element_id"), ["deck_id", "source_ref"]).withColumn("r", rank).where("r <= 2")
    near = near.groupBy("deck_id", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "element_id"))), lambda x: x["element_id"]).alias("_near"))
    first = pics.groupBy("deck_id").agg(F.min_by("element_id", "pos").alias("_first"))
    joined = asked.join(near, ["deck_id", "question_id"], "left").join(first, "deck_id", "left")
    speaks = contains_any(F.concat_ws(" ", "question", "explanation"), FIGURES)
    found = F.coalesce(F.when(F.size(own) > 0, own), F.col("_near"), F.when(speaks & F.col("_first").isNotNull(), F.array("_first")))
    return joined.withColumn("image_refs", found).drop("_near", "_first")


def section_pack(items: DataFrame, asked: DataFrame, notes: DataFrame) -> DataFrame:
    """(deck_id, section) → counts of items, questions and figure notes.

    items: deck_id, pos, section, source_refs. A question belongs to the first section with an item of one of its
    source pages, else to 综合复习. notes: deck_id, section.
    """
    section = F.coalesce(F.nullif("section", F.lit("")), F.lit("核心知识点"))
    named = items.withColumn("section", section)
    each = named.select("deck_id", "section", "pos", F.explode("source_refs").alias("ref"))
    start = named.groupBy("deck_id", "section").agg(F.min("pos").alias("at"), F.count(F.lit(1)).alias("checklist"))
    by_ref = each.join(start.select("deck_id", "section", "at"), ["deck_id", "section"]).groupBy("deck_id", "ref").agg(F.min(F.struct("at", "section")).alias("s"))
    refs = asked.select("deck_id", "question_id", F.explode("source_refs").alias("ref")).join(by_ref, ["deck_id", "ref"]).groupBy("deck_id", "question_id").agg(F.min("s").alias("s"))
    q = asked.select("deck_id", "question_id").join(refs, ["deck_id", "question_id"], "left").groupBy("deck_id", F.coalesce("s.section", F.lit("综合复习")).alias("section")).agg(F.count(F.lit(1)).alias("questions"))
    n = notes.groupBy("deck_id", F.coalesce(F.nullif("section", F.lit("")), F.lit("图表速查")).alias("section")).agg(F.count(F.lit(1)).alias("figure_notes"))
    return start.drop("at").join(q, ["deck_id", "section"], "full").join(n, ["deck_id", "section"], "full").na.fill(0, ["checklist", "questions", "figure_notes"])


def final_exam(asked: DataFrame) -> DataFrame:
    """Per deck: questions, points, minutes (6 a question, 30 to 180), and a digest of the first 80 questions as JSON."""
    n = F.count(F.lit(1))
    brief = F.struct("i", F.col("question_id").alias("id"), "type", "question", "answer", "source_refs", "pitfall")
    return asked.groupBy("deck_id").agg(
        n.alias("n_questions"), F.sum("points").alias("points"), F.greatest(F.lit(30), F.least(F.lit(180), n * 6)).cast("bigint").alias("minutes"), F.to_json(F.slice(F.array_sort(F.collect_list(brief)), 1, 80)).alias("digest")
    )


def _holding(options: Column, word: str) -> Column:
    """How many options hold the word, in any case."""
    return F.size(F.filter(options, lambda o: F.contains(F.lower(o), F.lit(word))))


def question_quality(asked: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Per deck: six scores of its questions, their weighted sum and flags.

    asked may have image_refs. figures: deck_id, n of its figure notes; a deck without has full figure score.
    """
    options = F.coalesce("options", F.array().cast("array<string>"))
    n = F.size(options)
    bad = sum((_holding(options, w) for w in BAD_DISTRACTORS), F.lit(0))
    unique = F.size(F.array_distinct(F.transform(options, lambda o: F.lower(o)))) / F.greatest(F.lit(1), n)
    long = F.size(F.filter(options, lambda o: F.length(o) >= 10)) / F.greatest(F.lit(1), n)
    choice = F.when(n < 4, 0.25).otherwise(F.greatest(F.lit(0.0), 0.45 * unique + 0.55 * F.least(F.lit(1.0), long) - F.least(F.lit(0.6), bad * 0.2)))
    refs = F.col("image_refs") if "image_refs" in asked.columns else F.lit(None).cast("array<string>")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    per = asked.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("questions_total"), F.count_if(F.col("type") == "choice").alias("choice_questions_total"), F.coalesce(F.avg(F.when(F.col("type") == "choice", choice)), F.lit(1.0)).alias("_choice"),
        share((clean_inline(F.col("explanation")) != "") & (clean_inline(F.col("pitfall")) != "")).alias("_said"), share(F.size(string_list(F.col("source_refs"), 8)) > 0).alias("_src"), F.least(F.lit(1.0), F.count_distinct("type") / 4).alias("_mix"),
        share(contains_any(F.col("question"), APPLIED)).alias("_applied"), F.count_if(F.size(refs) > 0).alias("_pics"),
    )
    if figures is None:
        per = per.withColumn("_n", F.lit(0))
    else:
        per = per.join(figures.select("deck_id", F.col("n").alias("_n")), "deck_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    pics = F.when(F.col("_n") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("_pics") / F.greatest(F.lit(1), F.least("_n", "questions_total"))))
    rows = per.withColumn("_fig", pics).withColumn("_mech", 1 - F.col("_applied"))
    parts = {"choice_distractor_score": "_choice", "explanation_score": "_said", "source_ref_score": "_src", "question_mix_score": "_mix", "figure_question_score": "_fig", "mechanical_definition_score": "_mech"}
    total = 0.24 * F.col("_choice") + 0.22 * F.col("_said") + 0.18 * F.col("_src") + 0.16 * F.col("_mix") + 0.12 * F.col("_fig") + 0.08 * (1 - F.col("_mech"))
    flags = [
        (F.col("_choice") < 0.55, "choice_distractors_need_same_concept_cluster"), (F.col("_said") < 0.65, "questions_need_explanations_and_pitfalls"), (F.col("_src") < 0.75, "questions_need_source_refs"),
        (F.col("_mix") < 0.5, "question_types_too_narrow"), ((F.col("_n") > 0) & (F.col("_fig") < 0.35), "figure_table_questions_need_inline_refs"), (F.col("_mech") > 0.65, "questions_too_definition_like"),
    ]
    return rows.select(
        "deck_id", round_score(total).alias("overall_score"), *[round_score(F.col(c)).alias(k) for k, c in parts.items()], "questions_total", "choice_questions_total", F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in flags])).alias("flags")
    )


def logic_chains(decks: DataFrame, dependencies: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Per deck rows (pos, title, steps): up to eight dependencies of its brief, else eight sections, else one of its first six titles.

    dependencies: deck_id, pos, source, target, reason. sections: deck_id, section, title, start. pages: deck_id, slide_id, title.
    """
    rank = lambda by: F.row_number().over(Window.partitionBy("deck_id").orderBy(by))
    some = lambda c, d: F.coalesce(F.nullif(clean_inline(F.col(c)), F.lit("")), F.lit(d))
    a = dependencies.withColumn("r", rank("pos")).where("r <= 8").select("deck_id", F.col("r").alias("pos"), F.concat(clean_inline(F.col("source")), F.lit(" -> "), clean_inline(F.col("target"))).alias("title"), F.array(some("reason", "前一个概念为后一个概念提供理解基础。")).alias("steps"))
    b = sections.withColumn("r", rank("section")).where("r <= 8").select(
        "deck_id", F.col("r").alias("pos"), F.coalesce(F.nullif(clean_inline(F.col("title")), F.lit("")), F.format_string("第 %d 节", "r")).alias("title"),
        F.array(F.concat(F.lit("复习页码范围：P"), F.coalesce(F.col("start").cast("string"), F.lit("?")), F.lit(" 起。")), F.lit("按章节顺序复习。")).alias("steps"),
    ).join(a.select("deck_id").distinct(), "deck_id", "left_anti")
    titled = pages.select("deck_id", "slide_id", clean_inline(F.col("title")).alias("t")).where("t <> ''").withColumn("r", rank("slide_id")).where("r <= 6")
    steps = titled.groupBy("deck_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: F.concat(F.lit("先掌握："), x["t"])).alias("s"))
    c = decks.select("deck_id").join(steps, "deck_id", "left").select("deck_id", F.lit(1).alias("pos"), F.lit("按材料顺序复习").alias("title"), F.coalesce("s", F.array(F.lit("先读 notes.md，再用自测题检查理解。"))).alias("steps"))
    c = c.join(a.select("deck_id").union(b.select("deck_id")).distinct(), "deck_id", "left_anti")
    return a.unionByName(b).unionByName(c)


def methods(items: DataFrame, most: int = 8) -> DataFrame:
    """Up to eight items of each deck that name formulas, steps or examples."""
    good = items.where(_holds(F.concat_ws(" ", "point", "explanation"), METHODS))
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("pos"))
    return good.withColumn("r", rank).where(F.col("r") <= most).select("deck_id", F.col("r").alias("pos"), F.col("point").alias("name"), F.col("explanation").alias("detail"))


def answer_text(kind: Column, options: Column, answer: Column) -> Column:
    """The answer in words: letter and text of a choice, 正确 or 错误, else the answer itself or 见解析."""
    index = F.least(F.greatest(as_int(answer), F.lit(0)), F.greatest(F.size(options) - 1, F.lit(0))).cast("int")
    chosen = F.trim(F.concat(F.char((F.lit(65) + index).cast("int")), F.lit(". "), F.coalesce(F.get(options, index), F.lit(""))))
    return F.when(kind == "choice", chosen).when(kind == "true_false", F.when(answer == "true", "正确").otherwise("错误")).otherwise(F.coalesce(F.nullif(clean_inline(answer), F.lit("")), F.lit("见解析")))


def exam_lines(asked: DataFrame) -> DataFrame:
    """(deck_id, i, part, line): each question, its options, and its answer with explanation, in order of part."""
    head = F.concat(F.col("i").cast("string"), F.lit(". 【"), _named(LABELS, F.col("type"), "题目"), F.lit(" · "), F.col("points").cast("string"), F.lit(" 分】"), "question")
    letters = F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o, j: F.concat(F.lit("   "), F.char((F.lit(65) + j).cast("int")), F.lit(". "), o))
    said = F.coalesce(F.nullif(clean_inline(F.col("explanation")), F.lit("")), F.lit("复习对应知识点后再核对答案。"))
    answer = F.concat(F.col("i").cast("string"), F.lit(". **答案**："), answer_text(F.col("type"), F.col("options"), F.col("answer")))
    lines = F.concat(F.array(head), letters, F.array(answer, F.concat(F.lit("   **解析**："), said)))
    return asked.select("deck_id", "i", F.posexplode(lines).alias("part", "line"))


def review_lines(items: DataFrame) -> DataFrame:
    """(deck_id, pos, part, line): each item with why, pitfall and page, as a review list."""
    label = _named({"must": "必考", "key": "重点", "frequent": "高频", "background": "了解"}, F.col("importance"), "重点")
    lines = F.array_compact(F.array(
        F.concat(F.lit("- **["), label, F.lit("] "), "point", F.lit("**："), "explanation"), F.when(F.col("why") != "", F.concat(F.lit("  - 为什么考："), "why")), F.when(F.col("pitfall") != "", F.concat(F.lit("  - 易错点："), "pitfall")),
        F.when(F.col("slide_id") > 0, F.concat(F.lit("  - 来源：P"), F.col("slide_id").cast("string"))),
    ))
    return items.select("deck_id", "pos", F.posexplode(lines).alias("part", "line"))


def study_payload(pages: DataFrame, items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per deck: title (of its first page with one), pages, titles of up to 300 pages, up to 300 guard items worth explaining, coverage, a summary."""
    title = F.when(clean_inline(F.col("title")) != "", clean_inline(F.col("title")))
    p = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages_total"), F.min_by(title, F.when(title.isNotNull(), F.col("slide_id"))).alias("title"))
    first = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id"))
    t = pages.withColumn("r", first).where("r <= 300").groupBy("deck_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("slide_id", "title")))).alias("page_titles"))
    rank = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_id", "element_id"))
    good = items.where(F.col("must_explain") | (F.col("confidence") >= 0.7)).withColumn("r", rank).where("r <= 300")
    g = good.groupBy("deck_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("slide_id", "element_id", "learning_role", "confidence")))).alias("high_value_items"))
    c = coverage.select("deck_id", F.to_json(F.struct("total", "covered", "ratio")).alias("coverage"))
    summary = F.concat(F.lit("本复习清单基于 "), F.col("pages_total").cast("string"), F.lit(" 页课程材料生成，优先覆盖定义、公式、表格结论、图示解释和容易混淆的概念。"))
    return p.join(t, "deck_id", "left").join(g, "deck_id", "left").join(c, "deck_id", "left").withColumn("summary", summary)
