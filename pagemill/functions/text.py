"""Text, hash and cast functions on columns. White space is Unicode's; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Element ids in a text: slide number, kind and number in the slide.
ELEMENT_ID = r"s\d+_(?:t|tbl|img|fig)\d+"
#: Parts of a text that are no explanation, removed in this order.
COMMENT = r"(?s)<!--.*?-->"
NOT_VISIBLE = (r"【[^】]*?PPT[^】]*?】", r"（\s*PPT\s*第\s*\d+\s*页\s*）", rf"(?U)\b{ELEMENT_ID}\b", r"(?U)\bp\d+:")
FILLER = r"(?U)[#>*_\-\s`~|:：,，.。;；、()（）\[\]【】]+"


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def preview(c: Column, limit: int = 160) -> Column:
    """Collapsed text, cut to limit - 1 characters and an ellipsis."""
    return cut(collapse(c), limit)


def cut(c: Column, limit: int) -> Column:
    """A text of over limit characters cut to limit - 1 and an ellipsis; one pattern, so that c is computed once."""
    return F.regexp_replace(c, rf"(?s)\A(.{{{limit - 1}}}).{{2,}}\z", "$1…")


def truncate(c: Column, limit: int) -> Column:
    """limit - 1 characters and three points where the text is longer; the result may exceed the limit by two."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("..."))).otherwise(c)


def trim_middle(c: Column, limit: int, marker: str = "\n...\n") -> Column:
    """The first 70 % and the last 30 % of the limit, with a marker between."""
    head = int(limit * 0.7)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(limit - head)))).otherwise(c)


def shorten(c: Column, limit: int) -> Column:
    """One line of at most limit characters."""
    text = F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def slugify(c: Column, fallback: str = "section") -> Column:
    """Lower case, runs of other than letters, digits and underscore as one hyphen, none at the ends."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w一-鿿]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def clean_lines(c: Column) -> Column:
    """Lines collapsed (ideographic space too), empty ones dropped; null has none."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n")
    return F.filter(F.transform(lines, lambda x: collapse(F.replace(x, F.lit("　"), F.lit(" ")))), lambda x: x != "")


def page_text(c: Column) -> Column:
    """Clean lines of a page without NUL characters, joined by newlines."""
    return F.array_join(clean_lines(F.replace(c, F.lit("\x00"), F.lit(""))), "\n")


def text_key(c: Column) -> Column:
    """Comparison key: white space and punctuation removed, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s:：,，.。;；、\-_（）()<>]+", ""))


def strip(c: Column) -> Column:
    """White space at the ends removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def heading_key(c: Column) -> Column:
    """Comparison key of a heading: its leading number, white space and the colons at its ends removed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)^(?:\d+|[一二三四五六七八九十]+)[.、\s-]+", ""), r"(?U)\s+", ""), F.lit("：:"))


def heading_text(c: Column) -> Column:
    """A heading without comments, the prefix 课程笔记, its number, and colons and hyphens at its ends."""
    text = strip(F.regexp_replace(c, COMMENT, ""))
    text = strip(F.regexp_replace(text, r"(?U)^课程笔记[：:\s-]*", ""))
    text = strip(F.regexp_replace(text, r"(?U)^\s*[（(]?\s*(?:\d+|[一二三四五六七八九十]+)\s*[)）.、]\s*", ""))
    return F.btrim(text, F.lit("：: -"))


def title_key(c: Column) -> Column:
    """Comparison key of a title: that of its heading text, dashes and book marks removed too."""
    return F.lower(F.regexp_replace(heading_text(c), r"(?U)[\s:：,，.。;；、\-_—（）()《》<>]+", ""))


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, COMMENT, "")


def clean_inline(c: Column) -> Column:
    """Tags and comments removed, white space collapsed; null as empty."""
    return collapse(strip_comments(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")))


def clean_text(c: Column) -> Column:
    """A foreign parser's text: tags as spaces, white space collapsed."""
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def clean_markdown(c: Column) -> Column:
    """Comments removed, lines without white space at their ends, one newline at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(strip_comments(c), r"(?m)[ \t]+$", ""), r"\s+\z", ""), F.lit("\n"))


def source_tokens(c: Column) -> Column:
    """Distinct element ids in a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?U)\b({ELEMENT_ID})\b"), F.lit(1)))


def source_slides(c: Column) -> Column:
    """Distinct page numbers in ``p12:`` marks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\bp(\d+):"), F.lit(1)), lambda x: x.cast("int")))


def slide_of(element_id: Column) -> Column:
    return F.nullif(F.regexp_extract(element_id, r"^s(\d+)_", 1), F.lit("")).try_cast("int")


def image_targets(c: Column) -> Column:
    """Link targets of a text's images, without angle brackets."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"!\[[^\]]*]\(([^)]+)\)"), F.lit(1)), lambda t: F.btrim(F.trim(t), F.lit("<>")))


def is_visible(block: Column) -> Column:
    """Whether a block says something beside comments, citations, ids and punctuation; an image counts."""
    text = F.regexp_replace(strip_comments(block), r"!\[[^\]]*]\([^)]+\)", " image ")
    for part in NOT_VISIBLE:
        text = F.regexp_replace(text, part, " ")
    return F.regexp_replace(text, FILLER, "") != ""


def text_lines(c: Column) -> Column:
    """Lines without white space at their ends, empty ones left out; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), strip), lambda x: x != "")


def numbered_lines(c: Column, numerals: str = "一二三四五") -> Column:
    """Lines that begin with a number; white space at the ends is removed of those only."""
    return F.transform(F.filter(F.split(c, r"\R"), lambda x: x.rlike(rf"(?U)^\s*(?:\d+|[{numerals}])\s*[.、．]")), strip)


def is_outline(c: Column, numerals: str = "一二三四五") -> Column:
    """Three or more numbered lines, of at most 260 characters together. A text of fewer lines isn't split."""
    lines = numbered_lines(c, numerals)
    return c.rlike(r"(?s)\R.*\R") & (F.size(lines) >= 3) & (F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)) <= 260)


#: Titles of contents pages; labels that stand alone there; what covers name.
STRUCTURAL_TITLES = ["目录", "课程目录", "本章目录", "章节导航", "contents", "outline", "agenda"]
STRUCTURAL_LABELS = ["目录", "课程目录", "本章目录", "章节导航", "contents", "outline"]
COVER_MARKERS = ["讲师", "教师", "教授", "联系邮箱", "邮箱", "主页", "email", "homepage", "http", "www"]
GUARD_COVER_MARKERS = ["讲师", "教师", "教授", "邮箱", "email", "homepage", "www", "http"]


def key_is_one_of(c: Column, words: list[str]) -> Column:
    """Whether a text's comparison key is one of the words; a pattern that gives up at the first other letter."""
    between = r"[\s:：,，.。;；、\-_（）()<>]*"
    return c.rlike(rf"(?iU)^{between}(?:" + "|".join(between.join(w) for w in words) + rf"){between}\z")


def is_structural_text(c: Column) -> Column:
    """A title of contents, or an outline by numerals up to ten."""
    return key_is_one_of(c, STRUCTURAL_TITLES) | is_outline(c, "一二三四五六七八九十")


def is_structural_page(title: Column, text: Column, index: Column, guard: bool = False) -> Column:
    """A contents page by title or outline, or a first page with a cover's words.

    text: the page's title and blocks, joined by newlines. The guard's test takes a whole text that is a label and
    numerals up to ten, that of coverage a label alone in one of the first four lines and numerals up to five.
    """
    cover, key = F.lit(False), text_key(text)
    for m in GUARD_COVER_MARKERS if guard else COVER_MARKERS:
        cover = cover | key.contains(m)
    label = F.exists(F.slice(F.split(text, r"\R"), 1, 4), lambda x: key_is_one_of(x, STRUCTURAL_LABELS))
    listed = is_structural_text(text) if guard else label | is_outline(text)
    return key_is_one_of(F.coalesce(title, F.lit("")), STRUCTURAL_TITLES) | ((index == 0) & cover) | listed


def is_section_title_page(title: Column, blocks: Column) -> Column:
    """A page with a title and up to three blocks that aren't numbers, of at most 120 characters together."""
    some = F.filter(F.transform(blocks, strip), lambda x: (x != "") & ~x.rlike(r"(?U)^\d+$"))
    return (F.coalesce(title, F.lit("")) != "") & (F.size(some) <= 3) & (F.aggregate(some, F.lit(0), lambda n, x: n + F.length(x)) <= 120)


def is_formula(c: Column) -> Column:
    """Comparison and equality signs, sums, quantifiers, fractions or an order of growth."""
    return c.rlike(r"[=<>≤≥∑∀∃]|\\frac|\\sum|\\forall|O\([^)]+\)")


def contains_any(c: Column, words: list[str], lowered: bool = False) -> Column:
    """Whether a text holds one of the words, in any case; lowered: the text is in lower case already."""
    low = c if lowered else F.lower(c)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return found


def count_of(c: Column, chars: str) -> Column:
    """How many of these characters a text holds."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


#: What marks code, outputs, causes, fixes, annotations and explanations.
CODE_SIGNALS = ["#include", "using namespace", "main()", "cout", "cin", "getline", "std::", "return ", "char ", "string ", "int "]
CODE_WORDS = r"(?U)\b(if|for|while|void|int|char|string|cout|cin)\b"
OUTPUT_SIGNALS = ["Data Entered", "Student Number", "Student Name", "Hello John", "输入", "输出"]
OUTPUT_PROMPT = r"(?U)\benter\s+(your|student)"
CAUSE = r"(?i)因为|由于|导致|所以|因此|异常|留在|依然|被接下来|流提取|换行符|空白字符|缓冲|before|after"
FIX = r"(?i)cin\.ignore|ignore\(|需要|必须|清空|清除|丢弃|解决|修复|避免|之前|之后"
ANNOTATION = r"(?i)×|√|->|=>|注意|提示|关键|红色|蓝框"
EXPLAINS = r"(?Ui)\b(because|therefore|need|before|after|fix|causes?)\b"


def has_signal(c: Column, kind: str) -> Column:
    """Whether a text looks like formula, code or output, names a cause, a fix or an annotation, or explains."""
    low = F.lower(c)
    if kind == "formula":
        return is_formula(c)
    if kind == "code":
        return contains_any(c, CODE_SIGNALS) | ((count_of(c, "{};<>=") >= 4) & low.rlike(CODE_WORDS))
    if kind == "output":
        named = F.lit(False)
        for s in OUTPUT_SIGNALS:
            named = named | c.contains(s)
        return low.rlike(OUTPUT_PROMPT) | (named & c.contains(":"))
    if kind == "explains":
        return (F.length(F.regexp_replace(c, r"[^一-鿿]", "")) >= 4) | c.rlike(EXPLAINS)
    return c.rlike({"cause": CAUSE, "fix": FIX, "annotation": ANNOTATION}[kind])


def token_set(c: Column) -> Column:
    """Lower-case ASCII words of two characters or more, and single CJK characters."""
    return F.array_union(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]{2,})"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"([一-鿿])"), F.lit(1)))


def string_list(c: Column, limit: int = 100) -> Column:
    """The first ``limit`` strings cleaned, empty ones left out; null as empty."""
    return F.filter(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, limit), clean_inline), lambda x: x != "")


def sha256_text(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def stable_key(*columns: str) -> Column:
    """SHA-256 of a JSON object with sorted keys, nulls kept. The keys are this library's own."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def str_or_none(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def json_object(c: Column) -> Column:
    """VARIANT of a JSON object in a text: without a code fence, else from the first brace to the last; else null."""
    bare = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    value = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def point_from_text(c: Column) -> Column:
    """The part before the first separator, tried in order, that leaves 2 to 36 characters; else 36 characters; 知识点 for an empty text."""
    return point_of(clean_inline(c))


def point_of(text: Column) -> Column:
    """``point_from_text`` of a text that is clean already, best a column of its own: it is read many times."""
    separators = ("：", ":", "。", ".", "；", ";")
    heads = [strip(F.substring_index(text, s, 1)) for s in separators]
    found = F.coalesce(*[F.when(F.contains(text, F.lit(s)) & F.length(h).between(2, 36), h) for s, h in zip(separators, heads, strict=True)], F.rtrim(F.substring(text, 1, 36)))
    return F.when(text == "", F.lit("知识点")).otherwise(found)


def ensure_sentence(c: Column) -> Column:
    """Collapsed text with a full stop where it ends in no mark."""
    text = collapse(c)
    return F.when((text == "") | text.rlike(r"[。.!！？?：:]$"), text).otherwise(F.concat(text, F.lit("。")))


def quote_lines(c: Column) -> Column:
    """Lines that aren't empty as a Markdown quote."""
    return F.array_join(F.transform(text_lines(c), lambda x: F.concat(F.lit("> "), x)), "\n")


def escape_md(c: Column) -> Column:
    """A Markdown table cell: bars escaped, newlines as breaks."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def styled_text(runs: Column) -> Column:
    """array<struct<text,color,bold,italic>> as HTML: escaped, a span where a run has a colour (#RRGGBB), weight or slant; null if none has."""
    def css(r: Column) -> Column:
        color = F.when(F.trim(r["color"]).rlike(r"^#[0-9A-Fa-f]{6}$"), F.concat(F.lit("color:"), F.upper(F.trim(r["color"]))))
        return F.array_join(F.array_compact(F.array(color, F.when(r["bold"], F.lit("font-weight:700")), F.when(r["italic"], F.lit("font-style:italic")))), ";")

    def piece(r: Column) -> Column:
        text = r["text"]
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.when(css(r) == "", text).otherwise(F.concat(F.lit('<span style="'), css(r), F.lit('">'), text, F.lit("</span>")))

    some = F.filter(runs, lambda r: F.coalesce(r["text"], F.lit("")) != "")
    whole = strip(F.array_join(F.transform(some, piece), ""))
    return F.when(F.exists(some, lambda r: css(r) != "") & (whole != ""), whole)


def zh_ordinal(n: Column) -> Column:
    """Chinese numerals up to twenty, digits beyond."""
    digit = F.array(*map(F.lit, "一二三四五六七八九十"))
    return F.when(n.between(1, 10), F.get(digit, n - 1)).when(n.between(11, 19), F.concat(F.lit("十"), F.get(digit, n - 11))).when(n == 20, F.lit("二十")).otherwise(n.cast("string"))


def round_score(c: Column) -> Column:
    """Clamped to 0 to 1, three digits."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3)


def rel_path(c: Column, root: str) -> Column:
    """A path below root without it, with forward slashes."""
    path, top = F.replace(c, F.lit("\\"), F.lit("/")), root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 20)).otherwise(path)


def with_unique_names(df: DataFrame, keys: list[str], name: str, order: str, separator: str = "-") -> DataFrame:
    """df with repeats of a name within the keys numbered: the second gets -2, the third -3, in this order."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat_ws(separator, F.col(name), n.cast("string"))))


def file_sha256(files: DataFrame) -> DataFrame:
    """binaryFile rows → path, digest of the hex text of their bytes."""
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2(F.lower(F.hex("content")), 256)).alias("digest"))
