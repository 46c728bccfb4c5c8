"""Text as columns: normal forms, grams, tokens, numbers, labels. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the index leaves out.
STOP_WORDS = (
    "的 和 及 与 或 在 是 为 了 元 万元 亿元 年 月 日 公司 报告 本期 上期 期末 期初 "
    "期末余额 期初余额 人民币 币种 单位 合计 其中 项目 附注 一 二 三 四 五 六 七 八 九 十 "
    "以及 及其 该 本 上述 如下 情况 说明 无 有 不 非"
).split()
# Patterns and phrases of the checks.
NUMBER = r"(≈|约|算出|计算得|得到)?\s*(\d[\d,]*\.?\d*)"
PLAIN_NUMBER = r"\d[\d,]*\.?\d*"
YEAR = r"^(19|20)\d{2}$"
META_PHRASE = r"根据(上述|原文|材料)|上述材料|如上所述|本报告期数据来源"
REFUSAL = r"检索到的原文中没有相关内容|材料未涉及|未披露|没有相关"
PAGE_MARKS = [r"(\d+)\s*/\s*(\d+)\s*$", r"[~～]\s*(\d+)\s*[~～]\s*$", r"第\s*(\d+)\s*页\s*$", r"^(\d{1,3})$"]
SECTION = r"^\s*第\s*([一二三四五六七八九十]+)\s*节\s*([^\n]{0,60})"
CJK_EDGE = "一-鿿（）、，。：；"


def _lit(x: str) -> Column:
    return F.lit(x)


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once; a column that lambdas use is else evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def norm_evidence(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s,，。、；：]", "")


def norm_question(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s,，。、；：？！]", "")


def norm_fact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s,，]", "")


def gram_list(c: Column, n: int) -> Column:
    """All runs of n >= 2 characters, with repeats; empty if the text is shorter. Time is linear: the text is cut into characters once."""

    def grams(chars: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(chars) - n)
        return F.when(F.size(chars) >= n, F.transform(places, lambda i: F.concat(*[chars[i + k] for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return let(F.split(c, ""), grams)


def gram_set(c: Column, n: int = 3) -> Column:
    return F.array_distinct(gram_list(c, n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""

    def share(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(both / (F.size(x["a"]) + F.size(x["b"]) - both))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def coverage(part: Column, whole: Column) -> Column:
    """Share of the first set that the second holds; 0 if the first is empty."""
    return let(part, lambda p: F.when(F.size(p) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p, whole)) / F.size(p)))


def index_tokens(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of two letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(c), _lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def query_tokens(c: Column) -> Column:
    """Words of a question, without filters."""
    return F.regexp_extract_all(F.lower(c), _lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigram_tokens(c: Column) -> Column:
    """Fallback where no segmenter knows words: character pairs without white space."""
    return gram_list(squash(c), 2)


def _clean_number(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"\.+$", "")


def number_tokens(c: Column) -> Column:
    """array<struct<token, exempt>> of numbers of three digits or more; years and computed numbers (after a mark) are exempt."""
    found = F.arrays_zip(
        F.regexp_extract_all(c, _lit(NUMBER), F.lit(1)).alias("mark"), F.regexp_extract_all(c, _lit(NUMBER), F.lit(2)).alias("raw")
    )
    tokens = F.transform(found, lambda x: F.struct(_clean_number(x["raw"]).alias("token"), x["mark"].alias("mark")))
    long = F.filter(tokens, lambda x: F.length(F.replace(x["token"], F.lit("."), F.lit(""))) >= 3)
    return F.transform(long, lambda x: F.struct(x["token"].alias("token"), (F.rlike(x["token"], _lit(YEAR)) | (F.length(x["mark"]) > 0)).alias("exempt")))


def checked_numbers(c: Column) -> Column:
    """Distinct numbers that a source must hold."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(number_tokens(c), lambda x: ~x["exempt"]), lambda x: x["token"])))


def exempt_numbers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(number_tokens(c), lambda x: x["exempt"]), lambda x: x["token"])))


def plain_numbers(c: Column) -> Column:
    """Distinct numbers of three digits or more that aren't years; commas go once a number is found, and a year with a closing dot is none."""
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    found = F.filter(
        F.regexp_extract_all(c, _lit(PLAIN_NUMBER), F.lit(0)), lambda x: (F.length(F.replace(bare(x), F.lit("."), F.lit(""))) >= 3) & ~F.rlike(bare(x), _lit(YEAR))
    )
    return F.array_sort(F.array_distinct(F.transform(found, _clean_number)))


def quoted_numbers(c: Column) -> Column:
    """Numbers of three digits or more as the quality check takes them: years count, a closing dot stays."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), _lit(PLAIN_NUMBER), F.lit(0))
    return F.filter(found, lambda x: F.length(F.replace(x, F.lit("."), F.lit(""))) >= 3)


def citation_ids(c: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, _lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")))))


def page_number(lines: Column) -> Column:
    """The page number in the last two lines that aren't blank, the bottom one first, by the first pattern that fits."""
    rows = F.filter(F.transform(lines, strip), lambda x: x != "")

    def of(line: Column) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in PAGE_MARKS])

    last = F.try_element_at(rows, F.lit(-1))
    before = F.try_element_at(rows, F.lit(-2))
    return F.coalesce(of(last), of(before)).try_cast("int")


def chunk_label(name: Column, code: Column, period: Column, report_type: Column, section: Column, page: Column, kind: str = "正文") -> Column:
    """Prefix of what is indexed; an unknown page (null or 0) is a question mark."""
    shown = F.coalesce(F.nullif(page, F.lit(0)).cast("string"), F.lit("?"))
    report = F.concat(period, report_type)
    return F.concat(F.lit("【"), F.concat_ws("·", name, code, report, section, F.concat(F.lit("第"), shown, F.lit("页")), F.lit(kind)), F.lit("】"))


def citation_label(title: Column, period: Column, report_type: Column, page: Column) -> Column:
    kind = F.when(report_type == "年报", "年度").otherwise("半年度")
    base = F.concat(F.lit("依据：《"), title, F.lit(" "), F.substring(period, 1, 4), F.lit(" 年"), kind, F.lit("报告》"))
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(base, F.lit("第 "), page.cast("string"), F.lit(" 页"))).otherwise(base)


def exchange_of(code: Column) -> Column:
    return F.when(code.startswith("6"), "sse").otherwise("szse")


def clean_file_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"(?U)[^\w\-.]", "_"), F.lit(80))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def coalesce_keys(json: Column, *names: str) -> Column:
    """The first of several spellings of a JSON key."""
    return F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names])


def recover_json(c: Column) -> Column:
    """The JSON inside a reply: without its code fence, else from the first bracket to the last."""
    bare = F.regexp_replace(strip(c), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.when(F.rlike(bare, _lit(r"^[\[{]")), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0), F.lit("")))
