"""Columns on hand-made rows: the traps that fixtures don't hold."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import folds, text as fx
from scriptorium.operators import verify as vf


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [kind(v) for v in values.values()]))) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def kind(v):
    if isinstance(v, list):
        return f"array<{kind(v[0]) if v else 'string'}>"
    return {str: "string", int: "int", float: "double", bool: "boolean"}.get(type(v), "string")


def plain_split(text, size=800, overlap=120, least=30):
    out, cur = [], ""
    for line in [x.strip() for x in text.split("\n") if x.strip()]:
        if len(line) > size:
            if cur:
                out.append(cur)
            start = 0
            while len(line) - start > size:
                out.append(line[start : start + size])
                start += size - overlap
            cur = line[start:]
        elif len(cur) + len(line) + 1 <= size:
            cur = cur + "\n" + line if cur else line
        else:
            if cur:
                out.append(cur)
                cur = cur[-overlap:] + "\n" + line
            else:
                cur = line
    return [c.strip() for c in [*out, cur] if len(c.strip()) > least]


@pytest.mark.parametrize("lengths", [[800], [801], [1480], [1481], [700, 99], [700, 100], [700, 101, 700], [30], [31], [2161, 5], [10, 900, 10]])
def test_split_text(spark, lengths):
    text = "\n　\n\n".join(chr(97 + i) * n for i, n in enumerate(lengths))
    assert one(spark, folds.split_text(F.col("t")), t=text) == plain_split(text.replace("　", ""))


def test_split_text_null(spark):
    assert spark.sql("select cast(null as string) t").select(folds.split_text(F.col("t"))).first()[0] == []


def test_table_text(spark):
    rows = [["项目", "金额"], ["甲", ""], ["", "2"]]
    assert one(spark, folds.table_to_text(F.col("t"), F.col("r")), t="表", r=rows) == "表\n项目 | 金额\n甲 | -\n- | 2"
    assert one(spark, folds.table_to_text(F.col("t"), F.col("r")), t="", r=rows).startswith("项目")
    parts = one(spark, folds.split_table_rows(F.col("t"), F.col("r")), t="T", r=[["h" * 30, "b"], *[["x" * 300, str(i)] for i in range(5)], ["y" * 1000, "z"]])
    assert len(parts) == 4 and all(p.startswith("T\n" + "h" * 30) for p in parts) and max(map(len, parts)) > 1000


def test_cells(spark):
    assert one(spark, folds.cell_join(F.col("p")), p=["营业", "收入"]) == "营业收入"
    assert one(spark, folds.cell_join(F.col("p")), p=["营业", "income"]) == "营业income"
    assert one(spark, folds.cell_join(F.col("p")), p=["net ", " ", "income"]) == "net income"
    assert one(spark, folds.clean_cell(F.col("p")), p="a　b\nc") == "a b c"


def test_page_number(spark):
    for lines, want in ((["a", "1/110"], 1), (["~ 141 ~", " "], 141), (["第 5 页"], 5), (["37"], 37), (["no"], None), (["12", "text"], 12)):
        assert one(spark, fx.page_number(F.col("p")), p=lines) == want


def test_numbers(spark):
    t = "2026年收入1,234.元，≈41.44%，12，5678，1999"
    assert one(spark, fx.checked_numbers(F.col("t")), t=t) == ["1234", "5678"]
    assert one(spark, fx.exempt_numbers(F.col("t")), t=t) == ["1999", "2026", "41.44"]
    assert one(spark, vf.unsupported_numbers(F.col("t"), F.col("b")), t=t, b=["x 51,2345", "y"]) == ["5678"]


def test_citations(spark):
    c = one(spark, vf.citations(F.col("t"), F.lit(8)), t="a[1][0] b[9][1][3]")
    assert (c["valid"], c["invalid"]) == ([1, 3], [0, 9])


def test_evidence(spark):
    level = lambda e, c: one(spark, vf.evidence_level(F.col("e"), F.col("c")), e=e, c=c)["level"]
    assert level("收入，增长 12%", "公司收入增长12%。") == 2
    assert level("收入降低", "收入增长") == 0
    assert level("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyX") == 1
    assert level("abcdefghijkl", "abcdefXhijkl") == 0


def test_stage1(spark):
    reason = lambda q, a, e, c: one(spark, vf.stage1_reason(F.col("q"), F.col("a"), F.col("e"), F.col("c")), q=q, a=a, e=e, c=c)
    chunk = "公司本期营业收入为1,234万元，同比增长。"
    assert reason("短", "", "", chunk) == "question_length"
    assert reason("根据上述材料收入是多少呢？", "", "", chunk) == "meta_phrase"
    assert reason("公司营业收入是多少呢？", "", " ", chunk) == "no_evidence"
    assert reason("公司营业收入是多少呢？", "9999", "完全不同的一句话呀", chunk) == "evidence_not_verbatim"
    assert reason("公司营业收入是多少呢？", "9999", "营业收入为1,234万元", chunk) == "numbers_missing"
    assert reason("公司营业收入是多少呢？", "1234", "营业收入为1,234万元", chunk) == "ok"


def test_facts_json_labels(spark):
    facts = F.array(F.struct(F.lit("a").alias("name"), F.array(F.lit("1,2 3"), F.lit("zz")).alias("any")), F.struct(F.lit("b").alias("name"), F.array(F.lit("q")).alias("any")))
    assert one(spark, vf.fact_hits(facts, F.col("t")), t="x123") == (1, 2, ["b"])
    assert one(spark, fx.recover_json(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, fx.recover_json(F.col("t")), t='Sure: [1, 2] ok') == "[1, 2]"
    assert one(spark, fx.recover_json(F.col("t")), t="none") is None
    assert one(spark, fx.citation_label(F.lit("甲"), F.lit("2026H1"), F.lit("半年报"), F.lit(3))) == "依据：《甲 2026 年半年度报告》第 3 页"
    assert one(spark, fx.chunk_label(*[F.lit(x) for x in ("甲", "600519", "2026H1", "半年报", "节")], F.lit(0))) == "【甲·600519·2026H1半年报·节·第?页·正文】"
    assert one(spark, fx.exchange_of(F.lit("600519"))) == "sse" and one(spark, fx.exchange_of(F.lit("000858"))) == "szse"


def test_revenue_row(spark):
    got = one(spark, vf.revenue_row(F.col("t"), "营业收入"), t="营业收入 无\n| 营业收入 | 1,234.50 | 1,000.00 | 23.45 |")
    assert tuple(got) == ("1,234.50", "23.45")
