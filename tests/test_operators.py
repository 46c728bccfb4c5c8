"""Operators on hand-made rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import checkpoints
from scriptorium.operators import curate as cu
from scriptorium.operators import evaluate as ev
from scriptorium.operators import near
from scriptorium.operators import pages as pg
from scriptorium.operators import retrieval as rt


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_bm25_counts_a_question_term_once(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(1, "alpha alpha unknown"), (2, "alpha")], "qid long, question string")
    top = rt.top_k(rt.bm25(chunks, "id", "text", q), 5, F.col("id").desc())
    got = {(r.qid, r.rank): (r.id, r.score) for r in top.collect()}
    assert got[1, 1][0] == 2 and got[1, 2][0] == 1 and got[1, 1][1] == got[2, 1][1] and len(got) == 4


def test_filter_after_the_cut(spark):
    ranked = spark.createDataFrame([(1, i, 1.0 / i, i) for i in range(1, 6)], "qid long, id long, score double, rank long").where("rank <= 3")
    members = spark.createDataFrame([(2, "x"), (5, "x")], "id long, c string")
    assert [r.id for r in rt.filtered_after(ranked, members, "id", F.col("c") == "x", 2).collect()] == [2]


def test_fusion_and_caps(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 1, 2, "a"), (1, 3, 1, "a")], "qid long, list_no int, rank int, id string")
    fused = rt.top_k(rt.fuse(lists, "id"), 9, F.col("first_seen"))
    assert [r.id for r in fused.orderBy("rank").collect()] == ["a", "b", "c"]
    hits = spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate([("t", "x"), ("t", "x"), ("t", "y"), (None, "x"), (None, "x"), ("u", "x")])], "qid long, rank int, tkey string, company string")
    capped = rt.cap(hits, F.col("tkey"), 2, [F.col("rank")], applies=F.col("tkey").isNotNull())
    assert rows(rt.cap(capped, F.col("company"), 2, [F.col("rank")]).select("rank")) == [(0,), (1,)]


@pytest.mark.parametrize("q, mode", [("所有者权益合计是多少", "fanout"), ("甲公司和乙公司对比", "multi"), ("甲公司分别是多少", "fanout"), ("收入", "global")])
def test_route(spark, q, mode):
    assert spark.range(1).select(rt.route(F.lit(q), ["甲公司", "乙公司"])).first()[0] == mode


def test_greedy_keeps_what_a_dropped_row_resembles(spark):
    a = "abcdefghijklmnopqrstuvwxyz0123456789"
    data = [("g", 1, a), ("g", 2, a + "AB"), ("g", 3, a + "ABCDEF"), ("h", 1, a), ("g", 4, ""), ("g", 5, ""), ("g", 6, None)]
    got = cu.greedy_near_dup(spark.createDataFrame(data, "g string, o int, t string"), "g", "o", F.col("t"), 0.85)
    assert {(r.g, r.o): r.kept for r in got.collect()} == {("g", 1): True, ("g", 2): False, ("g", 3): True, ("h", 1): True, ("g", 4): True, ("g", 5): True, ("g", 6): True}


def test_greedy_equals_the_plain_rule(spark):
    rng = random.Random(5)
    syllables = ["ing", "er", "the", "an", "on", "re", "st", "ou", "ha", "ti", "es", "nd", "wh", "ble", "ea", "ly", "or", "sh", "\u00e9n", "\u4e2d\u6587", "\U0001f600"]
    prose = lambda n: "".join(rng.choice(syllables) for _ in range(n))

    def edited(text, n):
        for _ in range(n):
            k = rng.randrange(len(text))
            text = text[:k] + prose(1) + text[k + rng.randrange(3) :]
        return text

    texts = [prose(rng.choice((2, 8, 60, 300, 900, 1400))) for _ in range(300)]
    texts += [edited(rng.choice(texts[:60]), rng.randrange(60)) for _ in range(150)] + [edited(texts[5] + prose(400), 6) for _ in range(60)] + ["", "ab", "abc", "abc"]
    rng.shuffle(texts)
    data = [(None if k % 97 == 0 else "uvw"[min(k % 5, 2)], None if k % 101 == 0 else k, t) for k, t in enumerate(texts)]
    want, kept = {}, {}
    for g, o, t in data:
        own = {t[i : i + 3] for i in range(len(t) - 2)}
        like = lambda x, own=own: own and len(own & x) / len(own | x) > 0.8
        want[g, o, t] = g is None or o is None or not any(map(like, kept.setdefault(g, [])))
        if want[g, o, t] and g is not None and o is not None:
            kept[g].append(own)
    assert 50 < sum(not x for x in want.values()) < 300
    got = cu.greedy_near_dup(spark.createDataFrame(data, "g string, o long, t string"), "g", "o", F.col("t"), 0.8)
    assert {(r.g, r.o, r.t): r.kept for r in got.collect()} == want


def test_greedy_moves_little_where_texts_share_their_grams(spark):
    rng = random.Random(6)
    syllables = ["ing", "er", "the", "an", "on", "re", "st", "ou", "ha", "ti", "es", "nd", "wh", "ble", "ea", "ly", "or", "sh"]
    data = [("g", k, "".join(rng.choices(syllables, k=400))) for k in range(600)]
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    tops = [checkpoints.folder(spark).removeprefix("file:"), *(str(d) for d in disks)]
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for top in tops for d, _, fs in os.walk(top) for f in fs if f.endswith((".parquet", ".data")))
    before = size()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as with large tables
    try:
        got = cu.greedy_near_dup(spark.createDataFrame(data, "g string, o long, t string"), "g", "o", F.col("t"), 0.8)
        assert got.where("kept").count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < size() - before < 4 * sum(len(t) for _, _, t in data)


def test_sketches_differ_in_no_more_bits_than_the_sets_in_grams():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 500, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n))
        b = np.union1d(rng.choice(a, max(1, n - n // 9), replace=False), rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1)))
        x, y = (np.frombuffer(near.sketch(s), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        assert int(np.bitwise_count(near._folded(x, w) ^ near._folded(y, w)).sum()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n, test", [(1, 0), (2, 0), (3, 1), (10, 2), (30, 4)])
def test_split_sizes(spark, n, test):
    split = cu.stratified_split(spark.range(n).withColumn("s", F.lit("x")), F.col("s"), "id")
    assert split.where("split = 'test'").count() == test and cu.split_leaks(split, "id").count() == 0


def test_alias_review_project(spark):
    docs = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, None)], "id long, url string")
    assert rows(cu.alias_of(docs, F.col("url"), "id").select("id", "alias_of"), "id") == [(1, None), (2, 1), (3, None), (4, None)]
    assert rows(cu.apply_review(docs, docs.where("id = 3"), ["id", "url"]).select("id")) == [(1,), (2,), (4,)]
    assert cu.project(docs, ["url", "zz"]).columns == ["url"]


def test_char_f1(spark):
    data = [("a", "abab", "abab"), ("b", "", "abc"), ("c", "aaaa", "aa"), ("d", "a b", "ab"), ("e", None, None)]
    got = dict(rows(ev.char_f1(spark.createDataFrame(data, "k string, p string, g string"), "k", "p", "g")))
    assert got == {"a": 1.0, "b": 0.0, "c": 0.5, "d": 1.0, "e": 0.0}


def test_scores_and_cells(spark):
    data = [("before", "1", 0.5, None, 1.0, False), ("before", "1", 1.0, None, 2.0, True), ("after", "2", 0.2, 1.0, 1.0, False)]
    summary = ev.cell_summary(spark.createDataFrame(data, "model string, cell string, char_f1 double, num_hit double, len_ratio double, refused boolean"))
    assert rows(summary.select("cell", "n", "num_hit", "n_with_numbers", "refused")) == [("1", 2, None, 0, 1), ("2", 1, 1.0, 1, 0)]
    assert rows(ev.cell_pivot(summary)) == [("1", "0.75", "-"), ("2", "-", "0.2")]
    t = spark.createDataFrame([("收入未披露", "收入1234", "2026 1234 12")], "p string, g string, n string")
    assert tuple(t.select(ev.refused(F.col("p"), F.col("g")), ev.num_hit(F.col("n"), F.col("g")), ev.num_hit(F.col("n"), F.lit("无"))).first()) == (True, 1.0, None)


def test_quantiles(spark):
    q = ev.index_quantiles(spark.range(1, 12).withColumnRenamed("id", "v"), "v", [0.5, 0.9]).first()
    assert (q.p50, q.p90, q.max, q.n) == (6, 10, 11, 11)


def test_mode_with_share(spark):
    data = [("a", 1)] * 9 + [("a", 2)] + [("b", 1)] * 89 + [("b", 2)] * 11 + [("c", 2), ("c", 1)]
    got = dict((r.g, (r.mode, r.share)) for r in pg.mode_with_share(spark.createDataFrame(data, "g string, v int"), "g", "v").collect())
    assert got == {"a": (1, 0.9), "b": (None, 0.89), "c": (None, 0.5)}


def test_sections(spark):
    data = [(1, 0, "第一节 概况"), (1, 1, "x"), (1, 2, "第二节 经营....... 5"), (2, 0, "y"), (2, 1, "第三节 财务")]
    lines = spark.createDataFrame(data, "page int, line int, t string").withColumn("doc", F.lit("d"))
    got = pg.carry_forward(lines, ["doc"], ["page", "line"], pg.section_heading(F.col("t")), "封面")
    assert [r.section for r in got.orderBy("page", "line").collect()] == ["第一节 概况", "第一节 概况", "第一节 概况", "第一节 概况", "第三节 财务"]
    assert spark.range(1).select(pg.toc_entry(F.lit("第二节 经营情况 ........ 5"))["page"]).first()[0] == 5


def test_edges_and_lines(spark):
    pages = spark.createDataFrame([("d", "H\na\n1/9"), ("d", "H\nb\n2/9"), ("d", "H"), ("e", None)], "doc string, t string")
    assert rows(pg.headers_by_share(pages, "doc", "t")) == [("d", "H", 4)]
    kept = spark.range(1).select(pg.drop_page_marks(F.array(*[F.lit(x) for x in ("H", "a", "12", "3/9", "")]), F.array(F.lit("H")))).first()[0]
    assert kept == ["a"]


def test_table_title_and_header(spark):
    above = F.array(*[F.lit(x) for x in ("主要财务指标情况表", "单位：元", "1,234", "√适用", "2026 年", "结束：")])
    assert spark.range(1).select(pg.table_title(above, ["表", "情况"])).first()[0] == "主要财务指标情况表"
    head = lambda *c: spark.range(1).select(pg.looks_like_header(F.array(*[F.lit(x) for x in c]), ["项目"])).first()[0]
    assert head("项目", "金额") and not head("项目", "12") and not head("项目", "") and not head("甲", "乙")


def test_table_chain(spark):
    def f(seq, page, title, table, top, bottom, header=False):
        return ("d", seq, page, title, table, top, bottom, 100.0, "s", header)

    data = [
        f(1, 1, "T", [["h", "k"], ["1", "2"]], 50.0, 95.0), f(2, 2, "", [["h", "k"], ["3", "4"]], 5.0, 40.0), f(3, 3, "T", [["5", "6"]], 5.0, 20.0),
        f(4, 4, "", [["7", "8", "9"]], 5.0, 90.0), f(5, 5, "", [["a", "b", "c"]], 5.0, 90.0, True),
    ]
    schema = "doc string, seq int, page int, title string, rows array<array<string>>, top double, bottom double, height double, section string, header_like boolean"
    got = pg.merge_tables(spark.createDataFrame(data, schema), "doc").orderBy("table_no").collect()
    # The chain keeps the first fragment's bottom, so the third still joins.
    assert [(r.first_page, r.last_page, len(r.rows)) for r in got] == [(1, 3, 4), (4, 4, 1), (5, 5, 1)]


def test_outside_boxes(spark):
    chars = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0), (1, 5.0, 7.0, 5.0, 7.0), (2, 0.0, 2.0, 0.0, 2.0)], "p int, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, 1.0, 3.0, 1.0, 3.0)], "p int, bx0 double, bx1 double, btop double, bbottom double")
    assert rows(pg.outside_boxes(chars, boxes, "p").select("p", "x0")) == [(1, 5.0), (2, 0.0)]


def test_latest_and_titles(spark):
    data = [(1, 1, None), (1, 2, None), (2, 3, "2020-01-02"), (2, 4, "2020-01-01")]
    got = pg.latest(spark.createDataFrame(data, "k int, seq int, ts string").withColumn("ts", F.col("ts").cast("timestamp")), ["k"], "ts", "seq")
    assert rows(got.select("k", "seq")) == [(1, 2), (2, 3)]
    m = lambda t: spark.range(1).select(pg.title_matches(F.lit(t), ["2026 年半年度报告"], ["摘要"])).first()[0]
    assert m("甲2026年 半年度报告") and not m("甲2026年半年度报告摘要") and not m("甲2025年年度报告")


def test_question_rules(spark):
    schema = "id string, type string, question string, must_refuse boolean"
    bad = spark.createDataFrame([("Q1", "点查", "a", False), ("Q2", "点查", "a", None)], schema)
    assert rows(ev.question_problems(bad)) == [("count",), ("cross_company",), ("missing_key",), ("repeated",)]


def test_evidence_matches(spark):
    """Every pair at level 1 or 2 is found, also where a quote's rarest word is changed or cut."""
    import random

    from scriptorium.operators import verify as vf

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(6)] + [(6, "短句子甲乙丙"), (7, "ab c"), (8, None), (9, "")]
    docs = [(0, None), (1, ""), (2, "x短句子，甲乙 丙y"), (3, "zabcz")]
    for i, t in items[:6]:
        w = t.split()
        for n in (0, 1, 2, 4, 8):
            v = list(w)
            for k in r.sample(range(40), n):
                v[k] = word()
            docs.append((10 * (i + 1) + n, " ".join([*(word() for _ in range(30)), "".join(v[:2]), *v[2:], *(word() for _ in range(30))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string")
    got = {(x.doc_id, x.item_id): (x.level, x.ratio) for x in vf.evidence_matches(d, "doc_id", "text", b, "item_id", "item").collect()}
    every = d.where("text IS NOT NULL").crossJoin(b.where("length(item) > 2")).select("doc_id", "item_id", vf.evidence_level(F.col("item"), F.col("text")).alias("e"))
    want = {(x.doc_id, x.item_id): (x.e.level, x.e.ratio) for x in every.collect() if x.e.level > 0}
    assert got == want and len(want) > 15


def test_held_elsewhere(spark):
    from scriptorium.operators import verify as vf

    docs = [(1, "s", "1234 and 5,678 and 99.5 and 2020"), (2, "s", "912345 约 5678"), (3, "t", "1234"), (4, "s", None), (5, "s", "99.51"), (6, "u", "777 777"), (7, "v", "12345678901 3"), (8, "v", "x12,345,678,901,2")]
    got = {(x.doc_id, x.number): x.held for x in vf.held_elsewhere(spark.createDataFrame(docs, "doc_id long, source string, text string"), "doc_id", "source", "text").collect()}
    want = {}
    import re

    for k, s, t in docs:
        for mark, n in re.findall(r"(≈|约|算出|计算得|得到)?\s*(\d[\d,]*\.?\d*)", t or ""):
            n = n.replace(",", "").rstrip(".")
            if not mark and len(n.replace(".", "")) >= 3 and not re.fullmatch(r"(19|20)\d{2}", n):
                want[k, n] = any(n in (u or "").replace(",", "") for j, v, u in docs if v == s and j != k)
    assert got == want


def test_plain_numbers(spark):
    from scriptorium.functions import text as fx

    found = lambda t: spark.range(1).select(fx.plain_numbers(F.lit(t))).first()[0]
    assert found("12.34,56") == ["12.34"] and found("1,234 2023 2,023 2023. 12") == ["1234", "2023"]
