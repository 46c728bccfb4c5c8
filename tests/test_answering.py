"""The written index, composed retrieval, checks of answers and the small joins around them."""

from pyspark.sql import functions as F

from scriptorium.operators import answering as an
from scriptorium.operators import retrieval as rt

DOCS = [(1, "a", "en", "red apple pie 1234"), (2, "a", "de", "red car"), (3, "b", "en", "green apple"), (4, "b", "en", "blue sky apple apple"), (5, "c", "en", "")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, source string, lang string, text string")


def test_index_equals_direct_scores_and_grows(spark, tmp_path):
    docs = _docs(spark)
    asked = spark.createDataFrame([(1, "red apple"), (2, "nothing here")], "qid long, question string")
    an.write_index(docs.where("doc_id < 3"), "doc_id", "text", str(tmp_path))
    an.write_index(docs.where("doc_id >= 3"), "doc_id", "text", str(tmp_path), mode="append")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(an.bm25_indexed(spark, str(tmp_path), "doc_id", asked))
    assert found == rows(rt.bm25(docs, "doc_id", "text", asked)) and {r[1] for r in found} == {1, 2, 3, 4}


def test_retrieve_by_mode(spark):
    docs = _docs(spark)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "哪家"), (3, "alpha")], "qid long, question string")
    docs = docs.withColumn("source", F.when(F.col("source") == "a", "alpha").when(F.col("source") == "b", "beta").otherwise("gamma"))
    scored = spark.createDataFrame([(q, d, float(9 - d)) for q in (1, 2, 3) for d in (1, 2, 3, 4)], "qid long, doc_id long, score double")
    dense = spark.createDataFrame([(2, 5, 0.5)], "qid long, doc_id long, score double")
    out = an.retrieve(scored, dense, docs, "doc_id", "source", asked, ["alpha", "beta", "gamma"]).collect()
    assert {(r.qid, r.mode) for r in out} == {(1, "multi"), (2, "fanout"), (3, "global")}
    assert [r.doc_id for r in sorted(out, key=lambda r: r.rank) if r.qid == 3] == [1, 2, 3, 4]
    five = [r for r in out if r.doc_id == 5]
    assert len(five) == 1 and five[0].bm25_rank is None and five[0].vec_rank == 1
    assert max(sum(r.qid == 2 and r.source == s for r in out) for s in ("alpha", "beta", "gamma")) == 2


def test_table_parts_are_capped(spark):
    docs = _docs(spark).where("doc_id < 5")
    asked = spark.createDataFrame([(1, "x")], "qid long, question string")
    scored = spark.createDataFrame([(1, d, float(9 - d)) for d in (1, 2, 3, 4)], "qid long, doc_id long, score double")
    out = an.retrieve(scored, scored.limit(0), docs, "doc_id", "source", asked, ["a", "b"], F.when(F.col("lang") == "en", "t1"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]


def test_answers_are_checked(spark):
    asked = spark.createDataFrame([(1, "price"), (2, "none")], "qid long, question string")
    blocks = spark.createDataFrame([(1, 1, "sold for 1,234"), (1, 2, "x")], "qid long, rank long, text string")
    seen = an.answer(blocks, asked, F.lit("L"), "text", lambda q, c: "it is 1234 and 5678 [1][3]" if c else "no [1]")
    one, two = seen.orderBy("qid").collect()
    assert (list(one.valid), list(one.invalid), list(one.unsupported), one.ok, one.n_blocks) == ([1], [3], ["5678"], False, 2)
    assert (list(two.valid), list(two.invalid), two.ok, two.n_blocks) == ([], [1], True, 0)


def test_evidence_tables(spark):
    docs = _docs(spark)
    places = spark.createDataFrame([(1, "1234", "a"), (2, "9", "a"), (3, "green", "a"), (9, "x", "a")], "doc_id long, value string, owner string")
    found = {(r.doc_id, r.problem) for r in an.evidence_violations(places, docs, "doc_id", "text", "source").collect()}
    assert found == {(2, "no_value"), (3, "other_group"), (9, "no_chunk")}
    hits = spark.createDataFrame([(1, 1), (2, 3)], "qid long, doc_id long")
    rows = an.evidence_matrix(places.select("doc_id"), docs, "doc_id", hits, [1, 2]).collect()
    assert {(r.doc_id, r.in_1, r.in_2) for r in rows} == {(1, True, False), (2, False, False), (3, False, True), (9, False, False)}


def test_small_joins(spark):
    docs = _docs(spark)
    facts = spark.createDataFrame([(1, ["x"])], "doc_id long, facts array<string>")
    assert {r.doc_id: list(r.facts) for r in an.with_facts(docs.select("doc_id"), facts, "doc_id").where("doc_id < 3").collect()} == {1: ["x"], 2: []}
    q = spark.createDataFrame([("a",), ("b",)], "question string")
    c = spark.createDataFrame([("a", "zz"), ("a", "yyy")], "question string, context string")
    assert [tuple(r) for r in an.with_contexts(q, c, "question", 2).collect()] == [("a", "yy")]
    found, missing = an.with_files(docs.select("doc_id"), facts.select("doc_id"), "doc_id")
    assert found.count() == 1 and missing.count() == 4
    assert tuple(an.keep_rate(docs, docs.where("doc_id < 3")).first()) == (5, 2, 0.4)
    assert tuple(an.keep_rate(docs.limit(0), docs.limit(0)).first()) == (0, 0, 0.0)
    assert an.completeness(docs, docs.where("doc_id > 1")).first().complete is False
    assert sorted(r.doc_id for r in an.capped_cells(docs, "source", [F.col("doc_id")], 1).collect()) == [1, 3, 5]


def test_segmenter_drops_stop_and_single_words(spark):
    rows = spark.createDataFrame([(1, "公司 净利润 增 长期"), (2, None)], "k long, t string")
    assert {r.k: list(r.tokens) for r in an.segmented(rows, "k", "t", str.split).collect()} == {1: ["净利润", "长期"], 2: []}


def test_verbatim(spark):
    rows = spark.createDataFrame([(" b ", "abc"), ("", "abc"), (None, "abc"), ("d", "abc"), ("b", None)], "e string, c string")
    assert [r[0] for r in rows.select(an.verbatim(F.col("e"), F.col("c"))).collect()] == ["是", "否", "否", "否", "否"]
