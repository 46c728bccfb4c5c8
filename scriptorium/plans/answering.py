"""Queries of written indexes, composed answering, evidence tables, sources and sinks, and the rules of single columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.checkpoints import folder
from scriptorium.functions import folds, text as fx
from scriptorium.operators import answering as an
from scriptorium.operators import curate as cu
from scriptorium.operators import pages as pg
from scriptorium.operators import retrieval as rt
from scriptorium.operators import verify as vf
from scriptorium.sources import io

from .curation import _CHUNKS, _PAIRS, _grams, _norm, _numbers, _pairs, _strip
from .retrieval import _BM25, _RRF, _VALUES, _VEC, _questions
from .tables import table

NAMES = [f"src{i}" for i in range(2, 10)]
ASKED = [(1, "src2 and src7 apache license version"), (2, "la entre pour les 所有"), (3, "nicht der heit software software")]


def _scratch(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _vectors(spark, sf) -> DataFrame:
    ids = table(spark, sf, "embeddings").where("vec_id IN (0, 1, 2)").select((F.col("vec_id") + 1).alias("qid"), F.col("embedding").alias("query"))
    scored = rt.vector_scores(table(spark, sf, "embeddings"), "vec_id", "embedding", ids).withColumnRenamed("vec_id", "doc_id")
    return scored.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")


def bm25_indexed(spark, sf):
    """The index is written, then questions are answered from its tables."""
    at = _scratch(spark, "index")
    an.write_index(table(spark, sf, "documents"), "doc_id", "text", at)
    return rt.top_k(an.bm25_indexed(spark, at, "doc_id", _questions(spark)), 20, F.col("doc_id").desc())


def retrieve_auto(spark, sf):
    """Three questions in one plan, each by the mode that its words choose."""
    docs, asked = table(spark, sf, "documents"), spark.createDataFrame(ASKED, "qid long, question string")
    part = F.when(F.col("lang") != "en", F.concat_ws("_", "source", "lang"))
    return an.retrieve(rt.bm25(docs, "doc_id", "text", asked), _vectors(spark, sf), docs, "doc_id", "source", asked, NAMES, part)


def answer_checks(spark, sf):
    """Answers that cite blocks and name numbers, held against the blocks of bm25_topk's windows."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    blocks = rt.top_k(rt.bm25(docs, "doc_id", "text", _questions(spark)), 8, F.col("doc_id").desc()).join(docs, "doc_id")
    said = _questions(spark).select("qid", F.concat(F.lit("见 [1][3][9]，共 77123 元，约 4,567.8，2024"), F.col("qid").cast("string")).alias("answer"))
    made = an.check_answers(said, blocks.select("qid", "rank", "text"))
    return made.select("qid", "n_blocks", F.array_join(F.col("valid").cast("array<string>"), ";").alias("valid"), F.array_join(F.col("invalid").cast("array<string>"), ";").alias("invalid"), "checked", F.array_join("unsupported", ";").alias("unsupported"), "ok")


def bigram_df_top(spark, sf):
    """The fallback's dictionary: character pairs of turns."""
    posts = rt.postings(table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), "text"), "key", fx.bigram_tokens(F.col("text")))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).orderBy(F.desc("df"), "term").limit(50)


def vector_completeness(spark, sf):
    return an.completeness(table(spark, sf, "documents"), table(spark, sf, "embeddings"))


def _locators(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("source").alias("owner"))


def evidence_matrix(spark, sf):
    found = rt.top_k(rt.bm25(table(spark, sf, "documents"), "doc_id", "text", _questions(spark)), 400, F.col("doc_id").desc())
    return an.evidence_matrix(_locators(spark, sf), table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", found, [1, 2, 3])


def evidence_assertions(spark, sf):
    """Locators of which some name a chunk, a value or an owner that isn't so."""
    value = F.when(F.col("doc_id") % 3 == 0, "no such value").otherwise("e")
    rows = _locators(spark, sf).select(F.when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), value.alias("value"), F.when(F.col("doc_id") % 2 == 0, F.lit("src0")).otherwise(F.col("owner")).alias("owner"))
    return an.evidence_violations(rows, table(spark, sf, "documents"), "doc_id", "text", "source")


def key_facts(spark, sf):
    facts = table(spark, sf, "labels").where("toxic = 1").groupBy("doc_id").agg(F.array(F.max("quality").cast("string")).alias("facts"))
    return an.with_facts(table(spark, sf, "documents").select("doc_id"), facts, "doc_id").select("doc_id", F.array_join("facts", ",").alias("facts"))


def rag_contexts(spark, sf):
    """Questions of conversations whose text an earlier run holds a context for."""
    rows = _pairs(spark, sf)
    contexts = rows.where("conv_id % 2 = 0").select("question", F.col("answer").alias("context"))
    return an.with_contexts(rows.select("conv_id", "turn", "question"), contexts, "question", 200).select("conv_id", "turn", F.md5("context").alias("context_md5"))


def cell_cap(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return an.capped_cells(rows, "source", [F.col("quality").desc(), F.col("doc_id")], 4).select("source", "doc_id", "quality")


def keep_rate(spark, sf):
    return an.keep_rate(table(spark, sf, "documents"), cu.apply_review(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), ["doc_id"]))


def manifest_pages(spark, sf):
    found, missing = an.with_files(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
    both = found.select("lang", F.lit("found").alias("state")).unionByName(missing.select("lang", F.lit("missing").alias("state")))
    return both.groupBy("lang", "state").agg(F.count("*").alias("n"))


def corpus_filter(spark, sf):
    """Documents of the chosen languages that aren't copies of another."""
    return cu.alias_of(table(spark, sf, "documents"), F.md5("text"), "doc_id").where("lang IN ('en', 'de') AND alias_of IS NULL").select("doc_id", "lang")


def qa_sources(spark, sf):
    """Chunks that questions are made from: text of 200 characters or more."""
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(folds.split_text(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.where("length(chunk) >= 200").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))


def report_counts(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.length("text").alias("c"), F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | ")))).alias("t"))
    return rows.groupBy("source").agg(F.count("*").alias("pages"), F.sum("c").cast("long").alias("chars"), F.sum("t").cast("long").alias("table_lines"))


def type_rollup(spark, sf):
    """Answers by language: how many, with checked numbers, and with all of them held by other documents of the source."""
    held = vf.held_elsewhere(table(spark, sf, "documents"), "doc_id", "source", "text").groupBy("doc_id").agg(F.every("held").alias("ok"))
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(held, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("ok").alias("with_numbers"), F.count_if("ok").alias("numbers_ok"))


def fanout_groups(spark, sf):
    """Groups that a fan-out's blocks come from."""
    return retrieve_auto(spark, sf).groupBy("qid", "mode").agg(F.count_distinct("source").alias("groups"), F.count("*").alias("blocks"))


def review_unseen(spark, sf):
    """A review sample of what no earlier sample held, each with whether its evidence stands in its text."""
    docs = table(spark, sf, "documents")
    rows = cu.remaining(docs, table(spark, sf, "labels"), "doc_id")
    picked = cu.review_sample(rows, F.col("source"), "doc_id", [F.col("n_chars")]).join(docs, "doc_id")
    return picked.select("doc_id", F.col("priority").cast("long").alias("priority"), an.verbatim(F.when(F.col("doc_id") % 3 > 0, F.substring("text", 5, 20)), F.col("text")).alias("verbatim"))


def jsonl_round_trip(spark, sf):
    """Written in two commits and read back with a declared schema."""
    at, rows = _scratch(spark, "jsonl"), table(spark, sf, "documents").select("doc_id", "source", "text")
    io.write_jsonl(rows.where("doc_id % 2 = 0"), at)
    io.write_jsonl(rows.where("doc_id % 2 = 1"), at, mode="append")
    return io.read_jsonl(spark, at, "doc_id long, source string, text string").select("doc_id", "source", F.md5("text").alias("text_md5"))


def csv_round_trip(spark, sf):
    """Quotes, commas and line ends inside fields come back."""
    at = _scratch(spark, "csv")
    io.write_csv(table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('a "b", '), "role", F.lit("\nc")).alias("field")), at)
    return io.read_csv(spark, at, "conv_id long, turn long, field string").select("conv_id", "turn", F.md5("field").alias("field_md5"))


def document_round_trip(spark, sf):
    """A report of one row as a JSON object."""
    at = _scratch(spark, "json")
    io.write_document(table(spark, sf, "labels").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")), at)
    return io.read_json_document(spark, at, "n long, toxic long")


def vectors_round_trip(spark, sf):
    """Vectors beside their ids."""
    at = _scratch(spark, "vectors")
    table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding").write.parquet(at)
    return io.read_vectors(spark, at).select("chunk_id", F.size("embedding").cast("long").alias("width"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x"))


def update_by_key(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return io.update_by_key(rows, table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("n_chars")), "doc_id")


def resolve_first(spark, sf):
    """Users with their first purchase, and those without one."""
    users = table(spark, sf, "events").select("user_id").distinct()
    found, failed = io.resolve_first(users, table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "event_id"), "user_id", "event_id")
    return found.select("user_id", "event_id").unionByName(failed.select("user_id", F.lit(None).cast("long").alias("event_id")))


def download_states(spark, sf):
    """Sizes within 5 % of what was announced and over 1 KB."""
    size = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", io.is_downloaded(size, size + F.col("doc_id") % 100).alias("done"))


def section_headings(spark, sf):
    line = F.concat(F.lit("  第三节 "), "source", F.when(F.col("doc_id") % 3 == 0, "…").when(F.col("doc_id") % 5 == 0, ".......").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", pg.section_heading(line).alias("heading"))


def toc_entries(spark, sf):
    line = F.concat(F.lit("第二节 "), "source", F.when(F.col("doc_id") % 4 == 0, "..").otherwise(" ........ "), (F.col("doc_id") % 1000).cast("string"))
    e = pg.toc_entry(line)
    return table(spark, sf, "documents").select("doc_id", e["number"].alias("number"), e["title"].alias("title"), e["page"].cast("long").alias("page"))


def dropped_marks(spark, sf):
    """Bodies without header lines and closing page numbers."""
    lines = F.array(F.col("source"), F.lit("body"), F.col("lang"), F.lit(" 12 / 30 "), F.lit(""), F.concat(F.lit("第 "), (F.col("doc_id") % 90).cast("string"), F.lit(" 页")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(pg.drop_page_marks(lines, F.array(F.lit("src1"))), "/").alias("body"))


def clean_cells(spark, sf):
    """Wrapped cells as one line, and rows that are left of a table."""
    cell = F.concat(F.lit(" "), "source", F.lit("\n\n "), "lang", F.lit("\n年度"), F.lit("\n报告\n"), F.col("doc_id").cast("string"))
    rows = F.array(F.array(F.lit("a"), F.col("lang")), F.array(F.lit(" "), F.lit(None)), F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("b"))).otherwise(F.array(F.lit(""), F.lit(""))))
    return table(spark, sf, "documents").select("doc_id", folds.clean_cell(cell).alias("cell"), F.coalesce(F.size(folds.keep_table(rows)), F.lit(0)).cast("long").alias("n_rows"))


def revenue_rows(spark, sf):
    body = F.concat(F.lit("项目 | 本期 | 增减\n营业收入 | "), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " | -").otherwise(" | -1.25"))
    r = vf.revenue_row(body, "营业收入")
    return table(spark, sf, "orders").select("o_orderkey", r["value"].alias("value"), r["growth"].alias("growth"))


def paraphrase_gate(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", vf.paraphrase_ok(F.substring("answer", 1, 90), F.col("question")).alias("ok"))


def recovered_json(spark, sf):
    """Replies with a code fence, with words around, and without JSON."""
    body = F.to_json(F.struct(F.col("doc_id").alias("question"), F.col("lang").alias("answer")))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("so: "), body, F.lit(" done"))).otherwise("none")
    rows = table(spark, sf, "documents").select("doc_id", fx.recover_json(reply).alias("j"))
    return rows.select("doc_id", fx.coalesce_keys(F.col("j"), "问题", "question").alias("question"), fx.coalesce_keys(F.col("j"), "answer").alias("answer")).where("question IS NOT NULL AND answer IS NOT NULL")


def labels_and_names(spark, sf):
    """A chunk's label, the exchange of a code, a clean file name and a filled template."""
    code = F.lpad(F.concat((F.col("doc_id") % 7).cast("string"), F.lit("00519")), 6, "0")
    label = fx.chunk_label(F.col("source"), code, F.lit("2026H1"), F.lit("半年报"), F.lit("第三节"), F.col("doc_id") % 5)
    return table(spark, sf, "documents").select(
        "doc_id", label.alias("label"), fx.exchange_of(code).alias("exchange"), fx.clean_file_name(F.concat("source", F.lit("/a b:c"))).alias("file"),
        fx.fill_template("Q: {q} ({c})", {"q": F.col("lang"), "c": code}).alias("filled"),
    )


QUERIES = {f.__name__: f for f in (
    bm25_indexed, retrieve_auto, answer_checks, bigram_df_top, vector_completeness, evidence_matrix, evidence_assertions, key_facts, rag_contexts, cell_cap, keep_rate, manifest_pages, corpus_filter,
    qa_sources, report_counts, type_rollup, fanout_groups, review_unseen, jsonl_round_trip, csv_round_trip, document_round_trip, vectors_round_trip, update_by_key, resolve_first, download_states,
    section_headings, toc_entries, dropped_marks, clean_cells, revenue_rows, paraphrase_gate, recovered_json, labels_and_names,
)}

_names = ", ".join(f"('{n}', {i + 1})" for i, n in enumerate(NAMES))
_asked = ", ".join(f"({q}, '{t}')" for q, t in ASKED)
_fan = ", ".join(f"(2, '{n}', 2)" for n in NAMES)
_AUTO = f"""{_BM25.replace(_VALUES, _asked)}, {_VEC}, {_RRF}, md(qid, mode, blocks) AS (VALUES (1, 'multi', 8), (2, 'fanout', 22), (3, 'global', 8)),
nm(name, no) AS (VALUES {_names}), wt(qid, source, per) AS (VALUES (1, 'src2', 6), (1, 'src7', 6), {_fan}),
l2 AS (SELECT qid, 2 * no AS list_no, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id DESC) AS rank, doc_id FROM (SELECT qid, doc_id, score FROM bmr WHERE rank <= 400) JOIN documents USING (doc_id)
 JOIN wt USING (qid, source) JOIN nm ON name = source QUALIFY rank <= per),
l3 AS (SELECT qid, 1 + 2 * no AS list_no, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id) AS rank, doc_id FROM vl JOIN documents USING (doc_id) JOIN wt USING (qid, source) JOIN nm ON name = source QUALIFY rank <= per),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 1000000 + rank) AS seen
  FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY qid, doc_id),
a AS (SELECT f.*, source, lang, mode, blocks, row_number() OVER (PARTITION BY f.qid, source, lang ORDER BY score DESC, seen, doc_id) AS n FROM f JOIN documents USING (doc_id) JOIN md ON md.qid = f.qid),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, seen, doc_id) AS m FROM a WHERE lang = 'en' OR n <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc_id) AS rank FROM b WHERE mode <> 'fanout' OR m <= 2 QUALIFY rank <= blocks)"""
_LOC = "loc AS (SELECT min(doc_id) AS doc_id, source AS owner FROM documents GROUP BY source)"
_NEAR = f"""g AS (SELECT conv_id, turn, {_grams('x')} AS a, {_grams('y')} AS b, c FROM (SELECT conv_id, turn, c, {_norm('c', '？！')} AS x, {_norm('question', '？！')} AS y FROM (
SELECT conv_id, turn, question, regexp_replace({_strip('substr(answer, 1, 90)')}, '^["“”'']+|["“”'']+$', '', 'g') AS c FROM pairs)))"""
ORACLES = {
    "bm25_indexed": f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bmr WHERE rank <= 20",
    "retrieve_auto": f"WITH {_AUTO} SELECT r.qid, mode, r.rank, r.doc_id, source, r.score, l0.rank AS bm25_rank, l1.rank AS vec_rank FROM r LEFT JOIN l0 ON l0.qid = r.qid AND l0.doc_id = r.doc_id LEFT JOIN l1 ON l1.qid = r.qid AND l1.doc_id = r.doc_id",
    "fanout_groups": f"WITH {_AUTO} SELECT qid::BIGINT AS qid, mode, count(DISTINCT source) AS groups, count(*) AS blocks FROM r GROUP BY qid, mode",
    "answer_checks": f"""WITH {_BM25}, t AS (SELECT qid, replace(text, ',', '') AS t FROM bmr JOIN documents USING (doc_id) WHERE rank <= 8), n AS (SELECT qid::BIGINT AS qid, unnest(['77123', '2024' || qid]) AS number FROM (VALUES {_VALUES}) v(qid, question)),
h AS (SELECT qid, number, bool_or(coalesce(contains(t, number), false)) AS held, count(t) AS k FROM n LEFT JOIN t USING (qid) GROUP BY qid, number)
SELECT qid, max(k) AS n_blocks, CASE WHEN max(k) >= 3 THEN '1;3' WHEN max(k) >= 1 THEN '1' ELSE '' END AS valid, CASE WHEN max(k) >= 3 THEN '9' WHEN max(k) >= 1 THEN '3;9' ELSE '1;3;9' END AS invalid, count(*) AS checked,
coalesce(string_agg(number, ';' ORDER BY number) FILTER (NOT held), '') AS unsupported, bool_and(held) AS ok FROM h GROUP BY qid""",
    "bigram_df_top": f"""WITH s AS (SELECT conv_id, turn, {_norm('text').replace(',，。、；：', '')} AS t FROM conversations), g AS (SELECT conv_id, turn, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i::INT, 2))) AS term FROM s)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT conv_id, turn, term, count(*) AS tf FROM g GROUP BY ALL) GROUP BY term ORDER BY df DESC, term LIMIT 50""",
    "vector_completeness": "SELECT *, vectors >= chunks AS complete FROM (SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors)",
    "evidence_matrix": f"""WITH {_BM25}, {_LOC}, top AS (SELECT * FROM bmr WHERE rank <= 400) SELECT loc.doc_id, owner, lang, n_chars, EXISTS (SELECT 1 FROM top WHERE qid = 1 AND top.doc_id = loc.doc_id) AS in_1,
EXISTS (SELECT 1 FROM top WHERE qid = 2 AND top.doc_id = loc.doc_id) AS in_2, EXISTS (SELECT 1 FROM top WHERE qid = 3 AND top.doc_id = loc.doc_id) AS in_3 FROM loc JOIN documents USING (doc_id)""",
    "evidence_assertions": f"""WITH {_LOC}, r AS (SELECT CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no such value' ELSE 'e' END AS value, CASE WHEN doc_id % 2 = 0 THEN 'src0' ELSE owner END AS owner FROM loc)
SELECT * FROM (SELECT r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'no_chunk' WHEN NOT contains(text, value) THEN 'no_value' WHEN source <> owner THEN 'other_group' END AS problem FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id) WHERE problem IS NOT NULL""",
    "key_facts": "SELECT doc_id, coalesce(q::VARCHAR, '') AS facts FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE toxic = 1 GROUP BY doc_id) USING (doc_id)",
    "rag_contexts": f"WITH {_PAIRS}, c AS (SELECT question, min(answer) AS context FROM pairs WHERE conv_id % 2 = 0 GROUP BY question) SELECT conv_id, turn, md5(substr(context, 1, 200)) AS context_md5 FROM pairs JOIN c USING (question)",
    "cell_cap": "SELECT source, doc_id, quality FROM labels JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) <= 4",
    "keep_rate": "SELECT count(*) AS raw, count(*) FILTER (t IS NULL) AS kept, round(count(*) FILTER (t IS NULL)::DOUBLE / greatest(1, count(*)), 3) AS keep_rate FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS t FROM labels WHERE toxic = 1) USING (doc_id)",
    "manifest_pages": "SELECT lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'found' ELSE 'missing' END AS state, count(*) AS n FROM documents GROUP BY ALL",
    "corpus_filter": "SELECT doc_id, lang FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE f = doc_id AND lang IN ('en', 'de')",
    "qa_sources": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n, sum(length(chunk))::BIGINT AS chars FROM chunks WHERE length(chunk) >= 200 GROUP BY doc_id",
    "type_rollup": f"""WITH {_numbers}, e AS (SELECT DISTINCT doc_id, source, unnest(a) AS number FROM nums), t AS (SELECT doc_id, source, replace(text, ',', '') AS t FROM documents),
h AS (SELECT doc_id, bool_and(EXISTS (SELECT 1 FROM t WHERE t.source = e.source AND t.doc_id <> e.doc_id AND contains(t.t, e.number))) AS ok FROM e GROUP BY doc_id)
SELECT lang, count(*) AS n, count(ok) AS with_numbers, count(*) FILTER (ok) AS numbers_ok FROM documents LEFT JOIN h USING (doc_id) GROUP BY lang""",
    "report_counts": "SELECT source, count(*) AS pages, sum(length(text))::BIGINT AS chars, sum(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | '))))::BIGINT AS table_lines FROM documents GROUP BY source",
    "review_unseen": """WITH r AS (SELECT doc_id, source, n_chars, md5('20260924|' || doc_id) AS o FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), c AS (
SELECT doc_id, 1 AS p, o FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, doc_id) <= 3
UNION ALL (SELECT doc_id, 2, o FROM r ORDER BY n_chars, doc_id LIMIT 10) UNION ALL SELECT doc_id, 3, o FROM r), k AS (SELECT doc_id, min(p) AS p, any_value(o) AS o FROM c GROUP BY doc_id ORDER BY p, o, doc_id LIMIT 40)
SELECT doc_id, p::BIGINT AS priority, CASE WHEN doc_id % 3 > 0 AND trim(substr(text, 5, 20)) <> '' THEN '是' ELSE '否' END AS verbatim FROM k JOIN documents USING (doc_id)""",
    "jsonl_round_trip": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents",
    "csv_round_trip": "SELECT conv_id, turn, md5('a \"b\", ' || role || chr(10) || 'c') AS field_md5 FROM conversations",
    "document_round_trip": "SELECT count(*) AS n, sum(toxic)::BIGINT AS toxic FROM labels",
    "vectors_round_trip": "SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::BIGINT AS width, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings",
    "update_by_key": "SELECT doc_id, lang, coalesce(q, n_chars)::BIGINT AS n_chars FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)",
    "resolve_first": "SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS event_id FROM events GROUP BY user_id",
    "download_states": "SELECT doc_id, n_chars > 1024 AND doc_id % 100 <= 0.05 * (n_chars + doc_id % 100) AS done FROM documents",
    "section_headings": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN '第三节 ' || source END AS heading FROM documents",
    "toc_entries": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN '二' END AS number, CASE WHEN doc_id % 4 > 0 THEN source END AS title, CASE WHEN doc_id % 4 > 0 THEN doc_id % 1000 END AS page FROM documents",
    "dropped_marks": "SELECT doc_id, CASE WHEN source = 'src1' THEN '' ELSE source || '/' END || 'body/' || lang AS body FROM documents",
    "clean_cells": "SELECT doc_id, source || ' ' || lang || '年度报告' || doc_id AS cell, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_rows FROM documents",
    "revenue_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DECIMAL(15, 2)::VARCHAR END AS value, CASE WHEN o_orderkey % 3 > 0 THEN '-1.25' END AS growth FROM orders",
    "paraphrase_gate": f"""WITH {_PAIRS}, {_NEAR} SELECT conv_id, turn, length(c) BETWEEN 6 AND 80 AND (len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) < 0.5) AS ok FROM g""",
    "recovered_json": "SELECT doc_id, doc_id::VARCHAR AS question, lang AS answer FROM documents WHERE doc_id % 3 < 2",
    "labels_and_names": """SELECT doc_id, '【' || source || '·' || c || '·2026H1半年报·第三节·第' || CASE WHEN doc_id % 5 = 0 THEN '?' ELSE (doc_id % 5)::VARCHAR END || '页·正文】' AS label, CASE WHEN c LIKE '6%' THEN 'sse' ELSE 'szse' END AS exchange,
source || '_a_b_c' AS file, 'Q: ' || lang || ' (' || c || ')' AS filled FROM (SELECT *, (doc_id % 7) || '00519' AS c FROM documents)""",
}
