"""Queries of groups F and H: evaluation and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as fx
from scriptorium.operators import evaluate as ev
from scriptorium.operators import pages as pg
from scriptorium.operators import retrieval as rt

from .curation import _PAIRS, _pairs, _strip
from .retrieval import _BM25, _bm25
from .tables import table

_SQUASH = r"regexp_replace({0}, '[\s\x{{3000}}\x{{00a0}}\x{{0085}}\x{{2028}}\x{{2029}}]+', '', 'g')"
_REFUSED = "software|license"
_QUESTIONS = [("Q1", "点查", "alpha?", False), ("Q2", "跨公司", "beta?", False), ("Q10", "跨公司", "gamma?", False), ("Q11", "附加", "delta?", True)]


def char_f1(spark, sf):
    rows = _pairs(spark, sf).withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    return ev.char_f1(rows, "key", "answer", "question")


def answer_scores(spark, sf):
    p, g = F.col("text"), F.reverse("text")
    return table(spark, sf, "documents").select(
        "doc_id", ev.num_hit(p, F.concat(F.coalesce(p, F.lit("")), F.lit(" 77123"))).alias("num_hit"), ev.len_ratio(p, F.col("source")).alias("len_ratio"), ev.refused(p, g, _REFUSED).alias("refused")
    )


def _scored(spark, sf):
    rows = table(spark, sf, "labels")
    return rows.select(
        F.when(F.col("toxic") == 1, "after").otherwise("before").alias("model"), (F.col("doc_id") % 5).cast("string").alias("cell"), (F.col("doc_id") % 97 / 100).alias("char_f1"),
        F.when(F.col("doc_id") % 3 > 0, F.col("quality").cast("double")).alias("num_hit"), (F.col("doc_id") % 13 / 10).alias("len_ratio"), (F.col("doc_id") % 11 == 0).alias("refused"),
    ).where("NOT (cell = '4' AND model = 'after')")


_SCORED = """sc AS (SELECT CASE WHEN toxic = 1 THEN 'after' ELSE 'before' END AS model, (doc_id % 5)::VARCHAR AS cell, (doc_id % 97)::DOUBLE / 100 AS char_f1,
CASE WHEN doc_id % 3 > 0 THEN quality::DOUBLE END AS num_hit, (doc_id % 13)::DOUBLE / 10 AS len_ratio, doc_id % 11 = 0 AS refused FROM labels),
cells AS (SELECT model, cell, count(*) AS n, round(avg(char_f1), 3) AS char_f1, round(avg(num_hit), 3) AS num_hit, count(num_hit) AS n_with_numbers, count(*) FILTER (refused) AS refused, round(avg(len_ratio), 2) AS len_ratio
FROM sc WHERE NOT (cell = '4' AND model = 'after') GROUP BY model, cell)"""


def cell_summary(spark, sf):
    return ev.cell_summary(_scored(spark, sf))


def cell_pivot(spark, sf):
    return ev.cell_pivot(ev.cell_summary(_scored(spark, sf)), value="n_with_numbers")


def hit_rate_by_type(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    flag = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("quality").cast("string"))
    ratio = F.concat(F.col("toxic").cast("string"), F.lit("/"), (F.col("doc_id") % 3).cast("string"))
    return rows.groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"), ev.hit_rate(flag).alias("gold_rate"), F.round(ev.ratio_mean(ratio), 6).alias("fact_mean"))


def error_distribution(spark, sf):
    rows = table(spark, sf, "events").select(F.explode(F.split(F.concat_ws(";", "event_type", F.when(F.col("value") > 50, "high")), ";")).alias("error"))
    return rows.groupBy("error").agg(F.count("*").alias("n"))


def verdict_score(spark, sf):
    return ev.verdict_score(table(spark, sf, "labels").withColumn("v", F.when(F.col("doc_id") % 7 > 0, F.col("quality") + F.col("toxic"))), "v")


def gold_rank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    ranked = rt.top_k(_bm25(spark, sf), 20, F.col("doc_id").desc()).join(docs, "doc_id")
    gold = spark.createDataFrame([(1, "src1", "en"), (2, "src2", "fr"), (2, "src7", "fr"), (3, "none", "de")], "qid long, source string, lang string")
    return ev.gold_rank(ranked, gold, ["source", "lang"])


def freeze_hash(spark, sf):
    return ev.freeze_hash(spark.createDataFrame(_QUESTIONS, "id string, type string, question string, must_refuse boolean"))


def question_problems(spark, sf):
    return ev.question_problems(spark.createDataFrame(_QUESTIONS, "id string, type string, question string, must_refuse boolean"), total=4, cross=2)


def markdown_report(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    return ev.markdown_table(counts, ["lang", "n", "longest"], "lang")


def repeated_edge_lines(spark, sf):
    return pg.repeated_edges(table(spark, sf, "documents"), "source", "text", 2)


def header_share(spark, sf):
    return pg.headers_by_share(table(spark, sf, "documents"), "source", "text", 0.01)


def mode_with_share(spark, sf):
    return pg.mode_with_share(table(spark, sf, "events"), "user_id", "event_type", least=0.4)


def carry_forward_section(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = pg.carry_forward(lines, ["doc_id"], ["line_no"], F.when(F.length("line") <= 40, F.col("line")), "")
    return marked.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("section").alias("section_md5"))


def span_lengths(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length("line") <= 40)
    return pg.spans(lines.select("doc_id", F.col("line_no").cast("long").alias("start"), F.col("n").cast("long").alias("n")), "doc_id", "start", "n").select("doc_id", "start", "stop")


def latest_version(spark, sf):
    return pg.latest(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def title_filter(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.col("html").alias("title"))
    return rows.where(pg.title_matches(F.col("title"), ["the and", "of the"], ["cookie", "摘要"])).select("page_id")


def page_number(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("x\n第 "), F.regexp_extract("url", r"(\d+)", 1), F.lit(" 页\n \n")).alias("body"))
    return rows.select("page_id", fx.page_number(F.split("body", "\n")).cast("long").alias("page"))


QUERIES = {f.__name__: f for f in (
    char_f1, answer_scores, cell_summary, cell_pivot, hit_rate_by_type, error_distribution, verdict_score, gold_rank, freeze_hash, question_problems, markdown_report,
    repeated_edge_lines, header_share, mode_with_share, carry_forward_section, span_lengths, latest_version, title_filter, page_number,
)}

_PLAIN = r"list_distinct(list_transform(list_filter(regexp_extract_all({0}, '\d[\d,]*\.?\d*'), lambda x: length(replace(replace(x, ',', ''), '.', '')) >= 3 AND NOT regexp_full_match(replace(x, ',', ''), '(19|20)\d{{2}}')), lambda x: rtrim(replace(x, ',', ''), '.')))"
_EDGES = f"""l AS (SELECT source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS k FROM documents),
e AS (SELECT source, k[1] AS line FROM l WHERE len(k) > 0 UNION ALL SELECT source, k[len(k)] FROM l WHERE len(k) > 0)"""
_rows = ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()}, {int(a[1:])})" for a, b, c, d in _QUESTIONS)
_json = """'[' || string_agg('{"id":"' || id || '","must_refuse":' || must_refuse || ',"question":"' || question || '","type":"' || type || '"}', ',' ORDER BY n) || ']'"""
_LINES = "x AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
ORACLES = {
    "char_f1": f"""WITH {_PAIRS}, p AS (SELECT conv_id || '/' || turn AS key, {_SQUASH.format('answer')} AS a, {_SQUASH.format('question')} AS b FROM pairs),
g AS (SELECT key, s, gram, count(*) AS n FROM (SELECT key, 0 AS s, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i::INT, 2))) AS gram FROM p
 UNION ALL SELECT key, 1, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i::INT, 2))) FROM p) GROUP BY ALL),
t AS (SELECT key, gram, coalesce(sum(n) FILTER (s = 0), 0) AS x, coalesce(sum(n) FILTER (s = 1), 0) AS y FROM g GROUP BY key, gram),
f AS (SELECT key, sum(least(x, y)) AS m, sum(x) AS x, sum(y) AS y FROM t GROUP BY key)
SELECT key, CASE WHEN coalesce(m, 0) > 0 THEN round((2.0::DOUBLE * m) / (x + y), 3) ELSE 0.0 END::DOUBLE AS char_f1 FROM p LEFT JOIN f USING (key)""",
    "answer_scores": f"""WITH n AS (SELECT doc_id, text, source, {_PLAIN.format("text")} AS p, {_PLAIN.format("text || ' 77123'")} AS g FROM documents)
SELECT doc_id, CASE WHEN len(g) > 0 THEN round(len(list_intersect(g, p))::DOUBLE / len(g), 3) END AS num_hit, round(length(text)::DOUBLE / greatest(1, length(source)), 2) AS len_ratio,
regexp_matches(text, '{_REFUSED}') AND NOT regexp_matches(reverse(text), '{_REFUSED}') AS refused FROM n""",
    "cell_summary": f"WITH {_SCORED} SELECT * FROM cells",
    "cell_pivot": f"WITH {_SCORED} SELECT cell, coalesce(max(n_with_numbers) FILTER (model = 'before')::VARCHAR, '-') AS before, coalesce(max(n_with_numbers) FILTER (model = 'after')::VARCHAR, '-') AS after FROM cells GROUP BY cell",
    "hit_rate_by_type": """WITH r AS (SELECT lang, CASE WHEN doc_id % 4 = 0 THEN '' ELSE quality::VARCHAR END AS f, toxic::DOUBLE / greatest(1.0, (doc_id % 3)::DOUBLE) AS q FROM labels JOIN documents USING (doc_id))
SELECT lang AS type, count(*) AS n, CASE WHEN count(*) FILTER (f <> '') > 0 THEN count(*) FILTER (f = '1') || '/' || count(*) FILTER (f <> '') ELSE '—' END AS gold_rate, round(avg(q), 6) AS fact_mean FROM r GROUP BY lang""",
    "error_distribution": "SELECT error, count(*) AS n FROM (SELECT event_type AS error FROM events UNION ALL SELECT 'high' FROM events WHERE value > 50) GROUP BY error",
    "verdict_score": "SELECT coalesce(sum(v), 0)::BIGINT AS score, count(v) * 2 AS most FROM (SELECT CASE WHEN doc_id % 7 > 0 THEN quality + toxic END AS v FROM labels)",
    "gold_rank": f"""WITH {_BM25}, g(qid, source, lang) AS (VALUES (1, 'src1', 'en'), (2, 'src2', 'fr'), (2, 'src7', 'fr'), (3, 'none', 'de'))
SELECT g.qid::BIGINT AS qid, min(rank) AS gold_rank FROM g LEFT JOIN (SELECT bmr.*, source, lang FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20) r ON r.qid = g.qid AND r.source = g.source AND r.lang = g.lang GROUP BY g.qid""",
    "freeze_hash": f"SELECT sha256({_json}) AS digest FROM (VALUES {_rows}) v(id, type, question, must_refuse, n)",
    "question_problems": f"SELECT 'count' AS problem FROM (VALUES {_rows}) v(id, type, question, must_refuse, n) WHERE type NOT LIKE '附加%' HAVING count(*) <> 4",
    "markdown_report": """SELECT '| lang | n | longest |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' | ' || longest || ' |', chr(10) ORDER BY lang) AS markdown
FROM (SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY lang)""",
    "repeated_edge_lines": f"WITH {_EDGES} SELECT source, line, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 2",
    "header_share": f"WITH {_EDGES}, t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source) SELECT source, line, count(*) AS n FROM e JOIN t USING (source) GROUP BY source, line, pages HAVING count(*) > 0.01::DOUBLE * pages",
    "mode_with_share": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS share,
row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, CASE WHEN share >= 0.4::DOUBLE THEN event_type END AS mode, round(share, 6) AS share FROM b WHERE r = 1""",
    "carry_forward_section": f"""WITH {_LINES} SELECT doc_id, line_no, md5(coalesce(last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '')) AS section_md5 FROM x""",
    "span_lengths": f"WITH {_LINES} SELECT doc_id, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), n) AS stop FROM x WHERE length(line) <= 40",
    "latest_version": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, event_id DESC) = 1",
    "title_filter": "SELECT page_id FROM (SELECT page_id, replace(html, ' ', '') AS t FROM pages) WHERE (contains(t, 'theand') OR contains(t, 'ofthe')) AND NOT contains(t, 'cookie') AND NOT contains(t, '摘要')",
    "page_number": r"SELECT page_id, CASE WHEN p = '' THEN NULL ELSE p::BIGINT END AS page FROM (SELECT page_id, regexp_extract(url, '(\d+)', 1) AS p FROM pages)",
}
