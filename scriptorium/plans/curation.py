"""Queries of groups C, D, E: text operators, verification, curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import folds, text as fx
from scriptorium.operators import curate as cu
from scriptorium.operators import evaluate as ev
from scriptorium.operators import verify as vf

from .tables import table

_WS = r"[\s\x{3000}\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(c: str, more: str = "") -> str:
    return rf"regexp_replace({c}, '[\s\x{{3000}}\x{{00a0}}\x{{0085}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}},，。、；：{more}]', '', 'g')"


def _grams(c: str, n: int = 3) -> str:
    return f"CASE WHEN length({c}) >= {n} THEN list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substr({c}, i::INT, {n}))) ELSE []::VARCHAR[] END"


def _pairs(spark, sf):
    """A user's turn with the assistant's next one, as question and answer."""
    from pyspark.sql import Window

    rows = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = rows.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("role2"), F.lead("text").over(w).alias("text2"))
    return nxt.where("role = 'user' AND role2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("text2").alias("answer"))


_PAIRS = """pairs AS (SELECT conv_id, turn, text AS question, text2 AS answer FROM (
SELECT *, lead(role) OVER w AS role2, lead(text) OVER w AS text2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND role2 = 'assistant')"""


def split_text_chunks(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(folds.split_text(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", (F.col("chunk_no") + 1).cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


_CHUNKS = f"""lines AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents),
folded AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: {{'o': []::VARCHAR[], 'c': x}}), lambda a, b: CASE
  WHEN length(b.c) > 800 THEN {{'o': list_concat(CASE WHEN a.c <> '' THEN list_append(a.o, a.c) ELSE a.o END,
    list_transform(range(0, ceil((length(b.c) - 800) / 680.0)::INT), lambda i: substr(b.c, (i * 680 + 1)::INT, 800))), 'c': substr(b.c, (ceil((length(b.c) - 800) / 680.0) * 680 + 1)::INT)}}
  WHEN length(a.c) + length(b.c) + 1 <= 800 THEN {{'o': a.o, 'c': CASE WHEN a.c = '' THEN b.c ELSE a.c || chr(10) || b.c END}}
  ELSE {{'o': CASE WHEN a.c <> '' THEN list_append(a.o, a.c) ELSE a.o END, 'c': CASE WHEN a.c <> '' THEN right(a.c, 120) || chr(10) || b.c ELSE b.c END}} END,
  {{'o': []::VARCHAR[], 'c': ''}}) AS s FROM lines),
chunks AS (SELECT doc_id, unnest(k) AS chunk, generate_subscripts(k, 1) AS chunk_no FROM (
  SELECT doc_id, list_filter(list_transform(CASE WHEN s.c <> '' THEN list_append(s.o, s.c) ELSE s.o END, lambda x: {_strip('x')}), lambda x: length(x) > 30) AS k FROM folded))"""


def chunk_quantiles(spark, sf):
    chunks = table(spark, sf, "documents").select(F.explode(folds.split_text(F.col("text"))).alias("chunk"))
    q = ev.index_quantiles(chunks.select(F.length("chunk").cast("long").alias("v")), "v", [0.5, 0.9, 0.99])
    return q.select("p50", "p90", "p99", "max", F.col("n").alias("n_chunks"))


def section_counts_top(spark, sf):
    return table(spark, sf, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("section")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(12)


def table_lines_to_text(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.contains("line", F.lit(" | ")))
    rows = F.array(F.transform(F.split("line", r" \| "), fx.strip))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), folds.table_to_text(F.concat(F.lit("T"), F.col("doc_id").cast("string")), rows).alias("body"))


def char_ngram_jaccard(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).where("next IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(fx.jaccard(fx.gram_set(fx.norm_question(F.col("text"))), fx.gram_set(fx.norm_question(F.col("next")))), 6).alias("jaccard"))


def normalise_text(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(fx.norm_evidence(c)).alias("evidence"), F.md5(fx.norm_question(c)).alias("question"), F.md5(fx.norm_fact(c)).alias("fact"))


def evidence_level(spark, sf):
    """Benchmark items and the documents that hold them verbatim or nearly so."""
    return vf.evidence_matches(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark").withColumnRenamed("text", "item"), "item_id", "item")


def number_tokens(spark, sf):
    c = F.col("text")
    rows = table(spark, sf, "documents").select("doc_id", fx.checked_numbers(c).alias("a"), fx.exempt_numbers(c).alias("b"), fx.plain_numbers(c).alias("p"))
    return rows.where("size(a) + size(b) + size(p) > 0").select("doc_id", F.array_join("a", ",").alias("checked"), F.array_join("b", ",").alias("exempt"), F.array_join("p", ",").alias("plain"))


def number_grounding(spark, sf):
    """A document's checked numbers that no other document of its source holds, inside a longer number or as one."""
    met = vf.held_elsewhere(table(spark, sf, "documents"), "doc_id", "source", "text")
    marked = met.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if(~F.col("held")).alias("unsupported"))
    return marked.select("doc_id", "checked", "unsupported", (F.col("unsupported") == 0).alias("ok"))


def citation_ids(spark, sf):
    answers = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" ["), ((F.col("conv_id") + F.col("turn")) % 12).cast("string"), F.lit("] ["), (F.col("turn") + 1).cast("string"), F.lit("][x]")).alias("answer"))
    made = answers.select("conv_id", "turn", vf.citations(F.col("answer"), F.lit(8)).alias("c"))
    return made.select("conv_id", "turn", F.array_join(F.transform("c.valid", lambda x: x.cast("string")), ";").alias("valid"), F.array_join(F.transform("c.invalid", lambda x: x.cast("string")), ";").alias("invalid"))


_FACTS = [("license", ["Apache License", "MIT License"]), ("mail", ["@mail"]), ("token", ["token=", "api_key="])]


def fact_hit(spark, sf):
    facts = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(v) for v in vs]).alias("any")) for n, vs in _FACTS])
    made = table(spark, sf, "documents").select("doc_id", vf.fact_hits(facts, F.col("text")).alias("f"))
    return made.select("doc_id", F.col("f.hit").cast("long").alias("hit"), F.col("f.total").cast("long").alias("total"), F.array_join("f.missing", ",").alias("missing"))


def stage1_reasons(spark, sf):
    rows = _pairs(spark, sf)
    reason = vf.stage1_reason(F.col("question"), F.col("answer"), F.substring("answer", 1, 40), F.concat_ws(" ", "answer", "question"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def alias_dedup(spark, sf):
    return cu.alias_of(table(spark, sf, "documents").select("doc_id", "text"), F.md5("text"), "doc_id").select("doc_id", "alias_of")


def greedy_near_dup(spark, sf):
    """Documents of a source, in the order of their ids, by the normal form of questions."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    return cu.greedy_near_dup(rows, "source", "doc_id", fx.norm_question(F.col("text")), 0.8).select("source", "doc_id", "kept")


def stratified_split(spark, sf):
    return cu.stratified_split(table(spark, sf, "documents").select("doc_id", "source", "lang"), F.concat("source", F.lit("|"), "lang"), "doc_id").select("doc_id", "split")


def split_leak_check(spark, sf):
    return cu.split_leaks(stratified_split(spark, sf), "doc_id")


def split_counts(spark, sf):
    rows = cu.stratified_split(table(spark, sf, "documents").select("doc_id", "source", "lang"), F.concat("source", F.lit("|"), "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


_SPLIT = """s AS (SELECT doc_id, lang, source || '|' || lang AS st, count(*) OVER (PARTITION BY source || '|' || lang) AS n,
row_number() OVER (PARTITION BY source || '|' || lang ORDER BY md5('20260924|' || doc_id), doc_id) AS r FROM documents),
split AS (SELECT doc_id, lang, CASE WHEN r <= CASE WHEN n >= 3 THEN greatest(1, round_even(0.15::DOUBLE * n, 0)) ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM s)"""


def balanced_sample(spark, sf):
    return cu.balanced_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def review_sample(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return cu.review_sample(rows, F.col("source"), "doc_id", [F.col("n_chars")]).select("doc_id", F.col("priority").cast("long").alias("priority"))


def apply_review(spark, sf):
    kept = cu.apply_review(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").where("toxic = 1"), ["doc_id"])
    return kept.groupBy("source").agg(F.count("*").alias("n"))


def resume_antijoin(spark, sf):
    return cu.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


def project_whitelist(spark, sf):
    return cu.project(table(spark, sf, "documents"), ["doc_id", "source", "lang", "missing"])


def citation_append(spark, sf):
    rows = _pairs(spark, sf)
    label = fx.citation_label(F.lit("报告"), F.lit("2026H1"), F.lit("半年报"), F.col("turn"))
    once = cu.append_citation(F.col("answer"), label)
    return rows.select("conv_id", "turn", F.md5(cu.append_citation(once, label)).alias("answer_md5"))


def cached_verdicts(spark, sf):
    """A verdict counts if it isn't negative; documents without one are still to be asked."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count_if(F.col("quality") >= 0).alias("cached"), F.count_if(F.col("quality").isNull()).alias("to_ask"), F.count_if((F.col("quality") >= 1) & (F.col("toxic") == 0)).alias("kept"))


def reason_joint(spark, sf):
    n = table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    total = table(spark, sf, "labels").agg(F.count("*").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.round(F.col("n") / F.greatest(F.lit(1), "all"), 3).alias("share"))


QUERIES = {f.__name__: f for f in (
    split_text_chunks, chunk_quantiles, section_counts_top, table_lines_to_text, char_ngram_jaccard, normalise_text, evidence_level, number_tokens, number_grounding,
    citation_ids, fact_hit, stage1_reasons, alias_dedup, greedy_near_dup, stratified_split, split_leak_check, split_counts, balanced_sample, review_sample, apply_review,
    resume_antijoin, project_whitelist, citation_append, cached_verdicts, reason_joint,
)}

_NUM = r"(≈|约|算出|计算得|得到)?\s*(\d[\d,]*\.?\d*)"
_tokens = rf"""list_filter(list_transform(list_zip(regexp_extract_all(text, '{_NUM}', 1), regexp_extract_all(text, '{_NUM}', 2)),
 lambda x: {{'m': x[1], 't': rtrim(replace(x[2], ',', ''), '.')}}), lambda x: length(replace(x.t, '.', '')) >= 3)"""
_numbers = f"""nums AS (SELECT doc_id, source, list_transform(list_filter(k, lambda x: NOT (regexp_full_match(x.t, '(19|20)\\d{{2}}') OR coalesce(x.m, '') <> '')), lambda x: x.t) AS a,
 list_transform(list_filter(k, lambda x: regexp_full_match(x.t, '(19|20)\\d{{2}}') OR coalesce(x.m, '') <> ''), lambda x: x.t) AS b,
 list_transform(list_filter(regexp_extract_all(text, '\\d[\\d,]*\\.?\\d*'), lambda x: length(replace(replace(x, ',', ''), '.', '')) >= 3 AND NOT regexp_full_match(replace(x, ',', ''), '(19|20)\\d{{2}}')), lambda x: rtrim(replace(x, ',', ''), '.')) AS p
 FROM (SELECT doc_id, source, text, {_tokens} AS k FROM documents))"""
_ev = f"""SELECT doc_id, item_id, e, c, {_grams('e')} AS ge, {_grams('c')} AS gc FROM (SELECT doc_id, item_id, {_norm('b.text')} AS e, {_norm('d.text')} AS c
 FROM pairs JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))"""
ORACLES = {
    "split_text_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_no, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM chunks",
    "chunk_quantiles": f"""WITH {_CHUNKS}, v AS (SELECT list_sort(list(length(chunk))) AS l, count(*) AS n FROM chunks)
SELECT l[floor(n * 0.5)::INT + 1] AS p50, l[floor(n * 0.9::DOUBLE)::INT + 1] AS p90, l[floor(n * 0.99::DOUBLE)::INT + 1] AS p99, l[n] AS max, n AS n_chunks FROM v""",
    "section_counts_top": "SELECT source || '/' || lang AS section, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, section LIMIT 12",
    "table_lines_to_text": f"""SELECT doc_id, line_no, 'T' || doc_id || chr(10) || array_to_string(list_transform(string_split(line, ' | '), lambda x: CASE WHEN {_strip('x')} = '' THEN '-' ELSE {_strip('x')} END), ' | ') AS body
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE contains(line, ' | ')""",
    "char_ngram_jaccard": f"""SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM (
SELECT conv_id, turn, {_grams('x')} AS a, {_grams('y')} AS b FROM (SELECT conv_id, turn, {_norm('text', '？！')} AS x, {_norm('nxt', '？！')} AS y FROM (
SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL))""",
    "normalise_text": f"SELECT conv_id, turn, md5({_norm('text')}) AS evidence, md5({_norm('text', '？！')}) AS question, md5({_norm('text').replace('。、；：', '')}) AS fact FROM conversations",
    "evidence_level": f"""WITH d AS (SELECT doc_id, {_norm('text')} AS c FROM documents), b AS (SELECT item_id, {_norm('text')} AS e FROM benchmark), bg AS (SELECT item_id, e, {_grams('e')} AS ge FROM b),
dg AS (SELECT doc_id, unnest({_grams('c')}) AS gram FROM d), ig AS (SELECT item_id, len(ge) AS n, unnest(ge) AS gram FROM bg),
hits AS (SELECT doc_id, item_id, round(count(*)::DOUBLE / n, 6) AS r FROM dg JOIN ig USING (gram) GROUP BY doc_id, item_id, n)
SELECT doc_id, item_id, CASE WHEN contains(c, e) THEN 2 ELSE 1 END::BIGINT AS level, CASE WHEN contains(c, e) THEN 1.0::DOUBLE ELSE r END AS ratio
FROM hits JOIN d USING (doc_id) JOIN b USING (item_id) WHERE contains(c, e) OR (r >= 0.9 AND length(e) >= 6)""",
    "number_tokens": f"""WITH {_numbers} SELECT doc_id, array_to_string(list_sort(list_distinct(a)), ',') AS checked, array_to_string(list_sort(list_distinct(b)), ',') AS exempt,
array_to_string(list_sort(list_distinct(p)), ',') AS plain FROM nums WHERE len(a) + len(b) + len(p) > 0""",
    "number_grounding": f"""WITH {_numbers}, e AS (SELECT DISTINCT doc_id, source, unnest(a) AS number FROM nums), t AS (SELECT doc_id, source, replace(text, ',', '') AS t FROM documents),
h AS (SELECT e.doc_id, e.number FROM e JOIN t ON t.source = e.source AND t.doc_id <> e.doc_id AND contains(t.t, e.number) GROUP BY ALL)
SELECT doc_id, count(*) AS checked, count(*) FILTER (h.number IS NULL) AS unsupported, count(*) FILTER (h.number IS NULL) = 0 AS ok FROM e LEFT JOIN h USING (doc_id, number) GROUP BY doc_id""",
    "citation_ids": r"""WITH a AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || (conv_id + turn) % 12 || '] [' || (turn + 1) || '][x]', '\[(\d+)\]', 1), lambda x: x::HUGEINT))) AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(ids, lambda x: x BETWEEN 1 AND 8), ';') AS valid, array_to_string(list_filter(ids, lambda x: x < 1 OR x > 8), ';') AS invalid FROM a""",
    "fact_hit": rf"""WITH n AS (SELECT doc_id, {_norm('text').replace('。、；：', '')} AS t FROM documents), h AS (SELECT doc_id, contains(t, 'ApacheLicense') OR contains(t, 'MITLicense') AS a, contains(t, '@mail') AS b, contains(t, 'token=') OR contains(t, 'api_key=') AS c FROM n)
SELECT doc_id, (a::INT + b::INT + c::INT)::BIGINT AS hit, 3::BIGINT AS total, array_to_string(list_filter([CASE WHEN NOT a THEN 'license' END, CASE WHEN NOT b THEN 'mail' END, CASE WHEN NOT c THEN 'token' END], lambda x: x IS NOT NULL), ',') AS missing FROM h""",
    "stage1_reasons": f"""WITH {_PAIRS}, x AS (SELECT {_strip('question')} AS q, {_strip('substr(answer, 1, 40)')} AS g, replace({_norm("answer || ' ' || question")}, ',', '') AS c, answer FROM pairs),
y AS (SELECT *, {_norm('g')} AS e, list_filter(regexp_extract_all(replace(answer, ',', ''), '\\d[\\d,]*\\.?\\d*'), lambda x: length(replace(x, '.', '')) >= 3) AS nums FROM x)
SELECT CASE WHEN length(q) < 8 OR length(q) > 60 THEN 'question_length' WHEN regexp_matches(q, '根据(上述|原文|材料)|上述材料|如上所述|本报告期数据来源') THEN 'meta_phrase' WHEN g = '' THEN 'no_evidence'
WHEN NOT (length(e) > 0 AND contains(c, replace(e, ',', ''))) THEN 'evidence_not_verbatim' WHEN len(list_filter(nums, lambda n: NOT contains(c, n))) > 0 THEN 'numbers_missing' ELSE 'ok' END AS reason, count(*) AS n FROM y GROUP BY 1""",
    "alias_dedup": "SELECT doc_id, CASE WHEN f < doc_id THEN f END AS alias_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents)",
    "greedy_near_dup": f"""WITH RECURSIVE s AS (SELECT source, doc_id, list_distinct(list_transform(range(1, length(x) - 1), lambda i: hash(substr(x, i::INT, 3)))) AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
 FROM (SELECT source, doc_id, {_norm('text', '？！')} AS x FROM documents)),
p AS (SELECT a.source, a.doc_id AS i, b.doc_id AS j, b.r AS rj FROM s a JOIN s b ON a.source = b.source AND a.doc_id < b.doc_id
 WHERE len(a.g) > 0 AND len(b.g) > 0 AND least(len(a.g), len(b.g)) > 0.8 * greatest(len(a.g), len(b.g)) AND len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) > 0.8),
w AS (SELECT source, 0::BIGINT AS r, []::BIGINT[] AS kept FROM s GROUP BY source
 UNION ALL SELECT w.source, s.r, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.source = s.source AND p.j = s.doc_id AND list_contains(w.kept, p.i)) THEN w.kept ELSE list_append(w.kept, s.doc_id) END FROM w JOIN s ON s.source = w.source AND s.r = w.r + 1)
SELECT s.source, s.doc_id, list_contains(k.kept, s.doc_id) AS kept FROM s JOIN (SELECT source, arg_max(kept, r) AS kept FROM w GROUP BY source) k USING (source)""",
    "stratified_split": f"WITH {_SPLIT} SELECT doc_id, split FROM split",
    "split_leak_check": f"WITH {_SPLIT} SELECT doc_id FROM split WHERE split = 'train' INTERSECT SELECT doc_id FROM split WHERE split = 'test'",
    "split_counts": f"WITH {_SPLIT} SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM split GROUP BY lang",
    "balanced_sample": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('20260924|' || doc_id), doc_id) <= 5",
    "review_sample": """WITH r AS (SELECT doc_id, source, n_chars, md5('20260924|' || doc_id) AS o FROM labels JOIN documents USING (doc_id)), c AS (
SELECT doc_id, 1 AS p, o FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, doc_id) <= 3
UNION ALL (SELECT doc_id, 2, o FROM r ORDER BY n_chars, doc_id LIMIT 10) UNION ALL SELECT doc_id, 3, o FROM r)
SELECT doc_id, p::BIGINT AS priority FROM (SELECT doc_id, min(p) AS p, any_value(o) AS o FROM c GROUP BY doc_id) ORDER BY p, o, doc_id LIMIT 40""",
    "apply_review": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source",
    "resume_antijoin": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "project_whitelist": "SELECT doc_id, source, lang FROM documents",
    "citation_append": f"""WITH {_PAIRS} SELECT conv_id, turn, md5(CASE WHEN contains(answer, '依据：') THEN answer ELSE regexp_replace(answer, '{_WS}+$', '') || chr(10) || '依据：《报告 2026 年半年度报告》' ||
CASE WHEN turn <> 0 THEN '第 ' || turn || ' 页' ELSE '' END END) AS answer_md5 FROM pairs""",
    "cached_verdicts": "SELECT lang, count(*) FILTER (quality >= 0) AS cached, count(*) FILTER (quality IS NULL) AS to_ask, count(*) FILTER (quality >= 1 AND toxic = 0) AS kept FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "reason_joint": "SELECT quality, toxic, count(*) AS n, round(count(*)::DOUBLE / greatest(1, (SELECT count(*) FROM labels)), 3) AS share FROM labels GROUP BY quality, toxic",
}
