"""Question, ranking and citation queries with their SQL."""

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import question as Q
from ..functions import text as T
from ..operators import retrieval as R
from ..sources import views as V
from .views_sql import CHUNKS, QUESTIONS_CTE

QUERIES, ORACLES = {}, {}


def query(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def qs(s, d):
    return V.questions(s, d)


def quote(x):
    return "'" + x.replace("'", "''") + "'"


def any_of(signals):
    return "(" + " or ".join(f"contains(low, {quote(x)})" for x in signals) + ")"


def any_match(patterns, column="low"):
    return "(" + " or ".join(f"regexp_matches({column}, {quote(p)})" for p in patterns) + ")"


WH = "|".join(L.WH_WORDS)
COMPOUND = f"({any_match((f' and (.* )?({WH})', f' ({WH}) (.* )?and ', f' or (.* )?({WH})', f'[,;] (.* )?({WH})'), 'p')} or len(regexp_extract_all(p, ' ({WH}) ')) >= 2)"
REC, PROC, SUMM, DOC = any_of(L.RECORDKEEPING), any_of(L.PROCEDURAL), any_of(L.SUMMARIZATION), any_match(L.DOCUMENT_PATTERNS)
TYPE = f"case when {SUMM} or ({DOC} and not {PROC} and not {REC}) then 'summarization' when {REC} then 'recordkeeping' when {PROC} then 'procedural' else 'general' end"
STRONG = " ".join(f"when type = '{k}' then {' + '.join(f'cast(contains(low, {quote(x)}) as int)' for x in v)}" for k, v in Q.STRONG.items())
INTENTS = f"{QUESTIONS_CTE}, it as (select id, q, low, p, {TYPE} as type, {REC} as is_recordkeeping, {PROC} as is_procedural, {SUMM} as is_summarization, {DOC} as is_document_query, {COMPOUND} as is_compound from qp)"

query("compound_question", lambda s, d: qs(s, d).select("id", Q.is_compound(F.col("q")).alias("is_compound")), f"with {QUESTIONS_CTE} select id, {COMPOUND} as is_compound from qp")
query("query_intent", lambda s, d: qs(s, d).select("id", Q.intent(F.col("q")).alias("i")).select("id", "i.*"), f"with {INTENTS} select id, type, is_recordkeeping, is_procedural, is_summarization, is_document_query, is_compound from it")


def confidence(s, d):
    found = qs(s, d).withColumn("i", Q.intent(F.col("q")))
    return found.withColumn("t", Q.confidence_tenths(F.col("q"), F.col("i"))).select("id", (F.col("t") / 10.0).alias("confidence_score"), Q.confidence_level(F.col("t")).alias("confidence"))


query(
    "intent_confidence", confidence,
    f"with {INTENTS}, c as (select id, least(10, 2 * (case {STRONG} else 0 end) + case when type = 'summarization' and is_document_query then 2 else 0 end + case when is_compound then 1 else 0 end) as t from it) select id, t / 10.0::double as confidence_score, case when t >= 6 then 'high' when t >= 3 then 'medium' else 'low' end as confidence from c",
)

KINDS = tuple(L.ENTITIES)
ENT = {k: "list_filter([" + ", ".join(f"case when {any_match(tuple(f' {x} ' for x in pats), 'p')} then {quote(name)} end" for name, pats in L.ENTITIES[k]) + "], lambda x: x is not null)" for k in KINDS}
ENT_CTE = f"{QUESTIONS_CTE}, en as (select id, q, low, {', '.join(f'{v} as {k}' for k, v in ENT.items())}, list_sort(list_distinct(regexp_extract_all(upper(q), {quote(L.FORMS)}, 1))) as forms from qp)"


def found_entities(s, d):
    q = F.col("q")
    return qs(s, d).select("id", "q", *(Q.entities(q, k).alias(k) for k in KINDS), Q.forms(q).alias("forms"))


query("entity_extract", lambda s, d: found_entities(s, d).select("id", *(F.array_join(k, ",").alias(k) for k in (*KINDS, "forms"))), f"with {ENT_CTE} select id, {', '.join(f'array_to_string({k}, chr(44)) as {k}' for k in (*KINDS, 'forms'))} from en")
PART = ", ".join(f"case when len({k}) > 0 then '{k}: ' || array_to_string({k}, ', ') end" for k in (*KINDS, "forms"))
query("entity_summary", lambda s, d: found_entities(s, d).select("id", Q.entity_summary({k: F.col(k) for k in (*KINDS, "forms")}).alias("summary")), f"with {ENT_CTE} select id, coalesce(nullif(concat_ws(' | ', {PART}), ''), 'No specific entities detected') as summary from en")
query(
    "entity_enhance", lambda s, d: found_entities(s, d).select("id", Q.enhance_with_entities(F.col("q"), F.col("regulations"), F.col("equipment"), F.col("procedures")).alias("enhanced")),
    f"with {ENT_CTE}, a as (select id, q, list_filter(regulations || equipment[1:2] || procedures[1:2], lambda x: not contains(low, lower(x))) as new from en) select id, q || case when len(new) > 0 then ' ' || array_to_string(new, ' ') else '' end as enhanced from a",
)
FORM = "replace(low, 'enter in', 'maintain in')"
for _w in L.FORM_KEYWORDS:
    FORM = f"(select x || case when contains(x, {quote(_w.lower())}) then '' else {quote(' ' + _w)} end from (select {FORM} as x))"
query("form_enhance", lambda s, d: qs(s, d).select("id", Q.enhance_for_forms(F.col("q")).alias("enhanced")), f"with {ENT_CTE} select id, case when len(list_filter(forms, lambda x: contains(x, 'NP') and contains(x, '133'))) > 0 then {FORM} end as enhanced from en")
GEN = " or ".join(f"starts_with(trim(low), '{w}')" for w in L.GENERIC_STARTERS)
query("needs_rewriting", lambda s, d: qs(s, d).select("id", Q.needs_rewriting(F.col("q")).alias("needs")), rf"with {QUESTIONS_CTE}, w as (select id, low, len(regexp_extract_all(q, '\S+')) as n from qp) select id, n < 6 or (n < 10 and ({GEN})) as needs from w")
query(
    "rewrite_guard", lambda s, d: qs(s, d).select("id", Q.accepted_rewrite(F.col("q"), F.concat(F.lit('"'), F.left("q", F.lit(25)), F.lit('"'))).alias("accepted")),
    rf"""with {QUESTIONS_CTE}, r as (select id, q, trim(regexp_replace(regexp_replace('"' || left(q, 25) || '"', '^["'']+', ''), '["'']+$', '')) as c from qp) select id, case when length(c) > 3 * length(q) or len(regexp_extract_all(c, '\S+')) < 3 then q else c end as accepted from r""",
)
query("tenant_norm", lambda s, d: V.query_logs(s, d).select("id", Q.normal_name(F.concat(F.lit("  "), F.upper("client_id"), F.lit(" ")), "default").alias("tenant")), "select event_id as id, 'c' || (user_id % 7) as tenant from events")


def vectors(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", "embedding")
    return R.vector_topk(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 12)


def vector_topk(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("summarization", "recordkeeping", "general"))), ((F.col("query_id") / 100).cast("int") % 3) + 1)
    return R.cut_by_intent(vectors(s, d), kind, (F.col("query_id") / 100).cast("int") % 2 == 0).select("query_id", "vec_id", "score", "rank")


VEC = "vt as (select q.vec_id as query_id, e.vec_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings q, embeddings e where q.vec_id % 100 = 0), vk as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from vt qualify rank <= 12)"
query("vector_topk", vector_topk, f"with {VEC} select query_id, vec_id, score, rank from vk where rank <= case when (query_id // 100) % 3 = 0 then 10 when (query_id // 100) % 2 = 0 then 8 else 5 end")


def bm25(s, d):
    items = V.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_topk(items, V.table(s, d, "documents").select("doc_id", "text"), 12)


BM25 = r"""
qt as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as term from benchmark),
dw as (select doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') as w from documents), st as (select count(*) as n, avg(len(w)) as al from dw),
tf as (select doc_id, l, term, count(*) as f from (select doc_id, len(w) as l, unnest(w) as term from dw) where term in (select term from qt) group by all),
df as (select term, count(*) as df from tf group by 1),
bs as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / al))), 6) as score from tf join df using (term) join qt using (term), st group by 1, 2),
bk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bs qualify rank <= 12)
"""
query("bm25_topk", bm25, f"with {BM25} select query_id, doc_id, score, rank from bk")
query(
    "hybrid_rrf", lambda s, d: R.fused(vectors(s, d).select("query_id", F.col("vec_id").alias("id"), "rank"), bm25(s, d).select("query_id", F.col("doc_id").alias("id"), "rank"), 10),
    f"with {VEC}, {BM25}, f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.vec_id, b.doc_id) as id, round(coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0), 9) as score from vk a full join bk b on a.query_id = b.query_id and a.vec_id = b.doc_id) select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank <= 10",
)


def passages(s, d):
    """The BM25 passages with their texts."""
    docs = V.table(s, d, "documents").select("doc_id", "text", "source")
    return F.broadcast(bm25(s, d)).join(docs, "doc_id").select("query_id", F.col("doc_id").alias("id"), "rank", "text", "source")


PASS = f"{BM25}, ps as (select query_id, doc_id as id, rank, text, source from bk join documents using (doc_id))"
WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{2,}}'))"


def reranked(s, d):
    questions = V.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    p = passages(s, d)
    return R.apply_rerank(p.select("query_id", "id", "rank"), R.overlap_scores(questions, p).where("idx <= 8")).select("query_id", "id", "rank", "new_score", "new_rank")


query(
    "rerank_apply", reranked,
    f"with {PASS}, sc as (select p.query_id, id, rank, case when rank <= 8 then round(10.0::double * len(list_intersect({WORDS.format('b.text')}, {WORDS.format('p.text')})) / len({WORDS.format('b.text')}), 4) end as new_score from ps p join benchmark b on b.item_id = p.query_id) select *, row_number() over (partition by query_id order by new_score desc nulls last, rank) as new_rank from sc",
)
SECTIONS = ("the ", "and", "tion", "xyz")
SCORE = " + ".join(f"case when not contains(lower(text), '{x}') then 0 when len(list_filter(string_split(lower(text), chr(10)), lambda y: contains(y, '{x}') and length(trim(y)) < 50)) > 0 then 10 else 5 end" for x in SECTIONS)
query("intent_reorder", lambda s, d: R.reorder_by_section(passages(s, d), SECTIONS), f"with {PASS}, z as (select query_id, id, rank, cast({SCORE} as bigint) as section_score from ps) select query_id, id, section_score, row_number() over (partition by query_id order by section_score desc, rank) as new_rank from z")
query("extractive_answer", lambda s, d: R.extractive_answer(passages(s, d)), f"with {PASS}, t as (select query_id, string_agg(text, chr(10) || chr(10) order by rank) as t from ps group by 1) select query_id, case when length(t) > 1500 then left(t, 1500) || '...' else t end as answer from t")
query(
    "citations", lambda s, d: R.citations(passages(s, d).select("query_id", "rank", F.concat(F.lit("<"), "source", F.lit("> & co")).alias("title"), F.concat(F.lit("/docs/"), F.col("id").cast("string")).alias("url"))),
    f"""with {PASS} select query_id, '[REFS]<ul>' || string_agg('<li data-idx="' || (rank - 1) || '"><a href="/docs/' || id || '">&lt;' || source || '&gt; &amp; co</a></li>', '' order by rank) || '</ul>' as block from ps group by 1""",
)
query(
    "doc_url", lambda s, d: V.table(s, d, "pages").withColumn("slug", F.concat(F.lit("/"), F.regexp_extract("url", "//[^/]+/([^?#]*)", 1), F.lit(" a+b*~.html#sec-1"))).select("page_id", T.doc_url(F.lit("co"), F.col("slug")).alias("link")),
    r"select page_id, '/co/docs/' || ltrim(regexp_extract(url, '//[^/]+/([^?#]*)', 1), '/') || '%20a%2Bb%2A~.html#sec-1' as link from pages",
)
query("clients", lambda s, d: V.chunks(s, d).select("client_id").distinct(), "select distinct source as client_id from documents")
query("chunk_peek", lambda s, d: V.chunks(s, d).orderBy("doc_id", "chunk_index").limit(10).select("doc_id", "chunk_index", "text"), f"with {CHUNKS} select doc_id, chunk_index, text from ch order by doc_id, chunk_index limit 10")
