"""Queries on what goes into and out of an answer: references, logs, tags, rules and ids, with their SQL."""

from pyspark.sql import functions as F

from ..functions import question as Q
from ..functions import text as T
from ..operators import analytics as A
from ..operators import anchors as N
from ..operators import incremental as I
from ..operators import memory as M
from ..operators import mining as G
from ..operators import retrieval as R
from ..sources import files as S
from ..sources import views as V
from .corpus import TOKENS
from .reports import logs, msgs
from .understanding import BM25, ENT_CTE, FORM, PASS, passages
from .views_sql import CHUNKS, LOGS, MESSAGES, QUESTIONS_CTE, SINCE

QUERIES, ORACLES = {}, {}


def query(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def nodes(s, d):
    """Passages with the metadata that an index keeps; some of it is missing."""
    p = passages(s, d)
    i = F.col("id")
    md = F.create_map(
        F.lit("section_title"), F.when(i % 3 == 0, F.concat(F.lit("Section "), i.cast("string"))).otherwise(""), F.lit("breadcrumb"), F.when(i % 2 == 0, F.concat(F.col("source"), F.lit(" > x"))),
        F.lit("file"), F.concat(F.lit("f "), i.cast("string"), F.lit(".html")), F.lit("slug_url"), F.when(i % 5 < 2, F.concat(F.lit("/d/"), i.cast("string"), F.lit(".html#s-"), i.cast("string"))), F.lit("viq_hints"), F.lit("1.1, 2.3,,"), F.lit("domain_tags"), F.when(i % 4 == 0, "viq:1.1 , x"),
    )
    return p.select("query_id", "rank", "text", (1.0 / F.col("rank")).alias("score"), md.alias("metadata"))


ND = f"{PASS}, nd as (select query_id, rank, id, text, 1.0::double / rank as score, case when id % 3 = 0 then 'Section ' || id end as st, case when id % 2 = 0 then source || ' > x' end as bc, 'f ' || id || '.html' as file, case when id % 5 < 2 then '/d/' || id || '.html#s-' || id end as slug, case when id % 4 = 0 then 'viq:1.1|x' else '' end as tags from ps)"
query(
    "reference_build", lambda s, d: R.references(nodes(s, d), F.lit("co")).select("query_id", "rank", "title", "breadcrumb", "url", "score", F.array_join("viq", "|").alias("viq"), F.array_join("tags", "|").alias("tags")),
    f"with {ND} select query_id, rank, coalesce(st, bc, file) as title, bc as breadcrumb, case when slug is null then '/co/docs/f%20' || id || '.html' else '/co/docs/d/' || id || '.html#s-' || id end as url, score, '1.1|2.3' as viq, tags from nd",
)
query("chat_sources", lambda s, d: R.sources(nodes(s, d)).select("query_id", "rank", "score", "file", "slug_url", F.md5(F.col("text_preview").cast("binary")).alias("h")), f"with {ND} select query_id, rank, score, file, slug as slug_url, md5(case when length(text) > 500 then left(text, 500) || '…' else text end) as h from nd")
query(
    "no_result_answer", lambda s, d: R.answers(V.table(s, d, "benchmark").select(F.explode(F.array("item_id", F.col("item_id") + 100000)).alias("query_id")), passages(s, d)).select("query_id", F.md5(F.col("answer").cast("binary")).alias("h"), "n_references"),
    f"""with {PASS}, t as (select query_id, string_agg(text, chr(10) || chr(10) order by rank) as t, count(*) as n from ps group by 1), q as (select unnest([item_id, item_id + 100000]) as query_id from benchmark)
    select q.query_id, md5(case when t.n is null then 'I couldn''t find any relevant information in the indexed documents.' when length(t) > 1500 then left(t, 1500) || '...' else t end) as h, coalesce(n, 0) as n_references from q left join t on t.query_id = q.query_id""",
)


def responses(s, d):
    """What a scorer might send back: plain, fenced, with a language name, out of range, not an array, or broken."""
    k = F.col("item_id") % 7
    body = F.concat(F.lit('[{"idx": 1, "score": '), k.cast("string"), F.lit('.5}, {"idx": 3, "score": 99}, {"idx": 2, "score": -4}]'))
    text = F.when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\njson "), body, F.lit("\n```"))).when(k == 3, '{"idx": 1, "score": 2}').when(k == 4, "sorry").when(k == 5, F.concat(F.lit("  "), body, F.lit(" "))).when(k == 6, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return V.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("response"))


query("rerank_parse", lambda s, d: R.parsed_scores(responses(s, d)), "select item_id as query_id, idx, score from (select item_id, unnest([1, 2, 3]) as idx, unnest([item_id % 7 + 0.5::double, 0, 10]) as score from benchmark where item_id % 7 not in (3, 4))")
query("rerank_prompt", lambda s, d: R.rerank_passages(passages(s, d).withColumn("title", F.col("source")), 8, 60).select("query_id", "idx", "passage"), f"with {PASS} select query_id, rank as idx, '[' || rank || '] ' || coalesce(source, '') || chr(10) || left(text, 60) as passage from ps where rank <= 8")
HEAD = "repeat('═', 63)"
HL = "text"
for _m in ("Process", "Procedure", "Responsibility", "Checking & Assurance", "Checking", "Assurance", "Recordkeeping", "Records", "Documentation", "Requirements", "Compliance", "Instructions"):
    for _t in ("chr(10)", "':'", "' '"):
        HL = f"replace({HL}, chr(10) || '{_m}' || {_t}, chr(10) || chr(10) || '🔹 SECTION: {_m.upper()} 🔹' || chr(10))"
SET = "replace(replace(replace(text, chr(10), chr(10) || 'Records: '), chr(10) || 'Records: T', chr(10) || 'Checking' || chr(10) || 'Process '), 'a ', chr(10) || 'Compliance ')"


def sectioned(c):
    """Text in which section names open lines."""
    out = F.replace(c, F.lit("\n"), F.lit("\nRecords: "))
    out = F.replace(out, F.lit("\nRecords: T"), F.lit("\nChecking\nProcess "))
    return F.replace(out, F.lit("a "), F.lit("\nCompliance "))


query(
    "marked_passages", lambda s, d: R.marked_passages(passages(s, d).select("query_id", "rank", F.col("source").alias("title"), F.lit(None).cast("string").alias("breadcrumb"), sectioned(F.col("text")).alias("text"))).select("query_id", "rank", F.md5(F.col("block").cast("binary")).alias("h")),
    f"with {PASS}, z as (select query_id, rank, source, {SET} as text from ps) select query_id, rank, md5({HEAD} || chr(10) || 'DOCUMENT ' || rank || ': ' || coalesce(source, 'Unknown') || chr(10) || 'Source: N/A' || chr(10) || {HEAD} || chr(10) || chr(10) || {HL} || chr(10) || chr(10)) as h from z",
)
query("section_highlight", lambda s, d: V.table(s, d, "documents").select("doc_id", F.md5(T.highlight(sectioned(F.col("text"))).cast("binary")).alias("h")), f"with z as (select doc_id, {SET} as text from documents) select doc_id, md5({HL}) as h from z")
query("tenant_passages", lambda s, d: R.of_tenant(V.chunks(s, d), "src3").select("doc_id", "chunk_index"), f"with {CHUNKS} select doc_id, chunk_index from ch where client_id = 'src3'")
query(
    "effective_query", lambda s, d: V.questions(s, d).select("id", Q.enhanced(F.col("q")).alias("searched"), Q.enhanced(F.col("q"), False).alias("plain")),
    f"with {ENT_CTE}, f as (select id, case when len(list_filter(forms, lambda x: contains(x, 'NP') and contains(x, '133'))) > 0 then {FORM} end as form, q, low, list_filter(regulations || equipment[1:2] || procedures[1:2], lambda x: not contains(low, lower(x))) as new from en) select id, coalesce(form, q || case when len(new) > 0 then ' ' || array_to_string(new, ' ') else '' end) as searched, coalesce(form, q) as plain from f",
)
GIVEN = "case id % 4 when 0 then ' Co:' || id || ' ' when 1 then cast(id as string) when 2 then '  ' end"
query(
    "conversation_id_norm", lambda s, d: logs(s, d).select("id", Q.conversation_id(F.lit("co"), F.expr(GIVEN), F.col("id")).alias("cid")),
    f"with {LOGS}, g as (select id, trim({GIVEN}) as given from logs) select id, case when coalesce(given, '') = '' then 'co:' || left(sha1(cast(id as varchar)), 12) when starts_with(lower(given), 'co:') then given else 'co:' || given end as cid from g",
)


def logged(s, d):
    """Logs with the references that their answers had."""
    k = F.col("k")
    ref = lambda r: F.struct(F.concat(F.lit("t"), r.cast("string")).alias("title"), F.lit(None).cast("string").alias("breadcrumb"), F.concat(F.lit("/u/"), k.cast("string")).alias("url"), (k / r).alias("score"), F.when(r % 2 == 0, F.array(F.lit("1.1"), k.cast("string"))).otherwise(F.array().cast("array<string>")).alias("viq"), F.when(r == 1, F.array(F.lit('a"b'))).alias("tags"), F.repeat(F.lit("xy"), 100 * r).alias("text"))
    return logs(s, d).select("id", F.transform(F.expr("filter(sequence(1, 4), r -> r <= k % 4)"), ref).alias("references"))


query(
    "reference_rows", lambda s, d: S.reference_rows(logged(s, d)),
    f"""with {LOGS}, r as (select id, k, unnest([x for x in [1, 2, 3, 4] if x <= k % 4]) as r from logs)
    select id as query_log_id, cast(r as bigint) as reference_rank, 't' || r as title, cast(null as varchar) as breadcrumb, '/u/' || k as url, k / r::double as score, case when r % 2 = 0 then '["1.1","' || k || '"]' end as viq_codes, case when r = 1 then '["a\\"b"]' end as tags, left(repeat('xy', 100 * r), 500) as text_snippet from r""",
)


def query_feedback(s, d):
    l = logs(s, d).where("k % 3 = 0")
    return l.select(F.col("id").alias("query_log_id"), F.explode(F.array(F.col("k") % 5 + 1, F.lit(3))).alias("rating"), (F.col("k") % 2 == 0).alias("helpful"))


query("log_feedback", lambda s, d: A.with_feedback(logs(s, d), query_feedback(s, d)), f"with {LOGS}, f as (select id as query_log_id, unnest([k % 5 + 1, 3]) as rating, k % 2 = 0 as helpful from logs where k % 3 = 0), g as (select query_log_id, count(*) as n, round(avg(rating), 4) as mean_rating, count(*) filter (helpful) as helpful from f group by 1) select id, coalesce(n, 0) as n, mean_rating, coalesce(helpful, 0) as helpful from logs left join g on id = query_log_id")
W3 = SINCE.format(3)
query("export_csv", lambda s, d: S.exported(A.recent(logs(s, d), V.AS_OF, 3).select("id", "timestamp", "client_id", "total_time_ms"), "csv").select("place", F.regexp_replace("line", r",\d{4}-[^,]*,", ",T,").alias("line")), f"with {LOGS} select row_number() over (order by \"timestamp\" desc, id desc) as place, id || ',T,' || client_id || ',' || total_time_ms as line from logs where {W3} union all select 0, 'id,timestamp,client_id,total_time_ms'")
query("export_json", lambda s, d: S.exported(logs(s, d).select("id", "timestamp", "client_id", "query_intent"), "json").select("place", F.regexp_replace("line", '"timestamp":"[^"]*"', '"timestamp":"T"').alias("line")), f"with {LOGS} select row_number() over (order by \"timestamp\" desc, id desc) as place, '{{\"id\":' || id || ',\"timestamp\":\"T\",\"client_id\":\"' || client_id || '\",\"query_intent\":' || coalesce('\"' || query_intent || '\"', 'null') || '}}' as line from logs")
query("recent_qa", lambda s, d: A.page(logs(s, d), "timestamp", 1, 20).select("id", T.preview(F.col("original_query"), 8).alias("question"), T.preview(F.col("answer"), 200).alias("answer")), f"with {LOGS} select id, case when length(original_query) > 8 then left(original_query, 8) || '...' else original_query end as question, case when length(answer) > 200 then left(answer, 200) || '...' else answer end as answer from logs order by \"timestamp\" desc, id desc limit 20")
query("delete_count", lambda s, d: M.deleted_count(msgs(s, d), "c1:4", "c1").withColumn("foreign", M.deleted_count(msgs(s, d), "c1:4", "c2").select("deleted").scalar()), f"with {MESSAGES} select count(*) as deleted, cast(0 as bigint) as foreign from msgs where conversation_id = 'c1:4'")
query("ordered_history", lambda s, d: M.in_order(msgs(s, d), "c1:4").select("id", "role"), f"with {MESSAGES} select id, role from msgs where conversation_id = 'c1:4' and not coalesce(role = 'assistant' and starts_with(content, '[REFS]'), false) order by id")
query("vector_upsert", lambda s, d: I.upserted(V.chunks(s, d).select("doc_id", "chunk_index", F.lit("old").alias("state")), V.chunks(s, d).where("doc_id % 4 = 0").select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.lit("new").alias("state")), "doc_id").groupBy("doc_id", "state").agg(F.sum("chunk_index").alias("n")), f"with {CHUNKS} select doc_id, case when doc_id % 4 = 0 then 'new' else 'old' end as state, cast(sum(chunk_index + case when doc_id % 4 = 0 then 1 else 0 end) as bigint) as n from ch group by 1, 2")


def embed_plan(s, d):
    chunks = V.chunks(s, d).select(F.col("doc_id").alias("file"), "chunk_index")
    changed = V.table(s, d, "documents").where("doc_id % 6 = 1").select(F.col("doc_id").alias("file"))
    one = lambda there, name: I.to_embed(chunks, changed, there).agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
    return one(chunks, "filled").unionByName(one(chunks.where("false"), "empty"))


query("embed_plan", embed_plan, f"with {CHUNKS} select 'filled' as collection, count(*) filter (doc_id % 6 = 1) as n from ch union all select 'empty', count(*) from ch")
query("tag_union", lambda s, d: V.table(s, d, "documents").select("doc_id", T.joined_tags(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("viq:9,"), "source")), F.when(F.col("doc_id") % 5 > 0, F.array(F.lit("syn:b"), F.col("source"))).otherwise(F.array().cast("array<string>"))).alias("tags")), "select doc_id, case when doc_id % 5 > 0 then array_to_string(list_sort(list_distinct(case when doc_id % 3 > 0 then ['viq:9', source] else [] end || ['syn:b', source])), ',') when doc_id % 3 > 0 then 'viq:9,' || source end as tags from documents")
query("stable_distinct", lambda s, d: V.table(s, d, "documents").select("doc_id", F.md5(F.array_join(T.stable_distinct(F.split("text", " ")), " ").cast("binary")).alias("h")), "with w as (select doc_id, unnest(string_split(text, ' ')) as x, unnest(generate_series(1, len(string_split(text, ' ')))) as i from documents), f as (select doc_id, x, min(i) as i from w group by 1, 2) select doc_id, md5(string_agg(x, ' ' order by i)) as h from f group by 1")
query("message_ids", lambda s, d: logs(s, d).select("id", T.message_id(F.col("answer")).alias("message_id")), f"with {LOGS} select id, left(regexp_replace(base64(encode(left(answer, 50))), '[^A-Za-z0-9]', '', 'g'), 16) as message_id from logs")
query("json_fields", lambda s, d: V.table(s, d, "events").withColumn("raw", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not json "), "event_type")).otherwise(F.col("props"))).select("event_id", T.decoded(F.col("raw"), "k int").alias("x")).select("event_id", F.col("x.value.k").cast("long").alias("k"), F.col("x.raw").alias("raw")), r"select event_id, case when event_id % 5 > 0 then cast(regexp_extract(props, '(\d+)', 1) as bigint) end as k, case when event_id % 5 = 0 then 'not json ' || event_type end as raw from events")
query("json_lists", lambda s, d: V.table(s, d, "documents").select("doc_id", T.listed(F.slice(F.array(F.col("source"), F.lit('a"b')), 1, (F.col("doc_id") % 3).cast("int"))).alias("listed")), r"""select doc_id, case doc_id % 3 when 1 then '["' || source || '"]' when 2 then '["' || source || '","a\"b"]' end as listed from documents where source is not null union all select doc_id, case doc_id % 3 when 1 then '[null]' when 2 then '[null,"a\"b"]' end from documents where source is null""")
query("feedback_cards", lambda s, d: V.feedback(s, d).select("id", T.card(F.col("answer"), F.when(F.col("id") % 2 == 0, F.repeat("comment", 90)).otherwise(F.col("comment"))).alias("c")).select("id", "c.answer", "c.comment"), "select d.doc_id as id, case when length(left(text, 300)) > 200 then left(text, 200) || '...' else text end as answer, case when d.doc_id % 2 = 0 then case when quality = 1 then null else left(repeat('comment ' || d.doc_id, 90), 500) end when quality <> 1 then 'comment ' || d.doc_id end as comment from labels l join documents d using (doc_id)")
query("node_ids", lambda s, d: V.chunks(s, d).select("doc_id", "chunk_index", N.node_id(F.col("client_id"), F.col("doc_id").cast("string"), F.col("chunk_index")).alias("section_node"), I.chunk_id(F.col("client_id"), F.col("doc_id"), F.col("text")).alias("text_node")), f"with {CHUNKS} select doc_id, chunk_index, 'node-' || sha1(client_id || '::' || doc_id || '::' || chunk_index) as section_node, sha1(client_id || '|' || doc_id || '|' || text) as text_node from ch")
query(
    "whole_text", lambda s, d: V.table(s, d, "pages").select("page_id", F.md5(T.whole_text(F.col("html"), True).cast("binary")).alias("h")),
    r"select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<!\w[^>]*>', ' ', 'gs'), '</?[A-Za-z][^>]*>', ' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))) as h from pages".replace('\\"', '"'),
)
query(
    "acronyms", lambda s, d: V.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", *(F.col("t").rlike(G.acronym_pattern(t)).alias(n) for n, t in (("one", "the"), ("two", "in-e"), ("three", "and the")))),
    r"select doc_id, regexp_matches(t, '(?i)(?:the|t\.?\s*h\.?\s*e)') as one, regexp_matches(t, '(?i)(?:^|[^a-z0-9])in\-e(?:$|[^a-z0-9])') as two, regexp_matches(t, '(?i)(?:^|[^a-z0-9])and[\s\-]+the(?:$|[^a-z0-9])') as three from (select doc_id, coalesce(text, '') as t from documents)",
)
RULES = [("1.1", 1, ["the", "and of"]), ("2.1", None, ["tion in"]), ("3.2", 3, ["que la", "der"])]
_HIT = {"1.1": r"the|and[\s\-/]+of", "2.1": r"tion[\s\-/]+in", "3.2": r"que[\s\-/]+la|der"}
_ON = {k: f"regexp_matches(low, '{v}')" for k, v in _HIT.items()}
_LIST = "array_to_string([x for x in [{}] if x is not null], ',')"
SYN = {"with": ["from"], "ist": ["die"]}
_WITH, _IST = r"regexp_matches(low, '(?i)(?:with|w\.?\s*i\.?\s*t\.?\s*h|from|f\.?\s*r\.?\s*o\.?\s*m)')", r"regexp_matches(low, '(?i)(?:ist|i\.?\s*s\.?\s*t|die|d\.?\s*i\.?\s*e)')"
query(
    "enrich_full", lambda s, d: G.enrich(V.table(s, d, "documents").select("doc_id", "text"), RULES, SYN, "acronym").select("doc_id", F.array_join("domain_tags", ",").alias("tags"), "viq_hints", "viq_chapters", "synonym_hits"),
    f"""with t as (select doc_id, lower(coalesce(text, '')) as low from documents) select doc_id, array_to_string(list_sort([x for x in [case when {_ON['1.1']} then 'viq:1.1' end, case when {_ON['1.1']} then 'chap:1' end, case when {_ON['2.1']} then 'viq:2.1' end, case when {_ON['3.2']} then 'viq:3.2' end, case when {_ON['3.2']} then 'chap:3' end, case when {_WITH} then 'syn:with' end, case when {_IST} then 'syn:ist' end] if x is not null]), ',') as tags,
    {_LIST.format(', '.join(f"case when {c} then '{k}' end" for k, c in _ON.items()))} as viq_hints, {_LIST.format(f"case when {_ON['1.1']} then '1' end, case when {_ON['3.2']} then '3' end")} as viq_chapters, {_LIST.format(f"case when {_IST} then 'ist' end, case when {_WITH} then 'with' end")} as synonym_hits from t""",
)
query("enrich_variants", lambda s, d: G.enrich(V.table(s, d, "documents").select("doc_id", "text"), [], SYN, "variant").select("doc_id", "synonym_hits"), f"select doc_id, {_LIST.format(chr(44).join(chr(10) + x for x in ('case when contains(low, $$die$$) then $$ist$$ end', 'case when contains(low, $$from$$) then $$with$$ end')))} as synonym_hits from (select doc_id, lower(coalesce(text, '')) as low from documents)")
query(
    "enrich_by_code", lambda s, d: G.enrich_by_code(V.table(s, d, "documents").select("doc_id", "text"), [{"code": "A", "patterns": ["th.", "^In"], "tags": ["t1", "t2"]}, {"patterns": ["e"]}, {"code": "B", "patterns": ["QUE"], "tags": ["t1"]}], [{"name": "g", "terms": ["with", "from"]}, "und"]).select("doc_id", "viq_hints", "domain_tags", "synonym_hits"),
    r"""with t as (select doc_id, lower(coalesce(text, '')) as low, ' ' || regexp_replace(lower(coalesce(text, '')), '([^\p{L}\p{N}_])', ' \1 ', 'g') || ' ' as p from documents), h as (select doc_id, regexp_matches(low, 'th.') or regexp_matches(low, '^in') as a, contains(low, 'que') as b, contains(p, ' with ') or contains(p, ' from ') as g, contains(p, ' und ') as u from t)
    select doc_id, array_to_string([x for x in [case when a then 'A' end, case when b then 'B' end] if x is not null], ',') as viq_hints, array_to_string(list_sort(list_distinct([x for x in [case when a then 'viq:A' end, case when a or b then 't1' end, case when a then 't2' end, case when b then 'viq:B' end, case when g then 'syn:g' end, case when u then 'syn:und' end] if x is not null])), ',') as domain_tags, array_to_string([x for x in [case when g then 'g' end, case when u then 'und' end] if x is not null], ',') as synonym_hits from h""",
)


def viqs(s, d):
    """Questions in columns of any case; some lack an id or a text."""
    i = F.col("doc_id")
    rows = V.table(s, d, "documents").select(F.when(i % 9 > 0, i.cast("string")).otherwise(" ").alias("VIQ_No"), (i % 12).alias("Chapter_No"), F.when(i % 4 > 0, F.col("text")).alias("viq_question"), F.when(i % 8 == 0, " req text ").alias("PROCEDURAL_requirements"))
    return S.questions(rows)


query("viq_rows", lambda s, d: G.usable(viqs(s, d)).select("viq_no", F.col("chapter_no").cast("long").alias("chapter_no"), F.md5(F.col("viq_question").cast("binary")).alias("h"), "procedural_requirements"), "select cast(doc_id as varchar) as viq_no, doc_id % 12 as chapter_no, md5(trim(case when doc_id % 4 > 0 then coalesce(text, '') else '' end)) as h, case when doc_id % 8 = 0 then 'req text' else '' end as procedural_requirements from documents where doc_id % 9 > 0 and ((doc_id % 4 > 0 and trim(coalesce(text, '')) <> '') or doc_id % 8 = 0)")
query(
    "rules_build", lambda s, d: G.build_rules(viqs(s, d)).select("viq_no", F.col("chapter_no").cast("long").alias("chapter_no"), F.array_join("patterns", "|").alias("patterns")),
    "with documents as (select doc_id, trim(case when doc_id % 4 > 0 then coalesce(text, '') else '' end) || chr(10) || case when doc_id % 8 = 0 then 'req text' else '' end as text from documents where doc_id % 9 > 0 and ((doc_id % 4 > 0 and trim(coalesce(text, '')) <> '') or doc_id % 8 = 0)), "
    + TOKENS
    + """, df as (select term, count(*) as df from (select doc_id, unnest(list_distinct(w)) as term from tk) group by 1), t3 as (select * from tt where length(term) >= 3),
    ph as (select doc_id, term, rank, 0 as kind from t3 where is_phrase), uw as (select doc_id, term, rank, row_number() over (partition by doc_id order by rank) as k from t3 join df using (term) where not is_phrase and length(term) >= 4 and df <= 25 qualify k <= 8),
    ct as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(p, 0) as p, coalesce(u, 0) as u from (select doc_id, count(*) as p from ph group by 1) a full join (select doc_id, count(*) as u from uw group by 1) b on a.doc_id = b.doc_id),
    mo as (select doc_id, case when p > 0 and p < 0.6::double * (p + u) then greatest(0, floor(p / 0.6::double - p)) else u end as most from ct),
    al as (select * from ph union all select uw.doc_id, term, rank, 1 from uw join mo using (doc_id) where k <= most)
    select cast(doc_id as varchar) as viq_no, doc_id % 12 as chapter_no, string_agg(term, '|' order by kind, rank) as patterns from al group by doc_id""",
)


def synonym_map(s, d):
    parts = V.table(s, d, "part")
    flat = parts.select(F.col("p_brand").alias("term"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("updated "), "p_type")).otherwise(F.col("p_type")).alias("synonym"))
    return G.synonym_map(S.synonym_pairs({"maritime_terms": flat})).select("base", F.array_join("variants", "|").alias("variants"))


query("synonym_map", synonym_map, "with b as (select lower(trim(p_brand)) as base, lower(trim(p_type)) as s, p_partkey from part), l as (select distinct base, string_split(regexp_replace(base, '[^a-z0-9]', '', 'g'), '') as c from b), a as (select base, s from b where p_partkey % 5 > 0 union select base, array_to_string(c, '.') from l where len(c) >= 3 union select base, array_to_string(c, ' ') from l where len(c) >= 3) select base, string_agg(distinct s, '|' order by s) as variants from a group by 1")
