"""The views of sources.views as SQL common table expressions."""

from ..sources.views import AS_OF, QUESTIONS

LOGS = """
ev as (select *, cast(regexp_extract(props, '(\\d+)', 1) as int) as k, cast(floor(value * 10) as bigint) as ms from events),
logs as (select event_id as id, ts as "timestamp", 'c' || cast(user_id % 7 as varchar) as client_id, cast(user_id as varchar) as conversation_id,
  'q ' || event_type || ' ' || cast(k as varchar) as original_query, repeat('answer ' || event_type || ' ', k % 25) || cast(k as varchar) as answer,
  nullif(event_type, 'signup') as query_intent, ms as total_time_ms, cast(floor(ms / 2) as bigint) as retrieval_time_ms,
  cast(floor(ms / 5) as bigint) as reranking_time_ms, cast(floor(ms / 4) as bigint) as synthesis_time_ms,
  case when k % 5 <> 0 then k / 100.0::double end as top_reference_score, k % 2 = 0 as is_compound, k % 7 = 0 as is_followup,
  k % 3 = 0 as entities_detected, k % 4 = 0 as was_rewritten, k / 100.0::double as confidence_score, cast(k % 13 as bigint) as chunks_retrieved,
  case when event_type = 'error' then 'error' else 'success' end as status, k from ev)
"""
REFS = f"""{LOGS},
refs as (select id as query_log_id, cast(r as bigint) as reference_rank, 'Section ' || cast(k * r as varchar) as title, round(k / 100.0::double / r, 6) as score
  from (select id, k, unnest([x for x in [1, 2, 3, 4] if x <= k % 4]) as r from logs))
"""
MESSAGES = """
msgs as (select conv_id * 1000 + turn as id, 'c' || cast(conv_id % 3 as varchar) || ':' || cast(conv_id as varchar) as conversation_id, role, text as content,
  timestamp '2024-01-01' + to_seconds(conv_id * 3600 + turn) as ts, conv_id % 5 = 0 as persistent from conversations
  union all select conv_id * 1000 + max(turn) + 1, 'c' || cast(conv_id % 3 as varchar) || ':' || cast(conv_id as varchar), 'assistant', '[REFS]<ul></ul>',
  timestamp '2024-01-01' + to_seconds(conv_id * 3600 + max(turn) + 1), conv_id % 5 = 0 from conversations group by conv_id)
"""
FEEDBACK = """
fb as (select d.doc_id as id, source as client_id, case when quality = 1 then 'thumbs_up' else 'thumbs_down' end as feedback_type, left(text, 300) as answer,
  case when quality <> 1 then 'comment ' || cast(d.doc_id as varchar) end as comment, timestamp '2024-01-01' + to_seconds(d.doc_id * 60) as created_at
  from labels l join documents d using (doc_id))
"""
_VALUES = ", ".join("({}, '{}')".format(-k, q.replace("'", "''")) for k, q in enumerate(QUESTIONS, 1))
#: p: every character that isn't a letter, digit or underscore has spaces around it, so a word is ' word '.
QUESTIONS_CTE = (
    f"qs as (select cast(id as bigint) as id, q from (values {_VALUES}) v(id, q) union all select conv_id * 1000 + turn, coalesce(text, '') from conversations where role = 'user'), "
    r"qp as (select id, q, lower(q) as low, ' ' || regexp_replace(lower(q), '([^\p{L}\p{N}_])', ' \1 ', 'g') || ' ' as p from qs)"
)
CHUNKS = """
ch as (select doc_id, source as client_id, cast(i - 1 as bigint) as chunk_index, lines[i] as text
  from (select doc_id, source, string_split(text, chr(10)) as lines, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents))
"""
MANIFEST = """
man as (select url as file, case when page_id % 5 = 0 then 'x' || sha256(html) else sha256(html) end as sha256 from pages where page_id % 11 <> 0)
"""
SINCE = "\"timestamp\" >= timestamp '{}' - interval {} day".format(AS_OF, "{}")
#: t is a title as text, u with its number before it, keys are their normal forms.
MANUAL_LINES = r"""
l0 as (select doc_id, unnest(ls) as line, unnest(generate_series(1, len(ls))) as i from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls from documents) where len(ls) > 0),
l1 as (select doc_id, i, line, array_to_string(string_split(trim(line), ' ')[1:3], ' ') as title from l0),
ml as (select *, cast(doc_id as varchar) as file, trim(regexp_replace(line, '\s+', ' ', 'g')) as p, trim(regexp_replace(title, '\s+', ' ', 'g')) as t from l1)
"""
NORMAL = r"trim(regexp_replace(lower(regexp_replace(trim({}), '^\s*[\d\.]+\s*', '')), '\s+', ' ', 'g'))"
_SLUG = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
SLUG = rf"case when {_SLUG} = '' then 'sec-' || left(sha1({{0}}), 10) else 'sec-' || left({_SLUG}, 120) end"
ANCHORS = f"""{MANUAL_LINES},
a0 as (
  select file, i, 'toc' as source, 0 as rank, '_Toc' || i as id, trim(i || '.' || t) as title from ml where i % 4 <> 0
  union all select file, i, 'bookmark', 1, '_Toc' || i, trim(i || ' ' || t) from ml where i % 3 = 1
  union all select file, i, 'heading', 2, 'sec' || i, trim(i || ' ' || t) from ml where i % 3 = 2
  union all select file, i, 'styled', 3, 'sty' || i, t from ml where i % 3 = 0
  union all select file, i, 'slug', 4, {SLUG.format("trim(i || ' ' || t)")}, trim(i || ' ' || t) from ml where i % 3 <> 0
  union all select file, i, 'styled_slug', 5, {SLUG.format('t')}, t from ml where i % 3 = 0),
ai as (select *, {NORMAL.format('title')} as key from a0 where title <> '')
"""
NODES = f"""{CHUNKS},
nd as (select *, tag = 'h2' or (tag = 'p' and ends_with(text, '.')) as is_heading from (select cast(doc_id as varchar) as file, chunk_index as pos,
  case when chunk_index % 7 = 1 then 'h2' when chunk_index % 7 = 3 then 'li' when chunk_index % 7 = 5 then 'ul' when chunk_index % 11 = 0 then 'table' else 'p' end as tag,
  case when chunk_index % 13 = 4 then '' when chunk_index % 6 < 2 then 'HEAD ' || chunk_index else text end as text from ch))
"""
