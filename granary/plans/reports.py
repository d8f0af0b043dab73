"""Log, feedback and conversation queries with their SQL."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import memory as M
from ..sources import views as V
from .views_sql import FEEDBACK, LOGS, MESSAGES, REFS, SINCE

QUERIES, ORACLES = {}, {}


def query(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def logs(s, d):
    return V.query_logs(s, d)


MEAN = "round(coalesce(avg({}), 0), 4)"
AVG_MS, AVG_Q = MEAN.format("total_time_ms"), MEAN.format("coalesce(top_reference_score, 0)")
W7, W30 = SINCE.format(7), SINCE.format(30)

query(
    "overview", lambda s, d: A.overview(logs(s, d), V.AS_OF, 7),
    f"with {LOGS} select count(*) filter ({W7}) as total_queries, round(coalesce(avg(case when {W7} then coalesce(top_reference_score, 0) end), 0), 4) as avg_quality, round(coalesce(avg(case when {W7} then total_time_ms end), 0), 4) as avg_ms, count(distinct client_id) as clients from logs",
)
query("daily_timeline", lambda s, d: A.daily_timeline(logs(s, d), V.AS_OF, 30), f'with {LOGS} select cast(cast("timestamp" as date) as varchar) as day, count(*) as n, {AVG_MS} as avg_ms, {AVG_Q} as avg_quality from logs where {W30} group by 1')
query("client_stats", lambda s, d: A.client_stats(logs(s, d), V.AS_OF, 30), f"with {LOGS} select client_id, count(*) as n, {AVG_MS} as avg_ms, {AVG_Q} as avg_quality from logs where {W30} group by 1")
query("intent_distribution", lambda s, d: A.intent_distribution(logs(s, d)), f"with {LOGS} select coalesce(query_intent, 'unknown') as intent, n from (select query_intent, count(*) as n from logs group by 1)")
OK = "status = 'success'"
RATE = "round(coalesce(100.0 * count(*) filter ({}) / nullif(count(*), 0), 0), 2)"
query(
    "query_analytics", lambda s, d: A.rates(logs(s, d)),
    f"with {LOGS} select count(*) as n, {RATE.format(OK)} as success_rate, {RATE.format('was_rewritten')} as rewrite_rate, {RATE.format('is_compound')} as compound_rate, {RATE.format('is_followup')} as followup_rate, {RATE.format('entities_detected')} as entity_rate from logs",
)
query("perf_averages", lambda s, d: A.timings(logs(s, d)), f"with {LOGS} select " + ", ".join(f"{MEAN.format(c)} as avg_{c}" for c in ("retrieval_time_ms", "reranking_time_ms", "synthesis_time_ms", "total_time_ms", "chunks_retrieved")) + " from logs")
query("rollup_client_day", lambda s, d: A.rollup_by_day(logs(s, d)), f'with {LOGS} select client_id, day, count(*) as n, cast(sum(total_time_ms) as bigint) as ms from (select *, cast(cast("timestamp" as date) as varchar) as day from logs) group by rollup (client_id, day)')
query("latency_percentiles", lambda s, d: A.latency_percentiles(logs(s, d)), f"with {LOGS} select client_id, quantile_disc(total_time_ms, 0.5) as p50, quantile_disc(total_time_ms, 0.95) as p95, count(*) as n from logs group by 1")

DETAIL = ("id", "timestamp", "client_id", "original_query", "total_time_ms")
query("query_page", lambda s, d: A.page(logs(s, d), "timestamp", 3, 20).select(*DETAIL), f'with {LOGS} select id, "timestamp", client_id, original_query, total_time_ms from logs order by "timestamp" desc, id desc limit 20 offset 40')
query(
    "query_search", lambda s, d: A.filtered(logs(s, d), V.AS_OF, 30, client="c3", intent="error", search="Q ERR").select("id", "original_query"),
    f"with {LOGS} select id, original_query from logs where {W30} and client_id = 'c3' and query_intent = 'error' and contains(lower(original_query), 'q err')",
)
query("query_count", lambda s, d: A.total_pages(A.filtered(logs(s, d), V.AS_OF, 30, client="c1"), 50), f"with {LOGS} select count(*) as n, greatest(1, cast(ceil(count(*) / 50.0) as bigint)) as pages from logs where {W30} and client_id = 'c1'")
query("query_detail", lambda s, d: logs(s, d).where("id = 42").select(*DETAIL, "answer", "status"), f"with {LOGS} select id, \"timestamp\", client_id, original_query, total_time_ms, answer, status from logs where id = 42")
query(
    "qa_details",
    lambda s, d: logs(s, d).select(
        "id", T.preview(F.col("original_query"), 8).alias("question"), T.preview(F.col("answer"), 200).alias("answer"), T.quality_bucket(F.col("top_reference_score")).alias("quality"), T.quality_color(F.col("top_reference_score")).alias("color"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce(F.char_length("answer"), F.lit(0)).cast("long").alias("answer_length"), F.nullif(F.left("answer", F.lit(500)), F.lit("")).alias("snippet"),
    ),
    f"""with {LOGS} select id, case when length(original_query) > 8 then left(original_query, 8) || '...' else original_query end as question,
    case when length(answer) > 200 then left(answer, 200) || '...' else answer end as answer,
    case when coalesce(top_reference_score, 0) >= 0.8 then 'High' when coalesce(top_reference_score, 0) >= 0.6 then 'Medium' else 'Low' end as quality,
    case when coalesce(top_reference_score, 0) >= 0.8 then 'green' when coalesce(top_reference_score, 0) >= 0.6 then 'orange' else 'red' end as color,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S') as at, cast(coalesce(length(answer), 0) as bigint) as answer_length, nullif(left(answer, 500), '') as snippet from logs""",
)
query(
    "time_ago", lambda s, d: logs(s, d).select("id", T.time_ago(F.expr(f"timestampdiff(SECOND, `timestamp`, timestamp_ntz'{V.AS_OF}')")).alias("ago")),
    f"""with {LOGS}, a as (select id, cast(floor(epoch(timestamp '{V.AS_OF}' - "timestamp")) as bigint) as s from logs), b as (select id, s // 86400 as dd, s % 86400 as r from a)
    select id, case when dd > 0 then dd || case when dd = 1 then ' day ago' else ' days ago' end when r > 3600 then (r // 3600) || case when r // 3600 = 1 then ' hour ago' else ' hours ago' end
    when r > 60 then (r // 60) || case when r // 60 = 1 then ' minute ago' else ' minutes ago' end else 'Just now' end as ago from b""",
)
query("export_rows", lambda s, d: logs(s, d).where(F.col("top_reference_score").isNotNull()).select("id", "client_id", F.col("top_reference_score").alias("score")), f"with {LOGS} select id, client_id, top_reference_score as score from logs where top_reference_score is not null")
query("recent_queries", lambda s, d: A.page(logs(s, d).where("client_id = 'c2'"), "timestamp", 1, 25).select(*DETAIL), f'with {LOGS} select id, "timestamp", client_id, original_query, total_time_ms from logs where client_id = \'c2\' order by "timestamp" desc, id desc limit 25')
query(
    "log_references", lambda s, d: A.with_references(logs(s, d), V.query_references(s, d)),
    f"with {REFS} select l.id, cast(count(r.query_log_id) as bigint) as n_refs, string_agg(r.title, '|' order by reference_rank) as titles from logs l left join refs r on l.id = r.query_log_id group by l.id",
)
query("top_reference", lambda s, d: A.top_reference(V.query_references(s, d)), f"with {REFS} select query_log_id, arg_min(title, reference_rank) as title, arg_min(score, reference_rank) as score from refs group by 1")

fb = V.feedback
query("feedback_stats", lambda s, d: A.feedback_stats(fb(s, d)), f"with {FEEDBACK} select count(*) as n, count(*) filter (feedback_type = 'thumbs_up') as up, round(coalesce(100.0 * count(*) filter (feedback_type = 'thumbs_up') / nullif(count(*), 0), 0), 1) as up_percent, round(coalesce(100.0 * count(*) filter (feedback_type = 'thumbs_down') / nullif(count(*), 0), 0), 1) as down_percent from fb")
query(
    "feedback_page", lambda s, d: A.page(fb(s, d).where("feedback_type = 'thumbs_down'"), "created_at", 2, 15).select("id", T.preview(F.col("answer"), 200).alias("card"), F.nullif(F.trim("comment"), F.lit("")).alias("comment"), "created_at"),
    f"with {FEEDBACK} select id, case when length(answer) > 200 then left(answer, 200) || '...' else answer end as card, nullif(trim(comment), '') as comment, created_at from fb where feedback_type = 'thumbs_down' order by created_at desc, id desc limit 15 offset 15",
)
query("feedback_recent", lambda s, d: A.page(fb(s, d), "created_at", 1, 10).select("id", "client_id", "feedback_type"), f"with {FEEDBACK} select id, client_id, feedback_type from fb order by created_at desc, id desc limit 10")
query("feedback_pages", lambda s, d: A.total_pages(fb(s, d), 20), f"with {FEEDBACK} select count(*) as n, greatest(1, cast(ceil(count(*) / 20.0) as bigint)) as pages from fb")

msgs = V.messages
query("conversation_list", lambda s, d: M.conversations(msgs(s, d), "c1:"), f"with {MESSAGES} select conversation_id, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from msgs where starts_with(conversation_id, 'c1:') group by 1")
query("conversation_stats", lambda s, d: M.conversations(msgs(s, d).where("conversation_id = 'c0:3'")), f"with {MESSAGES} select conversation_id, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from msgs where conversation_id = 'c0:3' group by 1")
query("history", lambda s, d: M.without_citations(msgs(s, d)).select("id", "conversation_id", "role"), f"with {MESSAGES} select id, conversation_id, role from msgs where not coalesce(role = 'assistant' and starts_with(content, '[REFS]'), false)")
LAST = "row_number() over (partition by conversation_id order by id desc)"
TURN = "cast(row_number() over (partition by conversation_id order by id) as bigint)"
query("recent_turns", lambda s, d: M.last_turns(msgs(s, d), 3).select("id", "conversation_id", "turn"), f"with {MESSAGES} select id, conversation_id, {TURN} as turn from (select * from msgs qualify {LAST} <= 3)")
query(
    "prompt_history", lambda s, d: M.prompt_history(msgs(s, d)),
    f"with {MESSAGES}, a as (select * from msgs qualify {LAST} <= 10), b as (select * from (select * from a where trim(content) <> '') qualify {LAST} <= 8) select conversation_id, {TURN} as turn, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || trim(content) as line from b",
)
query("message_search", lambda s, d: M.search(msgs(s, d), "THE").select("id", "conversation_id"), f"with {MESSAGES} select id, conversation_id from msgs where contains(lower(content), 'the') order by ts desc, id desc limit 50")
query("retention_cleanup", lambda s, d: M.retained(msgs(s, d), "2024-01-04", 2).select("id"), f"with {MESSAGES} select id from msgs where persistent or ts >= timestamp '2024-01-04' - interval 2 day")
query("delete_conversation", lambda s, d: M.delete_conversation(msgs(s, d), "c1:4", "c1").agg(F.count("*").alias("left_over")), f"with {MESSAGES} select count(*) as left_over from msgs where conversation_id <> 'c1:4'")
query(
    "message_validation", lambda s, d: M.is_valid(msgs(s, d)).groupBy("role", "is_valid").agg(F.count("*").alias("n")),
    f"with {MESSAGES} select role, coalesce(role in ('user', 'assistant', 'system'), false) and coalesce(trim(content), '') <> '' as is_valid, count(*) as n from msgs group by 1, 2",
)
query(
    "prev_user_question", lambda s, d: M.previous_question(msgs(s, d)),
    f"with {MESSAGES} select id, conversation_id, question from (select *, last_value(case when role = 'user' then content end ignore nulls) over (partition by conversation_id order by id rows between unbounded preceding and 1 preceding) as question from msgs) where role = 'assistant'",
)
