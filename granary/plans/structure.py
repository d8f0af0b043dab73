"""Anchors, sections, blocks and chunks of pages, with their SQL: it says what the pages were made from, without reading any html."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors as A
from ..operators import sections as S
from ..sources import views as V
from .views_sql import ANCHORS, MANUAL_LINES, NODES, NORMAL, SLUG

QUERIES, ORACLES = {}, {}


def query(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def index(s, d, *sources):
    return A.anchor_index(V.manuals(s, d), *sources)


def titles(s, d, size=None):
    title = F.col("title") if size is None else F.left("title", F.lit(size))
    return V.manual_lines(s, d).select(F.col("doc_id").cast("string").alias("file"), "i", title.alias("title"))


def hashed(c):
    return F.md5(F.col(c).cast("binary"))


query("anchor_index", lambda s, d: index(s, d).select("file", "source", "id", "title", "key"), f"with {ANCHORS} select file, source, id, title, key from ai")
FIRST = "(select file, key, arg_min(id, rank * 1000000 + i) as id from ai where source {} 'toc' group by 1, 2)"
query(
    "anchor_resolve", lambda s, d: A.resolve(titles(s, d), index(s, d)),
    f"with {ANCHORS} select m.file, m.i, m.title, coalesce(a.id, b.id, {SLUG.format('m.title')}) as anchor from ml m left join {FIRST.format('=')} a on a.file = m.file and a.key = {NORMAL.format('m.title')} left join {FIRST.format('<>')} b on b.file = m.file and b.key = {NORMAL.format('m.title')}",
)
LAST = "(select file, key, arg_max(id, i) as id, min(i) as at from ai where source = '{}' group by 1, 2)"
EXACT = " ".join(f"left join {LAST.format(n)} {n} on {n}.file = m.file and {n}.key = m.k" for n in ("toc", "bookmark", "heading"))
LONGER = "(select arg_min(x.id, x.at) from {} x where x.file = m.file and starts_with(x.key, m.k) and length(x.key) > length(m.k))"
query(
    "anchor_by_prefix", lambda s, d: A.resolve_by_prefix(titles(s, d, 5), index(s, d, ("toc", "bookmark", "heading"))),
    f"""with {ANCHORS}, q as (select file, i, left(title, 5) as title, {NORMAL.format('left(title, 5)')} as k from ml)
    select m.file, m.i, m.title, coalesce(case when m.k <> '' then coalesce(toc.id, bookmark.id, heading.id) end,
      case when length(m.k) >= 2 then coalesce({LONGER.format(LAST.format('bookmark'))}, {LONGER.format(LAST.format('toc'))}) end, {SLUG.format("m.title")}) as anchor from q m {EXACT}""",
)
TABLE = "case when i % 5 = 0 then ' k v ' || array_to_string([r || ' ' || i for r in generate_series(1, i % 25 + 1)], ' ') else '' end"
PLAIN = f"p || case when i % 7 = 0 then ' ' || t || ' x' else '' end || case when i % 4 = 0 then ' Records kept F042' else '' end || {TABLE}"
HEADING = "case when i % 3 = 0 then t else i || ' ' || t end"
query(
    "bookmark_sections", lambda s, d: A.bookmark_sections(V.manuals(s, d)).select("file", "anchor", "title", hashed("text").alias("h")),
    rf"""with {MANUAL_LINES}, x as (select file, i, {HEADING} as hd, {PLAIN} as body, (i - 1) // 3 as g from ml),
    g as (select file, g, min(i) as i, string_agg(case when i % 3 = 1 then '' else hd || ' ' end || body, ' ' order by i) as body from x group by 1, 2),
    e as (select a.file, a.i, trim(regexp_replace(a.body || ' ' || coalesce(b.hd, ''), '\s+', ' ', 'g')) as text from g a left join x b on b.file = a.file and b.i = a.i + 3)
    select file, '_Toc' || i as anchor, trim(i || ' ' || t) as title, md5(text) as h from e join ml using (file, i) where length(text) > 10""",
)
HTML_SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
query(
    "bookmark_offsets", lambda s, d: A.bookmark_sections(V.manuals(s, d), -1).select("file", "anchor", "start", "end"),
    rf"""with {MANUAL_LINES}, x as (select file, i, {HTML_SAFE.format('title')} as e, {HTML_SAFE.format('line')} as f from ml),
    y as (select file, i, case when i % 4 <> 0 then length('<p><a href="#_Toc' || i || '">' || i || '.' || e || '</a></p>') else 0 end as link,
      case when i % 3 = 1 then length('<h2><a name="_Toc' || i || '">' || i || ' ' || e || '</a>') when i % 3 = 2 then length('<h3 id="sec' || i || '">' || i || ' ' || e || '</h3>') else length('<p class="Heading2 x" id="sty' || i || '">' || e || '</p>') end as head,
      case when i % 3 = 1 then 5 else 0 end + length('<p>' || f || '</p>') + case when i % 7 = 0 then length('<ul><li>' || e || '</li><li>x</li></ul>') else 0 end + case when i % 4 = 0 then length('<div><b>Records</b> kept F042</div>') else 0 end
      + case when i % 5 = 0 then length('<table><tr><th>k</th><th>v</th></tr></table>') + cast(list_sum([length('<tr><td>' || r || '</td><td>' || i || '</td></tr>') for r in generate_series(1, i % 25 + 1)]) as bigint) else 0 end as body from x),
    z as (select *, 12 + sum(link) over (partition by file) + sum(head + body) over (partition by file order by i) - body as begins, 12 + sum(link + head + body) over (partition by file) + 14 as size from y)
    select file, '_Toc' || i as anchor, cast(begins as bigint) as start, cast(lead(begins, 1, size) over (partition by file order by i) as bigint) as "end" from z where i % 3 = 1""",
)
query(
    "heading_anchors", lambda s, d: A.heading_anchors(V.manuals(s, d)).select("file", "depth", "title", "anchor"),
    f"with {MANUAL_LINES} select file, cast(case when i % 3 = 1 then 2 else 3 end as bigint) as depth, trim(i || ' ' || t) as title, case when i % 3 = 2 then 'sec' || i when i = 1 then '_Toc1' else '_Toc' || (i - 3) end as anchor from ml where i % 3 <> 0",
)
NUMBER = r"regexp_extract(hd, '^(\d+(?:\.\d+)*)\s*(.*)$', {})"
TREE = rf"""{MANUAL_LINES}, hx as (select *, trim({HEADING}) as hd from ml),
hs as (select *, {NUMBER.format(1)} as num, case when {NUMBER.format(1)} = '' then hd when {NUMBER.format(2)} = '' then {NUMBER.format(1)} else {NUMBER.format(2)} end as ttl,
  case when i % 3 = 2 then 'sec' || i when i % 3 = 0 then 'sty' || i when i = 1 then '_Toc1' else '_Toc' || (i - 3) end as anchor,
  case when i % 3 = 2 then 3 else 2 end as depth, regexp_matches(p, '^[-•▪‣]\s+') as bullet from hx),
bl as (
  select file, i, 0 as b, case when bullet then 'list' else 'paragraph' end as kind, case when bullet then '- ' else '' end || p as text, 0 as n from hs where p <> ''
  union all select file, i, 1, 'list', '- ' || t || chr(10) || '- x', 0 from hs where i % 7 = 0
  union all select file, i, 2, 'callout', 'Records kept F042', 0 from hs where i % 4 = 0
  union all select file, i, 3, 'table', array_to_string([r || ' | ' || i for r in generate_series(1, i % 25 + 1)], chr(10)), i % 25 + 1 from hs where i % 5 = 0),
b1 as (select bl.file, bl.i, row_number() over (partition by bl.file, bl.i order by b) - 1 as pos, kind, bl.text, n, b from bl),
b2 as (select b1.file, b1.i, pos, kind, n, b, case when pos = 0 and kind in ('paragraph', 'list') and hd <> '' then hd || chr(10) || chr(10) else '' end || b1.text as text from b1 join hs on hs.file = b1.file and hs.i = b1.i)"""


def tree(s, d):
    return S.section_blocks(V.manuals(s, d))


query(
    "html_sections", lambda s, d: tree(s, d).select("file", "section", F.coalesce("number", F.lit("")).alias("number"), "title", "depth", "anchor", "path"),
    f"with {TREE} select file, i - 1 as section, num as number, ttl as title, cast(depth as bigint) as depth, anchor, case when num <> '' then num else depth || '.' || i end as path from hs",
)
query(
    "section_blocks", lambda s, d: tree(s, d).select("file", "section", F.posexplode("blocks").alias("pos", "b")).select("file", "section", F.col("pos").cast("long").alias("pos"), "b.kind", F.size("b.rows").cast("long").alias("n_rows"), F.array_join("b.headers", "|").alias("headers"), F.md5(F.col("b.text").cast("binary")).alias("h")),
    f"with {TREE} select file, i - 1 as section, pos, kind, cast(n as bigint) as n_rows, case when kind = 'table' then 'k|v' else '' end as headers, md5(text) as h from b2",
)
query(
    "section_chunks", lambda s, d: S.chunked(tree(s, d), 1_000_000).select("file", "section", "part", "block_types", "forms", "chunk_title", "anchor_id", "section_path", "block_start", "block_end", F.coalesce("table_group", F.lit("")).alias("table_group"), "tokens", F.md5(F.col("text").cast("binary")).alias("h")),
    rf"""with {TREE}, c as (select *, case when b < 2 then 0 else b end as g from b2), tg as (select *, unnest(generate_series(0, n - 1, 10)) as s0 from c where kind = 'table'),
    ch as (select file, i, g, 0 as part, string_agg(distinct kind, ',' order by kind) as block_types, string_agg(text, chr(10) || chr(10) order by pos) filter (text <> '') as text, min(pos) as block_start, max(pos) as block_end, '' as table_group from c where kind <> 'table' group by 1, 2, 3
      union all select file, i, g, s0 // 10, 'table', array_to_string([r || ' | ' || i for r in generate_series(s0 + 1, least(n, s0 + 10))], chr(10)), pos, pos, s0 || '-' || least(n, s0 + 10) from tg)
    select ch.file, ch.i - 1 as section, cast(part as bigint) as part, block_types, array_to_string(list_sort(list_distinct([upper(x) for x in regexp_extract_all(ch.text, '(?i)\bF0*\d{{2,3}}\b')])), ',') as forms,
      trim(case when num <> '' then num else depth || '.' || ch.i end || ' ' || ttl || case when contains(block_types, ',') then '' else ' — ' || upper(left(block_types, 1)) || substr(block_types, 2) end) as chunk_title, anchor as anchor_id,
      case when num <> '' then num else depth || '.' || ch.i end as section_path, block_start, block_end, table_group, greatest(1, length(ch.text) // 4) as tokens, md5(ch.text) as h from ch join hs on hs.file = ch.file and hs.i = ch.i""",
)
query(
    "toc_chunks", lambda s, d: A.section_chunks(A.bookmark_sections(V.manuals(s, d)), 1_000_000).select("file", "anchor", "chunk_index", "is_complete_section", "breadcrumb", "slug_url", "node_id"),
    rf"""with {MANUAL_LINES}, x as (select file, i, {HEADING} as hd, {PLAIN} as body, (i - 1) // 3 as g from ml),
    g as (select file, g, min(i) as i, string_agg(case when i % 3 = 1 then '' else hd || ' ' end || body, ' ' order by i) as body from x group by 1, 2),
    e as (select a.file, a.i, trim(regexp_replace(a.body || ' ' || coalesce(b.hd, ''), '\s+', ' ', 'g')) as text from g a left join x b on b.file = a.file and b.i = a.i + 3)
    select file, '_Toc' || i as anchor, cast(0 as bigint) as chunk_index, true as is_complete_section, file || ' > ' || trim(i || ' ' || t) as breadcrumb, file || '#_Toc' || i as slug_url, 'node-' || sha1(file || '::_Toc' || i || '::0') as node_id from e join ml using (file, i) where length(text) > 10""",
)
query(
    "sentence_split", lambda s, d: V.table(s, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 100, 0)).alias("pos", "part")).select("doc_id", F.col("pos").cast("long").alias("pos"), hashed("part").alias("h")),
    r"""with recursive s0 as (select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from documents),
    l as (select doc_id, unnest(s) as x, unnest(generate_series(1, len(s))) as i from s0 where len(s) > 0), n as (select *, greatest(1, length(x) // 4) as c from l),
    g as (select doc_id, i, c as used, cast(0 as bigint) as pos from n where i = 1 union all select n.doc_id, n.i, case when g.used + n.c > 100 then n.c else g.used + n.c end, g.pos + case when g.used + n.c > 100 then 1 else 0 end from g join n on n.doc_id = g.doc_id and n.i = g.i + 1)
    select g.doc_id, pos, md5(string_agg(x, ' ' order by g.i)) as h from g join n on n.doc_id = g.doc_id and n.i = g.i group by 1, 2""",
)
query(
    "heading_merge", lambda s, d: S.merged_with_following(V.nodes(s, d), 3).select("file", "pos", "n_merged", hashed("text").alias("h")),
    f"""with {NODES}, a as (select *, sum(cast(is_heading as int)) over (partition by file order by pos) as g, trim(text) <> '' as filled, not is_heading and tag not in ('li', 'p', 'ul') as other from nd),
    b as (select *, max(cast(other as int)) over (partition by file, g order by pos) as broken, coalesce(sum(cast(filled and not is_heading as int)) over (partition by file, g order by pos rows between unbounded preceding and 1 preceding), 0) as before from a),
    c as (select *, g > 0 and not is_heading and broken = 0 and before < 3 as taken from b)
    select file, min(pos) as pos, count(*) - 1 as n_merged, md5(string_agg(text, chr(10) || chr(10) order by pos)) as h from c where is_heading or (taken and filled) group by file, g
    union all select file, pos, 0, md5(text) from c where not is_heading and not taken""",
)
query(
    "heading_pairs", lambda s, d: S.merged_in_pairs(V.nodes(s, d).drop("is_heading")).select("file", "pos", "tags", hashed("text").alias("h")),
    rf"""with recursive {NODES}, a as (select file, pos, tag, trim(text) as t, tag = 'h2' as h, tag = 'h2' or (tag = 'p' and length(trim(text)) < 100 and regexp_matches(trim(text), '\p{{L}}') and upper(trim(text)) = trim(text)) as hd from nd),
    b as (select *, lead(t) over w as nt, lead(tag) over w as ng, hd and coalesce(lead(t) over w, '') <> '' and not coalesce(lead(h) over w, false) as can from a window w as (partition by file order by pos)),
    f as (select file, pos, can as merges, false as skipped from b where pos = 0 union all select b.file, b.pos, b.can and not f.merges, f.merges from f join b on b.file = f.file and b.pos = f.pos + 1)
    select b.file, b.pos, case when merges then tag || '+' || ng else tag end as tags, md5(case when merges then t || chr(10) || chr(10) || nt else t end) as h from b join f on f.file = b.file and f.pos = b.pos where not skipped""",
)
query(
    "tag_nodes", lambda s, d: S.node_rows(V.manuals(s, d)).groupBy("file", "tag").agg(F.count("*").alias("n")),
    rf"""with {MANUAL_LINES}, c as (select file, count(*) filter (i % 3 = 1) as h2, count(*) filter (i % 3 = 2) as h3, count(*) filter (i % 7 = 0) as ul, count(*) as m from ml group by 1)
    select file, 'h2' as tag, h2 as n from c where h2 > 0 union all select file, 'h3', h3 from c where h3 > 0 union all select file, 'ul', ul from c where ul > 0 union all select file, 'li', ul from c where ul > 0
    union all select file, 'p', n from (select file, cast(sum(runs) as bigint) as n from (select file, i, case when i % 3 = 0 and (i - 1) % 7 <> 0 then 0 else 1 end + case when i = 1 then 1 else 0 end as runs from ml) group by 1)""",
)
