"""The registered queries' results in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from gazetta.functions import lexicon as L
from gazetta.operators import models
from gazetta.plans.queries import NEAR, NOW, SIZE, TOPIC_NEAR

ORACLE_SQL: dict[str, str] = {}

#: The character trigrams of all documents.
GRAMS = r"""padded as (select doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f]+', ' ', 'g'), ' ') || ' ' as t from documents),
grams as (select doc_id, lang, substring(t, i, 3) as gram from (select doc_id, lang, t, unnest(range(1, length(t) - 1)) as i from padded))"""

TITLE = "left(split_part(coalesce(text, ''), chr(10), 1), 100)"
TITLED = f"titled as (select *, {TITLE} as title from documents)"
LOW = "lower(concat(title, ' ', text))"
KEPT = r"\x{30}-\x{2cea}\x{3300}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}"
STRICT = r"\x{3300}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{20000}-\x{2a6df}\x{2a700}-\x{2ceaf}"


def cleaned(text: str, kept: str = KEPT) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s{kept}]', '', 'g'))"


def unescaped(text: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{sign}')"
    return text


def found(groups: dict[str, list[str]], text: str) -> str:
    cases = ", ".join(f"case when {' or '.join(f'contains({text}, {w!r})' for w in words)} then {name!r} end" for name, words in groups.items())
    return f"array_to_string(list_filter([{cases}], lambda x: x is not null), ',')"


def first(groups: dict[str, list[str]], text: str) -> str:
    return "coalesce(" + ", ".join(f"case when {' or '.join(f'contains({text}, {w!r})' for w in words)} then {name!r} end" for name, words in groups.items()) + ")"


def hits(words: list[str], text: str) -> str:
    return "(" + " + ".join(f"contains({text}, {w!r})::int" for w in words) + ")"


def share(text: str, characters: str) -> str:
    return f"(length(regexp_replace({text}, '[^{characters}]', '', 'g')) / length({text}))"


def sentiment(text: str, up: list[str], down: list[str], name: str) -> str:
    a, b = hits(up, text), hits(down, text)
    return f"case when {a} > {b} then 'positive' when {b} > {a} then 'negative' else 'neutral' end as {name}sentiment, round(case when {a} = {b} then 0.5 else least(0.9, abs({a} - {b}) / greatest({a}, {b}, 1)) end::double, 6) as {name}confidence"


HAN, JA, KO = r"\x{4e00}-\x{9fff}", r"\x{3040}-\x{30ff}\x{4e00}-\x{9fff}", r"\x{ac00}-\x{d7af}"
KANA = r"\x{3040}-\x{30ff}"
SAMPLE = "(text || '漢字かなカナ한글')"


def language(text: str) -> str:
    return f"case when length({text}) = 0 then 'en' when {share(text, HAN)} > 0.1 then 'zh-cn' when {share(text, JA)} > 0.1 then 'ja' when {share(text, KO)} > 0.1 then 'ko' else 'en' end"


WORDS = "unnest(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 2))"
UNNESTED = "parts as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)"
CENTERS = f"{UNNESTED}, means as (select label, pos, avg(x) as x, count(*) as n from parts group by all), centers as (select label, max(n) as n, list(x order by pos) as center from means group by label)"
COSINE = "list_cosine_similarity(e.embedding::double[], c.center)"
MEDOIDS = "medoids as (select label, arg_min(vec_id, [d, vec_id]) as medoid, count(*) as n from (select e.label, e.vec_id, round(list_distance(e.embedding::double[], c.center), 9) as d from embeddings e join centers c on e.label = c.label) group by label)"
QUERY = [((i * 7) % 13 - 6) / 6 for i in range(SIZE)]

ORACLE_SQL |= {
    "clean_text": f"select doc_id, {cleaned('text')} as cleaned from documents",
    "clean_text_strict": f"select doc_id, {cleaned('text', STRICT)} as cleaned from documents",
    "clean_text_pages": f"select page_id, {cleaned(unescaped('html'))} as cleaned from pages",
    "normalize_text": f"select doc_id, lower({cleaned('text')}) as normalized from documents",
    "extract_title": f"select page_id, {cleaned(unescaped(chr(39).join(['regexp_extract(html, ', '(?i)<title[^>]*>(.*?)</title>', ', 1)'])))} as title from pages",
    "extract_meta_description": "select page_id, case when page_id % 3 > 0 then " + cleaned("('About & of ' || url)") + " end as description from pages",
    "language_detect": f"select doc_id, {language('text')} as service_code, case when length(trim(text)) < 3 then 'en' when {share('text', HAN)} > 0.1 then 'zh' when {share('text', KANA)} > 0.1 then 'ja' when {share('text', KO)} > 0.1 then 'ko' else 'en' end as translator_code from documents",
    "language_confidence": f"select doc_id, round({share(SAMPLE, HAN)}, 6) as zh, round({share(SAMPLE, JA)}, 6) as ja, round({share(SAMPLE, KO)}, 6) as ko, round(greatest(1 - {share(SAMPLE, HAN)} - {share(SAMPLE, JA)} - {share(SAMPLE, KO)}, 0), 6) as en from documents",
    "language_histogram": f"select language, count(*) as n from (select lang as language from documents union all select {language('text')} from documents) group by 1",
    "needs_translation": "select doc_id, lower(lang) not in ('en', 'english') and length(text) > 10 as needed, lang <> 'en' as flag from documents",
    "chunked_text": r"""
with recursive sentences as (select doc_id, text, string_split(text, '. ') as s from documents),
steps as (
  select doc_id, text, s, 1 as i, []::varchar[] as done, '' as open from sentences where length(text) > 1000
  union all
  select doc_id, text, s, i + 1, case when length(open) + length(s[i]) < 1000 or open = '' then done else list_append(done, trim(open)) end,
    case when length(open) + length(s[i]) < 1000 then open || s[i] || '. ' else s[i] || '. ' end
  from steps where i <= len(s)
), chunks as (
  select doc_id, list_append(done, trim(open)) as c from steps where i = len(s) + 1
  union all select doc_id, [text] from documents where length(text) <= 1000
)
select doc_id, len(c)::int as n_chunks, list_max(list_transform(c, lambda x: length(x)))::int as longest, array_to_string(c, chr(30)) as chunks from chunks""",
    "snippets": f"select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as snippet, {TITLE} as title from documents",
    "entity_names": "select s_suppkey, lower(s_name) as name from supplier",
    "embedding_input_text": rf"""
with {TITLED}, parts as (
  select doc_id, lang, source, regexp_replace(regexp_replace(trim(title), '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s.,!?\-:]', ' ', 'g') as t,
    regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s.,!?\-:]', ' ', 'g') as b from titled
)
select doc_id, concat_ws(' ', nullif(t, ''), nullif(case when length(b) > 2000 then left(b, 2000) || '...' else b end, ''), 'Topics: GEO:x ' || lang, 'Entities: ' || source) as prepared from parts""",
    "sentiment_lexicon": f"select doc_id, {sentiment('lower(text)', L.POSITIVE, L.NEGATIVE, '')}, {sentiment('lower(text)', ['the', 'ing', 'lich'], ['ent', 'tion', 'ich', 'que'], 'plain_')}, {hits(['the', 'ing', 'lich'], 'lower(text)')} as plain_positive, {hits(['ent', 'tion', 'ich', 'que'], 'lower(text)')} as plain_negative from documents",
    "keyword_tags": f"with {TITLED} select doc_id, {found(L.KEYWORD_GROUPS, LOW)} as tags, {found(L.PLAIN_GROUPS, LOW)} as plain_tags from titled",
    "semantic_tags": f"with {TITLED} select doc_id, {found(L.SEMANTIC_GROUPS, LOW)} as tags from titled",
    "geo_primary_country": f"select doc_id, {first(L.COUNTRIES, 'lower(text)')} as country, {first(L.PLAIN_GROUPS, 'lower(text)')} as plain from documents",
    "language_profiles": f"with {GRAMS}, counts as (select lang as language, gram, count(*) as n from grams group by 1, 2) select language, gram, n, rank::int as rank from (select *, row_number() over (partition by language order by n desc, gram) as rank from counts) where rank <= 100",
    "language_ngrams": f"""
with {GRAMS}, counts as (select lang as language, gram, count(*) as n from grams group by 1, 2),
kept as (select language, gram, n from (select *, row_number() over (partition by language order by n desc, gram) as k from counts) where k <= 300),
totals as (select language, sum(n) + (select count(distinct gram) from kept) as total from kept group by 1),
words as (select gram, t.language, ln((coalesce(k.n, 0) + 1) / t.total) as w from (select distinct gram from kept) g cross join totals t left join kept k using (gram, language)),
found as (select doc_id, gram, count(*) as c from grams group by 1, 2),
scores as (select doc_id, language, round(sum(c * w), 6) as score, sum(c) as seen from found join words using (gram) group by 1, 2),
best as (select doc_id, language, seen from (select *, row_number() over (partition by doc_id order by score desc, language) as k from scores) where k = 1)
select d.doc_id, case when coalesce(seen, 0) < 5 then 'unknown' else language end as language from documents d left join best b on d.doc_id = b.doc_id""",
    "geo_locations": f"select doc_id, {found(L.COUNTRIES, 'lower(text)')} as countries, {found(L.PLAIN_GROUPS, 'lower(text)')} as plain from documents",
    "storable_articles": f"with {TITLED} select doc_id, title, lang, length(text)::int as n_chars, null::varchar as author from titled where doc_id % 5 > 0 and doc_id % 7 > 0 and title <> '' and text <> ''",
    "capped_sources": "select distinct source as name from documents order by name nulls first limit 10",
    "chunk_tags": """
with chunks as (select conv_id, role, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: length(w) > 6)[1:4] as tags from conversations)
select conv_id, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') as tags, array_to_string(list_sort(list(distinct role)), ',') as entities from chunks group by conv_id""",
    "significance_score": f"""
with {TITLED}, tags as (select *, {found(L.SEMANTIC_GROUPS, LOW)} as tags from titled)
select doc_id, round(least(least(case when tags = '' then 0 else len(string_split(tags, ',')) end / 10, 0.3) + case when lang = 'en' then 0.1 else 0 end + case when source = 'src1' then 0.1 else 0 end, 1.0)::double, 6) as score from tags""",
    "process_articles": f"""
with {TITLED}, tags as (select *, {found(L.KEYWORD_GROUPS, LOW)} as keyword_tags, {found(L.SEMANTIC_GROUPS, LOW)} as semantic_tags, {first(L.COUNTRIES, LOW)} as primary_country, {hits(L.POSITIVE, 'lower(text)')} as up, {hits(L.NEGATIVE, 'lower(text)')} as down from titled)
select doc_id, keyword_tags, semantic_tags, primary_country, round(case when up > down then least(0.9, (up - down) / up) when down > up then -least(0.9, (down - up) / down) else 0 end::double, 6) as sentiment_score,
  round((least(case when keyword_tags = '' then 0 else len(string_split(keyword_tags, ',')) end / 10, 0.3) + case when primary_country is not null then 0.1 else 0 end)::double, 6) as significance_score from tags""",
    "escalation_score": """
select doc_id, round(least((case when doc_id % 2 = 0 then 1.0 else 0 end + case when doc_id % 3 = 0 then 0.9 else 0 end + case when doc_id % 5 = 0 then 0.85 else 0 end + case when doc_id % 7 = 0 then 0.7 else 0 end)::double / 3, 1.0), 3) as score,
  case when doc_id % 2 = 0 then 'HIGH' when 1 + (doc_id % 3 = 0)::int + (doc_id % 5 = 0)::int + (doc_id % 7 = 0)::int > 3 then 'MEDIUM' else 'LOW' end as priority,
  case when doc_id % 2 = 0 then 'East Asia' else 'Asia Pacific' end as region,
  concat_ws(',', case when doc_id % 2 = 0 then 'T:Taiwan' end, case when doc_id % 3 = 0 then 'T:PLA' end, case when doc_id % 5 = 0 then 'T:missile' end) as high
from documents""",
    "tag_summaries": f"""
with {TITLED}, words as (select doc_id, source, list_filter(string_split(lower(title), ' '), lambda w: length(w) > 2) as w from titled),
firsts as (select doc_id, source, list_filter(w, lambda x, i: list_position(w, x) = i)[1:4] as w from words)
select doc_id, 'Actor: ' || source || case when len(w) = 0 then '' else '; Geo: ' || array_to_string(w[1:3], ', ') || case when len(w) > 3 then '...' else '' end end as summary from firsts""",
    "ingest_validation": f"with {TITLED} select doc_id, title from titled where length(trim(text)) >= 50 and length(trim(title)) >= 5",
    "ingest_rejects_by_reason": f"with {TITLED} select case when length(trim(text)) < 50 then 'body too short' else 'title too short' end as reason, count(*) as n from titled where length(trim(text)) < 50 or length(trim(title)) < 5 group by 1",
    "raw_articles": "select page_id::varchar as id, url as source_url, length(html)::int as n_chars from pages where length(url) > 0 and length(html) > 0",
    "unprocessed_articles": "select doc_id, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "newest_unprocessed": "select doc_id, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) order by n_chars desc, doc_id limit 50",
    "articles_page": "select o_orderkey, o_custkey, round(o_totalprice, 2) as o_totalprice from orders order by o_orderkey limit 100 offset 100",
    "point_lookup": "select doc_id, lang, source from documents where doc_id = 7",
    "articles_by_ids": "select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)",
    "dedupe_by_text": "select min(doc_id) as doc_id, count(*) as copies from documents group by text",
    "only_new_pages": "with hosts as (select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages) select distinct host from hosts where host not in (select host from hosts where page_id % 10 = 0)",
    "upsert_processed": """
with stored as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1), patch as (select doc_id, case when lang = 'en' then 5 end as quality from documents where doc_id % 4 = 0)
select coalesce(s.doc_id, p.doc_id) as doc_id, coalesce(p.quality, s.quality)::int as quality, s.toxic from stored s full join patch p on s.doc_id = p.doc_id""",
    "keyed_update": "select c_custkey, c_nationkey, case when c_custkey in (select o_custkey from orders) then 'active' end as status from customer",
    "alias_resolution": "select doc_id::varchar as id, case when doc_id % 3 > 0 then source else 'later' end as title, length(text)::int as n_chars, null::varchar as url from documents",
    "external_rows": f"with {TITLED} select title, length(text)::int as n_chars, 'GDELT' as source, 'u' as source_url, {first(L.COUNTRIES, LOW)} as primary_country, lang as language, null::varchar as title_embedding from titled",
    "batch_numbers": "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 100 as batch from orders",
    "batch_numbers_by_source": "select doc_id, source, (row_number() over (partition by source order by doc_id) - 1) // 100 as batch from documents",
    "lookup_titles": f"with {TITLED} select label, doc_id, title from (select label, min(vec_id) as doc_id from embeddings group by 1) join titled using (doc_id)",
    "pending_articles": "select vec_id, label from embeddings where vec_id % 2 = 1 and label <> 3",
    "queue_peek": "select event_id, event_type from events order by event_id desc limit 20",
    "record_ids": "select doc_id, 'article_' || doc_id || '_' || source as key, sha256(source || '|' || text) as article_id from documents",
    "cluster_ids": "select label, 'cluster_' || left(sha256(string_agg(vec_id::varchar, '|' order by vec_id::varchar)), 16) as cluster_id from embeddings where label <> -1 group by 1",
    "quick_report": "select count(*) as total, count(*) filter (where doc_id in (select doc_id from labels)) as processed, count(*) filter (where doc_id not in (select doc_id from labels)) as unprocessed from documents",
    "newest_articles": "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 5",
    "status_counters": "select event_type, count(*) as n, count(*) filter (where value > 10) as large, round(sum(value), 4) as total from events group by 1",
    "recent_24h_counts": f"select count(*) as total, count(*) filter (where ts >= '2024-01-30') as since_midnight, count(*) filter (where ts >= timestamp '{NOW}' - interval 1 day) as last_day, count(*) filter (where ts >= timestamp '{NOW}' - interval 1 day and event_type = 'purchase') as complete_last_day from events",
    "health_rollup": "select count(*) as components, count(*) filter (where ok) as healthy, case when bool_and(ok) then 'healthy' else 'degraded' end as status from (select distinct event_type, event_type <> 'error' as ok from events)",
    "source_category_counts": "select count(*) as total, count(*) filter (where contains(source, 'src1')) as first, count(*) filter (where contains(source, '2')) as second, count(*) filter (where not contains(source, 'src1') and not contains(source, '2')) as neither from (select distinct source from documents)",
    "json_props_extract": "select event_id, json_extract(props, '$.k')::int as k from events",
    "queue_records": "select doc_id::varchar as article_id, case when doc_id % 5 > 0 then lang end as region from documents",
    "event_tumbling_counts": "select strftime(time_bucket(interval 5 minutes, ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all",
    "digest_grouping": """
with rows as (select *, doc_id % 40 as cluster from documents),
langs as (select cluster, lang, row_number() over (partition by cluster order by count(*) desc, lang) as k from rows group by cluster, lang),
sources as (select cluster, source, row_number() over (partition by cluster order by count(*) desc, source) as k from rows group by cluster, source),
base as (select cluster, count(*) as n, string_agg(distinct source, ',' order by source) as sources from rows group by 1)
select lang, source, row_number() over (partition by lang, source order by cluster)::int as item, cluster, n, sources from base join (from langs where k = 1) using (cluster) join (from sources where k = 1) using (cluster)""",
    "digest_markdown": f"""
with {TITLED}, topics as (select lang, source, '### ' || source || chr(10) || string_agg('- ' || doc_id || ' ' || title, chr(10) order by doc_id) || chr(10) as part from titled group by lang, source)
select lang, '## ' || lang || chr(10) || chr(10) || string_agg(part, chr(10) order by source) as markdown from topics group by lang""",
    "report_marks": "select doc_id, case doc_id % 4 when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'LOW' end as priority_level, doc_id % 10 as escalation_score, case doc_id % 4 when 0 then '🔴' when 1 then '🟡' when 2 then '🟢' else '⚪' end as priority_mark, case when doc_id % 10 >= 8 then '🚨' when doc_id % 10 >= 6 then '⚠️' when doc_id % 10 >= 4 then '📈' else '📊' end as escalation_mark from documents",
    "cluster_sizes": "select label, count(*) as n, string_agg(vec_id, ',' order by vec_id) as members from embeddings where label <> -1 group by 1 having count(*) >= 3",
    "cluster_centroids": f"with {UNNESTED} select label, count(*) as n, pos::int as pos, round(avg(x), 6) as x from parts group by all",
    "centroid_similarity_filter": f"with {CENTERS} select vec_id, e.label, round({COSINE}, 6) as similarity from embeddings e join centers c on e.label = c.label where {COSINE} >= {NEAR}",
    "cluster_medoids": f"with {CENTERS}, {MEDOIDS} select * from medoids",
    "cluster_report": f"with {CENTERS}, {MEDOIDS}, near as (select e.label, count(*) as near, round(avg({COSINE}), 6) as mean_similarity from embeddings e join centers c on e.label = c.label where {COSINE} >= {NEAR} group by 1) select m.*, near, mean_similarity from medoids m left join near on m.label = near.label where n >= 3",
    "cluster_stats": """
with rows as (select label from documents left join embeddings on doc_id = vec_id), sizes as (select label, count(*) as n from rows where label is not null group by 1)
select (select count(*) from rows) as total, (select count(label) from rows) as clustered, (select count(*) from rows where label is null) as unclustered, (select count(*) from sizes) as n_clusters, (select coalesce(round(avg(n), 6), 0.0) from sizes) as mean_size, (select coalesce(max(n), 0) from sizes) as largest""",
    "cluster_summaries": f"""
with {TITLED}, words as (select source, {WORDS} as w from titled),
ranked as (select source, w, row_number() over (partition by source order by count(*) desc, w) as k from words group by source, w),
tags as (select source, string_agg(w, ',' order by k) as top_tags from ranked where k <= 5 group by 1),
langs as (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as k from titled group by source, lang)
select t.source, count(*) as size, arg_min(title, doc_id) filter (where title <> '') as representative_title, coalesce(any_value(top_tags), '') as top_tags, any_value(l.lang) as primary_topic, any_value(l.lang) as primary_region
from titled t left join tags on t.source = tags.source join langs l on l.source = t.source and l.k = 1 group by t.source having count(*) >= 3""",
    "cluster_summary_text": rf"""
with {TITLED}, words as (select source, {WORDS} as w from titled),
ranked as (select source, w, row_number() over (partition by source order by count(*) desc, w) as k from words group by source, w),
tags as (select source, string_agg(w, ', ' order by k) as tags from ranked where k <= 3 group by 1),
terms as (select source, unnest((['x'] || list_filter(string_split(regexp_replace(title, '\s+', ' ', 'g'), ' '), lambda w: length(w) > 0)[1:5].list_filter(lambda w: length(w) > 2))[1:3]) as w from titled),
counted as (select source, w, row_number() over (partition by source order by count(*) desc, w) as k from terms group by source, w),
topics as (select source, string_agg(w, ' ' order by k) as topic from counted where k <= 5 and length(w) > 2 group by 1)
select source, 'Topic Cluster: ' || topic || '. Contains ' || (select count(*) from documents d where d.source = topics.source) || ' articles. Common tags: ' || tags || '.' as text from topics join tags using (source)""",
    "cluster_modal_source": "select cluster, source from (select doc_id % 25 as cluster, source, row_number() over (partition by doc_id % 25 order by count(*) desc, source) as k from documents group by doc_id % 25, source) where k = 1",
    "cluster_top_terms": f"with {TITLED}, words as (select source, {WORDS} as value from titled) select source, value, n, rank::int as rank from (select source, value, count(*) as n, row_number() over (partition by source order by count(*) desc, value) as rank from words group by source, value) where rank <= 5",
    "cluster_details": f"""
with {TITLED}, words as (select source, {WORDS} as w from titled), counted as (select source, w, count(*) as n, row_number() over (partition by source order by count(*) desc, w) as k from words group by source, w)
select source, count(*) as article_count, round(avg(n_chars), 6) as avg_confidence, (select count(*) from counted c where c.source = t.source) as unique_tags, (select string_agg(w || ':' || n, ',' order by k) from counted c where c.source = t.source and k <= 5) as top_tags from titled t group by source""",
    "route_summaries": "select (n_chars // 100)::int as cluster, count(*) as n, case when count(*) < 3 then 'complete' else 'pending' end as status, case when count(*) < 3 then 'Single article cluster - no summary needed' end as summary from documents group by 1",
    "optimal_k": "select source, lang, count(*) as n, case when count(*) < 10 then least(count(*), 8) else least(greatest(count(*) // 10, 20), 150, count(*)) end as k from documents group by 1, 2",
    "knn_topk": "select query_id, neighbour_id, similarity, rank::int as rank from (select q.vec_id as query_id, e.vec_id as neighbour_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as similarity, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id) as rank from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0) where rank <= 15",
    "vector_search_topk": f"select vec_id, round(greatest(0, least(1, (list_cosine_similarity(embedding::double[], {QUERY}::double[]) + 1) / 2)), 4) as similarity from embeddings order by similarity desc, vec_id limit 10",
    "stored_index_search": f"select vec_id, round(greatest(0, least(1, (list_cosine_similarity(embedding::double[], {QUERY}::double[]) + 1) / 2)), 4) as similarity from embeddings order by similarity desc, vec_id limit 10",
    "vector_normalize_whole": f"with {UNNESTED}, scaled as (select vec_id, pos, x * (vec_id % 7) as x from parts), sums as (select vec_id, pos, x, sqrt(sum(x * x) over (partition by vec_id)) as s from scaled) select vec_id, pos::int as pos, round(case when s > 0 then x / s else x end, 6) as x from sums",
    "vector_blend_whole": f"""
with {UNNESTED}, mixed as (select a.vec_id, a.pos, 0.7::double * a.x + 0.3::double * b.x as x, a.x as o from parts a join parts b on a.vec_id = b.vec_id and b.pos = {SIZE - 1} - a.pos),
again as (select vec_id, pos, case when vec_id % 2 = 0 then 0.8::double * x - 0.2::double * o else x end as x from mixed), sums as (select *, sqrt(sum(x * x) over (partition by vec_id)) as s from again)
select vec_id, pos::int as pos, round(x / s, 6) as x from sums""",
    "vector_index_stats": f"select count(*) filter (where vec_id % 10 not in (3, 4)) as stored, count(*) filter (where vec_id % 10 in (3, 4)) as rejected, {SIZE}::int as dimension from embeddings",
    "embedding_decode_whole": f"with {UNNESTED} select vec_id, pos::int as pos, round(x, 5) as x from parts",
    "incremental_assign": f"""
with parts as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings where vec_id % 3 > 0),
centers as (select label, list(x order by pos) as center from (select label, pos, avg(x) as x from parts group by all) group by label),
scored as (select e.vec_id, c.label, round({COSINE}, 9) as s from embeddings e cross join centers c where e.vec_id % 3 = 0)
select vec_id, case when s >= {NEAR} then label end as label, round(s, 6) as similarity from (select *, row_number() over (partition by vec_id order by s desc, label) as k from scored) where k = 1""",
    "keyed_table_steps": "select doc_id::varchar as article_id, length(text)::int as n_chars, lang as source_language, 'en' as target_language, case when doc_id % 10 = 0 then coalesce(source, '') when doc_id % 3 > 0 then concat_ws(',', source, lang) else '' end as tags, case when doc_id % 5 = 0 then 'c' || (doc_id % 7) end as cluster_id from documents",
    "topic_assign_first_pass": rf"""
with {TITLED}, topics as (select e.vec_id, e.embedding::double[] as v, list_filter(string_split(regexp_replace(title, '\s+', ' ', 'g'), ' '), lambda w: length(w) > 0)[1:5].list_filter(lambda w: length(w) > 2)[1:3] as ws, title,
  case when vec_id % 4 = 1 then vec_id // 8 when vec_id % 4 > 1 then 1000000 + label end as cluster from embeddings e join titled t on t.doc_id = e.vec_id),
rows_ as (select *, case when len(ws) > 0 then ws else list_filter(string_split(regexp_replace(left(title, 50), '\s+', ' ', 'g'), ' '), lambda w: length(w) > 0) end as said from topics),
sizes as (select cluster, count(*) < 3 as few from rows_ where cluster is not null group by 1),
counted as (select cluster, w, row_number() over (partition by cluster order by count(*) desc, w) as k from (select cluster, unnest(said) as w from rows_ where cluster is not null) group by cluster, w),
abouts as (select cluster, list_distinct(list(lower(w))) as about from counted where k <= 5 and length(w) > 2 group by 1),
near as (select a.vec_id, b.cluster, list_distinct(list_transform(a.said, lambda w: lower(w))) as x, round(list_cosine_similarity(a.v, b.v), 9) as s, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.v, b.v), 9) desc, b.vec_id) as rank
  from rows_ a join rows_ b on a.vec_id <> b.vec_id where a.cluster is null),
scored as (select n.vec_id, n.cluster, n.s, n.rank, few, coalesce(len(list_intersect(x, about)) / len(list_distinct(x || about)), 0) as o
  from near n join sizes using (cluster) left join abouts using (cluster) where rank <= 15 and n.s >= {TOPIC_NEAR}),
small as (select vec_id, cluster, o from (select *, row_number() over (partition by vec_id order by 0.7::double * o + 0.3::double * s desc, rank) as k from scored where few) where k = 1),
large as (select vec_id, arg_min(cluster, rank) as cluster from scored where not few and o > 0.2 group by 1)
select vec_id, new from (select coalesce(a.vec_id, b.vec_id) as vec_id, case when a.o > 0.1 then a.cluster else b.cluster end as new from small a full join large b on a.vec_id = b.vec_id) where new is not null""",
    "topic_jaccard": rf"""
with {TITLED}, a as (select doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(title), '\s+', ' ', 'g'), ' '), lambda w: length(w) > 0)) as w from titled),
b as (select item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), lambda w: length(w) > 0)) as v from benchmark),
pairs as (select doc_id, item_id, round(len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))), 9) as j from a cross join b)
select doc_id, item_id, round(j, 6) as jaccard from (select *, row_number() over (partition by doc_id order by j desc, item_id) as k from pairs where j > 0.05) where k = 1""",
}

LISTED = "array_to_string(list_sort(list_distinct({})), ',')"
STOPPED = sorted({w for some in models.LANGUAGE_WORDS.values() for w in some})
SCRIPTS = "(repeat(case doc_id % 4 when 0 then '漢字漢字漢字' when 1 then 'かなカナひらがな' when 2 then '한글한글한글' else '' end, ceil(length(text) / 40.0)::int) || text)"
VOTES = ", ".join(f"len(list_filter(w, lambda x: list_contains({some!r}, x))) as {code}" for code, some in models.LANGUAGE_WORDS.items())
MOST = f"greatest({', '.join(models.LANGUAGE_WORDS)})"

ORACLE_SQL |= {
    "field_defaults": "select doc_id, case when lang <> 'en' then lang else 'Unknown' end as region, case when doc_id % 3 = 0 then source else 'General' end as topic, 'LOW' as priority_level from documents",
    "batch_totals": f"with {TITLED} select source, count(*) as articles, sum(len(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 2)))::bigint as total_tags, sum(case when lang <> 'en' then 2 else 0 end)::bigint as total_entities from titled group by source",
    "untagged_newest": "select doc_id, n_chars from documents where lang = 'de'",
    "prediction_rows": "select doc_id as osint_id, source as event_type, upper(lang) as region, round(n_chars / 1e6, 6) as likelihood_score, 'rules' as model_used from documents where lang = 'fr'",
    "pending_clusters": "select (n_chars // 100)::int as cluster, count(*) as n from documents group by 1 having count(*) >= 3",
    "ingest_status": """
with q as (select count(*) as n from events where event_type = 'view')
select (select count(*) from documents) + n as articles_scraped, (select count(*) from documents where doc_id in (select doc_id from labels)) as articles_processed, (select count(distinct label) from embeddings) as clusters_created,
  (select count(*) from documents where n_chars > 1000) as summaries_generated, n as queue_size, case when n > 0 then 'active' else 'inactive' end as status from q""",
    "daily_digest": """
with last as (select user_id as cluster, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events),
chosen as (select cluster from last where k = 1 and event_type = 'purchase' and ts >= timestamp '2024-01-30' and ts <= timestamp '2024-01-31'),
rows as (select *, doc_id % 150 as cluster from documents where doc_id % 150 in (select cluster from chosen)),
langs as (select cluster, lang, row_number() over (partition by cluster order by count(*) desc, lang) as k from rows group by cluster, lang),
sources as (select cluster, source, row_number() over (partition by cluster order by count(*) desc, source) as k from rows group by cluster, source),
base as (select cluster, count(*) as n, string_agg(distinct source, ',' order by source) as sources from rows group by 1)
select lang, source, row_number() over (partition by lang, source order by cluster)::int as item, cluster, n, sources from base join (from langs where k = 1) using (cluster) join (from sources where k = 1) using (cluster)""",
    "cluster_stats_full": f"""
with {TITLED}, words as (select source, {WORDS} as w from titled), tags as (select source, count(distinct w) as unique_tags from words group by 1)
select source, count(*) as article_count, round(avg(n_chars), 6) as avg_confidence, round(max(doc_id % 10) / 10, 6)::double as max_escalation, coalesce(any_value(unique_tags), 0) as unique_tags, count(distinct lang) as unique_entities,
  case when max(doc_id % 10) >= 7 then 'high' when max(doc_id % 10) >= 3 then 'medium' else 'low' end as escalation_level from titled left join tags using (source) group by source""",
    "cluster_records": f"""
with {TITLED}, members as (select label, doc_id, title, lang, embedding from titled join embeddings on doc_id = vec_id),
parts as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from members),
centers as (select label, list(x order by pos) as center from (select label, pos, avg(x) as x from parts group by all) group by label),
medoids as (select m.label, arg_min(doc_id, [round(list_distance(embedding::double[], center), 9), doc_id]) as representative_article_id from members m join centers c on m.label = c.label group by m.label),
words as (select label, unnest(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 2)) as w from members),
ranked as (select label, w, row_number() over (partition by label order by count(*) desc, w) as k from words group by label, w),
tags as (select label, string_agg(w, ',' order by k) as top_tags from ranked where k <= 10 group by 1),
langs as (select label, lang, row_number() over (partition by label order by count(*) desc, lang) as k from members group by label, lang),
entities as (select label, string_agg(lang, ',' order by k) as top_entities, string_agg(lang, ', ' order by k) filter (where k <= 3) as three_entities from langs where k <= 10 group by 1),
said as (select label, unnest(case when len(t) > 0 then t else list_filter(string_split(left(title, 50), ' '), lambda w: length(w) > 0) end) as w from (
  select label, title, (list_filter(string_split(lower(title), ' '), lambda w: length(w) > 2) || list_filter(list_filter(string_split(title, ' '), lambda w: length(w) > 0)[1:5], lambda w: length(w) > 2))[1:3] as t from members)),
about as (select label, w, row_number() over (partition by label order by count(*) desc, w) as k from said group by label, w),
themes as (select label, string_agg(w, ' ' order by k) as theme from about where k <= 5 and length(w) > 2 group by 1),
three as (select label, string_agg(w, ', ' order by k) as three_tags from ranked where k <= 3 group by 1)
select m.label, count(*) as member_count, any_value(representative_article_id)::bigint as representative_article_id, coalesce(any_value(top_tags), '') as top_tags, any_value(top_entities) as top_entities, case when count(*) < 3 then 'complete' else 'pending' end as status,
  coalesce(any_value(theme), '') as theme, case when count(*) < 3 then 'Single article cluster - no summary needed' else case when any_value(theme) <> '' then 'Topic Cluster: ' || any_value(theme) || '. Contains ' || count(*) || ' articles. ' else 'Cluster of ' || count(*) || ' articles. ' end
    || coalesce('Key entities: ' || any_value(three_entities) || '. ', '') || coalesce('Common tags: ' || any_value(three_tags) || '.', '') end as summary
from members m left join themes on m.label = themes.label left join three on m.label = three.label join medoids d on m.label = d.label left join tags t on m.label = t.label join entities e on m.label = e.label group by m.label""",
    "cluster_members": "select label, doc_id, lang from documents join embeddings on doc_id = vec_id where label <> -1",
    "page_metadata": "select page_id, case when page_id % 3 > 0 then 'A ' || page_id end as author, case when page_id % 3 > 0 then "
    + cleaned("('About & ' || url)")
    + " end as description, case when page_id % 3 > 0 then '2024-01-02' end as date, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages",
    "language_scripts": f"select doc_id, {language(SCRIPTS)} as service_code, case when length(trim({SCRIPTS})) < 3 then 'en' when {share(SCRIPTS, HAN)} > 0.1 then 'zh' when {share(SCRIPTS, KANA)} > 0.1 then 'ja' when {share(SCRIPTS, KO)} > 0.1 then 'ko' else 'en' end as translator_code from documents",
    "ingest_white_space": rf"""
with {TITLED}, stripped as (select doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as b, length(regexp_replace(title, '^\s+|\s+$', '', 'g')) as t from titled)
select doc_id, case when b < 50 then 'body too short' when t < 5 then 'title too short' end as reason from stripped""",
    "queue_malformed": """select case when doc_id % 3 = 0 then '{"article_id":"' || doc_id || '"' else doc_id::varchar end as article_id, case when doc_id % 3 > 0 then lang end as region from documents""",
    "latest_by_user": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1",
    "incremental_assign_all": f"""
with {CENTERS}, scored as (select e.vec_id, c.label, round({COSINE}, 9) as s from embeddings e cross join centers c)
select vec_id, case when s >= {NEAR} then label end as label, round(s, 6) as similarity from (select *, row_number() over (partition by vec_id order by s desc, label) as k from scored) where k = 1""",
    "tfidf_embeddings": rf"""
with words as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}'), lambda w: not list_contains({models.LANGUAGE_WORDS["en"]!r}, w)) as w from documents),
terms as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from words),
counts as (select doc_id, term, count(*) as n from terms group by all),
vocabulary as (select term, count(*) as texts from counts group by 1 order by sum(n) desc, term limit 200),
weighted as (select doc_id, term, n * (ln((1 + (select count(*) from documents)) / (1 + texts)) + 1) as x from counts join vocabulary using (term))
select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from weighted""",
    "top_keywords": rf"""
with {TITLED}, words as (select doc_id, unnest(list_filter(regexp_split_to_array({LOW}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 and not list_contains({STOPPED!r}, w))) as w from titled),
ranked as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, w) as k from words group by doc_id, w having count(*) > 1),
general as (select doc_id, string_agg(w, ',' order by k) as general from ranked where k <= 10 group by 1)
select t.doc_id, {found(L.PLAIN_GROUPS, LOW)} as found, coalesce(general, '') as general from titled t left join general g on t.doc_id = g.doc_id""",
    "language_vote": rf"""
with words as (select doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') as w from documents), votes as (select doc_id, {VOTES} from words)
select doc_id, case when {MOST} = 0 then 'unknown' {" ".join(f"when {c} = {MOST} then '{c}'" for c in models.LANGUAGE_WORDS)} end as language from votes""",
    "cluster_lead_summaries": r"""
with texts as (select doc_id // 4 as cluster, count(*) as n, string_agg(text, chr(10) || chr(10) order by doc_id) as text from documents group by 1 having count(*) >= 3),
bare as (select cluster, n, trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) as t from texts),
split as (select cluster, n, t, string_split(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(31), 'g'), chr(31)) as s from bare),
fit as (select cluster, n, t, s, list_transform(range(1, least(len(s), 601) + 1), lambda k: array_to_string(s[1:k], ' ')) as p from split)
select cluster, n, case when length(t) < 100 then t when length(s[1]) > 600 then left(s[1], 600) || '...' else list_filter(p, lambda x: length(x) <= 600)[-1] end as summary from fit""",
    "lead_summaries": r"""
with bare as (select doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) as t from documents),
split as (select doc_id, t, string_split(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(31), 'g'), chr(31)) as s from bare),
fit as (select doc_id, t, s, list_transform(range(1, len(s) + 1), lambda k: array_to_string(s[1:k], ' ')) as p from split)
select doc_id, case when length(t) < 100 then t when length(s[1]) > 600 then left(s[1], 600) || '...' else list_filter(p, lambda x: length(x) <= 600)[-1] end as summary from fit""",
}
