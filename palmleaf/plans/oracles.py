"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from palmleaf.config import BY_CHAPTER, BY_CHAPTER_AND_SUTRA, BY_SUTRA, META_KEYS, UNKNOWN
from palmleaf.functions.patterns import ASK_AGAIN, ERROR_PREFIX, NO_INFO
from palmleaf.operators.answer import ANSWER_HEAD, NO_SOURCES, PROMPT_HEAD, PROMPT_RULES, SOURCES_HEAD, SOURCES_HIDDEN


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_DISTANCE = {
    "l2": "power(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2)",
    "cosine": "1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
}


def _topk(metric: str, source: str = "embeddings") -> str:
    return f"""
        select query_id, rank, id, distance from (
            select *, row_number() over (partition by query_id order by round(exact, 12), id)::INT as rank from (
                select q.vec_id as query_id, v.vec_id as id, {_DISTANCE[metric]} as exact, round({_DISTANCE[metric]}, 6) as distance
                from {source} q join {source} v on q.vec_id <> v.vec_id))
        where rank <= 5"""


_PASSAGES = f"""
    with with_docs as (select e.* from embeddings e where vec_id in (select doc_id from documents)),
    hits as ({_topk("l2", "with_docs")}),
    passages as (select h.query_id, h.rank, d.text as document, d.source, d.lang from hits h join documents d on d.doc_id = h.id)
"""

_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as para_no from documents)"
_CLEAN = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+([A-ZĐ])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_CHUNKS = f"""
    select doc_id, source, list_append(f.done, trim(f.cur)) as parts from (
        select doc_id, source, list_reduce(
            list_transform({_SENTENCES}, lambda s: {{'cur': s || ' ', 'done': []::VARCHAR[]}}),
            lambda a, b: case when length(a.cur) + length(b.cur) <= 512
                then {{'cur': a.cur || b.cur, 'done': a.done}} else {{'cur': b.cur, 'done': list_append(a.done, trim(a.cur))}} end) as f
        from documents where trim(text) <> '')
"""
_SLUG = "left(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]', '', 'g'), 50)"

_LABEL = f"""case when any_chapter and any_sutra then {_text(BY_CHAPTER_AND_SUTRA)} when any_chapter then {_text(BY_CHAPTER)}
            when any_sutra then {_text(BY_SUTRA)} else {_text(UNKNOWN)} end"""

_V1 = f"""
    with x as (
        select conv_id as doc_id, turn as para_no, role,
            case role when 'system' then turn || '. PHẨM system' when 'user' then turn || '. KINH ' || turn else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as text,
            role = 'system' as chapter, role = 'user' as sutra from conversations),
    y as (
        select *, sum((chapter or sutra)::INT) over w as segment, sum(chapter::INT) over w as chapter_no,
            last_value(case when chapter then text end ignore nulls) over w as chapter_title from x where text <> ''
        window w as (partition by doc_id order by para_no rows unbounded preceding)),
    z as (
        select *, sum((not chapter and not sutra and segment = 0)::INT) over (partition by doc_id) as front, max(segment) over (partition by doc_id) as heads,
            max(case when sutra then text end) over (partition by doc_id, segment) as own,
            bool_or(chapter) over (partition by doc_id) as any_chapter, bool_or(sutra) over (partition by doc_id) as any_sutra from y),
    s as (
        select *, front >= 2 or (heads = 0 and front > 0) as whole from z),
    state as (
        select doc_id, para_no, text, chapter, sutra, segment::BIGINT as segment, chapter_no::BIGINT as chapter_no, coalesce(chapter_title, 'Không xác định') as chapter_title,
            case when segment = 0 and whole then doc_id || '_full' else coalesce(own, 'Không xác định') end as title,
            (sum(sutra::INT) over (partition by doc_id, chapter_no order by para_no rows unbounded preceding) + case when whole and chapter_no = 0 then 1 else 0 end)::BIGINT as number,
            {_LABEL} as label
        from s)
"""

_V2 = """
    with x as (
        select conv_id as doc_id, turn as para_no, turn % 3 = 0 as cut,
            turn % 3 <> 0 and role = 'user' and turn % 4 = 2 as chapter, turn % 3 <> 0 and role = 'user' and turn % 4 <> 2 as sutra, turn,
            case when role = 'user' and turn % 4 = 2 then 'PHẦN ' || turn || ': name' when role = 'user' then 'KINH ' || turn else '- ' || regexp_replace(text, '\\s+$', '') end as text
        from conversations),
    y as (
        select *, sum(cut::INT) over (partition by doc_id order by para_no rows unbounded preceding) as segment from x),
    z as (
        select *, sum(chapter::INT) over w as epoch, last_value(case when chapter then turn end ignore nulls) over w as chapter_no, last_value(case when chapter then text end ignore nulls) over w as chapter_title
        from y where segment > 0 window w as (partition by doc_id order by para_no rows unbounded preceding)),
    state as (
        select *, last_value(case when sutra then text end ignore nulls) over w as title, sum(sutra::INT) over w as number
        from z window w as (partition by doc_id, epoch order by para_no rows unbounded preceding))
"""

_SIDES = """
    with e as (select user_id || '-' || event_type as id, ts, value from events),
    s as (select id, max(ts) as ts, count(*)::BIGINT as n from e group by id),
    t as (select id, max(ts) as ts, count(*)::BIGINT as n from e where value > 60 group by id)
"""


_BOOKS = "(select doc_id as book, source, lang from documents where lang <> 'de')"
_COUNTS = "list_transform(['a', 'e', 'i', 'o'], lambda c: (length({0}) - length(replace({0}, c, '')))::DOUBLE)"


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_running": _V1 + f"""
            select printf('%s_pham_%02d_kinh_%03d_%s.json', doc_id::VARCHAR, chapter_no, number, left(title, 50)) as file_name, coalesce(any_value(source), 'Not_Available') as bo,
                chapter_title as chapter, title as sutra, label, 21::BIGINT as n_keys, count(*)::BIGINT as n_lines, md5(string_agg(text, chr(10) order by para_no)) as lines_md5
            from state left join {_BOOKS} on book = doc_id where not chapter and not sutra and title <> 'Không xác định' group by doc_id, segment, chapter_no, number, chapter_title, title, label""",
        "ingest_delimited": _V2 + f"""
            , marked as (select *, not cut and not chapter and not sutra and turn % 5 = 1 as short, bool_or(chapter) over (partition by doc_id) as any_chapter, bool_or(sutra) over (partition by doc_id) as any_sutra from state),
            parts as (
                select doc_id, segment, {_LABEL} as label, coalesce(arg_max(chapter_no, para_no) filter (chapter_no is not null), 0) as c, max_by(coalesce(chapter_title, 'Not_Available'), para_no) as chapter,
                    max_by(number, para_no) as n, max_by(coalesce(title, 'Not_Available'), para_no) as sutra, count(*) filter (not short) as n_lines, string_agg(text, chr(10) order by para_no) filter (not short) as lines
                from marked where not cut group by doc_id, segment, label)
            select doc_id::VARCHAR || case when c > 0 then printf('_pham_%02d_phan%dname', c, c) else '' end || case when n > 0 then printf('_kinh_%03d_', n::BIGINT) || lower(replace(sutra, ' ', '')) else '' end || '.json' as file_name,
                coalesce(source, 'Not_Available') as bo, chapter, sutra, label, 21::BIGINT as n_keys, n_lines::BIGINT as n_lines, md5(lines) as lines_md5
            from parts left join {_BOOKS} on book = doc_id where n_lines > 0""",
        "chapter_words": """
            with x as (select conv_id as doc_id, turn as para_no, turn, turn > 0 and role = 'user' as chapter, (conv_id + turn) % 3 = 0 as counted, sum((turn = 0)::INT) over (partition by conv_id order by turn) as started from conversations),
            y as (select *, sum((chapter and counted)::INT) over w as epoch, last_value(case when chapter then 'CHƯƠNG ' || case when counted then turn::VARCHAR else 'NHẤT' end end ignore nulls) over w as chapter_title
                from x where started > 0 window w as (partition by doc_id order by para_no rows unbounded preceding)),
            z as (select *, coalesce(max(case when chapter and counted then turn end) over (partition by doc_id, epoch), 0)
                + sum((chapter and not counted)::INT) over (partition by doc_id, epoch order by para_no rows unbounded preceding) as no from y)
            select doc_id, para_no, no::BIGINT as chapter_no, coalesce(chapter_title, 'Không xác định') as chapter_title from z""",
        "document_records": f"""
            select doc_id || '.json' as file_name, coalesce(any_value(source), 'Not_Available') as bo, 'Toàn bộ tài liệu' as label, md5(string_agg({_CLEAN}, chr(10) order by para_no)) as body_md5
            from {_LINES} left join {_BOOKS} on book = doc_id group by doc_id""",
        "json_records": "select r_name as bo, string_agg(n_name, ',' order by n_name) as lines from nation join region on n_regionkey = r_regionkey group by r_name",
        "normalized_copy": "select doc_id::VARCHAR as source_file, md5(nfc_normalize(text)) as value_md5 from documents",
        "enrich_cache": """
            with n as (select n_name, n_nationkey as k, r_name from nation join region on n_regionkey = r_regionkey)
            select n_name as name, r_name as bo, null::VARCHAR as ghi_chu, 1::BIGINT as n_keys from n where r_name <> 'ASIA'
            union all select 'Nátiòn-' || k, case when k % 3 <> 0 and k % 2 = 0 then 'asked ' || k else 'Not_Available' end, 'Not_Available', 21
            from n where r_name = 'ASIA' and k in (select c_nationkey from customer)""",
        "sync_rejects": """
            with s as (select event_id as id, case when event_type = 'error' or value > 80 then '0001-01-01'::TIMESTAMP else date_trunc('second', ts) end as at from events where event_type <> 'view'),
            t as (select event_id as id, case when value < 40 then '0001-01-01'::TIMESTAMP when value < 60 then date_trunc('second', ts) + interval 1 day else date_trunc('second', ts) end as at from events where value > 20)
            select coalesce(s.id, t.id)::VARCHAR as id, case when t.id is null then 'add' when s.id is null then 'delete' when s.at > t.at then 'update' else 'unchanged' end as action
            from s full join t on s.id = t.id""",
        "answer_flow": f"""
            with q as (select conv_id * 1000 + turn as query_id, case when turn = 0 then ' ' else text end as question from conversations),
            v as (select doc_id::VARCHAR as id, text as document, source, lang, {_COUNTS.format("text")} as x from documents),
            w as (select *, {_COUNTS.format("question")} as y from q),
            hits as (select query_id, question, id, row_number() over (partition by query_id order by list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), id) as rank from w, v),
            found as (
                select query_id, question, string_agg(document, chr(10) order by rank) as context, list_aggregate(list_sort(list_distinct(list('Bộ: ' || source || ', Kinh: ' || lang))), 'string_agg', ' | ') as citations
                from hits join v using (id) where rank <= 5 group by query_id, question),
            asked as (select *, {_text(PROMPT_HEAD)} || question || {_text(PROMPT_RULES)} || '''''''' || chr(10) || {_CLEAN.replace("line", "context")} || chr(10) || '''''''' as prompt from found),
            said as (select *, case when length(prompt) % 7 = 0 then {_text(ERROR_PREFIX + "too busy")} when length(prompt) % 5 = 0 then {_text(NO_INFO)} else 'A: ' || right(prompt, 60) end as answer from asked)
            select query_id, md5(answer) as answer_md5, citations, md5(case when question = ' ' then {_text(ASK_AGAIN)} else {_text(ANSWER_HEAD)} || answer || chr(10) || chr(10)
                || case when length(prompt) % 7 = 0 or length(prompt) % 5 = 0 then {_text(SOURCES_HIDDEN)} else {_text(SOURCES_HEAD)}
                    || '_ ' || replace(citations, ' | ', '_' || chr(10) || '_ ') || '_' end end) as page_md5 from said""",
        "flag_newest": """
            select '<h3>"' || n_name || '",' || chr(10) || '</h3>' as text, '2025-05-2' || n_regionkey || ' 16:21:55' as timestamp from nation where n_regionkey <> 3""",
        "vector_topk": _topk("l2"),
        "vector_topk_cosine": _topk("cosine"),
        "rag_context": _PASSAGES + f"""
            , c as (select query_id, string_agg(document, chr(10) order by rank) as context from passages group by query_id),
            p as (select query_id, {_text(PROMPT_HEAD)} || 'question ' || query_id || {_text(PROMPT_RULES)} || '''''''' || chr(10) || context || chr(10) || '''''''' as prompt from c)
            select query_id, length(prompt)::BIGINT as prompt_chars, md5(prompt) as prompt_md5 from p""",
        "citations": _PASSAGES + """
            select query_id, string_agg(c, ' | ' order by c) as citations from (select distinct query_id, 'Bộ: ' || source || ', Kinh: ' || lang as c from passages) group by query_id""",
        "chunk_documents": f"select doc_id, generate_subscripts(parts, 1)::BIGINT - 1 as chunk_no, unnest(parts) as content from ({_CHUNKS})",
        "chunk_ordinals": f"""
            select doc_id, chunk_no, source, row_number() over (partition by source order by doc_id, chunk_no) as doan_so
            from (select doc_id, source, generate_subscripts(parts, 1)::BIGINT - 1 as chunk_no, unnest(parts) as content from ({_CHUNKS}))""",
        "sentence_split": f"select doc_id, generate_subscripts({_SENTENCES}, 1)::BIGINT - 1 as no, unnest({_SENTENCES}) as sentence from documents",
        "nfc_text": "select doc_id, length(nfc_normalize(text))::BIGINT as chars, md5(nfc_normalize(text)) as text_md5 from documents",
        "match_key_a": """
            select doc_id, length(k)::BIGINT as chars, md5(k) as key_md5 from (
                select doc_id, regexp_replace(replace(replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'), '[^a-z0-9]', '', 'g') as k from documents)""",
        "match_key_b": r"""
            select doc_id, length(k)::BIGINT as chars, md5(k) as key_md5 from (select doc_id, regexp_replace(strip_accents(lower(text)), '[\s_\-]', '', 'g') as k from documents)""",
        "clean_lines": f"select doc_id, para_no::BIGINT as para_no, {_CLEAN} as text from {_LINES} where {_CLEAN} <> ''",
        "whole_documents": f"select doc_id, md5(string_agg({_CLEAN}, chr(10) order by para_no)) as body_md5 from {_LINES} group by doc_id",
        "file_names": f"""
            select p_partkey, printf('book_pham_%02d_kinh_%03d_%s.json', p_size, p_size + 1, left(regexp_replace(p_name, '[\\\\/:*?"<>|]', '_', 'g'), 50)) as name_v1,
                left(replace(replace('a_book' || case when p_size > 25 then printf('_pham_%02d', p_size - 25) || '_' || {_SLUG} else '' end
                    || case when p_size > 0 then printf('_kinh_%03d', p_size) || '_' || {_SLUG} else '' end, '__', '_'), ' ', '_'), 200) || '.json' as name_v2 from part""",
        "base_names": "select n_nationkey, case when n_name = 'NATION_1' then 'first' else n_name || '_x_y' end as name from nation",
        "roman_numeral": "select p_partkey, p_partkey % 3999 + 1 as expected, p_partkey % 3999 + 1 as value from part",
        "segment_running": _V1 + "select doc_id, para_no, segment, chapter_no, chapter_title, title, number from state",
        "segment_collect": _V1 + """
            select doc_id, segment, title, label, count(*)::BIGINT as n_lines, md5(string_agg(text, chr(10) order by para_no)) as lines_md5 from state
            where not chapter and not sutra and title <> 'Không xác định' group by doc_id, segment, title, label""",
        "segment_delimited": _V2 + """
            select doc_id, segment::BIGINT as segment, coalesce(arg_max(chapter_no, para_no) filter (chapter_no is not null), 0)::BIGINT as chapter_no,
                coalesce(max_by(coalesce(chapter_title, 'Không xác định'), para_no), 'Không xác định') as chapter_title, max_by(number, para_no)::BIGINT as number,
                max_by(coalesce(title, 'Không xác định'), para_no) as title, md5(string_agg(text, chr(10) order by para_no)) as lines_md5
            from state where not cut group by doc_id, segment""",
        "structure_label": _V1 + "select doc_id, any_value(label) as label from state group by doc_id",
        "dedup_first": "select lang, doc_id from (select *, row_number() over (partition by lang, text order by doc_id) as r from documents) where r = 1",
        "tree_flatten": """
            with c as (select n_name as source_file, c_name, c_mktsegment, c_custkey, 3 * (row_number() over (partition by n_name order by c_custkey) - 1) as p from customer join nation on c_nationkey = n_nationkey),
            n as (select source_file, p as pos, c_name as text, c_custkey from c union all select source_file, p + 2, c_mktsegment, c_custkey from c)
            select source_file, pos::BIGINT as pos, text, c_custkey::VARCHAR as key, null::VARCHAR as own from (select *, row_number() over (partition by source_file, text order by pos) as r from n) where r = 1""",
        "metadata_enrich": """
            select c_custkey, coalesce(r_name, 'Not_Available') as bo, 'Not_Available' as ghi_chu, 21::BIGINT as n_keys
            from customer left join (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA') on c_nationkey = n_nationkey""",
        "template_fill": f"""
            select r_regionkey, list_aggregate(list_sort(list_transform([{', '.join(map(_text, META_KEYS))}], lambda k: k || '=' || case k when 'Bộ' then r_name when 'Số Phẩm' then r_regionkey::VARCHAR else 'Not_Available' end)), 'string_agg', ';') as filled from region""",
        "metadata_scalars": "select event_id, 2::BIGINT as n, json_extract_string(props, '$.k') as k, strftime(ts, '%Y-%m-%d %H:%M:%S') as last_updated from events",
        "ingest_files": """
            select arg_min(role, turn) || '-' || conv_id as doc_id, true as filled, count(*) as paragraphs, 'book ' || arg_min(role, turn) as bo from conversations group by conv_id""",
        "tree_roots": r"""
            select conv_id::VARCHAR as source_file, row_number() over (partition by conv_id order by turn) as no, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as text_md5,
                case when conv_id % 4 in (1, 3) then 'c' || conv_id end as k, case when conv_id % 4 < 3 then turn::VARCHAR end as turn
            from conversations where text is not null and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""",
        "docx_read": "select conv_id::VARCHAR as doc_id, row_number() over (partition by conv_id order by turn) - 1 as para_no, md5(text) as text_md5, false as failed from conversations",
        "ledger_answers": f"""
            select conv_id, turn, md5(case when trim(said) = '' or contains(lower(said), {_text(NO_INFO.lower())}) or contains(lower(said), 'tôi không tìm thấy thông tin') or contains(lower(said), 'không có thông tin này')
                then {_text(NO_INFO)} else said end) as answer_md5 from (select *, 'told ' || text as said from conversations)""",
        "index_recall": "select vec_id as query_id, (select least(5, count(*) - 1) from embeddings)::BIGINT as hits, true as recall_ok, (select count(*) from embeddings)::BIGINT as indexed from embeddings where vec_id % 20 = 0",
        "sync_changes": """
            select doc_id::VARCHAR as id, md5(case when source = 'src3' then 'new ' || text else text end) as document_md5, case when source = 'src3' then '2024-02-01' else '2024-01-01' end as last_updated
            from documents where source <> 'src5'""",
        "sync_diff": _SIDES + "select s.id, case when t.id is null then 'add' when s.ts > t.ts then 'update' else 'unchanged' end as action from s left join t on s.id = t.id",
        "sync_apply": _SIDES + """
            select s.id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') as last_updated, case when t.id is null or s.ts > t.ts then s.n else t.n end as n from s left join t on s.id = t.id""",
        "batch_assign": "select event_id, (row_number() over (order by event_id) - 1) // 100 as batch from events",
        "answer_classify": f"""
            select conv_id, turn, case when trim(said) = '' or contains(lower(said), {_text(NO_INFO.lower())}) or contains(lower(said), 'tôi không tìm thấy thông tin') or contains(lower(said), 'không có thông tin này')
                then 'no_info' when starts_with(said, {_text(ERROR_PREFIX)}) then 'error' else 'answer' end as kind
            from (select *, case when role = 'system' then {_text(ERROR_PREFIX)} || text when turn % 5 = 3 then text || ' Không có thông tin này.' else text end as said from conversations)""",
        "answer_page": f"""
            select conv_id, turn, md5(case when turn = 0 then {_text(ASK_AGAIN)} else {_text(ANSWER_HEAD)} || case when role = 'system' then {_text(NO_INFO)} else text end || chr(10) || chr(10)
                || case role when 'system' then {_text(SOURCES_HIDDEN)} when 'user' then {_text(SOURCES_HEAD)} || '_ Bộ: a_' || chr(10) || '_ Kinh: b_' else {_text(NO_SOURCES)} end end) as page_md5 from conversations""",
        "flag_report": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp from events where event_type <> 'error'",
        "flag_html": """
            select '<tr><td>' || event_id || '</td><td>' || replace(props, '"', '&quot;') || '</td><td>' || event_type || '</td></tr>' as line from events""",
        "ingest_counts": "select lang, source, count(*)::BIGINT as n, grouping_id(lang, source)::BIGINT as level from documents group by rollup (lang, source)",
        "stream_sync": f"""
            select doc_id || '-' || (no - 1) as id, md5(content) as document_md5, ((length(content) - length(replace(content, 'a', ''))) / length(content))::FLOAT::DOUBLE as first
            from (select doc_id, generate_subscripts(parts, 1) as no, unnest(parts) as content from ({_CHUNKS}))""",
    }
