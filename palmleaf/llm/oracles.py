"""DuckDB SQL for those training-data queries that SQL can express.

A trained network or model, a tokenizer's merges and first-fit packing are beyond it; tests/llm holds those against brute
force. Of op6 and op11 the base columns are held against SQL by
`secret_base_spans` and `quality_base_counts`, the same counts without the models' and vocabularies' columns.
"""

from __future__ import annotations

_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents"

_REPEATS = """
    with h as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::BIGINT as n from documents),
    w as (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as m from (select doc_id, h, unnest(range(0, n - 99)) as p from h)),
    d as (select doc_id, p from (select *, row_number() over (partition by m order by doc_id, p) as r from w) where r > 1),
    i as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from (
        select doc_id, p, case when p > lag(p, 1, -1000) over (partition by doc_id order by p) + 100 then 1 else 0 end as fresh from d)),
    runs as (select doc_id, min(p) as a, max(p) + 100 as b from i group by doc_id, run),
    gaps as (
        select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from runs
        union all select h.doc_id, coalesce(max(r.b), 0), max(h.n) from h left join runs r on r.doc_id = h.doc_id group by h.doc_id),
    kept as (select g.doc_id, sha256(unhex(string_agg(substr(h.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' order by g.a))) as kept_sha256 from gaps g join h on h.doc_id = g.doc_id group by g.doc_id),
    total as (select doc_id, sum(b - a)::BIGINT as n_removed, count(*)::BIGINT as n_spans from runs group by doc_id)
    select h.doc_id, h.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256
    from h join kept on kept.doc_id = h.doc_id left join total on total.doc_id = h.doc_id
"""

_TOP_K = """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) as e from embeddings where embedding is not null)
    select query_id, rank, vec_id, score from (
        select *, row_number() over (partition by query_id order by score desc, vec_id)::INT as rank from (
            select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::BIGINT as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0))
    where rank <= 20
"""

_REACH = """
    reach(a, b) as (select id, id from nodes union select r.a, l.b from reach r join links l on l.a = r.b),
    found as (select a as id, min(b) as component_id from reach group by a)
"""

_RANGE_JOIN = f"""
    with recursive nodes as (select vec_id as id from embeddings),
    links as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.vec_id <> y.vec_id where list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.95),
    {_REACH}
    select id as vec_id, (select count(*) from links where a = id)::BIGINT as n_links, component_id, id = component_id as kept from found
"""

_BLANK = " \\t\\n\\v\\f\\r"
_COMMON = """case when {x} is null or {y} is null then 0 else coalesce(list_position(list_transform(range(1, least(len({x}), len({y}), 200) + 1), lambda i: {x}[i] = {y}[i]), false) - 1,
    least(len({x}), len({y}), 200)) end"""
_UNITS = f"""
    with p as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][{_BLANK}]+|\\n[{_BLANK}]*)', '\\1' || chr(1), 'g'), chr(1)) as parts from documents),
    l as (select doc_id, unnest(parts) as unit, generate_subscripts(parts, 1) as no from p),
    o as materialized (select *, lower(trim(regexp_replace(unit, '[{_BLANK}]+', ' ', 'g'))) as form, (sum(length(unit)) over (partition by doc_id order by no))::BIGINT as finish from l),
    r as (select *, form <> '' and row_number() over (partition by form order by doc_id, no) > 1 as again, first_value([doc_id, no]) over (partition by form order by doc_id, no) as f,
        case when form = '' then 0 else length(form) - length(replace(form, ' ', '')) + 1 end as words from o),
    i as (select *, no - row_number() over (partition by doc_id, again order by no) as run from r),
    g as materialized (select doc_id, min(no) as a, max(no) as b, sum(words) as words, count(*) as n, min(finish - length(unit)) as start, max(finish) as finish, arg_max(f, words * 1000000 - no) as f, arg_max(no, words * 1000000 - no) as own
        from i where again group by doc_id, run having sum(words) >= 8),
    w as materialized (select doc_id, no, string_split(form, ' ') as x, list_reverse(string_split(form, ' ')) as y, regexp_extract_all(unit, '[^{_BLANK}]+[{_BLANK}]*') as parts from o where form <> ''),
    e as (select g.*, {_COMMON.format(x="lb.y", y="la.y")} as more_left, {_COMMON.format(x="rb.x", y="ra.x")} as more_right, lb.parts as pl, rb.parts as pr
        from g left join w lb on lb.doc_id = g.doc_id and lb.no = g.a - 1 left join w la on la.doc_id = g.f[1] and la.no = g.f[2] - g.own + g.a - 1
        left join w rb on rb.doc_id = g.doc_id and rb.no = g.b + 1 left join w ra on ra.doc_id = g.f[1] and ra.no = g.f[2] - g.own + g.b + 1),
    s as (select doc_id, n, start - length(array_to_string(pl[len(pl) - more_left + 1 :], '')) * (more_left > 0)::INT as a, finish + length(array_to_string(pr[: more_right], '')) * (more_right > 0)::INT as b
        from (select * replace (coalesce(pl, []) as pl, coalesce(pr, []) as pr) from e) where words + more_left + more_right >= 40),
    m as (select *, sum(fresh) over (partition by doc_id order by a, b) as grp from (
        select *, case when a <= max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from s)),
    runs as materialized (select doc_id, min(a)::BIGINT as a, max(b)::BIGINT as b, sum(n) as n from m group by doc_id, grp),
    t as (select doc_id, coalesce(text, '') as t from documents),
    gaps as (
        select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from runs
        union all select t.doc_id, coalesce(max(r.b), 0), any_value(length(t.t)) from t left join runs r on r.doc_id = t.doc_id group by t.doc_id),
    kept as (select g.doc_id, sha256(string_agg(substr(t, (g.a + 1)::INT, (g.b - g.a)::INT), '' order by g.a)) as kept_sha256 from gaps g join t on t.doc_id = g.doc_id group by g.doc_id),
    spans as (select doc_id, string_agg(a || ':' || b, ',' order by a) as removed, sum(b - a)::BIGINT as chars, sum(n)::BIGINT as n from runs group by doc_id)
    select t.doc_id, length(t)::BIGINT as n_chars, coalesce(n, 0) as n_removed, coalesce(chars, 0) as n_removed_chars, coalesce(removed, '') as removed, kept_sha256
    from t join kept on kept.doc_id = t.doc_id left join spans on spans.doc_id = t.doc_id
"""

_JACCARD = f"""
    with recursive words as (
        select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    sets as materialized (
        select distinct id, md5(array_to_string(w[i : i + 4], ' ')) as s from (select id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from words)),
    sizes as materialized (select id, count(*) as n from sets group by id),
    links as materialized (
        select p.a, p.b from (select x.id as a, y.id as b, count(*) as c from sets x join sets y on x.s = y.s and x.id <> y.id group by x.id, y.id) p
        join sizes p1 on p1.id = p.a join sizes p2 on p2.id = p.b where 100 * c >= 75 * (p1.n + p2.n - c)),
    nodes as (select id from words),
    {_REACH}
    select found.id as doc_id, coalesce(n, 0)::BIGINT as n_shingles, component_id from found left join sizes on sizes.id = found.id
"""

_LINE_DEDUP = f"""
    with l as ({_LINES}),
    f as (select doc_id, no, md5(line) as m, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50 as long from l where trim(line) <> ''),
    w as (select *, lead(m, 1) over o as m1, lead(m, 2) over o as m2, lead(no, 1) over o as n1, lead(no, 2) over o as n2 from f window o as (partition by doc_id order by no)),
    runs as (select *, row_number() over (partition by m, m1, m2 order by doc_id, no) as r from w where m2 is not null),
    gone as (
        select doc_id, unnest([no, n1, n2]) as no from runs where r > 1
        union select doc_id, no from (select doc_id, no, row_number() over (partition by m order by doc_id, no) as r from f where long) where r > 1)
    select l.doc_id, count(*)::BIGINT as n_lines, count(gone.no)::BIGINT as n_removed, coalesce(string_agg(gone.no::VARCHAR, ',' order by gone.no), '') as removed_lines,
        sha256(coalesce(string_agg(line, chr(10) order by l.no) filter (gone.no is null), '')) as kept_sha256
    from l left join gone on gone.doc_id = l.doc_id and gone.no = l.no group by l.doc_id
"""

# The base patterns, with the group and the least length that count.
_BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}


def _base_kind(no: int, name: str) -> str:
    pattern, group, least = _BASE[name]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""select doc_id, {no} as k, '{name}' as kind, fin - n as a, fin as b from (
        select *, length(whole) as n, (sum(length(piece) + coalesce(length(whole), 0)) over (partition by doc_id order by i))::BIGINT as fin from (
            select doc_id, unnest(string_split_regex(t, {p})) as piece, unnest(regexp_extract_all(t, {p})) as whole, unnest(regexp_extract_all(t, {p}, {group})) as part,
                generate_subscripts(string_split_regex(t, {p}), 1) as i from d)) where length(part) >= {least}"""


_SECRETS = f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    s as ({" union all ".join(_base_kind(no, name) for no, name in enumerate(_BASE))})
    select d.doc_id, count(*) filter (k = 0)::BIGINT as n_assign, count(*) filter (k = 1)::BIGINT as n_access, count(*) filter (k = 2)::BIGINT as n_hex,
        sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, k), '')) as base_sha256
    from d left join s on s.doc_id = d.doc_id group by d.doc_id
"""


_QUALITY = """
    with d as (select doc_id, coalesce(text, '') as t from documents),
    w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
    g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
    r as (select doc_id, count(distinct p)::BIGINT as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
    l as (select doc_id, (count(*) - count(distinct line))::BIGINT as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
        where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id)
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from (
        select w.doc_id, len(w)::BIGINT as n_words, length(array_to_string(w, ''))::BIGINT as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT as n_symbols,
            coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
        from w left join r on r.doc_id = w.doc_id left join l on l.doc_id = w.doc_id)
"""


def _merkle(levels: int = 8, upper: int = 4) -> str:
    """Levels are written out: up to 8 ** levels documents a language and 8 ** upper languages."""
    number = "row_number() over (partition by lang order by doc_id nulls first, leaf) - 1"
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 bit by bit: 4294967295 and 3988292384 are its start and its polynomial
    crc = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
        list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT))"""
    parts = [
        f"""l as materialized (select doc_id, coalesce('1' || lang, '0') as t, {leaf('text')} as leaf, {number} as place,
            case when {crc} % 3 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as altered from documents)""",
        "p0 as materialized (select doc_id, t, leaf, place as pos, place, leaf as node, coalesce(altered, leaf) as folded, '' as proof from l)",
        "n0 as materialized (select t, place as pos, leaf as node from l)",
    ]
    for k in range(levels + upper):
        if k == levels:
            parts += [
                f"s as materialized (select t, node as subroot, row_number() over (order by t) - 1 as pos from n{k})",
                f"q as materialized (select p.*, s.subroot, s.pos as above from p{k} p join s on s.t = p.t)",
                f"p{k}u as materialized (select doc_id, t, leaf, above as pos, place, node, folded, proof, subroot from q)",
                f"n{k}u as materialized (select '' as t, pos, subroot as node from s)",
            ]
        u, more, key = ("", "", "p.t") if k < levels else ("u", ", p.subroot", "''")
        v = "" if k + 1 < levels or k + 1 == levels else "u"
        parts += [
            f"g{k} as materialized (select *, count(*) over (partition by t) > 1 as many, string_agg(node, '') over (partition by t, pos // 8 order by pos rows between unbounded preceding and 1 preceding) as a,"
            f" string_agg(node, '') over (partition by t, pos // 8 order by pos rows between 1 following and unbounded following) as b from n{k}{u})",
            f"n{k + 1}{v} as materialized (select t, pos // 8 as pos, case when any_value(many) then sha256(string_agg(node, '' order by pos)) else any_value(node) end as node from g{k} group by t, pos // 8)",
            f"p{k + 1}{v} as materialized (select p.doc_id, p.t, p.leaf, p.pos // 8 as pos, p.place, g.node, case when many then sha256(coalesce(a, '') || p.folded || coalesce(b, '')) else p.folded end as folded,"
            f" case when many then p.proof || coalesce(a, '') || coalesce(b, '') else p.proof end as proof{more} from p{k}{u} p join g{k} g on g.t = {key} and g.pos = p.pos)",
        ]
    return f"""with {", ".join(parts)}
        select doc_id, leaf, subroot, (select node from n{levels + upper}u) as root, sha256(proof) as proof_sha256, folded as folded_root, folded = (select node from n{levels + upper}u) as verified from p{levels + upper}u"""


def _centroids(k: int = 40, rounds: int = 5) -> str:
    parts = [
        """v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as e from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"c0 as materialized (select row_number() over (order by h) - 1 as c, e from (select sha256('2:' || vec_id) as h, e from v order by h limit {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} as materialized (select * from (select vec_id, v.e, c, (list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, m.e) + list_dot_product(m.e, m.e))::BIGINT as d
                from v, c{r} m) qualify row_number() over (partition by vec_id order by d, c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} as materialized (select o.c, coalesce(m.e, o.e) as e from c{r} o left join (select c, list(x order by i) as e from (
                    select c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE as x from (
                        select c, unnest(e)::BIGINT as x, generate_subscripts(e, 1) as i from a{r}) group by c, i) group by c) m on m.c = o.c)"""
            )
    return f"""with {", ".join(parts)}
        select vec_id, a.c::INT as cluster, d as distance, (sum(d) over (partition by a.c))::BIGINT as cluster_inertia, (sum(d) over ())::BIGINT as inertia,
            sha256(array_to_string(list_transform(m.e, lambda x: x::BIGINT::VARCHAR), ',')) as centroid_sha256 from a{rounds} a join c{rounds} m on m.c = a.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "secret_base_spans": _SECRETS,
        "quality_base_counts": _QUALITY,
        "op1_repeated_substrings": _REPEATS,
        "op2_topk_search": _TOP_K,
        "op4_range_join": _RANGE_JOIN,
        "op5_unit_dedup": _UNITS,
        "op9_jaccard_join": _JACCARD,
        "op10_line_dedup": _LINE_DEDUP,
        "op12_merkle_manifest": _merkle(),
        "op13_centroids": _centroids(),
    }
