"""SQL of the clustering, the top-k search and the conversation repair."""

from __future__ import annotations

#: Vectors of whole components as integers.
INTEGERS = "list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)"
WHOLE = "embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))"


def clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, one after the other, on longs."""
    parts = [
        f"kept as materialized (select vec_id, {INTEGERS} as q from embeddings where {WHOLE} and len(embedding) = 64)",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, q from kept qualify c < {k})",
    ]
    distance = "list_sum(list_transform(list_zip(kept.q, x.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select vec_id, any_value(kept.q) as q, min(row({distance}::bigint, c)) as b from kept cross join c{r} x group by vec_id)")
        if r < rounds:
            sums = f"select b[2] as c, i, sum(q[i])::hugeint as s, count(*)::hugeint as n from a{r} cross join range(1, 65) r(i) group by 1, 2"
            parts.append(f"m{r} as materialized (select c, list(((s - ((s % n + n) % n)) // n)::bigint order by i) as q from ({sums}) group by c)")
            parts.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.q, c{r}.q) as q from c{r} left join m{r} using (c))")
    return f"""with {", ".join(parts)}
        select vec_id, b[2]::int as cluster, b[1] as distance, (sum(b[1]) over (partition by b[2]))::bigint as cluster_inertia, (sum(b[1]) over ())::bigint as inertia,
            sha256(array_to_string(f.q, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} f on f.c = a.b[2]"""


TOP_K = f"""with v as materialized (select vec_id, {INTEGERS} as q from embeddings where {WHOLE})
    select query_id, (row_number() over w)::int as rank, vec_id, score from (
        select a.vec_id as query_id, b.vec_id as vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
        from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
    window w as (partition by query_id order by score desc, vec_id) qualify rank <= 10"""

#: Costs go with the letters of the edits, so that the least pair is the cheapest and, among equals, the least in ASCII.
#: f holds the least pairs of a row and all after it, for the states nothing yet, after s, after u, after a.
_PLUS = lambda cost, letter, of: f"row({of}[1] + {cost}, '{letter}' || {of}[2])"
_NEVER = "row(1000000000::bigint, '~')"
_ROW = []
for _state, _next, _kept in ((0, 2, "case i when 's' then n[2] when 'u' then n[3] end"), (1, 2, "case i when 'u' then n[3] end"), (2, 3, "case i when 'a' then n[4] end"), (3, 2, "case i when 'u' then n[3] end")):
    _keep, _then = f"({_kept})", f"n[{_next + 1}]"
    _ROW.append(f"least({_PLUS(4, 'D', f'n[{_state + 1}]')}, case when gone then {_NEVER} else {_PLUS('3 + cut', 'R', _then)} end, case when gone or {_keep} is null then {_NEVER} else {_PLUS('cut', 'K', _keep)} end)")
_INSERTS = "[" + ", ".join(f"least(m[{s + 1}], {_PLUS(3, 'I', f'm[{a + 1}]')}, {_PLUS(6, 'II', f'm[{b + 1}]')})" for s, a, b in ((0, 2, 3), (1, 2, 3), (2, 3, 2), (3, 2, 3))) + "]"
_SPACE = r"[\x20\x09-\x0D]"

REPAIR = f"""with recursive
    keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
    crc as (select *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ord(x)::bigint), lambda a, b:
        list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295), 4294967295) % 20 as kind from keyed),
    rows_ as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from crc cross join range(2) r(copy) where kind <> 0 and (copy = 0 or kind = 3)),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, right(regexp_replace(text, '{_SPACE}+$', ''), 1) as tail from rows_),
    faults as (select *, case when tail = '' then 'blank' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
        coalesce(lag(left(role, 1)) over (partition by conv_id order by p) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal from placed),
    facts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
        count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where illegal) as illegal from faults group by conv_id),
    walk as (
        select conv_id, n as p, [row(0::bigint, ''), row(6::bigint, 'II'), row(3::bigint, 'I'), row(0::bigint, '')] as f from facts
        union all
        select conv_id, p, {_INSERTS} from (select conv_id, p, [{", ".join(_ROW)}] as m from (
            select w.conv_id, w.p - 1 as p, w.f as n, left(x.role, 1) as i, x.fault in ('blank', 'duplicate') as gone, case when x.fault = 'truncated' then 3 else 0 end as cut
            from walk w join faults x on x.conv_id is not distinct from w.conv_id and x.p = w.p))),
    solved as (select conv_id, f[1][1] as cost, f[1][2] as audit from walk where p = 0),
    letters as (select conv_id, k, audit[k] as letter, len(replace(audit, 'D', '')) % 2 as has_s, len(regexp_replace(audit[1:k], 'D', '', 'g')) as e, len(regexp_replace(audit[1:k], 'I', '', 'g')) as p
        from solved cross join lateral (select unnest(range(1, len(audit) + 1)) as k)),
    lines as (select l.conv_id, l.k, case when l.letter = 'K' then x.role when (l.e + l.has_s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when l.letter = 'I' then '' else x.text end as line
        from letters l left join faults x on x.conv_id is not distinct from l.conv_id and x.p = l.p and l.letter <> 'I' where l.letter <> 'D'),
    repaired as (select conv_id, string_agg(line, chr(10) order by k) as text from lines group by conv_id)
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
        coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(r.text, '')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join solved s on s.conv_id is not distinct from c.conv_id left join repaired r on r.conv_id is not distinct from c.conv_id"""
