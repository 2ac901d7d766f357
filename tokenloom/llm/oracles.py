"""SQL counterparts of the registered queries, where SQL can express them.

The others are tested against brute force, an exact round trip or held-out rows: suffix dedup and
secret spans (brute force), the classifier (held-out labels), embedding passes (brute force), BPE (the
tokenizers library), the context tree (its definition).
"""

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"



def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)::ubigint[]), lambda c, k: xor(c >> 1, (c & 1) * 3988292384::ubigint))"
    return (f"xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({text}, ''), "
            f"lambda x: ord(x)::ubigint)), lambda a, b: {step}))")


def leaf_sql(*fields: str) -> str:
    one = lambda f: f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')"
    return f"sha256({' || '.join(map(one, fields))})"


SQL: dict[str, str] = {
    "op2_ngram_join": rf"""with recursive
        w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {WORD}) as a from documents),
        g as (select distinct doc_id, unnest(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')]
              else list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) end) as s from w),
        n as (select doc_id, count(*) as n from g group by doc_id),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as o from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by all),
        l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 75 * (na.n + nb.n - o)),
        e as (select a, b from l union all select b, a from l),
        reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id
        from documents d left join n using (doc_id) left join (select a, min(b) as b from reach group by a) m on m.a = d.doc_id""",
    "op4_url_trie": rf"""with rules(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        r as (select page_id, case when coalesce(strpos(url, '://'), 0) = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
        h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from r),
        p as (select page_id, translate(raw, {UPPER}, {LOWER}) as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
        m as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v
              from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join m using (page_id)""",
    "op6_rule_ledger": rf"""with t as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, text, regexp_extract_all(text, {WORD}) as a from t),
        g as (select doc_id, i, array_to_string(a[i:i + 4], ' ') as s from (select doc_id, a, unnest(range(1, len(a) - 3)) as i from w)),
        c as (select doc_id, i, count(*) over (partition by doc_id, s) as c from g),
        x as (select doc_id, count(distinct place) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as place from c where c > 1) group by doc_id),
        l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
        m as (select doc_id, len(a) as n_words, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)::bigint as word_chars,
              length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
              coalesce(n_repeat_words, 0) as n_repeat_words, length(text) - length(replace(text, chr(10), '')) + 1 as n_lines,
              length(regexp_replace(text, '[^A-Z]', '', 'g')) as up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters,
              length(regexp_replace(text, '[^!]', '', 'g')) as marks
              from w join l using (doc_id) left join x using (doc_id)),
        b as (select *, (n_words < 10)::int as f0, (100 * n_repeat_words > 20 * n_words)::int as f1, (word_chars > 40 * n_words)::int as f2,
              (100 * n_symbols > 15 * word_chars)::int as f3, (100 * n_dup_lines > 60 * n_lines)::int as f4,
              (letters >= 50 and 100 * up > 70 * letters)::int as f5, (100 * marks > 50 * n_words)::int as f6 from m),
        f as (select *, (f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 + 64 * f6)::bigint as failures from b),
        s as (select *, case failures when 1 then 'few_words' when 2 then 'repeated_windows' when 4 then 'long_words' when 8 then 'symbols'
              when 16 then 'repeated_lines' when 32 then 'shouting' when 64 then 'marks' end as sole_rule from f)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures % 4 <> 0 as base_failed, failures = 0 as kept,
        failures, sole_rule, case when sole_rule is not null then count(*) over (partition by sole_rule) end as sole_rows from s""",
    "op11_merkle_veb": f"""with recursive
        leaves as (select row_number() over () as rid, doc_id, source, {leaf_sql("doc_id", "source", "lang", "n_chars", "text")} as leaf,
            case when {crc32_sql("doc_id::varchar")} % 5 = 0
                 then {leaf_sql("doc_id", "source", "lang", "n_chars", f"translate(text, {UPPER}, {LOWER})")} end as found from documents),
        t(level, source, pos, digest, n) as (
            select 0, source, row_number() over (partition by source order by doc_id nulls first, leaf) - 1, leaf, count(*) over (partition by source) from leaves
            union all select level + 1, source, pos // 16, sha256(string_agg(digest, '' order by pos)), (n + 15) // 16
            from t where n > 1 group by level, source, pos // 16, n),
        sub as (select source, digest, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from t where n = 1),
        u(level, pos, digest, n) as (
            select 0, pos, digest, n from sub
            union all select level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (n + 15) // 16 from u where n > 1 group by level, pos // 16, n),
        ends as (select digest as root from u where n = 1),
        s as (select a.level, a.source, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos), '') as l,
              coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos), '') as r
              from t a join t b on a.level = b.level and a.source is not distinct from b.source and a.pos // 16 = b.pos // 16 where a.n > 1 group by all),
        us as (select a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos < a.pos), '') as l,
              coalesce(string_agg(b.digest, '' order by b.pos) filter (where b.pos > a.pos), '') as r
              from u a join u b on a.level = b.level and a.pos // 16 = b.pos // 16 where a.n > 1 group by all),
        ranked as (select rid, doc_id, source, leaf, found, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves),
        climb(rid, source, level, pos, proof, folded) as (
            select rid, source, 0, pos, '', coalesce(found, leaf) from ranked
            union all select rid, c.source, c.level + 1, c.pos // 16, proof || l || r, sha256(l || folded || r)
            from climb c join s on s.level = c.level and s.pos = c.pos and s.source is not distinct from c.source),
        top as (select rid, source, arg_max(proof, level) as proof, arg_max(folded, level) as folded from climb group by rid, source),
        rise(rid, level, pos, proof, folded) as (
            select rid, 0, sub.pos, proof, folded from top join sub on top.source is not distinct from sub.source
            union all select rid, c.level + 1, c.pos // 16, proof || l || r, sha256(l || folded || r) from rise c join us on us.level = c.level and us.pos = c.pos),
        told as (select rid, arg_max(proof, level) as proof, arg_max(folded, level) as folded from rise group by rid)
        select doc_id, leaf, sub.digest as subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
        from ranked join told using (rid) join sub on ranked.source is not distinct from sub.source, ends""",
    "op12_block_join": """with v as (select distinct vec_id, embedding::double[] as e from embeddings where vec_id is not null
            and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n as (select vec_id, e, len(e) as width, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) as norm from v),
        p as (select q.vec_id as query_id, q.e as qe, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.norm * c.norm) as score
              from n q join n c on q.width = c.width and q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id, qe order by score desc, vec_id) as rank from p)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
    "op13_cyk_repair": rf"""with recursive
        c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
              {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as hit from conversations),
        d as (select conv_id, turn, case when hit = 4 then 'user' else role end as role,
              case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
              unnest(range(case when hit = 3 then 2 else 1 end)) as copy from c where hit <> 0),
        o as (select *, sha256(role || chr(0) || text) as h, row_number() over (partition by conv_id order by turn nulls first, sha256(role || chr(0) || text), copy) as pos,
              row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from d),
        f as (select conv_id, pos, turn, role, text, left(role, 1) as i, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'good' end as fault from o),
        steps(p, q, i) as (values (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
        made as (select p, q from steps where i <> 's'),
        e1 as (select p, q, 5 as cost, 'I' as a from made union all select p, p, 0, '' from (select unnest(range(4)) as p)),
        e2 as (select x.p, y.q, x.cost + y.cost as cost, x.a || y.a as a from e1 x join e1 y on x.q = y.p),
        e4 as (select x.p, y.q, x.cost + y.cost as cost, x.a || y.a as a from e2 x join e2 y on x.q = y.p),
        gap as (select p, q, min(cost) as cost, arg_min(a, cost) as a from e4 group by p, q),
        edits as (select f.conv_id, f.pos, s.p, s.q, 'K' as a, if(fault = 'truncated', 5, 0) as cost from f join steps s using (i) where fault in ('good', 'truncated')
            union all select f.conv_id, f.pos, m.p, m.q, 'R', 1 + if(fault = 'truncated', 5, 0) from f, made m where fault in ('good', 'truncated')
            union all select f.conv_id, f.pos, p, p, 'D', 2 from f, (select unnest(range(4)) as p)),
        best(conv_id, pos, q, v) as (
            select conv_id, 0, 0, {{'cost': 0, 'a': '', 'roles': ''}} from (select distinct conv_id from conversations)
            union all select b.conv_id, e.pos, e.q, min({{'cost': (b.v.cost + g.cost + e.cost)::int, 'a': b.v.a || g.a || e.a, 'roles': ''}})
            from best b join gap g on g.p = b.q join edits e on e.conv_id is not distinct from b.conv_id and e.pos = b.pos + 1 and e.p = g.q group by b.conv_id, e.pos, e.q),
        n as (select conv_id, count(*) as n from f group by conv_id),
        last as (select b.conv_id, min({{'cost': (b.v.cost + g.cost)::int, 'a': b.v.a || g.a}}) as v from best b left join n on n.conv_id is not distinct from b.conv_id join gap g on g.p = b.q
              where b.pos = coalesce(n.n, 0) and (g.q = 3 or (b.q = 0 and g.q = 0)) group by b.conv_id),
        letters as (select conv_id, unnest(string_split(v.a, '')) as l, unnest(range(1, length(v.a) + 1)) as k from last where v.a <> ''),
        placed as (select *, sum((l <> 'I')::int) over w as pos, sum((l <> 'D')::int) over w as place
              from letters window w as (partition by conv_id order by k rows unbounded preceding)),
        rows_ as (select p.conv_id, p.k, p.l, p.place, case when p.l = 'I' then '' else f.text end as text, case when p.l = 'K' then f.role end as kept,
              max(case when p.l = 'K' and p.place = 1 and f.i = 's' then 1 else 0 end) over (partition by p.conv_id) as led
              from placed p left join f on f.conv_id is not distinct from p.conv_id and f.pos = p.pos and p.l <> 'I' where p.l <> 'D'),
        spelled as (select conv_id, string_agg(coalesce(kept, if((place - led) % 2 = 1, 'user', 'assistant')) || ':' || text, chr(10) order by k) as t from rows_ group by conv_id),
        near as (select conv_id, i || lead(i) over (partition by conv_id order by pos) as pair from f),
        bad as (select conv_id, count(*) as illegal from near where pair is not null and pair not in ('su', 'ua', 'au') group by conv_id),
        sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 'blank')::int)::bigint as blank,
              sum((fault = 'duplicate')::int)::bigint as duplicate, sum((fault = 'truncated')::int)::bigint as truncated from f group by conv_id)
        select l.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
        coalesce(illegal, 0)::bigint as illegal, l.v.cost::bigint as cost, l.v.a as audit, sha256(coalesce(t, '')) as repaired_sha256
        from last l left join sums s on s.conv_id is not distinct from l.conv_id left join bad b on b.conv_id is not distinct from l.conv_id
        left join spelled x on x.conv_id is not distinct from l.conv_id""",
    "op10_mixture": rf"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0) as size,
            md5(concat_ws(chr(31), '0', doc_id::varchar)) as k from documents),
        s as (select source, sum(size)::bigint as n, 3.0::double * sum(size)::double as lim from d group by source),
        w as (select *, (1 + (row_number() over (order by source nulls last) - 1) % 3)::double as w from s),
        o as (select *, row_number() over (order by lim / w, source nulls last) as rk, sum(n) over () as total,
              sum(lim) over (order by lim / w, source nulls last) - lim as capped,
              sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) as free from w),
        v as (select coalesce(arg_min((total - capped) / free, rk) filter (where w * ((total - capped) / free) < lim), 0) as level, max(lim) as m from o),
        t as (select source, n, case when level = 0 then lim else least(lim, w * level) end as target from w, v),
        r as (select doc_id, size, n as source_size, target, floor(target)::bigint as budget,
              sum(size) over (partition by d.source order by k, size rows unbounded preceding) - size as before
              from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, (case when source_size > 0 then budget // source_size * size + greatest(0, least(size,
            budget - budget // source_size * source_size - before)) else 0 end)::bigint as taken from r""",
}
