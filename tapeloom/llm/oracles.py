"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x != '')"

SQL: dict[str, str] = {
    "op2_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha256(html) as digest from p),
f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
select page_id, n::bigint as payload_bytes, d.digest as payload_digest, case when page_id != first then 'revisit' else 'response' end as record_type, case when page_id != first then first end::double as refers_to
from d left join f on f.digest = d.digest and d.n >= 100""",
    "op6_substrings": f"""
with w as (select doc_id, {_WORDS.format(t="text")} as w from documents),
g as (select doc_id, w, len(w) as n from w),
s as (select doc_id, unnest(generate_series(1, n - 34)) as i from g where n >= 35),
h as (select s.doc_id, i, md5(array_to_string(g.w[i : i + 34], ' ')) as h from s join g using (doc_id)),
c as (select h from h group by h having count(*) > 1),
r as (select distinct doc_id, unnest(generate_series(i, i + 34)) as i from h where h in (select h from c)),
x as (select doc_id, list(i) as gone from r group by doc_id),
k as (select g.doc_id, g.n, len(coalesce(gone, [])) as m, list_filter(w, lambda v, i: not list_contains(coalesce(gone, []), i)) as kept from g left join x using (doc_id))
select doc_id, n::bigint as n_words, m::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k""",
    "op8_quality_rules": rf"""
with w as (select doc_id, coalesce(text, '') as t, {_WORDS.format(t="text")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, w[i : i + 2] as g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) >= 3)),
d as (select *, count(*) over (partition by doc_id, g) as c from g),
r as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from d where c > 1) group by doc_id),
b as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_bangs, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r using (doc_id)),
f as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 20 * n_words)::bigint + 8 * (100 * n_bangs > 50 * n_words)::bigint
             + 16 * (100 * n_dup_lines > 60 * n_lines)::bigint + 32 * (2 * n_words > word_chars)::bigint + 64 * (word_chars > 25 * n_words)::bigint as fail_bits from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) != 0 as base_failed, fail_bits = 0 as kept, fail_bits from f""",
    "op11_trie": r"""
with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
b as (select distinct conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as s from o),
c as (select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(list_concat([4294967295], s), lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end), 4294967295) % 9 as h from b),
n as (select conv_id, count(*) as n from o group by conv_id),
r as (select c.conv_id, o.p as d, role, text from c join o on o.conv_id = c.base where o.p <= h
      union all select c.conv_id, least(h, coalesce(n.n, 0)) + o.p - h, role, text from c join o using (conv_id) left join n on n.conv_id = c.base where o.p > h),
l as (select conv_id, array_agg({'r': role, 't': text} order by d) as path from r group by conv_id),
f as (select conv_id, coalesce(path, []) as path from c left join l using (conv_id)),
x as (select conv_id, len(path) as n, d, path[1:d] as path from (select *, unnest(generate_series(0, len(path))) as d from f)),
v as (select path, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '') as ends from x group by path, d),
k as (select path[1 : d - 1] as path, count(*) as n_children from v where d > 0 group by 1),
w as (select v.*, coalesce(n_children, 0) as n_children, case when v.d = 0 then 0 else (n_convs - 1) * octet_length(encode(v.path[v.d].t)) end as own from v left join k using (path)),
s as (select path[1:i] as path, sum((n_children = 0)::bigint)::bigint as n_leaves, sum(own)::bigint as saved_tokens from (select *, unnest(generate_series(0, d)) as i from w) group by 1)
select w.conv_id, w.d::bigint as depth, u.conv_id::double as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) as ends_sha256
from w join s using (path) left join v u on w.d > 0 and u.d = w.d - 1 and u.path = w.path[1 : w.d - 1]""",
    "op12_suffixes": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
g as (select doc_id, x, len(x) // 2 as n from d),
w as (select doc_id, unnest(generate_series(0, n - 200)) as i, x from g where n >= 200),
h as (select doc_id, i, md5_number(substring(x, 2 * i + 1, 400)) as h from w),
c as (select h from h group by h having count(*) > 1),
r as (select doc_id, i from h where h in (select h from c)),
a as (select *, i > max(i + 200) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as s from r),
b as (select *, count(*) filter (s is null or s) over (partition by doc_id order by i rows unbounded preceding) as k from a),
m as (select doc_id, min(i) as a, max(i) + 200 as b from b group by doc_id, k),
o as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as last, row_number() over (partition by doc_id order by a desc) = 1 as final from m),
k as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substring(x, 2 * last + 1, 2 * (a - last)), '' order by a) || max(case when final then substring(x, 2 * b + 1) end) as kept from o join g using (doc_id) group by doc_id)
select g.doc_id, g.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from g left join k using (doc_id)""",
    "op13_phrases": r"""
with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(string_split_regex(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x != '') as w from d),
g as (select lang, w, unnest(generate_series(1, len(w))) as i from p where len(w) > 0),
f as (select lang, phrase, k, count(*)::bigint as f from (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select *, unnest([1, 2, 3]) as k from g) where i + k - 1 <= len(w)) group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 10),
x as (select lang, phrase, k, a, j, array_to_string(w[1:j], ' ') as first, array_to_string(w[j + 1 :], ' ') as rest from (select *, unnest(generate_series(1, k - 1)) as j from c)),
y as (select x.*, u.f as l, v.f as r, ((1000000::hugeint * a * a) // (u.f::hugeint * v.f))::bigint as score from x join f u on u.lang = x.lang and u.phrase = x.first join f v on v.lang = x.lang and v.phrase = x.rest),
s as (select * from y qualify row_number() over (partition by lang, phrase order by score, j) = 1),
m as (select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from c where k = 3) group by all),
e as (select s.* from s left join m on m.lang = s.lang and m.phrase = s.phrase and s.k = 2 where longer is null or 100 * longer < 50 * a),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from e)
select q.lang, rank::bigint as rank, phrase, a, l, r, n, score from q join n using (lang) where rank <= 2000""",
}
