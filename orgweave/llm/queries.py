"""The training-data operators as queries: name -> f(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from orgweave.llm import decontaminate, fill_in_middle, html_extract, language_id, license_scan, lm_scoring, near_dedup, packing, pii, quality_model, quality_rules, url_filter, whitening

QUERIES = {
    "op1_quality_model": quality_model.op1,
    "op2_language_id": language_id.op2,
    "op3_pii": pii.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_html_extract": html_extract.op5,
    "op6_near_dedup": near_dedup.op6,
    "op7_license_scan": license_scan.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_packing": packing.op9,
    "op10_lm_scoring": lm_scoring.op10,
    "op11_fill_in_middle": fill_in_middle.op11,
    "op12_whitening": whitening.op12,
    "op13_url_filter": url_filter.op13,
}
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR_DEDUP = f"""
with recursive w as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end)) as s from w),
n as (select doc_id, (select count(*) from g where g.doc_id = d.doc_id) as n from documents d),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {near_dedup.PERCENT} * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(d, m) as (select doc_id, doc_id from documents union select r.d, e.b from r join e on r.m = e.a)
select d as doc_id, any_value(n.n)::bigint as n_shingles, min(m) as component_id, d = min(m) as kept from r join n on n.doc_id = r.d group by d"""

_RATIOS = {
    "symbol_ratio": "case when word_chars > 0 then n_symbols / word_chars else 0 end",
    "dup_line_ratio": "case when n_lines > 0 then n_dup_lines / n_lines else 0 end",
    "repeat_ratio": "case when n_words > 0 then n_repeat_words / n_words else 0 end",
    "upper_ratio": "case when word_chars > 0 then n_upper / word_chars else 0 end",
    "mean_word_chars": "case when n_words > 0 then word_chars / n_words else 0 end",
}
_Q = quality_rules
_PATH = ", ".join(f"({i}, {', '.join(map(repr, c))})" for i, c in enumerate(_Q.PATH))
_QUALITY_RULES = f"""
with w as (select doc_id, coalesce(lang, 'unknown') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select doc_id, unnest([array_to_string(ws[i:i + 7], ' ') for i in range(1, len(ws) - 6)]) as g, unnest(range(1, len(ws) - 6)) as i from w),
f as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
r as (select doc_id, sum(least({_Q.WINDOW}, coalesce(following - i, {_Q.WINDOW})))::bigint as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as following from f) group by 1),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
c as (select w.doc_id, stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as n_upper, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from w join l using (doc_id) left join r using (doc_id)),
m as (select *, {", ".join(f"({x})::double as {k}" for k, x in _RATIOS.items())}, n_words < {_Q.MIN_WORDS} or 100 * n_repeat_words > {_Q.MAX_REPEAT_PERCENT} * n_words as base_failed from c),
path(i, {", ".join("c_" + k for k in _RATIOS)}) as (values {_PATH}),
x as (select m.*, (select coalesce(min(i), {len(_Q.PATH)}) from path where {" or ".join(f"m.{k} > c_{k}" for k in _RATIOS)}) as level from m),
good as (select * from x where not base_failed and doc_id in (select doc_id from labels group by doc_id having max(quality) = 1)),
k as (select stratum, i, count(*) as n, count(*) filter (where level <= i) as k from good cross join path group by 1, 2),
tail as (select stratum, i, case when k > n * {_Q.RISK!r} then 1 else (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - case when n = j then 0 else lgamma(n - j + 1) end
  + j * ln({_Q.RISK!r}) + (n - j) * ln({1 - _Q.RISK!r}))) from (select unnest(range(0, k + 1)) as j)) end as p from k),
best as (select stratum, max(i) as i from tail where p <= {_Q.CONFIDENCE!r} / (select count(distinct stratum) from good) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x.stratum, {", ".join(_RATIOS)},
  not base_failed and level > coalesce(best.i, -1) as kept from x left join best using (stratum)"""

_DRAWS = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
_FILL_IN_MIDDLE = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select doc_id, t, u, len(u)::bigint as n, {_DRAWS} from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from x),
p as (select *, array_to_string(u[1:i], '') as pre, array_to_string(u[i + 1:j], '') as mid, array_to_string(u[j + 1:n], '') as suf from c)
select doc_id, n, form, case when form != 'plain' then length(pre)::bigint end as prefix_chars, case when form != 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p"""

#: The other operators are beyond SQL (learned models, alignment, Feistel networks, parsing, a tokenizer); tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_near_dedup": _NEAR_DEDUP, "op8_quality_rules": _QUALITY_RULES, "op11_fill_in_middle": _FILL_IN_MIDDLE}
