"""Registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigmill.llm import alignment, embedding_dedup, graph_search, licenses, line_dedup, merkle, mixing, packing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup
from sigmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_packing": over("documents", packing.document_pieces),
        "op2_mixing": over("documents", mixing.document_mix),
        "op3_quality_classifier": lambda spark, d: quality_classifier.classify(table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_suffix_dedup": over("documents", suffix_dedup.document_repeats),
        "op5_line_dedup": over("documents", line_dedup.document_lines),
        "op6_sharding": over("documents", sharding.document_shards),
        "op7_licenses": over("documents", licenses.document_licenses),
        "op8_simhash": over("documents", simhash.document_components),
        "op10_embedding_dedup": over("embeddings", embedding_dedup.near_vectors),
        "op9_quality_rules": over("documents", quality_rules.document_rules),
        "op11_alignment": over("documents", alignment.document_alignment),
        "op12_graph_search": over("embeddings", graph_search.document_neighbours),
        "op13_merkle": over("documents", merkle.document_proofs),
    }


#: Words of a text, in DuckDB's SQL; white space is space and tab to carriage return.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _draw(level: int, child: str) -> str:
    """-ln(u) of a child at a level of the tree, u from the first 12 hex digits."""
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::varchar, '~') || ':{level}:' || {child}), 1, 12))::bigint + 0.5) / 281474976710656.0)"


def _descent(shards: int, name: str) -> str:
    """Shard of every row: best region, then best rack in it, then best shard in that."""
    nodes = f"(select s, s // 4 as k, s // 8 as r from range({shards}) t(s))"
    return f"""
{name}_r as (select doc_id, row_id, arg_min(r, d) as r from (
  select doc_id, row_id, r, {_draw(0, "r")} / w as d from base, (select r, count(*)::double as w from {nodes} group by r)) group by all),
{name}_k as (select doc_id, row_id, arg_min(k, d) as k from (
  select doc_id, row_id, k, {_draw(1, "k")} / w as d from {name}_r join (select r, k, count(*)::double as w from {nodes} group by r, k) using (r)) group by all),
{name}_s as (select doc_id, row_id, arg_min(s, d) as shard from (
  select doc_id, row_id, s, {_draw(2, "s")} / 1.0 as d from {name}_k join {nodes} using (k)) group by all)"""


def _licenses() -> str:
    """Both readings, then one step for each sequence rule: if it holds, note the licence and take its sentences away."""
    L = licenses
    q = lambda x: "'" + x.replace("'", "''") + "'"
    table_of = lambda d: ", ".join(f"({q(k)}, {q(v)})" for k, v in d.items())
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(L.SEQUENCES, 1):
        pattern, rest = "(.*?)".join(f" {i} " for i in ids), "".join(rf"\{n + 1}" for n in range(len(ids) - 1))
        held = f"regexp_matches(rest, {q(pattern)})"
        steps.append(f"r{k} as (select doc_id, row_id, ids, case when {held} then list_append(found, {q(name)}) else found end as found, case when {held} then regexp_replace(rest, {q(pattern)}, {q(rest)}, 'g') else rest end as rest from {last})")
        last = f"r{k}"
    bare = f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), {q('(?m)' + L.MARKS)}, '', 'g'), {q('(?m)' + L.END_MARKS)}, '', 'g'), {q(L.TAG)}, 'SPDX-License-Identifier ', 'gi')"
    read = lambda ends: f"""
  (select row_id, list(id order by i) filter (where id is not null) as ids from (select row_id, i, coalesce(known.id, names.id) as id from
    (select row_id, i, trim(regexp_replace(regexp_replace(lower(s), {q(L.BRACKETS)}, ' ', 'g'), {q(L.OTHER)}, ' ', 'g')) as s from
      (select row_id, unnest(parts) as s, generate_subscripts(parts, 1) as i from (select row_id, regexp_split_to_array(t, {q(ends)}) as parts from d))) e
    left join known using (s) left join names on known.id is null and regexp_full_match(e.s, {q(L.NOTICE)}) and names.n = regexp_extract(e.s, {q("^" + L.NOTICE + "$")}, 1)) group by row_id)"""  # noqa: E731
    return rf"""
with known(s, id) as (values {table_of(L.known())}), names(n, id) as (values {table_of(L.names())}), single(id, name) as (values {table_of(L.alone())}),
d as (select doc_id, row_number() over () as row_id, {bare} as t from documents),
j as {read(L.ENDS[0])}, l as {read(L.ENDS[1])},
h as (select doc_id, row_id, coalesce(j.ids, []::varchar[]) || list_filter(coalesce(l.ids, []::varchar[]), lambda x: not list_contains(coalesce(j.ids, []::varchar[]), x)) as ids from d left join j using (row_id) left join l using (row_id)),
r0 as (select doc_id, row_id, ids, []::varchar[] as found, ' ' || array_to_string(ids, '  ') || ' ' as rest from h),
{", ".join(steps)},
s as (select row_id, list(name) as more from (select row_id, unnest(regexp_extract_all(rest, '[^ ]+')) as id from {last}) join single using (id) group by row_id)
select doc_id, len(ids)::bigint as n_sentences, array_to_string(ids, ',') as sentence_ids, array_to_string(list_sort(list_distinct(found || coalesce(more, []::varchar[]))), ',') as licenses from {last} left join s using (row_id)"""


def _merkle() -> str:
    """Levels one after another, siblings by level, then each way folded from its leaf to the root."""
    told = lambda v: f"coalesce(octet_length(encode({v}::varchar))::varchar || ':' || {v}::varchar, '-')"
    leaf = lambda n: f"sha256({' || '.join(told(v) for v in ('doc_id', 'source', 'lang', n, 'text'))})"
    tree = lambda name, base: f"""
{name}(g, l, i, h, n) as (select g, 0, i, h, n from {base} union all
  select g, l + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from {name} where n > 1 group by g, l, i // 2, n)"""  # noqa: E731
    steps = lambda name, base: f"""
{name} as (select g, i, list(s order by l) filter (where s is not null) as p from (select b.g, b.i, t.l,
    case when t.n > 1 then case when o.h is null then '=' when o.i < t.i then '<' || o.h else '>' || o.h end end as s
  from {base} b join {base}_t t on t.g = b.g and t.i = b.i >> t.l left join {base}_t o on o.g = t.g and o.l = t.l and o.i = xor(t.i, 1)) group by g, i)"""  # noqa: E731
    return f"""
with recursive d as (select *, {leaf("n_chars")} as leaf, {leaf("(n_chars + 1)")} as odd, row_number() over (order by lang nulls first, doc_id nulls first) as r, coalesce(doc_id::varchar, '') as k from documents),
langs as (select lang, row_number() over (order by lang nulls first) - 1 as g, count(*) as n from d group by lang),
bits(v0, v, b) as (select n, n::bigint, 0 from range(256) x(n) union all select v0, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, b + 1 from bits where b < 8),
tab as (select list(v order by v0) as tab from bits where b = 8),
a as (select d.*, langs.g, langs.n, row_number() over (partition by langs.g order by doc_id nulls first, leaf) - 1 as i, leaf as h,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda s, c: xor(s >> 8, tab[xor(s, c) % 256 + 1])), 4294967295) as crc from d join langs on d.lang is not distinct from langs.lang, tab),
{tree("a_t", "a")},{steps("low", "a")},
b as (select 0 as g, g as i, h, count(*) over () as n from a_t where n = 1),
{tree("b_t", "b")},{steps("high", "b")},
p as (select a.*, b.h as subroot, root.h as root, coalesce(low.p, []::varchar[]) || coalesce(high.p, []::varchar[]) as p from a join low on low.g = a.g and low.i = a.i join b on b.i = a.g join high on high.i = a.g, (select h from b_t where n = 1) root),
f as (select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s[2:]), '')) as proof_sha256,
  list_reduce(list_prepend(case when doc_id is not null and crc % 7 = 0 then coalesce(odd, leaf) else leaf end, p), lambda x, s: sha256(case when s[1] = '<' then s[2:] || x else x || s[2:] end)) as folded_root from p)
select *, folded_root = root as verified from f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_merkle": _merkle(),
        "op2_mixing": rf"""
with d as (select doc_id, source, len({WORDS})::bigint as size, md5('42:' || coalesce(doc_id::varchar, '~')) as h from documents),
s as (select source, sum(size)::bigint as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source),
f as (select *, source_size * 2.0::double as cap, 1.5::double * sum(source_size) over () as pool, sum(w) over () as all_w from s),
g as (select *, (pool - (sum(cap) over o - cap)) / (all_w - (sum(w) over o - w)) as level from f
      window o as (order by cap / w, source nulls last rows unbounded preceding)),
t as (select source, source_size, case when cap / w <= level then cap else w * (select max(level) from g where cap / w > level) end as target from g),
u as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
p as (select d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size as need,
        sum(d.size) over (partition by d.source order by h, d.doc_id, d.size rows unbounded preceding) - d.size / 2.0 as mid
      from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target, ((whole + case when need > 0 and mid <= need then 1 else 0 end) * size)::bigint as taken from p""",
        "op7_licenses": _licenses(),
        "op5_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
lines as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as j from d),
worded as (select doc_id, j, line, lead(j) over o as j1, lead(line) over o as l1, lead(j, 2) over o as j2, lead(line, 2) over o as l2
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') window o as (partition by doc_id order by j)),
later as (select doc_id, j, j1, j2 from worded where l2 is not null qualify row_number() over (partition by line, l1, l2 order by doc_id, j) > 1),
gone as (select doc_id, j from later union select doc_id, j1 from later union select doc_id, j2 from later),
g as (select doc_id, count(*) as n from gone group by doc_id),
k as (select doc_id, string_agg(line, chr(10) order by j) as kept from lines anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(a)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g using (doc_id) left join k using (doc_id)""",
        "op6_sharding": rf"""
with recursive bits(n, v, k) as (select n, n::bigint, 0 from range(256) r(n) union all
  select n, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
tab as (select list(v order by n) as tab from bits where k = 8),
base as (select doc_id, row_number() over () as row_id, octet_length(encode(coalesce(text, '')))::bigint + 16 as size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
    lambda a, c: xor(a >> 8, tab[xor(a, c) % 256 + 1])), 4294967295) as text_crc32 from documents, tab),
{_descent(40, "a")},
{_descent(41, "b")}
select doc_id, size, text_crc32, 'key' as law, a_s.shard::int as shard,
  (row_number() over (partition by a_s.shard order by md5(coalesce(doc_id::varchar, '~') || ':slot'), doc_id, size) - 1)::bigint as slot, b_s.shard::int as grown_shard
from base join a_s using (doc_id, row_id) join b_s using (doc_id, row_id)""",
        "op9_quality_rules": rf"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as text, {WORDS} as w from documents),
lines as (select r, count(*) as n, count(distinct line) as k, count(*) filter (where regexp_matches(line, '^[\x20\x09-\x0D]*[-*•‣]')) as bullets,
          count(*) filter (where regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) as ellipses
          from (select r, unnest(string_split(text, chr(10))) as line from d)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
grams as (select r, i, list_slice(w, i, i + 7)::varchar as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
cover as (select r, count(*) as n from (select distinct r, i + k as at from rep, range(8) t(k)) group by r),
m as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(lines.n - lines.k, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words,
        5 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 2 * len(w) or (lines.n >= 3 and (10 * bullets > 9 * lines.n or 10 * ellipses > 3 * lines.n)) as odd
      from d left join lines using (r) left join cover using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select * exclude (odd), not (base_failed or coalesce(odd, false) or 5 * n_symbols > n_words or (n_dup_lines >= 3 and 20 * n_dup_lines > n_words)
  or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept from b""",
    }
