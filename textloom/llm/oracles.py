"""DuckDB SQL for the queries of this package that SQL can express over whole tables."""

from __future__ import annotations

from textloom.llm import line_dedup, mixing, quality_rules, topk_search, url_filter
from textloom.llm.quality_rules import BINS, CAPITALS, CORE, CUTOFF, DIMS, FALL, FLOOR, HALF_FACTOR, MIN_GROUP, PAIRS, Q975, REWEIGHT_FACTOR, SIGNS, STARTS, SYMBOLS
from textloom.llm.quality_rules import WORDS as SPREAD_WORDS

#: Concentration steps that the SQL of op2 is written out for; further ones change nothing once all starts have converged.
STEPS = 14

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"

TOPK = f"""
with v as (select distinct vec_id as id, list_transform(embedding, lambda x: floor({topk_search.SCALE} * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.id as query_id, c.id as vec_id, max(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])))::bigint as score
  from v q join v c on q.id <> c.id and len(q.v) = len(c.v) where q.id % {topk_search.EVERY} = 0 group by all),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from p)
select * from r where rank <= {topk_search.K}"""


def _mixing() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
with d as (select doc_id, source, len({WORDS})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, ([{weights}])[((place - 1) % {len(mixing.WEIGHTS)} + 1)::int]::double as weight, ({mixing.MOST} * source_size)::double as cap,
  {mixing.SHARE}::double * (sum(source_size) over ())::double as total from s),
f as (select *, total - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double) as left_over,
  sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as weight_from from w),
g as (select *, cap * weight_from <= weight * left_over as stops from f),
t as (select source, source_size, case when stops then cap else least(cap, weight * ((total - sum(case when stops then cap else 0.0::double end) over ())
  / nullif(sum(case when stops then 0.0::double else weight end) over (), 0))) end as target from g),
r as (select d.doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{mixing.SEED}'), 1, 13))::bigint::double / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken from r"""


LINES = f"""
with l as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
pages as (select distinct source, md5(text) as page, lines from l where text is not null),
totals as (select source, count(*) as pages from (select distinct source, page from pages) group by source),
marked as (select distinct source, page, unnest(list_filter(lines, lambda x: regexp_matches(x, '{WORD}'))) as line from pages),
bad as (select m.source, list(line) as bad from (select source, line, count(*) as n from marked group by all) m join totals t on m.source is not distinct from t.source
  where n >= {line_dedup.MIN_PAGES} and n > {line_dedup.RATIO}::double * pages group by m.source),
k as (select doc_id, lines, list_filter(lines, lambda x: not (regexp_matches(x, '{WORD}') and list_contains(coalesce(bad, []), x))) as kept
  from l left join bad on l.source is not distinct from bad.source)
select doc_id, coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '{WORD}'))), 0)::bigint as n_lines, coalesce(len(lines) - len(kept), 0)::bigint as n_dropped,
  sha256(array_to_string(kept, chr(10))) as kept_sha256 from k"""


def _rules() -> str:
    rows = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in url_filter.RULES)
    hosts = ", ".join(f"('{h}')" for h in url_filter.BLOCKED)
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with p as (select page_id, row_number() over () as n, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{upper}', '{upper.lower()}') as host,
  coalesce(regexp_extract(url, '{pattern}', 2), '') as path from pages),
r(rule, name, start, verdict) as (values {rows}), b(name) as (values {hosts}),
fit as (select n, rule, verdict, row_number() over (partition by n order by length(rule) desc, instr(rule, '/') desc) as k from p join r
  on (p.host = r.name or ends_with(p.host, '.' || r.name)) and starts_with(p.path, r.start))
select page_id, host, path, rule, coalesce(verdict, case when exists (select 1 from b where p.host = b.name or ends_with(p.host, '.' || b.name)) then 'block' else 'allow' end) as verdict
from p left join fit on p.n = fit.n and fit.k = 1"""


def _quality() -> str:
    xs, names = ", ".join(f"x{i}" for i in DIMS), "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    parts = [f"""
w as materialized (select row_number() over () as n, doc_id, lang, source, coalesce(text, '') as text, {WORDS} as w from documents),
u as (select n, unnest(w) as x, generate_subscripts(w, 1) as i from w),
v as (select n, i, [x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o, lead(x, 4) over o] as five, lead(x, 4) over o as fifth from u window o as (partition by n order by i)),
twice as (select n, i from (select n, i, count(*) over (partition by n, five) as c from v where fifth is not null) where c > 1),
again as (select n, sum(reach) as n_repeat_words from (select n, least(5, coalesce(lead(i) over (partition by n order by i) - i, 5)) as reach from twice) group by n),
c as (select w.n, doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::bigint as word_chars,
  {", ".join(f"(length(text) - length(translate(text, '{x}', '')))::bigint as {n}" for n, x in (("n_symbols", SYMBOLS), ("n_signs", SIGNS), ("n_capitals", CAPITALS)))},
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join again on w.n = again.n),
f as materialized (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  round(1000 * ln(greatest(word_chars, 1)::double / greatest(n_words, 1)))::bigint as f0,
  round(1000 * ln(1 + 100 * n_signs::double / greatest(word_chars, 1)))::bigint as f1,
  round(1000 * ln(1 + 100 * n_capitals::double / greatest(word_chars, 1)))::bigint as f2 from c),
middle as (select lang, {", ".join(f"quantile_disc(f{i}, 0.5) as c{i}" for i in DIMS)} from f where not base_failed group by lang),
t as materialized (select f.*, {", ".join(f"round((f{i} - c{i}) * sqrt(n_words::double * {SPREAD_WORDS} / (n_words::double + {SPREAD_WORDS})) / 10)::bigint as x{i}" for i in DIMS)}
  from f left join middle on f.lang is not distinct from middle.lang),
g0 as (select lang, source, count(*) as n from t where not base_failed group by all),
g1 as (select *, sum(n) over (partition by lang) as in_lang, min(n) over (partition by lang) as least from g0),
g2 as (select *, case when n >= {MIN_GROUP} then coalesce('=' || lang, '') || chr(1) || coalesce('=' || source, '')
  when in_lang >= {MIN_GROUP} then coalesce('=' || lang, '') || chr(2) else chr(3) end as g from g1),
groups as materialized (select lang, source, g from g2),
rows_ as materialized (select distinct g, {xs} from (
  select g, {xs} from t join groups k on t.lang is not distinct from k.lang and t.source is not distinct from k.source where not base_failed and right(g, 1) not in (chr(2), chr(3))
  union all select g, {xs} from t join (select distinct lang, g from g2 where right(g, 1) = chr(2)) k on t.lang is not distinct from k.lang where not base_failed
  union all select chr(3), {xs} from t where not base_failed and exists (select 1 from g2 where g = chr(3))))"""]
    r = [f"greatest(quantile_disc(x{i}, 0.75)::double - quantile_disc(x{i}, 0.25)::double, 1.0::double)" for i in DIMS]
    width = ", ".join((f"1.0::double / ({r[i]} * {r[i]})" if i == j else "0.0::double") + f" as a{i}{j}" for i, j in PAIRS)
    d = [f"(x{i}::double - m{i})" for i in DIMS]
    d2 = " + ".join(f"{d[i]} * {d[j]} * a{i}{j} * {1.0 if i == j else 2.0}::double" for i, j in PAIRS)

    ms, as_ = ", ".join(f"m{i}" for i in DIMS), ", ".join(f"a{i}{j}" for i, j in PAIRS)

    def estimate(name: str, core: str, factor: float, keys: str = "g, start") -> list[str]:
        cov = {(i, j): f"c{min(i, j)}{max(i, j)}" for i in DIMS for j in DIMS}

        def minor(i: int, j: int) -> str:
            (r0, r1), (k0, k1) = [x for x in DIMS if x != i], [x for x in DIMS if x != j]
            return f"({cov[r0, k0]} * {cov[r1, k1]} - {cov[r0, k1]} * {cov[r1, k0]}) * {-1.0 if (i + j) % 2 else 1.0}::double"

        sums = ", ".join([*(f"sum(x{i})::double as s{i}" for i in DIMS), *(f"sum(x{i} * x{j})::double as s{i}{j}" for i, j in PAIRS)])
        means = ", ".join(f"s{i} / n as m{i}" for i in DIMS)
        covs = ", ".join(f"(s{i}{j} / n - m{i} * m{j}) * {factor}::double" + (f" + {float(FLOOR)}::double" if i == j else "") + f" as c{i}{j}" for i, j in PAIRS)
        return [
            f"{name}_s as (select {keys}, count(*)::double as n, {sums} from {core} group by {keys})",
            f"{name}_m as (select *, {means} from {name}_s)",
            f"{name}_c as (select {keys}, {ms}, {covs} from {name}_m)",
            f"{name}_k as (select *, {', '.join(f'{minor(i, j)} as k{i}{j}' for i, j in PAIRS)} from {name}_c)",
            f"{name}_d as (select *, c00 * k00 + c01 * k01 + c02 * k02 as det from {name}_k)",
            f"{name} as materialized (select {keys}, {ms}, {', '.join(f'k{i}{j} / det as a{i}{j}' for i, j in PAIRS)}, det from {name}_d)",
        ]

    begin = " union all ".join(f"select g, {k} as start, {', '.join(f'quantile_disc(x{i}, {q})::double as m{i}' for i in DIMS)}, {width} from rows_ group by g" for k, q in enumerate(STARTS))
    parts += [*estimate("every", "rows_", 1.0, "g"), f"model0 as materialized ({begin} union all select g, {len(STARTS)} as start, {ms}, {as_} from every)"]
    for k in range(STEPS):
        parts += [
            f"dist{k} as materialized (select g, start, {xs}, floor(sqrt(greatest({d2}, 0.0::double)) * {BINS})::bigint as bin from rows_ join model{k} using (g))",
            f"""edge{k} as (select g, start, min(bin) as edge from (select g, start, bin, sum(count(*)) over (partition by g, start order by bin) as upto,
  sum(count(*)) over (partition by g, start) as everyone from dist{k} group by g, start, bin) where upto >= ceil({CORE}::double * everyone) group by g, start)""",
            f"core{k} as materialized (select dist{k}.* from dist{k} join edge{k} using (g, start) where bin <= edge)",
            *estimate(f"step{k}", f"core{k}", HALF_FACTOR),
            f"model{k + 1} as materialized (select n.* from step{k} n)" if not k else
            f"model{k + 1} as materialized (select g, start, {', '.join(f'case when n.det < o.det * (1 - {FALL}::double) then n.{c} else o.{c} end as {c}' for c in f'{ms}, {as_}, det'.split(', '))} from model{k} o join step{k} n using (g, start))",
        ]
    parts += [
        f"best as materialized (select * from model{STEPS} qualify row_number() over (partition by g order by det, start) = 1)",
        f"near as materialized (select * from (select rows_.g, {xs}, {d2} as d2 from rows_ join best using (g)) where d2 <= {Q975}::double)",
        *estimate("final", "near", REWEIGHT_FACTOR, "g"),
        "own as (select lang, source, final.* from groups join final using (g))",
        f"""scored as (select t.*, {d2} as d2 from t left join own on t.lang is not distinct from own.lang and t.source is not distinct from own.source)""",
    ]
    return f"with {', '.join(p.strip() for p in parts)} select doc_id, {names}, base_failed, not base_failed and coalesce(d2, 0) <= {CUTOFF}::double as kept from scored"


NEAR = rf"""
with recursive w as materialized (select row_number() over () as n, doc_id, list_transform({WORDS},
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
s as materialized (select distinct n, array_to_string(case when len(w) < 5 then w else w[i : i + 4] end, ' ') as s
  from (select n, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
sizes as materialized (select n, count(*) as size from s group by n),
both_ as (select a.n as x, b.n as y, count(*) as c from s a join s b on a.s = b.s and a.n < b.n group by all),
link as materialized (select x, y from both_ join sizes p on p.n = x join sizes q on q.n = y where 100 * c >= 75 * (p.size + q.size - c)),
arc as materialized (select x, y from link union all select y, x from link),
reach as (select n as x, n as y from w union select reach.x, arc.y from reach join arc on reach.y = arc.x),
least_ as (select reach.x as n, min(doc_id) as component_id from reach join w on w.n = reach.y group by 1)
select doc_id, coalesce(size, 0)::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept
from w left join sizes using (n) join least_ using (n)"""

SUBSTRING = f"""
with w as materialized (select row_number() over () as n, doc_id, {WORDS} as w from documents),
s as materialized (select n, doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) as s from (select n, doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
first as (select s, min(doc_id) as first from s group by s),
gone as materialized (select n, i from s join first using (s) where doc_id > first),
places as (select distinct n, unnest(range(i, i + 13)) as i from gone),
cut as (select n, list(i) as gone_at from places group by n)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone_at), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone_at is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(gone_at, z[2])), lambda z: z[1]) end, ' ')) as kept_sha256
from w left join cut using (n)"""

#: A reflected 32-bit checksum of the decimal digits of ``conv_id``, bit by bit.
_CRC_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)), lambda c, b: {_CRC_STEP}), 4294967295::ubigint)"

TRIE = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null),
c as (select conv_id, count(*) as own, ({_CRC} % 9)::bigint as h, conv_id - conv_id % 5 as base from t group by conv_id),
r as (select conv_id, 0 as side, place, t.role, t.text from c join (select conv_id as base, place, role, text from t) t using (base) where place <= h
  union all select conv_id, 1 as side, place, role, text from t join c using (conv_id) where place > h),
s as materialized (select conv_id, coalesce(list(struct_pack(role := role, text := text) order by side, place) filter (where role is not null), []) as s
  from c left join r using (conv_id) group by conv_id),
m as materialized (select conv_id, d as depth, md5(to_json(s[1:d])::varchar) as k, md5(to_json(s[1:d - 1])::varchar) as up, coalesce(strlen(s[d].text), 0) as size, d = len(s) as ends
  from (select conv_id, s, unnest(range(len(s) + 1)) as d from s)),
n as materialized (select depth, k, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from m group by depth, k),
kids as (select depth - 1 as depth, up as k, count(*) as n_children from n where depth > 0 group by all),
f as materialized (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (depth, k)),
below as (select v.depth, v.k, count(*) filter (where u.n_children = 0) as n_leaves, sum(case when u.depth = 0 then 0 else (u.n_convs - 1) * u.size end)::bigint as saved_tokens
  from f u join m v on v.conv_id = u.conv_id and v.depth <= u.depth group by all)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from f join below using (depth, k) left join n p on p.depth = f.depth - 1 and p.k = f.up"""

ORACLES: dict[str, str] = {
    "op1_topk_search": TOPK,
    "op2_quality_rules": _quality(),
    "op5_mixing": _mixing(),
    "op6_line_dedup": LINES,
    "op7_url_filter": _rules(),
    "op8_near_dedup": NEAR,
    "op10_substring_dedup": SUBSTRING,
    "op11_prefix_trie": TRIE,
}
