"""The operators' queries in DuckDB's SQL, where it can express them on whole tables."""

from __future__ import annotations

from . import common, mixing, quality as Q, url_filter as U

LOWER = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"
WORD = "[^\\x20\\x09-\\x0D]+"


def host(c: str) -> str:
    return f"translate(coalesce(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), ''), '{common.UPPER}', '{common.LOWER}')"


def rules() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in U.RULES)
    return f"rules(v, h, p) as (values {rows})"


def rank(name: str, edges: str, seed: str) -> str:
    """CTEs of the propagation's rounds; the last is ``name``."""
    out = [f"{name}_w as (select src, dst, links / sum(links) over (partition by src) as w from {edges})", f"{name}_0 as (select host, {seed} / n / (select sum({seed} / n) from hosts) as score from hosts where {seed} > 0)"]
    for k in range(U.ROUNDS):
        out.append(
            f"{name}_{k + 1} as materialized (select host, sum(part) as score from (select w.dst as host, s.score * w.w * {U.DAMPING}::double as part from {name}_{k} s join {name}_w w on s.host = w.src union all select host, score * {1 - U.DAMPING}::double from {name}_0) group by host)"
        )
    return ", ".join(out)


HREF, PATHS = (x.replace("'", "''") for x in (U.ABSOLUTE, U.LOCAL))

OP2 = f"""with {rules()},
pg as (select page_id, {host('url')} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html, row_number() over () as row_no from pages),
fit as (select row_no, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as ruled from pg join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by row_no),
x as (select pg.*, rule, ruled from pg left join fit using (row_no)),
hosts as (select host, count(*)::double as n, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from x where host <> '' group by host),
l as (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '{HREF}', 1)) as link from pg),
e as (select src, {host("case when starts_with(link, '//') then 'x:' || link else link end")} as dst from l),
fwd as (select src, dst, count(*)::double as links from e where src <> dst and src <> '' and dst <> '' group by src, dst),
lp as (select src, link as dst, count(*)::double as links from (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '{PATHS}', 1)) as link from pg where host <> '') group by src, link),
lq as (select src, dst, links from lp union all select dst, src, links from lp),
fwd2 as (select src, dst, links from fwd union all select src, dst, links from lq), rev2 as (select dst as src, src as dst, links from fwd union all select src, dst, links from lq),
{rank('t', 'fwd2', 'good')}, {rank('d', 'rev2', 'bad')},
sc as (select coalesce(a.host, b.host) as host, coalesce(a.score, 0) as trust, coalesce(b.score, 0) as distrust from t_{U.ROUNDS} a full join d_{U.ROUNDS} b on a.host = b.host)
select page_id, x.host, path, rule, coalesce(ruled, case when distrust > {U.RATIO} * trust and distrust * (select count(*) from hosts) >= {U.FLOOR} then 'block' else 'allow' end) as verdict from x left join sc on x.host = sc.host"""

OP3 = f"""with d as (select doc_id, {LOWER} as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256 from d window w as (partition by t)"""



def inverse(m: str, knots) -> str:
    """The time at which a schedule's cumulative weight reaches ``m``."""
    out = ""
    for t0, length, w0, slope, before in mixing.segments(knots):
        rest = f"greatest({m} - {before!r}::double, 0)"
        step = f"{rest} / {w0!r}::double" if not slope else f"case when {rest} = 0 then 0 else 2 * {rest} / ({w0!r}::double + sqrt(greatest({w0 * w0!r}::double + {2 * slope!r}::double * {rest}, 0))) end"
        here = f"{t0!r}::double + least({step}, {length!r}::double)"
        out += f" when {m} < {before + length * (w0 + slope * length / 2)!r}::double then {here}"
    return f"case{out} else {here} end"


def words_of(k: int) -> str:
    return f"greatest(least(round(target)::bigint - {k} * source_size - before, size), 0)"


def position(k: int) -> str:
    cases = " ".join(f"when {r} then {inverse(f'm{k}', knots)}" for r, knots in enumerate(mixing.SCHEDULES))
    return f"case when w{k} > 0 then round(case rank % {len(mixing.SCHEDULES)} {cases} end, 9) end as position_{k + 1}"


OP6 = f"""with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size, md5(coalesce(doc_id::varchar, '') || 'mix') as o from documents),
a as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from s group by source),
b as (select *, {list(mixing.WEIGHTS)}[(rank % {len(mixing.WEIGHTS)})::int + 1]::double as weight, 3.0::double * source_size as cap, sum(source_size) over () as total from a),
c as (select *, greatest((total - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following), 0) as level from b),
t as (select *, least(cap, coalesce(max(level) filter (level * weight <= cap) over (), 'inf'::double) * weight) as target from c),
p as (select doc_id, size, source_size, rank, target, coalesce(sum(size) over (partition by s.source order by o, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from s join t on s.source is not distinct from t.source),
w as (select *, {', '.join(f'{words_of(k)} as w{k}' for k in range(3))} from p),
m as (select *, {', '.join(f'({k} * source_size + before + w{k}::double / 2) / target as m{k}' for k in range(3))} from w)
select doc_id, size, source_size, round(target, 6) as target, (w0 + w1 + w2)::bigint as taken, {', '.join(position(k) for k in range(3))} from m"""

NGRAMS = " union all ".join(
    f"select rn, (((({' + '.join([f'{n}::hugeint * {257**n}'] + [f'b{k}::bigint * {257 ** (n - 1 - k)}' for k in range(n)])}) * 11400714819323198485::hugeint) % 18446744073709551616::hugeint) // 281474976710656::hugeint)::int as bucket from g where b{n - 1} is not null"
    for n in Q.ORDERS
)

OP4 = f"""with d as (select row_number() over () as rn, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w, doc_id in (select doc_id from labels where quality = 1) as trusted from documents),
win as (select rn, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) as x from d where len(w) >= 8),
twice as (select rn, i from (select *, count(*) over (partition by rn, x) as k from win) where k > 1),
cover as (select rn, count(distinct place) as n_repeat_words from (select rn, unnest(range(i, i + 8)) as place from twice) group by rn),
r as (select rn, doc_id, trusted, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d left join cover using (rn)),
b as (select rn, unnest(regexp_extract_all(hex(encode(t)), '..')) as x, unnest(range(0, octet_length(encode(t)))) as i from d),
n as (select rn, i, ('0x' || x)::int as b0 from b),
g as (select rn, b0, {', '.join(f'lead(b0, {k}) over p as b{k}' for k in range(1, max(Q.ORDERS)))} from n window p as (partition by rn order by i)),
m as (select rn, bucket, count(*) as k from ({NGRAMS}) group by rn, bucket),
c as (select bucket, sum(k)::double as raw, coalesce(sum(k) filter (trusted), 0)::double as target from m join d using (rn) group by bucket),
o as (select sum(raw) + {Q.SMOOTH * Q.BUCKETS} as raws, sum(target) + {Q.SMOOTH * Q.BUCKETS} as targets from c),
v as (select bucket, ln((target + {Q.SMOOTH}) / targets) - ln((raw + {Q.SMOOTH}) / raws) as weight from c, o),
s as (select rn, sum(k * weight) / (sum(k) + {Q.SHRINK}) as llr from m join v using (bucket) group by rn),
a as (select r.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(llr, 0.0)::double as llr from r left join s using (rn)),
z as (select floor(llr * {Q.GRID}) as g, row_number() over (order by floor(llr * {Q.GRID})) as place, count(*) over () as total from a where trusted and not base_failed),
th as (select min(g) / {Q.GRID} as threshold from z where place > {Q.LOSE} * total)
select doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, n_repeat_words, base_failed, round(llr, 9) as llr, not base_failed and llr >= coalesce(threshold, llr) as kept from a, th"""

OP8 = f"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as x from w),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.other = e.a),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id from m left join n using (doc_id)"""

OP11 = f"""with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
f as (select doc_id, part, concat(case when len(w) < 50 then 'A' end, case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' end, case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' end,
 case when regexp_matches(t, '[#$%&*|]') then 'D' end, case when doc_id > min(doc_id) over (partition by t) then 'E' end) as fails from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by part, fails),
s as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from s a, s b, s c, s d, s e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
c as (select part, filter_order, k, filter_order[k] as letter from (select distinct part from m), o, (select unnest(range(1, 6)) as k)),
g as (select part, filter_order, n, good, toxic, fails, list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i]))) as gone from m, o),
z as (select c.part, c.filter_order, c.k, c.letter, coalesce(sum(n) filter (gone is null or gone > k), 0)::bigint as kept, coalesce(sum(n) filter (gone = k), 0)::bigint as removed, coalesce(sum(n) filter (gone < k and contains(fails, letter)), 0)::bigint as redundant,
 coalesce(sum(n) filter (fails = letter), 0)::bigint as unique_fails, coalesce(sum(good) filter (gone = k), 0)::bigint as good_lost, coalesce(sum(toxic) filter (gone = k), 0)::bigint as toxic_lost from c join g using (part, filter_order) group by all)
select part, filter_order, k::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from z"""


def op12(k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64) -> str:
    """Every round as CTEs: all distances, the nearest, floored means."""
    out = [
        f"v as (select row_number() over () as rn, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width})",
        f"c_0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as c, v as centre from v qualify c < {k})",
    ]
    for r in range(rounds + 1):
        out.append(f"d_{r} as (select rn, c, list_sum(list_transform(list_zip(v, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c_{r})")
        out.append(f"a_{r} as materialized (select rn, arg_min(c, d * {k} + c) as c, min(d) as d from d_{r} group by rn)")
        if r < rounds:
            out.append(f"p_{r} as (select c, i, sum(x)::hugeint as s, count(*) as n from (select c, unnest(v) as x, unnest(range(1, {width + 1})) as i from a_{r} join v using (rn)) group by c, i)")
            out.append(f"m_{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as centre from p_{r} group by c)")
            out.append(f"c_{r + 1} as materialized (select c, coalesce(m.centre, o.centre) as centre from c_{r} o left join m_{r} m using (c))")
    return f"""with {', '.join(out)} select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(centre, ',')) as centroid_sha256 from a_{rounds} join v using (rn) join c_{rounds} using (c)"""


SQL = {"op2_url_link_graph": OP2, "op3_extendible_dedup": OP3, "op4_ngram_ratio": OP4, "op6_curriculum_mix": OP6, "op8_count_vector_join": OP8, "op11_first_failure_audit": OP11, "op12_exponion_clusters": op12()}
