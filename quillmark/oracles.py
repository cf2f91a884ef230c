"""The queries in DuckDB's SQL."""

from __future__ import annotations

from .functions.numbers import AND, FOLD_FROM, FOLD_TO, table
from .operators.entities import CATEGORIES
from .pairs import CAPITALS, FILLER, LEAST


def tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def corrupt(c: str, drop: int | None = 7, swap: int | None = 11, double: int | None = None) -> str:
    cases = [f"when (i - 1) % {n} = {k} then {x}" for n, k, x in ((drop, 3, "[]"), (swap, 5, f"['{FILLER}']"), (double, 6, "[w, w]")) if n]
    return f"flatten(list_transform({c}, lambda w, i: case {' '.join(cases)} else [w] end))" if cases else c


def distance(r: str, h: str) -> str:
    """Words that ``h`` has less than ``r``, or more, and its fillers: no alignment can do with fewer edits where words are only
    left out or replaced by a word that ``r`` doesn't have, or only doubled."""
    return f"(abs(len({r}) - len({h})) + len(list_filter({h}, lambda x: x = '{FILLER}')))"


PAIRS = f"""p0 as (select doc_id, lang, source, {tok('text')} as r from documents),
p1 as (select *, {corrupt('r')} as h from p0),
pairs as (select *, array_to_string(r, ' ') as ref, array_to_string(h, ' ') as hyp from p1)"""


def rate(d: str, r: str = "r", h: str = "h") -> str:
    return f"case when len({r}) > 0 then {d}::double / len({r}) when len({h}) > 0 then 1.0 else 0.0 end"


RATES = f"""{PAIRS}, rates as (select *, {distance('r', 'h')} as distance from pairs), rated as (select *, {rate('distance')} as wer from rates)"""


#: Number words that mean a number by themselves.
ALONE = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, (kind, n) in table().items() if kind < AND) + "}"


def norm(c: str) -> str:
    """Number words of the prose as digits, word by word: no two that make one number follow each other there."""
    return f"array_to_string(list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: coalesce({ALONE}[translate(lower(w), '{FOLD_FROM}', '{FOLD_TO}')], w)), '')"


def said(side: str) -> str:
    """A pair's text as digits: what the speaker adds in words is known."""
    item = "doc_id" if side == "ref" else "doc_id + (doc_id % 3 = 0)::int"
    return f"({norm(side)} || ' total ' || length(ref) || ' item ' || ({item}))"


def nums(side: str) -> str:
    return f"regexp_extract_all({said(side)}, '[0-9]+(?:\\.[0-9]+)?')"


def total(c: str) -> str:
    return f"coalesce(list_sum({c}), 0)"


def low(c: str) -> str:
    return f"list_transform({c}, lambda x: lower(x))"


def jac(r: str, h: str) -> str:
    return f"len(list_intersect({r}, {h}))::double / greatest(len(list_distinct(list_concat({r}, {h}))), 1)"


JACCARD_CI = f"case when len(r) > 0 and len(h) > 0 then {jac(low('r'), low('h'))} else 0.0 end"
COUNT = "len(regexp_extract_all({c}, '{p}'))"


def share(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{p}'))::double / greatest(length({c}), 1)"


NUMBER_ACC = f"case when len(list_distinct({nums('ref')})) > 0 then len(list_intersect(list_distinct({nums('ref')}), {nums('hyp')}))::double / len(list_distinct({nums('ref')})) else 1.0 end"
ADJ = "case when len({w}) > 0 then {s}::double * 5 / len({w}) else 0.0 end"


def adjacent(w: str) -> str:
    same = f"coalesce(list_sum(list_transform(range(1, len({w})), lambda i: (lower({w}[i]) = lower({w}[i + 1]))::int)), 0)"
    return ADJ.format(w=w, s=same)


def diff(a: str, b: str) -> str:
    """Pairs of unequal letters; the longer text's rest is paired with null."""
    return f"coalesce(list_sum(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda x: (x[1] <> x[2])::int)), 0)"


def prepare(t: str) -> str:
    """Text with its numbers as digits, as error rates are worked out on."""
    for what, to in (("(?m)^[\\p{L}\\p{N}_]+:\\s*", ""), ("\\(\\p{Nd}+:\\p{Nd}+\\.?\\p{Nd}*-\\p{Nd}+:\\p{Nd}+\\.?\\p{Nd}*\\)", ""), ("\\s+", " "), ("^\\s+|\\s+$", "")):
        t = f"regexp_replace({t}, '{what}', '{to}', 'g')"
    return f"lower({t})"


SYL = "greatest(len(regexp_extract_all(lower({c}), '[aeiou]+')) - (case when lower({c}) like '%e' then 1 else 0 end), 1)"
FRAGMENTS = "list_filter(list_transform(regexp_extract_all(text, '[।|.!?]+|[^।|.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
CLEAN = "lower(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"
NOUN = "\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b"



def ascii_only(c: str) -> str:
    """Every other character as an underscore, which is a word character to both engines."""
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '_', 'g')"


TURNS = f"""t0 as (select conv_id, turn, role as speaker, text as transcript, len({tok('text')}) as n from conversations),
turns as (select conv_id, turn, speaker, transcript, sum(n) over w * 0.4 as end_ts, (sum(n) over w - n) * 0.4 as start_ts from t0 window w as (partition by conv_id order by turn rows unbounded preceding))"""
SWAP = "case when turn % 5 = 0 then case when role = 'user' then 'assistant' else 'user' end else role end"
LABELLED = f"""lab as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as ref, string_agg({SWAP} || ': ' || text, chr(10) order by turn) as hyp from conversations group by conv_id)"""


def segs(name: str, src: str, key: str, c: str) -> str:
    return f"""{name}0 as (select {key}, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select {key}, string_split(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), chr(10)) as l from {src})),
{name}1 as (select *, sum((instr(line, ':') > 0)::int) over (partition by {key} order by line_no rows unbounded preceding) as seg from {name}0),
{name} as (select {key}, seg - 1 as pos, max(case when instr(line, ':') > 0 then regexp_replace(substring(line, 1, instr(line, ':') - 1), '^\\s+|\\s+$', '', 'g') end) as speaker,
 string_agg(case when instr(line, ':') > 0 then regexp_replace(substring(line, instr(line, ':') + 1), '^\\s+|\\s+$', '', 'g') else line end, ' ' order by line_no) as text from {name}1 where seg > 0 group by {key}, seg)"""


NAME = "[\\p{L}\\p{M}\\p{N}_]+"


def runs(c: str, pattern: str = NOUN) -> str:
    return f"unnest(list_transform(regexp_extract_all({ascii_only(c)}, '{pattern}'), lambda x: array_to_string(regexp_extract_all(lower(x), '{NAME}'), ' ')))"


ALLOWED = "case when least(length(a.canon), length(b.canon)) < 5 then 0 when least(length(a.canon), length(b.canon)) < 9 then 1 else 2 end"
ENTITIES = f"""known as (select name, {list(CATEGORIES)}[(length(name) % 5)::int + 1] as category, string_split(name, ' ') as nw from (select doc_id, {runs('text', CAPITALS)} as name from documents) where length(name) >= {LEAST} group by name having count(distinct doc_id) >= 2),
side as (select doc_id, 'ref' as side, ref as t from pairs union all select doc_id, 'hyp', hyp from pairs),
wrd as (select doc_id, side, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from (select doc_id, side, regexp_extract_all(lower(t), '{NAME}') as w from side)),
nwd as (select name, len(nw) as n, unnest(nw) as x, unnest(range(0, len(nw))) as k from known),
hits as (select doc_id, side, p - k as start, name, n from wrd join nwd using (x) group by all having count(*) = n),
cov as (select *, max(start + n) over (partition by doc_id, side order by start, n desc rows between unbounded preceding and 1 preceding) as upto from hits),
own as (select distinct doc_id, side, {runs('t')} as name from side),
ent as (select distinct doc_id, side, category, name from cov join known using (name) where upto is null or upto < start + n union select doc_id, side, 'PERSON', name from own where name not in (select name from known)),
als as (select case when len(nw) >= 3 then array_to_string(nw[1:2], ' ') else name[1:7] end as alias, min(name) as target from known where len(nw) >= 3 or (len(nw) = 1 and length(name) >= 10) group by 1 having alias not in (select name from known)),
dn as (select side, name, coalesce(target, name) as canon from (select distinct side, name from ent) left join als on name = alias),
same as (select a.name, b.name as other from dn a join dn b on a.side = 'ref' and b.side = 'hyp' where a.canon = b.canon or (case when abs(length(a.canon) - length(b.canon)) <= 2 then levenshtein(a.canon, b.canon) <= {ALLOWED} else false end)),
mt as (select distinct r.doc_id, r.category, r.name from ent r join same s on r.name = s.name join ent h on h.side = 'hyp' and h.doc_id = r.doc_id and h.category = r.category and h.name = s.other where r.side = 'ref'),
cnt as (select e.doc_id, e.category, count(*) as n_ref, count(mt.name) as n_matched from ent e left join mt using (doc_id, category, name) where side = 'ref' group by 1, 2),
e1 as (select doc_id, category, coalesce(n_ref, 0) as n_ref, coalesce(n_matched, 0) as n_matched from (select doc_id, unnest({list(CATEGORIES)}) as category from documents) left join cnt using (doc_id, category))"""
ENTITY = f"{PAIRS}, {ENTITIES}"

PREPARED = f"""{PAIRS}, q0 as (select *, {tok(prepare(said('ref')))} as pr, {tok(prepare(said('hyp')))} as ph from pairs), rates as (select *, {distance('pr', 'ph')} + (doc_id % 3 = 0)::int as distance from q0), rated as (select *, {rate('distance', 'pr', 'ph')} as wer from rates)"""

SCORED = f"""{PREPARED},
{ENTITIES}, e2 as (select doc_id, sum(n_ref) as n, sum(n_matched) as m from e1 group by doc_id),
{segs('sr', 'pairs', 'doc_id', 'ref')}, {segs('sh', 'pairs', 'doc_id', 'hyp')},
sp as (select a.doc_id, avg((lower(a.speaker) = lower(b.speaker))::int) as speaker from sr a join sh b on a.doc_id = b.doc_id and a.pos = b.pos group by a.doc_id),
feat as (select x.doc_id, wer, case when n > 0 then m::double / n else 1.0 end as entity, {adjacent('h')} as repetition, {JACCARD_CI} as semantic, coalesce(speaker, 0.0) as speaker, {NUMBER_ACC} as number
 from rated x join e2 using (doc_id) left join sp using (doc_id)),
parts as (select *, greatest(0.0, 1 - wer) * 0.15 as part_wer, entity * 0.40::double as part_entity, greatest(0.0, 1 - repetition / 5) * 0.10 as part_repetition, semantic * 0.15::double as part_semantic, speaker * 0.10::double as part_speaker, number * 0.10::double as part_number from feat),
scored as (select *, least(greatest(part_wer + part_entity + part_repetition + part_semantic + part_speaker + part_number, 0.0), 1.0)::double as reward from parts)"""

CONF = "list_transform(r, lambda w: (length(w) % 10) / 10.0::double)"


def conf_cols(v: str) -> str:
    n = f"len({v})::double"
    mean = f"list_sum({v}) / {n}"
    return f"""round({mean}, 6) as mean_confidence, round(list_min({v}), 6) as min_confidence, round(list_max({v}), 6) as max_confidence, round(list_stddev_pop({v}), 6) as std_confidence,
 round(len(list_filter({v}, lambda x: x < 0.5)) / {n}, 6) as low_confidence_ratio, round(len(list_filter({v}, lambda x: x > 0.8)) / {n}, 6) as high_confidence_ratio"""


SPECIAL = share("text", "[^\\p{L}\\p{N}\\s]")
CAL = f"""d as (select doc_id, round(1 - least({SPECIAL} * 2, 1.0), 3) as confidence from documents),
c as (select (confidence >= 0.6)::int as p, quality as y, confidence as c from d join labels using (doc_id)),
b as (select count(*)::double n, avg((p = y)::int) accuracy, count(*) filter (p = 1 and y = 1)::double tp, count(*) filter (p = 1)::double pp, count(*) filter (y = 1)::double pos, avg((c - y) * (c - y)) brier,
 avg(-(y * ln(least(greatest(c, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(c, 1e-15), 1 - 1e-15)))) nll from c),
bins as (select least(floor(c * 10), 9) bin, count(*) k, avg(c) conf, avg((p = y)::int) acc from c group by 1),
e as (select sum(k * abs(conf - acc)) / sum(k) ece from bins),
t as (select c, sum(y)::double y1, sum(1 - y)::double y0 from c group by c),
w as (select *, coalesce(sum(y0) over (order by c rows between unbounded preceding and 1 preceding), 0) below, sum(y1) over (order by c desc rows unbounded preceding) tp2, sum(y0) over (order by c desc rows unbounded preceding) fp2 from t),
g as (select sum(y1 * (below + y0 / 2)) wins, sum(y1) p1, sum(y0) p0, sum(y1 * tp2 / (tp2 + fp2)) ap from w),
m as (select *, case when pp > 0 then tp / pp else 0 end as precision, case when pos > 0 then tp / pos else 0 end as recall from b, e, g)"""

STATS = f"f as (select doc_id, len({tok('text')})::double as word_count, case when len({tok('text')}) > 0 then list_sum(list_transform({tok('text')}, lambda x: length(x)))::double / len({tok('text')}) else 0.0 end as avg_word_length from documents)"


def ladder() -> str:
    from .queries import LADDER

    rows = ", ".join(f"{{'label': '{n}', 'quality_score': {q}, 'h': {corrupt('r', *k)}}}" for n, q, k in LADDER)
    return f"with {PAIRS}, l as (select doc_id, r, unnest([{rows}]) as s from pairs), m as (select doc_id, r, s.label as label, s.quality_score as quality_score, s.h as h from l) select doc_id, label, quality_score, array_to_string(h, ' ') as transcript, round({rate(distance('r', 'h'))}, 6) as wer from m"


#: With only words left out or replaced by a filler, an alignment of least cost hits all other words.
ALIGNED = f"""{RATES}, hit as (select *, len(r) - distance as hits, len(r) as n, len(h) as m from rated),
aligned as (select *, case when n > 0 then distance::double / n else 0.0 end as mer, case when n > 0 and m > 0 then 1 - (hits::double / n) * (hits::double / m) when n = 0 and m = 0 then 0.0 else 1.0 end as wil,
 case when n > 0 then greatest(0.0, 1 - abs(m::double / n - 1)) else 0.0 end as length_penalty from hit)"""


def some(c: str) -> str:
    return f"round(coalesce({c}, 0.0)::double, 6)"


def rerank_cols(failed: str = "false") -> str:
    from .operators.models import DEFAULTS

    v = "(case when m > 0 then list_transform(h, lambda w: (length(w) % 10) / 10.0::double) else [0.8::double] end)"
    k = f"len({v})::double"
    cols = {
        "wer_score": "wer", "mer_score": "mer", "wil_score": "wil", "wer_reward": "greatest(0.0, 1 - wer)", "mer_reward": "greatest(0.0, 1 - mer)", "wil_reward": "greatest(0.0, 1 - wil)",
        "length_penalty": "length_penalty", "length_ratio": "m::double / greatest(n, 1)",
        "mean_confidence": f"list_sum({v}) / {k}", "min_confidence": f"list_min({v})", "max_confidence": f"list_max({v})", "std_confidence": f"list_stddev_pop({v})",
        "low_confidence_ratio": f"len(list_filter({v}, lambda x: x < 0.5)) / {k}", "high_confidence_ratio": f"len(list_filter({v}, lambda x: x > 0.8)) / {k}",
        "semantic_similarity": JACCARD_CI, "token_overlap": "len(list_intersect(r, h))::double / greatest(len(list_distinct(r)), len(list_distinct(h)), 1)", "jaccard_similarity": jac("r", "h"),
        "word_count": "m", "avg_word_length": "case when m > 0 then list_sum(list_transform(h, lambda x: length(x)))::double / m else 0.0 end",
        "repetition_ratio": "len(list_filter(map_values(list_aggregate(h, 'histogram')), lambda x: x > 1))::double / greatest(m, 1)",
        "char_diversity": "case when length(hyp) > 0 then len(list_distinct(string_split(hyp, '')))::double / length(hyp) else 0.0 end",
        "punct_ratio": share("hyp", "[.,!?;:]"), "digit_ratio": share("hyp", "\\p{Nd}"), "special_ratio": share("hyp", "[^\\p{L}\\p{N}\\s]"),
    }
    return ", ".join(f"case when {failed} then {DEFAULTS.get(n, 0.0)}::double else {some(c)} end as {n}" for n, c in cols.items())


def chunk_sql(items: str, size: int, step: int, more: str = "", name: str = "chunk") -> str:
    return f"with c as (select doc_id, {items} as w from documents), k as (select doc_id, w, unnest(range(0, len(w), {step})) as i from c) select doc_id, {more}(i // {step})::int as pos, array_to_string(w[i + 1 : i + {size}], ' ') as {name} from k"


SQL = {
    "token_stats": f"select doc_id, len({tok('text')}) as n_words, length(text) as n_chars, round(case when len({tok('text')}) > 0 then list_sum(list_transform({tok('text')}, lambda x: length(x)))::double / len({tok('text')}) else 0.0 end, 6) as avg_word_length from documents",
    "transcript_totals": f"select conv_id, count(*) as n_segments, sum(len({tok('text')}))::bigint as n_words, sum(length(text))::bigint as n_chars from conversations group by conv_id",
    "preview": "select doc_id, substring(text, 1, 500) as p500, substring(text, 1, 50) as p50 from documents",
    "wer_preprocess": f"select doc_id, {prepare("'ss: ' || " + norm('text') + " || ' (0:01-0:02.5)' || chr(10) || 'ps: 235 x'")} as prepared from documents",
    "number_normalize": f"with {PAIRS} select doc_id, {said('ref')} as normalized, {norm('ref')} <> ref as changed from pairs",
    "number_recall": f"with {PAIRS} select doc_id, len(list_distinct({nums('ref')})) as n_numbers, round({NUMBER_ACC}, 6) as number_accuracy from pairs",
    "adjacent_repetition": f"with d as (select doc_id, {tok('text')} as w from documents) select doc_id, round({adjacent('w')}, 6) as repetition from d",
    "global_repetition": f"""with d as (select doc_id, {tok('text')} as w from documents), x as (select doc_id, unnest(w) as t from d), c as (select doc_id, t, count(*) n from x group by 1, 2), g as (select doc_id, count(*) filter (n > 1) as k from c group by 1)
select doc_id, round(coalesce(k, 0)::double / greatest(len(w), 1), 6) as repetition_ratio from d left join g using (doc_id)""",
    "char_profile": f"""select doc_id, round(case when length(text) > 0 then len(list_distinct(string_split(text, '')))::double / length(text) else 0.0 end, 6) as char_diversity, round({share('text', '[.,!?;:]')}, 6) as punct_ratio, round({share('text', '\\p{Nd}')}, 6) as digit_ratio, round({share('text', '[^\\p{L}\\p{N}\\s]')}, 6) as special_ratio from documents""",
    "syllable_rate": f"with d as (select doc_id, {SYL.format(c='text')} as n_syllables, len({tok('text')}) * 0.4::double as duration from documents) select doc_id, n_syllables, round(case when duration > 0 then n_syllables * 60 / duration else 0.0 end, 6) as rate from d",
    "noun_variants": f"""with d as (select doc_id, regexp_extract_all({ascii_only('text')}, '{NOUN}') as l from documents), n as (select doc_id, unnest(range(0, len(l))) as pos, unnest(l) as noun from d)
select doc_id, pos, noun as full_name, array_to_string({tok('noun')}[1:2], ' ') as first_two, array_to_string(list_transform({tok('noun')}, lambda x: substring(x, 1, 1)), '') as initials from n""",
    "compound_nouns": f"""with d as (select doc_id, regexp_extract_all({ascii_only('text')}, '{NOUN}') as l, string_split(regexp_replace({ascii_only('text')}, '{NOUN}', chr(1), 'g'), chr(1)) as gaps from documents), n as (select doc_id, l, gaps, unnest(range(0, len(l))) as pos, unnest(l) as noun from d),
s as (select *, {total('list_transform(gaps[1 : pos + 1], lambda x: length(x))')} + {total('list_transform(l[1 : pos], lambda x: length(x))')} as start_pos from n)
select doc_id, pos, noun, start_pos::int as start_pos, (start_pos + length(noun))::int as end_pos, {SYL.format(c='noun')} as syllables from s""",
    "noun_timing": f"""with t as (select doc_id, text as transcript, 1.0::double as start_ts, 1 + len({tok('text')}) * 0.4::double as end_ts from documents),
d as (select *, regexp_extract_all({ascii_only('transcript')}, '{NOUN}') as l, string_split(regexp_replace({ascii_only('transcript')}, '{NOUN}', chr(1), 'g'), chr(1)) as gaps from t), n as (select *, unnest(range(0, len(l))) as pos, unnest(l) as noun from d),
s as (select *, {SYL.format(c='noun')} as noun_syllables, start_ts + ({total('list_transform(gaps[1 : pos + 1], lambda x: length(x))')} + {total('list_transform(l[1 : pos], lambda x: length(x))')})::double / length(transcript) * (end_ts - start_ts) as noun_start from n)
select doc_id, noun, noun_syllables, round(noun_start::double, 6) as noun_start, round((noun_start + noun_syllables::double / {SYL.format(c='transcript')} * (end_ts - start_ts))::double, 6) as noun_end from s""",
    "noun_repair": f"with d as (select doc_id, text, regexp_extract_all({ascii_only('text')}, '{NOUN}') as l from documents) select doc_id, list_reduce(list_concat([text], l[1:10]), lambda a, n: case when instr(a, n) > 0 then substring(a, 1, instr(a, n) - 1) || upper(n) || substring(a, instr(a, n) + length(n)) else a end) as repaired from d",
    "sentence_fragments": f"with d as (select doc_id, {FRAGMENTS} as l from documents) select doc_id, unnest(range(0, len(l)))::int as pos, unnest(l) as fragment from d",
    "fragment_chunks": chunk_sql(FRAGMENTS, 10, 10),
    "word_chunks_overlap": chunk_sql(tok("text"), 200, 180, "(len(w) + 179) // 180 as n_chunks, "),
    "word_windows": f"with c as (select doc_id, {tok(CLEAN)} as w from documents), k as (select doc_id, w, unnest(range(0, len(w), 50)) as i from c) select doc_id, (i // 50)::int as segment_id, array_to_string(w[i + 1 : i + 50], ' ') as text, i::int as start_word, least(i + 50, len(w))::int as end_word from k",
    "clean_text": f"select doc_id, {CLEAN} as cleaned from documents",
    "word_wer": f"with {RATES} select doc_id, len(r) as n_ref, len(h) as n_hyp, distance, round(wer, 6) as wer, round(greatest(0.0, 1 - wer), 6) as wer_reward from rated",
    "wer_grade": f"with {RATES} select doc_id, case when wer < 0.1 then 5 when wer < 0.2 then 4 when wer < 0.3 then 3 when wer < 0.5 then 2 else 1 end as grade from rated",
    "length_penalty": f"with {PAIRS} select doc_id, round(case when len(r) > 0 then greatest(0.0, 1 - abs(len(h)::double / len(r) - 1)) else 0.0 end, 6) as length_penalty, round(len(h)::double / greatest(len(r), 1), 6) as length_ratio from pairs",
    "token_overlap": f"with {PAIRS} select doc_id, round(len(list_intersect(r, h))::double / greatest(len(list_distinct(r)), len(list_distinct(h)), 1), 6) as token_overlap from pairs",
    "jaccard_cs": f"with {PAIRS} select doc_id, round({jac('r', 'h')}, 6) as jaccard from pairs",
    "jaccard_ci": f"with {PAIRS} select doc_id, round({JACCARD_CI}, 6) as jaccard from pairs",
    "embedding_cosine": "with c as (select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(c, 5) as cosine, round(greatest(0.0, c), 5) as floored from c",
    "positional_char_diff": f"with {PAIRS}, d as (select doc_id, ref, {diff('ref', 'hyp')} as chars_changed from pairs) select doc_id, chars_changed::int as chars_changed, round(case when length(ref) > 0 then chars_changed * 100.0::double / length(ref) else 0.0 end, 6) as change_percentage from d",
    "quality_delta": f"""with {PAIRS}, q as (select *, list_filter(h, lambda w: w <> '{FILLER}') as c from pairs), z as (select *, array_to_string(c, ' ') as corrected, {rate(distance('r', 'h'))} as wo, {rate(distance('r', 'c'), 'r', 'c')} as wc from q), y as (select *, {diff('hyp', 'corrected')} as cc from z)
select doc_id, length(hyp) as original_length, length(corrected) as corrected_length, cc::int as chars_changed, round(case when length(hyp) > 0 then cc * 100.0::double / length(hyp) else 0.0 end, 6) as change_percentage, round(wo, 6) as wer_original, round(wc, 6) as wer_corrected, round(wo - wc, 6) as improvement, round(case when wo > 0 then (wo - wc) * 100 / wo else 0.0 end, 6) as improvement_percentage from y""",
    "wer_prepared": f"with {PREPARED} select doc_id, len(pr) as n_ref, len(ph) as n_hyp, distance, round(wer, 6) as wer from rated",
    "mer_wil": f"with {ALIGNED} select doc_id, distance, hits, round(mer, 6) as mer, round(wil, 6) as wil from aligned",
    "heuristic_quality": f"with {ALIGNED} select doc_id, round(greatest(0.0, 1 - wer) * 0.4 + greatest(0.0, 1 - mer) * 0.3 + greatest(0.0, 1 - wil) * 0.2 + length_penalty * 0.1, 6) as quality_score from aligned",
    "rerank_features": f"with {ALIGNED} select doc_id, {rerank_cols()} from aligned",
    "speaker_segments": f"with {LABELLED}, {segs('s', 'lab', 'conv_id', 'ref')} select conv_id, pos::int as pos, speaker, text from s",
    "speaker_accuracy": f"with {LABELLED}, {segs('sr', 'lab', 'conv_id', 'ref')}, {segs('sh', 'lab', 'conv_id', 'hyp')}, a as (select sr.conv_id, avg((lower(sr.speaker) = lower(sh.speaker))::int) as x from sr join sh on sr.conv_id = sh.conv_id and sr.pos = sh.pos group by 1) select conv_id, round(coalesce(x, 0.0), 6) as speaker_accuracy from lab left join a using (conv_id)",
    "transcript_assembly": f"with {LABELLED}, {segs('s', 'lab', 'conv_id', 'ref')} select conv_id, string_agg(case when length(speaker) > 0 then speaker || ': ' || text else text end, chr(10) order by pos) as transcript from s group by conv_id",
    "full_transcript": "select conv_id, string_agg(text, ' ' order by turn) as transcript from conversations group by conv_id",
    "speaker_rollup": f"with {TURNS} select speaker, count(*) as n_segments, round(sum(end_ts - start_ts)::double, 3) as seconds, round(max(end_ts)::double, 3) as last_end from turns group by speaker",
    "entity_match": f"with {ENTITY} select doc_id, category, n_ref, n_matched, n_ref - n_matched as n_missing, round(case when n_ref > 0 then n_matched::double / n_ref else 1.0 end, 6) as score from e1",
    "category_rollup": f"with {ENTITY} select coalesce(category, 'ALL') as category, sum(n_ref)::bigint as total, sum(n_ref - n_matched)::bigint as missing, round(sum(n_matched) * 100.0::double / sum(n_ref), 6) as accuracy from e1 group by rollup (category) having sum(n_ref) > 0",
    "confidence_stats": f"with {PAIRS}, c as (select doc_id, case when len(r) > 0 then {CONF} else [0.8::double] end as c from pairs) select doc_id, {conf_cols('c')} from c",
    "words_probe": f"with {PAIRS} select doc_id, len(r) as n, round(coalesce(list_sum(list_transform(r, lambda w, i: case when (i - 1) % 3 = 0 then 0.8::double else (length(w) % 10) / 10.0::double end)), 0.0), 6) as total from pairs",
    "stt_json_decode": f"with {TURNS} select conv_id, turn, 0 as pos, round((case when (conv_id + turn) % 5 = 4 then 0.0 else start_ts end)::double, 6) as start_ts, round((case when (conv_id + turn) % 5 = 4 then 0.0 else end_ts end)::double, 6) as end_ts, transcript, case when (conv_id + turn) % 5 >= 3 then 'SPEAKER_00' else speaker end as speaker from turns",
    "fenced_json": "select event_id, case when event_id % 3 = 2 then -1 else floor(value)::bigint end as score from events",
    "reward_score": f"with {SCORED} select doc_id, round(wer, 6) as wer, round(entity, 6) as entity, round(repetition, 6) as repetition, round(semantic, 6) as semantic, round(speaker, 6) as speaker, round(number, 6) as number, round((1 - entity) * 10, 6) as entity_penalty, round(reward, 6) as reward from scored",
    "reward_breakdown": f"with {SCORED}, u as (select doc_id, unnest(['wer', 'entity', 'repetition', 'semantic', 'speaker', 'number']) as part, unnest([part_wer, part_entity, part_repetition, part_semantic, part_speaker, part_number]) as value from scored) select doc_id, part, round(value::double, 6) as value from u",
    "corpus_summary": f"with {SCORED} select count(*) as n, round(avg(reward), 6) as mean, round(stddev_pop(reward), 6) as std, round(min(reward), 6) as min, round(max(reward), 6) as max, round(quantile_cont(reward, 0.5), 6) as median, round(avg(wer), 6) as mean_wer, round(avg(entity), 6) as mean_entity, round(avg(repetition), 6) as mean_repetition, round(avg(semantic), 6) as mean_semantic, round(avg(number), 6) as mean_number from scored",
    "augmented_split": f"""with {SCORED}, a as (select *, doc_id % 2 = 1 as f from scored) select count(*) filter (not f) as n_original, count(*) filter (f) as n_augmented, round(avg(reward) filter (not f), 6) as mean_original, round(stddev_pop(reward) filter (not f), 6) as std_original, round(avg(reward) filter (f), 6) as mean_augmented, round(stddev_pop(reward) filter (f), 6) as std_augmented,
round(avg(reward) filter (not f) - avg(reward) filter (f), 6) as reward_drop, round(avg(wer) filter (f) - avg(wer) filter (not f), 6) as wer_rise, round(avg(entity) filter (f) - avg(entity) filter (not f), 6) as entity_rise from a""",
    "score_buckets": f"""with {SCORED}, b as (select case when round(reward, 6) >= 0.8 then 'excellent' when round(reward, 6) >= 0.6 then 'good' when round(reward, 6) >= 0.4 then 'fair' else 'poor' end as bucket from scored), n as (select unnest(['excellent', 'good', 'fair', 'poor']) as bucket)
select n.bucket, count(b.bucket) as n, round(count(b.bucket) * 100.0::double / (select count(*) from b), 6) as percent from n left join b on n.bucket = b.bucket group by n.bucket""",
    "rerank_topk": f"with {PAIRS}, s as (select doc_id, lang, source, round({JACCARD_CI}, 6) as score from pairs), k as (select *, row_number() over (partition by lang, source order by score desc, doc_id) as rank from s) select lang, source, rank, doc_id, score from k where rank <= 3",
    "binarize": f"with {PAIRS}, s as (select doc_id, round({JACCARD_CI}, 6) as score from pairs) select doc_id, (score >= 0.6)::int as prediction, (score >= 0.8)::int as label, score as confidence from s",
    "calibration_metrics": f"with {CAL} select round(accuracy, 5) as accuracy, round(precision, 5) as precision, round(recall, 5) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 5) as f1, round(ece, 5) as ece, round(brier, 5) as brier, round(nll, 5) as nll, round(wins / (p1 * p0), 5) as auroc, round(ap / p1, 5) as auprc from m",
    "standard_scale": f"with {STATS}, s as (select avg(word_count) m1, stddev_pop(word_count) s1, avg(avg_word_length) m2, stddev_pop(avg_word_length) s2 from f where doc_id % 5 <> 0) select doc_id, doc_id % 5 = 0 as held_out, round((word_count - m1) / s1, 5) as word_count, round((avg_word_length - m2) / s2, 5) as avg_word_length from f, s",
    "regression_metrics": f"with q as (select quality::double as y, 1 - least({SPECIAL} * 2, 1.0) as p from documents join labels using (doc_id)), s as (select count(*) n, sum((y - p) * (y - p)) sse, avg(abs(y - p)) mae, var_pop(y) v from q) select round(sse / n, 5) as mse, round(sqrt(sse / n), 5) as rmse, round(mae, 5) as mae, round(1 - sse / (n * v), 5) as r2 from s",
    "corruption_ladder": ladder(),
}
