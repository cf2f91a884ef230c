"""The queries of ``flows`` in DuckDB's SQL: what comes back is what was written."""

from __future__ import annotations

from .flows import SEED
from .operators.audio import KINDS, drawn
from .oracles import ALIGNED, CLEAN, FRAGMENTS, JACCARD_CI, NOUN, PAIRS, RATES, SQL as OWN, SYL, TURNS, ascii_only, chunk_sql, corrupt, distance, ladder, rate, rerank_cols, tok, total

TEXT_FEATURES = "semantic_similarity token_overlap length_ratio word_count avg_word_length repetition_ratio char_diversity punct_ratio digit_ratio wer_reward mer_reward wil_reward length_penalty".split()

SAMPLE = "'sample_' || doc_id || '.wav'"
CLIP = "'clip_' || conv_id || '.wav'"
GRADE = "case when wer < 0.1 then 5 when wer < 0.2 then 4 when wer < 0.3 then 3 when wer < 0.5 then 2 else 1 end"
TIMES = "round(start_ts::double, 6) as start_ts, round(end_ts::double, 6) as end_ts, transcript, speaker"
POS = "(row_number() over (partition by conv_id order by turn) - 1)::int as pos"
RATE = "case when conv_id % 3 = 0 then 8000 else 16000 end"
CONVS = "c0 as (select distinct conv_id from conversations)"
QUALITY = "select doc_id, round(greatest(0.0, 1 - wer) * 0.4 + greatest(0.0, 1 - mer) * 0.3 + greatest(0.0, 1 - wil) * 0.2 + length_penalty * 0.1, 6) as quality_score from aligned"


def variants(src: str, path: str, n: int) -> str:
    """The rows of ``src`` with variant, kind and name."""
    mark = f"('0x' || substring(md5({path} || '#' || variant), 1, 6))::bigint"
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""v0 as (select *, unnest(range(0, {n})) as variant from {src}), v1 as (select *, {kinds}[({mark} % {len(KINDS)})::int + 1] as kind from v0),
variants as (select *, replace({path}, '.wav', '') || '_aug_' || variant || '_' || kind || '.wav' as name from v1)"""


def joined(chunks: str, name: str) -> str:
    return f"with k as ({chunks}) select doc_id, coalesce(string_agg('<' || chunk || '>', ' ' order by pos), '') as {name} from documents left join k using (doc_id) group by doc_id"


#: The segments of a first hearing, their nouns with times, and the words of a second one.
REHEARD = f"""t0 as (select conv_id, turn, {tok('text')} as w, {tok(CLEAN)} as c from conversations),
t1 as (select *, coalesce(sum(len(w)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as before from t0),
seg as (select conv_id, turn, array_to_string(list_transform(c, lambda x, i: case when (i - 1) % 9 in (3, 4) and regexp_matches(x, '^[a-z]') then upper(x[1]) || x[2:] else x end), ' ') as t, greatest(before * 0.4::double - 0.5::double, 0.0::double) as a, (before + len(w)) * 0.4::double + 0.5::double as z from t1),
hit as (select *, regexp_extract_all({ascii_only('t')}, '{NOUN}') as l, string_split(regexp_replace({ascii_only('t')}, '{NOUN}', chr(1), 'g'), chr(1)) as gaps from seg), n0 as (select *, unnest(range(0, len(l))) as pos, unnest(l) as noun from hit),
n1 as (select *, a + ({total('list_transform(gaps[1 : pos + 1], lambda x: length(x))')} + {total('list_transform(l[1 : pos], lambda x: length(x))')})::double / length(t) * (z - a) as ns from n0),
n2 as (select *, ns + {SYL.format(c='noun')}::double / {SYL.format(c='t')} * (z - a) as ne, row_number() over (partition by conv_id order by turn, pos) as idx from n1),
wd as (select conv_id, word, (before + i) * 0.4::double as ws, (before + i + 1) * 0.4::double as we from (select conv_id, before, unnest(w) as word, unnest(range(0, len(w))) as i from t1)),
rep as (select n2.conv_id, idx, string_agg(word, ' ' order by ws) as reply from n2 join wd on n2.conv_id = wd.conv_id and least(ne, we) - greatest(ns, ws) >= 0.5::double * (we - ws) where idx <= 10 group by 1, 2)"""

SQL = {
    "noun_rehearing": f"""with {REHEARD}, fx as (select conv_id, list(noun || chr(1) || coalesce(reply, noun) order by idx) as fixes, count(*) as n_nouns, count(reply) as n_heard from n2 left join rep using (conv_id, idx) where idx <= 10 group by conv_id),
tx as (select conv_id, string_agg(t, ' ' order by turn) as t from seg group by conv_id)
select conv_id, list_reduce(list_concat([t], coalesce(fixes, [])), lambda x, n: case when instr(x, split_part(n, chr(1), 1)) > 0 then substring(x, 1, instr(x, split_part(n, chr(1), 1)) - 1) || split_part(n, chr(1), 2) || substring(x, instr(x, split_part(n, chr(1), 1)) + length(split_part(n, chr(1), 1))) else x end) as corrected,
coalesce(n_nouns, 0) as n_nouns, coalesce(n_heard, 0) as n_heard from tx left join fx using (conv_id)""",
    "number_reply": "select doc_id, case when doc_id % 4 < 2 then doc_id || ' ' || n_chars || '.5' else '' end as numbers from documents",
    "default_features": f"with {ALIGNED} select doc_id, {rerank_cols('doc_id % 7 = 0')}, case when doc_id % 7 = 0 then 1.0::double else round(greatest(0.0, 1 - wer)::double, 6) end as target from aligned",
    "ground_truth_scan": f"select {SAMPLE} as audio_path, text as reference_text, case when doc_id % 2 = 1 then 'sample_' || (doc_id - 1) || '.wav' else {SAMPLE} end as original_audio, doc_id % 2 = 1 as is_augmented from documents",
    "training_scan": f"select transcript, quality_score, wer, label from ({ladder()})",
    "combined_dataset": f"""with o as (select {SAMPLE} as audio_path, text as reference_text from documents), {variants('o', 'audio_path', 2)}
select audio_path, reference_text, audio_path as original_audio, false as is_augmented from o union all select name, reference_text, audio_path, true from variants""",
    "stt_folder_scan": f"with {TURNS} select conv_id, {POS}, {TIMES} from turns",
    "stt_reference_scan": f"""with t as ({OWN['full_transcript']}), p as (select conv_id, transcript as reference, {tok('transcript')} as r from t), q as (select *, {corrupt('r')} as h from p), rates as (select *, {distance('r', 'h')} as distance from q), rated as (select *, {rate('distance')} as wer from rates)
select 'conv_' || conv_id as name, array_to_string(h, ' ') as transcript, regexp_replace(reference, '^\\s+|\\s+$', '', 'g') as reference, {GRADE} as quality_score from rated""",
    "text_features": f"""with {ALIGNED}, q as ({QUALITY}), c as (select doc_id, {rerank_cols()} from aligned)
select doc_id, {', '.join(TEXT_FEATURES)}, quality_score from c join q using (doc_id)""",
    "training_set": f"with {RATES} select doc_id, {GRADE} as quality_score from rated",
    "results_json": OWN["token_stats"],
    "segments_json": f"with {TURNS} select conv_id, turn, {TIMES} from turns",
    "text_outputs": f"select cleaned from ({OWN['clean_text']}) where length(cleaned) > 0",
    "calibration_payload": f"select prediction, label, confidence from ({OWN['binarize']})",
    "reply_path": "select conv_id, turn, case when turn % 5 <> 4 then text end as text from conversations",
    "similarity_reply": f"with {PAIRS} select doc_id, round(case when doc_id % 4 < 2 then least((doc_id % 150) / 100.0::double, 1.0) else {JACCARD_CI} end, 6) as similarity, case when doc_id % 4 < 2 then 'judge' else 'words' end as backend from pairs",
    "repair_chunks": joined(chunk_sql(tok("text"), 200, 180), "repaired"),
    "repair_merged": f"""with d as (select doc_id, {tok('text')} as w from documents), c as (select doc_id, w, unnest(range(0, len(w), 180)) as i from d),
k as (select doc_id, i, list_transform(w[i + 1 : i + 200], lambda x, j: case when (j - 1) % 9 = 4 then x || '_' || (j - 1) else x end) as f from c), m as (select doc_id, i, array_to_string(case when i = 0 then f else f[21:] end, ' ') as t from k)
select doc_id, coalesce(string_agg(t, ' ' order by i) filter (t <> ''), '') as repaired from documents left join m using (doc_id) group by doc_id""",
    "translate_chunks": joined(chunk_sql(FRAGMENTS, 10, 10), "translated"),
    "remote_annotation": "select event_id, event_type, upper(event_type) as annotation, 'remote' as backend from events",
    "audio_variants": f"with {CONVS}, c as (select {CLIP} as path, {RATE} as rate from c0), {variants('c', 'path', 5)} select path, variant::int as variant, kind, name, case when kind in ('time_stretch', 'all') then round(rate / {drawn(SEED).stretch!r}::double)::bigint else rate end as n_samples from variants",
    "audio_probe": f"with {CONVS} select conv_id as sample_id, case when conv_id % 6 = 0 then 'sample_' || conv_id || '.mp3' when conv_id % 3 <> 2 then 'sample_' || conv_id || '.wav' end as file from c0",
    "stt_batch": f"with {TURNS} select {CLIP} as audio_path, {POS}, {TIMES} from turns",
    "stt_slices": f"with {CONVS}, s as (select *, {RATE} as rate, unnest([0.0::double, 0.5]) as start_ts, unnest([0.25::double, 2.0]) as end_ts from c0) select {CLIP} as audio_path, start_ts, end_ts, (least(end_ts, 1) * rate - start_ts * rate)::int || ' samples at ' || rate || ' in en' as transcript from s",
}
