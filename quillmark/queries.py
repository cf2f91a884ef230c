"""Queries of the transcript-quality operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import edit, json as js, metrics as M, numbers as N, text as T
from .operators import entities as E, models, report as R, segments as S
from .pairs import FILLER, dealt_parts, documents, known_names, labelled_transcripts, name_aliases, paired, spoken_pairs, table, text_pairs, timed_turns
from .shared import staged


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)


def token_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"), F.length("text").alias("n_chars"))
    return d.select("doc_id", F.size("w").alias("n_words"), "n_chars", _r(T.mean_word_length("w")).alias("avg_word_length"))


def transcript_totals(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", F.size(T.tokens("text")).alias("w"), F.length("text").alias("c"))
    return d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("w").alias("n_words"), F.sum("c").alias("n_chars"))


def preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 500).alias("p500"), F.substring("text", 1, 50).alias("p50"))


def wer_preprocess(spark, sf_dir):
    stamped = F.concat(F.lit("ss: "), F.col("text"), F.lit(" (0:01-0:02.5)\nps: Two hundred thirty-five x"))
    return _docs(spark, sf_dir).withColumn("stamped", stamped).select("doc_id", T.preprocess(N.normalize_numbers("stamped")).alias("prepared"))


def number_normalize(spark, sf_dir):
    """Texts that end in numbers as words, read as digits."""
    d = spoken_pairs(spark, sf_dir).select("doc_id", "ref", N.normalize_numbers("ref_said").alias("normalized"))
    return d.select("doc_id", "normalized", (~F.startswith("normalized", F.concat("ref", F.lit(" total ")))).alias("changed"))


def number_recall(spark, sf_dir):
    p = spoken_pairs(spark, sf_dir).select("doc_id", N.numbers("ref_said").alias("r"), N.numbers("hyp_said").alias("h"))
    return p.select("doc_id", F.size(F.array_distinct("r")).alias("n_numbers"), _r(M.number_recall(F.col("r"), F.col("h"))).alias("number_accuracy"))


def adjacent_repetition(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    return d.select("doc_id", _r(T.adjacent_repetition("w")).alias("repetition"))


def global_repetition(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    return d.select("doc_id", _r(T.global_repetition("w")).alias("repetition_ratio"))


def char_profile(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", _r(T.char_diversity("text")).alias("char_diversity"), _r(T.punct_ratio("text")).alias("punct_ratio"), _r(T.digit_ratio("text")).alias("digit_ratio"), _r(T.special_ratio("text")).alias("special_ratio")
    )


def syllable_rate(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.syllables("text").alias("n_syllables"), (F.size(T.tokens("text")) * 0.4).alias("duration"))
    return d.select("doc_id", "n_syllables", _r(T.ratio(F.col("n_syllables") * 60, F.col("duration"))).alias("rate"))


def compound_nouns(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.compound_noun_hits("text")).alias("pos", "hit"))
    return d.select("doc_id", "pos", "hit.noun", "hit.start_pos", "hit.end_pos", T.syllables("hit.noun").alias("syllables"))


def noun_variants(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.compound_nouns("text")).alias("pos", "noun")).withColumn("v", T.noun_variants("noun"))
    return d.select("doc_id", "pos", F.col("v")[0].alias("full_name"), F.col("v")[1].alias("first_two"), F.col("v")[2].alias("initials"))


def noun_timing(spark, sf_dir):
    """Documents as segments that start at 1 s and last 0.4 s a word."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("transcript"), F.lit(1.0).alias("start_ts"), (1 + F.size(T.tokens("text")) * 0.4).alias("end_ts"))
    return S.noun_times(d).select("doc_id", "noun", "noun_syllables", _r(F.col("noun_start")).alias("noun_start"), _r(F.col("noun_end")).alias("noun_end"))


def noun_repair(spark, sf_dir):
    fixes = F.transform(T.compound_nouns("text"), lambda n: F.struct(n.alias("old"), F.upper(n).alias("new")))
    return _docs(spark, sf_dir).select("doc_id", T.replace_nouns("text", fixes).alias("repaired"))


def sentence_fragments(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.fragments("text")).alias("pos", "fragment"))


def fragment_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.fragments("text").alias("f"))
    return d.select("doc_id", F.posexplode(T.chunks("f", 10)).alias("pos", "chunk"))


def word_chunks_overlap(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    d = d.select("doc_id", T.chunk_count(F.size("w"), 180).alias("n_chunks"), F.posexplode(T.chunks("w", 200, 180)).alias("pos", "chunk"))
    return d


def word_windows(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.tokens(T.clean("text")).alias("w"))
    d = d.select("doc_id", F.size("w").alias("n"), F.posexplode(T.chunks("w", 50)).alias("segment_id", "text"))
    return d.select("doc_id", "segment_id", "text", (F.col("segment_id") * 50).alias("start_word"), F.least(F.col("segment_id") * 50 + 50, "n").alias("end_word"))


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean("text").alias("cleaned"))


#: label, quality and how words are corrupted (drop, swap, double; None: never).
LADDER = (("perfect", 5, (None, None, None)), ("excellent", 4, (None, None, 13)), ("good", 3, (None, 11, None)), ("fair", 2, (7, 11, None)), ("poor", 1, (4, 6, None)))


def corruption_ladder(spark, sf_dir):
    d = text_pairs(spark, sf_dir).select("doc_id", "r")
    steps = [F.struct(F.lit(n).alias("label"), F.lit(q).alias("quality_score"), T.corrupted("r", *k, filler=FILLER).alias("h")) for n, q, k in LADDER]
    d = d.select("doc_id", "r", F.explode(F.array(*steps)).alias("s")).select("doc_id", "r", "s.*")
    wer = edit.error_rate(edit.word_distance(F.col("r"), F.col("h")), F.size("r"), F.size("h"))
    return d.select("doc_id", "label", "quality_score", F.array_join("h", " ").alias("transcript"), _r(wer).alias("wer"))


def _rates(spark, sf_dir) -> DataFrame:
    p = text_pairs(spark, sf_dir)
    return p.withColumn("distance", edit.word_distance(F.col("r"), F.col("h"))).withColumn("wer", edit.error_rate(F.col("distance"), F.size("r"), F.size("h")))


def word_wer(spark, sf_dir):
    return _rates(spark, sf_dir).select("doc_id", F.size("r").alias("n_ref"), F.size("h").alias("n_hyp"), "distance", _r(F.col("wer")).alias("wer"), _r(edit.reward(F.col("wer"))).alias("wer_reward"))


def _prepared(text: str) -> Column:
    """The words that a reward's error rate compares."""
    return T.tokens(T.preprocess(N.normalize_numbers(text)))


def wer_prepared(spark, sf_dir):
    """The error rate of the prepared pair: numbers as digits, without labels and stamps, in lower case."""
    p = spoken_pairs(spark, sf_dir).select("doc_id", _prepared("ref_said").alias("r"), _prepared("hyp_said").alias("h"))
    p = p.withColumn("distance", edit.word_distance(F.col("r"), F.col("h")))
    return p.select("doc_id", F.size("r").alias("n_ref"), F.size("h").alias("n_hyp"), "distance", _r(edit.error_rate(F.col("distance"), F.size("r"), F.size("h"))).alias("wer"))


def wer_grade(spark, sf_dir):
    return _rates(spark, sf_dir).select("doc_id", M.grade(F.col("wer")).alias("grade"))


def length_penalty(spark, sf_dir):
    p = text_pairs(spark, sf_dir)
    return p.select("doc_id", _r(M.length_penalty(F.size("r"), F.size("h"))).alias("length_penalty"), _r(M.length_ratio(F.size("r"), F.size("h"))).alias("length_ratio"))


def token_overlap(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("doc_id", _r(M.token_overlap(F.col("r"), F.col("h"))).alias("token_overlap"))


def jaccard_cs(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("doc_id", _r(M.jaccard(F.col("r"), F.col("h"))).alias("jaccard"))


def jaccard_ci(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("doc_id", _r(M.jaccard_folded(F.col("r"), F.col("h"))).alias("jaccard"))


def embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = M.cosine(F.col("embedding"), F.col("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(c, 5).alias("cosine"), F.round(F.greatest(F.lit(0.0), c), 5).alias("floored"))


def positional_char_diff(spark, sf_dir):
    p = text_pairs(spark, sf_dir).select("doc_id", "ref", T.char_diff("ref", "hyp").alias("chars_changed"))
    return p.select("doc_id", "chars_changed", _r(T.change_percentage("chars_changed", "ref")).alias("change_percentage"))


def quality_delta(spark, sf_dir):
    """Original: the corrupted text; corrected: it without the filler words; reference: the document."""
    p = text_pairs(spark, sf_dir).withColumn("c", F.filter("h", lambda w: w != FILLER))
    rate = lambda x: edit.error_rate(edit.word_distance(F.col("r"), F.col(x)), F.size("r"), F.size(x))
    p = p.withColumn("corrected", F.array_join("c", " ")).withColumn("wer_original", rate("h")).withColumn("wer_corrected", rate("c")).withColumn("chars_changed", T.char_diff("hyp", "corrected"))
    gain = F.col("wer_original") - F.col("wer_corrected")
    return p.select(
        "doc_id", F.length("hyp").alias("original_length"), F.length("corrected").alias("corrected_length"), "chars_changed", _r(T.change_percentage("chars_changed", "hyp")).alias("change_percentage"),
        _r(F.col("wer_original")).alias("wer_original"), _r(F.col("wer_corrected")).alias("wer_corrected"), _r(gain).alias("improvement"), _r(T.ratio(gain * 100, "wer_original")).alias("improvement_percentage"),
    )


def mer_wil(spark, sf_dir):
    p = edit.aligned(text_pairs(spark, sf_dir).select("doc_id", F.col("r").alias("ref_words"), F.col("h").alias("hyp_words")))
    n, m = F.size("ref_words"), F.size("hyp_words")
    return p.select("doc_id", "distance", "hits", _r(edit.match_error_rate(F.col("distance"), F.col("hits"))).alias("mer"), _r(edit.information_lost(F.col("hits"), n, m)).alias("wil"))


def heuristic_quality(spark, sf_dir):
    p = edit.aligned(text_pairs(spark, sf_dir).select("doc_id", F.col("r").alias("ref_words"), F.col("h").alias("hyp_words")))
    n, m = F.size("ref_words"), F.size("hyp_words")
    rates = (edit.error_rate(F.col("distance"), n, m), edit.match_error_rate(F.col("distance"), F.col("hits")), edit.information_lost(F.col("hits"), n, m))
    return p.select("doc_id", _r(M.heuristic_quality(*map(edit.reward, rates), M.length_penalty(n, m))).alias("quality_score"))


def rerank_features(spark, sf_dir):
    """The reranker's 24 features of each pair, in their order. The tables have no confidences: word lengths stand for them."""
    p = edit.aligned(text_pairs(spark, sf_dir).select("doc_id", "ref", "hyp", F.col("r").alias("ref_words"), F.col("h").alias("hyp_words")))
    r, h, n, m = F.col("ref_words"), F.col("hyp_words"), F.size("ref_words"), F.size("hyp_words")
    rates = {"wer": edit.error_rate(F.col("distance"), n, m), "mer": edit.match_error_rate(F.col("distance"), F.col("hits")), "wil": edit.information_lost(F.col("hits"), n, m)}
    cols = {f"{k}_score": v for k, v in rates.items()} | {f"{k}_reward": edit.reward(v) for k, v in rates.items()}
    cols |= {"length_penalty": M.length_penalty(n, m), "length_ratio": M.length_ratio(n, m)}
    cols |= M.confidence_stats(F.transform(h, lambda w: (F.length(w) % 10) / 10.0))
    cols |= {"semantic_similarity": M.similarity(r, h), "token_overlap": M.token_overlap(r, h), "jaccard_similarity": M.jaccard(r, h)}
    cols |= {"word_count": m, "avg_word_length": T.mean_word_length(h), "repetition_ratio": T.global_repetition(h), "char_diversity": T.char_diversity("hyp"), "punct_ratio": T.punct_ratio("hyp"), "digit_ratio": T.digit_ratio("hyp"), "special_ratio": T.special_ratio("hyp")}
    return p.select("doc_id", *(_r(F.coalesce(c.cast("double"), F.lit(0.0))).alias(k) for k, c in cols.items()))


def speaker_segments(spark, sf_dir):
    d = labelled_transcripts(spark, sf_dir).select("conv_id", F.posexplode(S.speaker_segments(F.col("ref"))).alias("pos", "s"))
    return d.select("conv_id", "pos", "s.speaker", "s.text")


def speaker_accuracy(spark, sf_dir):
    d = labelled_transcripts(spark, sf_dir)
    return d.select("conv_id", _r(S.speaker_accuracy(S.speaker_segments(F.col("ref")), S.speaker_segments(F.col("hyp")))).alias("speaker_accuracy"))


def transcript_assembly(spark, sf_dir):
    return labelled_transcripts(spark, sf_dir).select("conv_id", S.assemble(S.speaker_segments(F.col("ref"))).alias("transcript"))


def full_transcript(spark, sf_dir):
    return S.full_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def speaker_rollup(spark, sf_dir):
    d = timed_turns(spark, sf_dir)
    return d.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_segments"), F.round(F.sum(F.col("end_ts") - F.col("start_ts")), 3).alias("seconds"), F.round(F.max("end_ts"), 3).alias("last_end"))


def _entity_rows(spark, sf_dir) -> DataFrame:
    """Recall of names by category, over a gazetteer and aliases that the tables' own capitalised runs give."""
    known = staged(known_names(spark, sf_dir), "known-names")
    docs = documents(spark, sf_dir)
    parts = dealt_parts(docs, "text")
    dealt = paired(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").repartition(parts, "doc_id"))
    return E.text_recall(dealt, "doc_id", "ref", "hyp", known, name_aliases(known), paired(docs), parts)


def entity_match(spark, sf_dir):
    return _entity_rows(spark, sf_dir).select("doc_id", "category", "n_ref", "n_matched", "n_missing", _r(F.col("score")).alias("score"))


def category_rollup(spark, sf_dir):
    out = R.category_rollup(_entity_rows(spark, sf_dir))
    return out.select("category", "total", "missing", _r(F.col("accuracy")).alias("accuracy"))


def confidence_stats(spark, sf_dir):
    p = text_pairs(spark, sf_dir).select("doc_id", F.transform("r", lambda w: (F.length(w) % 10) / 10.0).alias("c"))
    return p.select("doc_id", *(_r(c).alias(k) for k, c in M.confidence_stats(F.col("c")).items()))


def words_probe(spark, sf_dir):
    """Confidences read back from JSON: every third word is a plain string."""
    words = F.transform("r", lambda w, i: F.when(i % 3 == 0, F.lit('"x"')).otherwise(F.concat(F.lit('{"confidence":'), ((F.length(w) % 10) / 10.0).cast("string"), F.lit("}"))))
    data = F.concat(F.lit('{"timestamps":{"words":['), F.array_join(words, ","), F.lit("]}}"))
    p = text_pairs(spark, sf_dir).select("doc_id", js.word_confidences(data).alias("c"))
    return p.select("doc_id", F.size("c").alias("n"), _r(F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def stt_json_decode(spark, sf_dir):
    """Each turn as a reply in one of the five shapes, decoded."""
    t = timed_turns(spark, sf_dir)
    a, z, x, s = F.col("start_ts"), F.col("end_ts"), F.col("transcript"), F.col("speaker")
    one = F.to_json(F.struct(F.struct(F.array(F.struct(a.alias("start_time_seconds"), z.alias("end_time_seconds"), x.alias("transcript"), s.alias("speaker_id"))).alias("entries")).alias("diarized_transcript")))
    two = F.to_json(F.struct(F.array(F.struct(a.alias("start"), z.alias("end"), x.alias("text"), s.alias("speaker"))).alias("segments")))
    three = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(a.alias("start_time"), z.alias("end_time"), x.alias("transcript"), s.alias("speaker_label"))).alias("segments"))).alias("results")))
    four = F.to_json(F.struct(F.struct(F.array(F.struct(a.alias("start_ts"), z.alias("end_ts"), x.alias("text"))).alias("segments")).alias("data")))
    five = F.to_json(F.struct(x.alias("transcript")))
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    reply = F.when(k == 0, one).when(k == 1, two).when(k == 2, three).when(k == 3, four).otherwise(five)
    d = t.select("conv_id", "turn", F.posexplode(js.stt_segments(reply)).alias("pos", "seg"))
    return d.select("conv_id", "turn", "pos", _r(F.col("seg.start_ts")).alias("start_ts"), _r(F.col("seg.end_ts")).alias("end_ts"), F.col("seg.transcript").alias("transcript"), F.col("seg.speaker").alias("speaker"))


def fenced_json(spark, sf_dir):
    """The score in an event's reply: fenced, bare or broken."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    body = F.concat(F.lit('{"score": '), F.floor("value").cast("string"), F.lit("}"))
    k = F.pmod("event_id", F.lit(3))
    reply = F.when(k == 0, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\nend"))).when(k == 1, body).otherwise(F.lit("none"))
    return e.select("event_id", F.coalesce(js.fenced_object(reply, "score long")["score"], F.lit(-1)).alias("score"))


def _scored(spark, sf_dir) -> DataFrame:
    """Pairs with the six features, the reward's parts and the reward."""
    p = spoken_pairs(spark, sf_dir)
    # what lambdas use again and again is a column first; a text's numbers are read once
    p = p.withColumn("d_ref", N.normalize_numbers("ref_said")).withColumn("d_hyp", N.normalize_numbers("hyp_said"))
    digits = lambda c: F.regexp_extract_all(c, F.lit(N.DIGITS), F.lit(0))
    p = p.withColumn("n_ref", digits("d_ref")).withColumn("n_hyp", digits("d_hyp"))
    p = p.withColumn("p_ref", T.tokens(T.preprocess("d_ref"))).withColumn("p_hyp", T.tokens(T.preprocess("d_hyp")))
    p = p.withColumn("wer", edit.error_rate(edit.word_distance(F.col("p_ref"), F.col("p_hyp")), F.size("p_ref"), F.size("p_hyp")))
    p = p.withColumn("repetition", T.adjacent_repetition("h"))
    p = p.withColumn("s_ref", S.speaker_segments(F.col("ref"))).withColumn("s_hyp", S.speaker_segments(F.col("hyp")))
    p = p.withColumn("semantic", M.similarity(F.col("r"), F.col("h"))).withColumn("speaker", S.speaker_accuracy(F.col("s_ref"), F.col("s_hyp"))).withColumn("number", M.number_recall(F.col("n_ref"), F.col("n_hyp")))
    p = p.select("doc_id", "wer", "repetition", "semantic", "speaker", "number").join(E.entity_scores(_entity_rows(spark, sf_dir), "doc_id"), "doc_id")
    parts = M.reward_parts(*(F.col(c) for c in ("wer", "entity", "repetition", "semantic", "speaker", "number")))
    p = p.withColumns({f"part_{k}": c for k, c in parts.items()})
    return p.withColumn("reward", M.reward_score({k: F.col(f"part_{k}") for k in parts}))


def reward_score(spark, sf_dir):
    p = _scored(spark, sf_dir)
    return p.select("doc_id", *(_r(F.col(c)).alias(c) for c in ("wer", "entity", "repetition", "semantic", "speaker", "number")), _r(E.entity_penalty(F.col("entity"))).alias("entity_penalty"), _r(F.col("reward")).alias("reward"))


def reward_breakdown(spark, sf_dir):
    p = _scored(spark, sf_dir)
    rows = p.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(f"part_{k}").alias("value")) for k in M.WEIGHTS))).alias("x"))
    return rows.select("doc_id", "x.part", _r(F.col("x.value")).alias("value"))


def corpus_summary(spark, sf_dir):
    out = R.summary(_scored(spark, sf_dir), "reward", ["wer", "entity", "repetition", "semantic", "number"])
    return out.select(*(_r(F.col(c)).alias(c) if c != "n" else F.col("n") for c in out.columns))


def augmented_split(spark, sf_dir):
    """Odd documents stand for augmented clips."""
    p = _scored(spark, sf_dir).withColumn("is_augmented", F.col("doc_id") % 2 == 1)
    out = R.augmented_split(p, "reward", "wer", "entity")
    return out.select(*(F.col(c) if c.startswith("n_") else _r(F.col(c)).alias(c) for c in out.columns))


def score_buckets(spark, sf_dir):
    out = R.score_buckets(_scored(spark, sf_dir).withColumn("reward", _r(F.col("reward"))), "reward")
    return out.select("bucket", "n", _r(F.col("percent")).alias("percent"))


def rerank_topk(spark, sf_dir):
    """The best three documents of each language and source by similarity to their corrupted copy."""
    p = text_pairs(spark, sf_dir).select("doc_id", "lang", "source", _r(M.jaccard_folded(F.col("r"), F.col("h"))).alias("score"))
    return R.rerank(p, ["lang", "source"], "score", "doc_id", 3).select("lang", "source", "rank", "doc_id", "score")


def binarize(spark, sf_dir):
    p = text_pairs(spark, sf_dir).select("doc_id", _r(M.jaccard_folded(F.col("r"), F.col("h"))).alias("score"))
    return R.binarized(p, "score").select("doc_id", "prediction", "label", "confidence")


def calibration_metrics(spark, sf_dir):
    """A text-quality score against the labels' quality."""
    d = _docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"), "text")
    d = d.select("doc_id", F.round(1 - F.least(T.special_ratio("text") * 2, F.lit(1.0)), 3).alias("confidence"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    out = R.calibration(d.withColumn("prediction", (F.col("confidence") >= 0.6).cast("int")), "prediction", "label", "confidence")
    return out.select(*(F.round(F.col(c), 5).alias(c) for c in out.columns))


def _features(spark, sf_dir) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "text", T.tokens("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("double").alias("word_count"), T.mean_word_length("w").alias("avg_word_length"), T.punct_ratio("text").alias("punct_ratio"), T.digit_ratio("text").alias("digit_ratio"), T.special_ratio("text").alias("special_ratio"), T.char_diversity("text").alias("char_diversity"))


FEATURES = ["word_count", "avg_word_length", "punct_ratio", "digit_ratio", "special_ratio", "char_diversity"]


def standard_scale(spark, sf_dir):
    out = R.standard_scale(_features(spark, sf_dir).select("doc_id", "word_count", "avg_word_length"), ["word_count", "avg_word_length"], ~R.holdout(F.col("doc_id")))
    return out.select("doc_id", R.holdout(F.col("doc_id")).alias("held_out"), F.round("word_count", 5).alias("word_count"), F.round("avg_word_length", 5).alias("avg_word_length"))


def regression_metrics(spark, sf_dir):
    d = _features(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out = R.regression(d.withColumn("p", 1 - F.least(F.col("special_ratio") * 2, F.lit(1.0))), "quality", "p")
    return out.select(*(F.round(F.col(c), 5).alias(c) for c in out.columns))


def _training(spark, sf_dir) -> DataFrame:
    return _features(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")


def rf_fit(spark, sf_dir):
    d = _training(spark, sf_dir)
    model = models.fit(d.where(~R.holdout(F.col("doc_id"))), FEATURES, "label")
    return models.predict(d.where(R.holdout(F.col("doc_id"))), model).select("doc_id", "label", F.col("prediction").alias("predicted_score"))


def gbt_fit(spark, sf_dir):
    d = _training(spark, sf_dir)
    model = models.fit(d.where(~R.holdout(F.col("doc_id"))), FEATURES, "label", models.boosted("label"))
    return models.predict(d.where(R.holdout(F.col("doc_id"))), model).select("doc_id", "label", F.col("prediction").alias("predicted_score"))


def feature_importance(spark, sf_dir):
    model = models.fit(_training(spark, sf_dir), FEATURES, "label")
    return models.importance(spark, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import flows

    own = {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k not in ("queries", "oracle_sql") and getattr(f, "__module__", "") == __name__}
    return own | flows.queries()


def oracle_sql() -> dict[str, str]:
    from . import oracles, oracles_flows

    return oracles.SQL | oracles_flows.SQL
