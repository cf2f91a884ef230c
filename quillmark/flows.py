"""Queries of sources, sinks, annotators, audio and models: what is written is read again by the matching source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import queries as Q
from .functions import edit, json as js, metrics as M, text as T
from .operators import annotate, audio, models, report as R, stt
from .pairs import FILLER, documents, hearings, table, text_pairs, timed_turns
from .plans import rehear, repair
from .shared import new_path, staged
from .ship import ship
from .sources import io


#: Of the settings that augmentation draws once a run.
SEED = 7
#: Clips of a task.
CLIPS = 200


def _items(spark, sf_dir) -> DataFrame:
    """Documents as ground-truth items; every second one is an original without lineage."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sample_"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_path"), F.col("text").alias("reference_text"))
    odd = F.col("doc_id") % 2 == 1
    return d.withColumn("original_audio", F.when(odd, F.concat(F.lit("sample_"), (F.col("doc_id") - 1).cast("string"), F.lit(".wav")))).withColumn("is_augmented", F.when(odd, F.lit(True))).drop("doc_id")


def ground_truth_scan(spark, sf_dir):
    path = new_path(spark, "ground-truth")
    io.write_array(_items(spark, sf_dir), path)
    return io.ground_truth(spark, path)


def training_scan(spark, sf_dir):
    path = new_path(spark, "ladder")
    io.write_array(Q.corruption_ladder(spark, sf_dir).select("transcript", "quality_score", "wer", "label"), path)
    return io.ladder(spark, path)


def combined_dataset(spark, sf_dir):
    """Originals and two variants of each, with their lineage, written as one data set and read back."""
    original = _items(spark, sf_dir).select("audio_path", "reference_text")
    made = audio.variants(original, 2, key="audio_path").select(F.col("name").alias("audio_path"), "reference_text", F.col("audio_path").alias("original_audio"), F.lit(True).alias("is_augmented"))
    path = new_path(spark, "combined")
    io.write_array(io.combined(original, made), path)
    return io.ground_truth(spark, path)


def _replies(spark, sf_dir) -> DataFrame:
    """conv_id, segments: each conversation's turns as a recogniser's reply."""
    t = timed_turns(spark, sf_dir)
    segment = F.struct("turn", F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), F.col("transcript").alias("text"), "speaker")
    out = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("s"))  # a reply is a conversation
    return out.select("conv_id", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["speaker"].alias("speaker"))).alias("segments"))


def stt_folder_scan(spark, sf_dir):
    """A reply file per conversation, read back as a folder."""
    path = new_path(spark, "replies")
    _replies(spark, sf_dir).repartition("conv_id").write.partitionBy("conv_id").json(path)
    rows = io.stt_outputs(spark, path).withColumn("conv_id", F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long"))
    return rows.select("conv_id", "pos", Q._r(F.col("start_ts")).alias("start_ts"), Q._r(F.col("end_ts")).alias("end_ts"), "transcript", "speaker")


def stt_reference_scan(spark, sf_dir):
    """Every conversation's reply and its reference, paired by name, as graded training samples: the reply leaves out words."""
    t = Q.full_transcript(spark, sf_dir).withColumn("name", F.concat(F.lit("conv_"), F.col("conv_id").cast("string")))
    heard = F.array_join(T.corrupted(T.tokens("transcript"), double=None, filler=FILLER), " ")
    replies, references = new_path(spark, "replies"), new_path(spark, "references")
    t.select("name", F.to_json(F.struct(heard.alias("transcript"))).alias("text")).write.json(replies)
    t.select("name", F.col("transcript").alias("text")).write.json(references)
    out = io.training_samples(io.stt_with_reference(io.named_texts(spark, replies), io.named_texts(spark, references)))
    return out.select("name", "transcript", "reference", "quality_score")


def training_set(spark, sf_dir):
    """Pairs as graded samples."""
    p = text_pairs(spark, sf_dir).select("doc_id", F.col("ref").alias("reference"), F.col("hyp").alias("transcript"))
    return io.training_samples(p).select("doc_id", "quality_score")


def results_json(spark, sf_dir):
    path = new_path(spark, "results")
    d = Q.token_stats(spark, sf_dir)
    io.write_results(d, path)
    return spark.read.schema(d.schema).json(path)


def segments_json(spark, sf_dir):
    path = new_path(spark, "segments")
    d = timed_turns(spark, sf_dir).select("conv_id", "turn", Q._r(F.col("start_ts")).alias("start_ts"), Q._r(F.col("end_ts")).alias("end_ts"), "transcript", "speaker")
    io.write_results(d, path)
    return spark.read.schema(d.schema).json(path)


def text_outputs(spark, sf_dir):
    """The cleaned texts as one file in the order of documents, which all tasks write together; their places in it with them."""
    path = new_path(spark, "texts") + "/cleaned.txt"
    io.write_one_text(Q.clean_text(spark, sf_dir), "cleaned", path, ["doc_id"])
    return spark.read.text(path).withColumnRenamed("value", "cleaned")


def calibration_payload(spark, sf_dir):
    path = new_path(spark, "payload")
    io.write_calibration(Q.binarize(spark, sf_dir), path, rows=500)
    return io.calibration_pairs(spark, path, lines=True)


def reply_path(spark, sf_dir):
    """A turn's text out of a nested reply; every fifth reply has no candidates."""
    t = table(spark, sf_dir, "conversations")
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    reply = F.when(F.col("turn") % 5 == 4, F.lit('{"candidates":[]}')).otherwise(nested)
    return t.select("conv_id", "turn", js.reply_text(reply).alias("text"))


def number_reply(spark, sf_dir):
    """The numbers of a judge's reply about each document: fenced, bare, without the list or broken."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    body = F.to_json(F.struct(F.array(F.col("doc_id").cast("string"), F.concat(F.col("n_chars").cast("string"), F.lit(".5"))).alias("numbers")))
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("Found:\n```json\n"), body, F.lit("\n```"))).when(k == 1, body).when(k == 2, F.lit('{"digits": ["1"]}')).otherwise(F.lit("none"))
    return d.select("doc_id", F.array_join(js.reply_numbers(reply), " ").alias("numbers"))


def similarity_reply(spark, sf_dir):
    """A judge's number out of its reply, else the pair's own similarity."""
    p = text_pairs(spark, sf_dir).select("doc_id", "r", "h")
    k = F.col("doc_id") % 4
    number = ((F.col("doc_id") % 150) / 100.0).cast("string")
    reply = F.when(k == 0, F.concat(F.lit("Similarity: "), number, F.lit(" of 1"))).when(k == 1, F.concat(F.lit("-"), number)).when(k == 2, F.lit("cannot say"))
    return p.select("doc_id", Q._r(M.similarity(F.col("r"), F.col("h"), M.judged_number(reply))).alias("similarity"), F.when(M.judged_number(reply).isNotNull(), "judge").otherwise("words").alias("backend"))


def noun_rehearing(spark, sf_dir):
    """Each conversation's first nouns by their times in overlapping segments, heard again in a second hearing, and the text with them."""
    segments, words = hearings(spark, sf_dir)
    out = rehear.rehear(segments, rehear.SecondHearing(words))
    return out.select(F.col("recording").alias("conv_id"), "corrected", "n_nouns", "n_heard")


def _marked(chunk: Column) -> Column:
    """Stands for a model: its work can be told from the text."""
    return F.concat(F.lit("<"), chunk, F.lit(">"))


def repair_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    return repair.repair(d, "doc_id", "text", annotate.LocalRules(_marked)).select("doc_id", "repaired")


def _fixed(chunk: Column) -> Column:
    """Changes every ninth word of a chunk, so that overlapping chunks don't agree on all words they share."""
    return F.array_join(F.transform(T.tokens(chunk), lambda w, i: F.when(i % 9 == 4, F.concat(w, F.lit("_"), i.cast("string"))).otherwise(w)), " ")


def repair_merged(spark, sf_dir):
    """Overlapping chunks, changed one by one and joined by content: each sentence once."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    return repair.repair(d, "doc_id", "text", annotate.LocalRules(_fixed), dedup_overlap=True).select("doc_id", "repaired")


def translate_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    return repair.translate(d, "doc_id", "text", annotate.LocalRules(_marked)).select("doc_id", "translated")


def remote_annotation(spark, sf_dir):
    """Each distinct event type is asked once, under a job-wide rate."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return annotate.annotate(e, "event_type", annotate.Remote(str.upper, calls_per_minute=6000, partitions=2)).select("event_id", "event_type", "annotation", "backend")


def _clips(spark, sf_dir) -> DataFrame:
    """conv_id, audio_path, content: a falling tone of one second for each conversation, every third at 8 kHz."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f["conv_id"]:
                rate = 8000 if k % 3 == 0 else 16000
                t = np.arange(rate) / rate
                out.append(audio.encode_wav(0.6 * np.exp(-2 * t) * np.sin(2 * np.pi * (110 + 10 * (k % 40)) * t), rate))
            yield f.assign(audio_path=[f"clip_{k}.wav" for k in f["conv_id"]], content=out)

    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    # ids are small and Spark would put all of them into one task, their clips are work
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-ids.count() // CLIPS))
    return ids.repartition(parts, "conv_id").mapInPandas(run, "conv_id long, audio_path string, content binary")


def audio_features(spark, sf_dir):
    out = audio.stats_of(_clips(spark, sf_dir).select(F.col("audio_path").alias("path"), "content"))
    return out.select("path", *(Q._r(F.col(c)).alias(c) for c in out.columns[1:]))


def audio_variants(spark, sf_dir):
    """Five variants of each clip by settings drawn once, with a hum as background, as files in the shared folder, and how many samples
    each file has."""
    folder = new_path(spark, "variants")
    clips = _clips(spark, sf_dir).select(F.col("audio_path").alias("path"), "content")
    hum = 0.3 * np.sin(2 * np.pi * 50 * np.arange(4000) / 16000)
    # a clip becomes its files in one task: no table holds their content once more
    made = audio.augmented(clips, 5, audio.drawn(SEED), hum)
    files = staged(audio.write_clips(made, folder, ("path", "variant", "kind", "name")), "variants-files")
    return files.select("name", "path", "variant", "kind", ((F.col("size") - 44) / 2).cast("long").alias("n_samples"))


def audio_probe(spark, sf_dir):
    """The file of each sample: every third has none, every sixth two."""
    ids = _clips(spark, sf_dir).select(F.col("conv_id").alias("sample_id"), "content")
    kinds = F.when(F.col("sample_id") % 3 == 2, F.array().cast("array<string>")).when(F.col("sample_id") % 6 == 0, F.array(F.lit("wav"), F.lit("mp3"))).otherwise(F.array(F.lit("wav")))
    folder = new_path(spark, "samples")
    staged(audio.write_clips(ids.withColumn("kind", F.explode(kinds)).withColumn("name", F.concat(F.lit("sample_"), F.col("sample_id").cast("string"), F.lit("."), F.col("kind"))), folder), "samples-files")
    found = io.audio_files(spark, ids.select("sample_id"), folder)
    return found.select("sample_id", F.regexp_extract("audio_path", r"([^/]*)$", 1).alias("file"))


def stt_batch(spark, sf_dir):
    """Replies that were made before, decoded clip by clip."""
    known = _replies(spark, sf_dir).select("conv_id", F.concat(F.lit("clip_"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("audio_path"), F.to_json(F.struct("segments")).alias("reply"))
    clips = known.select("audio_path")
    rows = stt.transcribe_batch(clips, stt.PrecomputedReplies(known.select("audio_path", "reply")))
    return rows.select("audio_path", "pos", Q._r(F.col("start_ts")).alias("start_ts"), Q._r(F.col("end_ts")).alias("end_ts"), "transcript", "speaker")


def _heard(content, language: str) -> str:
    x, rate = audio.decode_wav(content)
    return json.dumps({"transcript": f"{len(x)} samples at {rate} in {language}"})


def stt_slices(spark, sf_dir):
    """Two slices of each clip heard again by a backend that says what it was given."""
    clips = _clips(spark, sf_dir)
    times = F.explode(F.array(F.struct(F.lit(0.0).alias("start_ts"), F.lit(0.25).alias("end_ts")), F.struct(F.lit(0.5).alias("start_ts"), F.lit(2.0).alias("end_ts"))))
    rows = clips.select("audio_path", "content", times.alias("t")).select("audio_path", "content", "t.*")
    return stt.transcribe_slices(rows, stt.RemoteReplies(_heard), "en")


def text_features(spark, sf_dir):
    """The regressor's 14 text features of each document's pair."""
    p = edit.aligned(text_pairs(spark, sf_dir).select("doc_id", "ref", "hyp", F.col("r").alias("ref_words"), F.col("h").alias("hyp_words")))
    r, h, n, m = F.col("ref_words"), F.col("hyp_words"), F.size("ref_words"), F.size("hyp_words")
    rates = {"wer": edit.error_rate(F.col("distance"), n, m), "mer": edit.match_error_rate(F.col("distance"), F.col("hits")), "wil": edit.information_lost(F.col("hits"), n, m)}
    rewards = {f"{k}_reward": edit.reward(v) for k, v in rates.items()}
    cols = {"semantic_similarity": M.similarity(r, h), "token_overlap": M.token_overlap(r, h), "length_ratio": M.length_ratio(n, m)}
    cols |= {"word_count": m, "avg_word_length": T.mean_word_length(h), "repetition_ratio": T.global_repetition(h), "char_diversity": T.char_diversity("hyp"), "punct_ratio": T.punct_ratio("hyp"), "digit_ratio": T.digit_ratio("hyp")}
    cols |= rewards | {"length_penalty": M.length_penalty(n, m), "quality_score": M.heuristic_quality(*rewards.values(), M.length_penalty(n, m))}
    return p.select("doc_id", *(Q._r(c.cast("double")).alias(k) for k, c in cols.items()))


def features36(spark, sf_dir):
    """The 36 features of each document: its pair's text features, and the sound of the clip of its number; without a clip the audio
    features are defaults."""
    p = text_features(spark, sf_dir)
    heard = audio.stats_of(_clips(spark, sf_dir).select(F.col("conv_id").cast("string").alias("path"), "content")).withColumn("doc_id", F.col("path").cast("long")).drop("path")
    names = [*audio.PROSODY, *audio.FLUENCY, *p.columns[1:]]
    return models.with_defaults(p.join(heard, "doc_id", "left"), names).select("doc_id", *(Q._r(F.col(k)).alias(k) for k in names))


def default_features(spark, sf_dir):
    """The reranker's features; every seventh document is a sample that failed."""
    p = Q.rerank_features(spark, sf_dir)
    names = p.columns[1:]
    p = p.select("doc_id", *(F.when(F.col("doc_id") % 7 != 0, F.col(k)).alias(k) for k in names), F.when(F.col("doc_id") % 7 != 0, F.col("wer_reward")).alias("target"))
    return models.with_defaults(p, names, "target")


def cross_validation(spark, sf_dir):
    mse, std = models.cross_validated(Q._training(spark, sf_dir), Q.FEATURES, "label")
    return spark.createDataFrame([(5, mse, std, (2 * std) ** 0.5)], "folds int, mse double, std double, spread double")


def model_artefact(spark, sf_dir):
    """A forest saved, loaded and applied to the held-out part."""
    d = Q._training(spark, sf_dir)
    path = new_path(spark, "model")
    models.save(models.fit(d.where(~R.holdout(F.col("doc_id"))), Q.FEATURES, "label"), path)
    return models.predict(d.where(R.holdout(F.col("doc_id"))), models.load(path)).select("doc_id", F.col("prediction").alias("predicted_score"))


def rerank_model(spark, sf_dir):
    """The best three documents of each language and source by a fitted model's score; a missing score counts as 0."""
    d = Q._features(spark, sf_dir)
    model = models.fit(Q._training(spark, sf_dir), Q.FEATURES, "label")
    scored = models.predict(d, model).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return R.rerank(scored, ["lang", "source"], "prediction", "doc_id", 3).select("lang", "source", "rank", "doc_id", F.col("prediction").alias("predicted_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k != "queries" and getattr(f, "__module__", "") == __name__}
