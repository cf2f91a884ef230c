"""Decoding of recognisers' and annotators' JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SEGMENT = "struct<start:double,start_time:double,start_ts:double,end:double,end_time:double,end_ts:double,text:string,transcript:string,speaker:string,speaker_id:string,speaker_label:string>"
_ENTRY = "struct<start_time_seconds:double,end_time_seconds:double,transcript:string,speaker_id:string>"
SCHEMA = f"struct<diarized_transcript:struct<entries:array<{_ENTRY}>>,segments:array<{_SEGMENT}>,results:array<struct<segments:array<{_SEGMENT}>>>,data:struct<segments:array<{_SEGMENT}>>,transcript:string>"
DEFAULT_SPEAKER = "SPEAKER_00"


def _out(start, end, text, speaker) -> Column:
    return F.struct(
        F.coalesce(start, F.lit(0.0)).alias("start_ts"), F.coalesce(end, F.lit(0.0)).alias("end_ts"),
        F.coalesce(text, F.lit("")).alias("transcript"), F.coalesce(speaker, F.lit(DEFAULT_SPEAKER)).alias("speaker"),
    )


def _segment(s: Column) -> Column:
    return _out(F.coalesce(s["start"], s["start_time"], s["start_ts"]), F.coalesce(s["end"], s["end_time"], s["end_ts"]), F.coalesce(s["text"], s["transcript"]), F.coalesce(s["speaker"], s["speaker_id"], s["speaker_label"]))


def stt_segments(reply: Column) -> Column:
    """array<struct<start_ts, end_ts, transcript, speaker>> of a reply in any of five shapes; a null field is a missing one.

    Diarized entries come first, then segments, the first result that has the field (an empty one, too), the data's segments, the bare transcript.
    """
    j = F.from_json(reply, SCHEMA)
    results = F.filter(j["results"], lambda r: r["segments"].isNotNull())
    whole = F.when(j["transcript"].isNotNull(), F.array(_out(F.lit(0.0), F.lit(0.0), j["transcript"], F.lit(DEFAULT_SPEAKER))))
    return F.coalesce(
        F.transform(j["diarized_transcript"]["entries"], lambda e: _out(e["start_time_seconds"], e["end_time_seconds"], e["transcript"], e["speaker_id"])),
        F.transform(j["segments"], _segment),
        F.when(F.size(results) > 0, F.transform(F.get(results, F.lit(0))["segments"], _segment)),
        F.transform(j["data"]["segments"], _segment),
        whole,
        F.array().cast("array<struct<start_ts:double,end_ts:double,transcript:string,speaker:string>>"),
    )


def fenced(reply: Column) -> Column:
    """The JSON object inside a fence, else the whole reply."""
    inner = F.regexp_extract(reply, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    return F.when(F.length(inner) > 0, inner).otherwise(reply)


def fenced_object(reply: Column, schema: str) -> Column:
    """The fenced object by ``schema``; null where it can't be parsed."""
    return F.from_json(fenced(reply), schema)


def reply_numbers(reply: Column) -> Column:
    """The digit strings of an annotator's {"numbers": [...]}, fenced or not; none where there is no such list."""
    return F.coalesce(fenced_object(reply, "numbers array<string>")["numbers"], F.array().cast("array<string>"))


def reply_text(reply: Column) -> Column:
    return F.get_json_object(reply, "$.candidates[0].content.parts[0].text")


def word_confidences(data: Column) -> Column:
    """Confidences at timestamps.words: an object's own (0.8 if it has none), a plain string's 0.8."""
    items = F.from_json(F.get_json_object(data, "$.timestamps.words"), "array<string>")
    return F.transform(items, lambda w: F.coalesce(F.get_json_object(w, "$.confidence").try_cast("double"), F.lit(0.8)))
