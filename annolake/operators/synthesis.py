"""Notes that a language model has written, with the entities that it lists. Generating them is the
model's work; reading its answers is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators.resolve import drop_overlapping
from annolake.schema import no_spans
from annolake.sources.readers import align_tags

#: How an answer says its note and its entities, and what ends them if the model goes on talking.
QUOTED_NOTE = r'(?i)Clinical\s+Note:\s*"([^"]*)"'
PLAIN_NOTE = r"(?i)Clinical\s+Note:\s*([^\n]+)"
ENTITIES = r"(?is)PHI:\s*(.+)"
AFTER = r"(?s)(?:\n\n|\nPlease|\nNote:|\n```).*"
LISTS = "map<string,array<string>>"


def rfind(text: Column, part: str) -> Column:
    """The place of the last ``part``, -1 for none."""
    back = F.locate(part[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - len(part) + 1).otherwise(F.lit(-1))


def _lists(blob: Column) -> Column:
    """map<label, values> of a JSON object: a list stays, one value is a list of it, null is none; single quotes around
    keys are forgiven."""
    each = lambda s: F.transform_values(F.from_json(s, "map<string,string>"), lambda k, v: F.coalesce(F.from_json(v, "array<string>"), F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.array(v))))
    return F.coalesce(each(blob), each(F.regexp_replace(blob, r"'([^']*)'\s*:", '"$1":')))


def _loose(blob: Column) -> Column:
    """map<label, values> of whatever looks like "LABEL": [values]."""
    found = F.regexp_extract_all(blob, F.lit(r'("[^"]+"\s*:\s*\[[^\]]*\])'), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'"([^"]+)"', 1).alias("k"), F.from_json(F.regexp_extract(x, r"(?s)(\[.*\])", 1), "array<string>").alias("v")))
    last = F.aggregate(F.filter(pairs, lambda p: p["v"].isNotNull()), F.create_map().cast(LISTS), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))
    return last


def parsed(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """``answers`` with note and entities (map<label, values>). The note is what stands in quotes after "Clinical Note:",
    else the rest of its line, else a JSON answer's clinical_note, else all of the answer. Entities are a JSON object
    after "PHI:", else whatever reads like lists there, else what the JSON answer has under phi, PHI or entities."""
    body = F.trim(F.col(raw))
    # escaped quotes stand aside while the closing one is looked for
    aside = F.replace(F.replace(body, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    quoted = F.replace(F.replace(F.regexp_extract(aside, QUOTED_NOTE, 1), F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))
    plain = F.regexp_extract(body, PLAIN_NOTE, 1)
    spoken = F.coalesce(F.get_json_object(F.concat(F.lit('{"x":"'), F.regexp_replace(quoted, "\n", "\\\\n"), F.lit('"}')), "$.x"), F.replace(quoted, F.lit('\\"'), F.lit('"')))
    note = F.when(aside.rlike(QUOTED_NOTE), spoken).when(plain != "", F.trim(F.regexp_replace(F.trim(plain), ",+$", "")))
    blob = F.trim(F.regexp_replace(F.regexp_extract(body, ENTITIES, 1), AFTER, ""))
    inner = F.regexp_extract(blob, r"(?s)(\{.*\})", 1)
    whole = F.when(F.startswith(body, F.lit("{")), body)
    listed = F.coalesce(F.get_json_object(whole, "$.phi"), F.get_json_object(whole, "$.PHI"), F.get_json_object(whole, "$.entities"))
    some = lambda m: F.when(F.size(m) > 0, m)
    said = F.coalesce(some(_lists(inner)), some(_loose(blob)))
    entities = F.when(body.rlike(ENTITIES), said).when(note.isNull(), _lists(listed))
    own = F.when(~body.rlike(ENTITIES), F.get_json_object(whole, "$.clinical_note"))
    return answers.withColumn("note", F.trim(F.coalesce(F.nullif(note, F.lit("")), own, body))).withColumn("entities", F.coalesce(entities, F.create_map().cast(LISTS)))


def documents_of(answers: DataFrame, raw: str = "raw", doc_id: str = "doc_id", keep_overlapping: bool = False) -> DataFrame:
    """(doc_id, text, spans) of model answers: each listed value is found in the note from where the last one ended."""
    p = parsed(answers, raw)
    tags = F.flatten(F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.transform(e["value"], lambda v: F.struct(v.alias("value"), e["key"].alias("label")))))
    tags = F.filter(tags, lambda t: F.length(t["value"]) > 0)
    spans = F.coalesce(align_tags(F.col("note"), tags), no_spans())
    spans = F.transform(spans, lambda s: s.withField("source", F.lit("llm_phi_dict")))
    return p.select(doc_id, F.col("note").alias("text"), (spans if keep_overlapping else drop_overlapping(spans)).alias("spans"))
