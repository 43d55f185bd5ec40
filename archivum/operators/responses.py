"""Model responses landed as text: payload, repair, attempts, conformance, stamps, audit."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from . import schema

RESULT = "result map<string, string>"
# The categories and sections that a record may name.
SECTIONS = (
    "people_subjects", "clothing_fashion", "objects_artifacts", "animals_pets", "setting_environment", "architecture_built", "events_occasions",
    "photo_format", "written_elements_identifiers", "activities_actions", "emblems_symbols_context", "landscape_nature", "documents_records", "date_reference",
)


def payload(s: Column) -> Column:
    """The JSON text of a reply: a fence marked json, else any fence, else from the first brace to
    the last, else all of it."""
    s = F.coalesce(s, F.lit(""))
    marked = F.regexp_extract(s, r"(?is)```json\s*(.*?)\s*```", 1)
    fenced = F.regexp_extract(s, r"(?s)```\s*(.*?)\s*```", 1)
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    braces = (first > 0) & (last > first) & (F.instr(s, "}") > 0)
    fence = F.when(s.rlike(r"(?is)```json.*```"), marked).when(s.rlike(r"(?s)```.*```"), fenced)
    return F.coalesce(F.when(s.contains("```"), fence), F.when(braces, F.substring(s, first, last - first + 1)), s)


def without_marks(raw: Column) -> Column:
    """Without list or diff marks at line starts: of a diff the new side, of a list its entries."""
    lines = F.split(raw, "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    minus, plus = n(r"^\s*- "), n(r"^\s*\+ ")
    bare = lambda x, sign: F.regexp_replace(x, rf"^(\s*)\{sign} (\s*[\"\[{{}}\]0-9\-tfn].*)$", "$1$2")
    diff = F.transform(F.filter(lines, lambda x: ~x.rlike(r"^\s*- ")), lambda x: bare(x, "+"))
    return F.when((minus >= 3) & (plus >= 3), F.array_join(diff, "\n")).when(minus >= 3, F.array_join(F.transform(lines, lambda x: bare(x, "-")), "\n")).otherwise(raw)


def collapsed(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?:\[ ?\? ?\][\s,]*){5,}", "[illegible] ")


def mended(text: str) -> str:
    """Brackets that close the wrong way, colons after lists, trailing commas, missing ends and raw
    control characters in strings put right; one pass with a stack of open brackets."""
    out: list[str] = []
    stack: list[str] = []
    closer = {"{": "}", "[": "]"}
    quoted = escaped = False

    solid = -1  # where in ``out`` the last character outside strings stands that isn't white space

    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            elif ord(c) < 32:
                c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\u{ord(c):04x}")
            out.append(c)
            solid = len(out) - 1
        elif c.isspace():
            out.append(c)
        else:
            before = out[solid] if solid >= 0 else ""
            if c in "}]":
                if before == ",":
                    out[solid] = ""
                c = closer[stack.pop()] if stack else ""
            elif c in closer:
                stack.append(c)
            elif c == ":" and before in ("]", "}"):
                c = ","
            quoted = c == '"'
            if c:
                out.append(c)
                solid = len(out) - 1
    return "".join(out + [closer[c] for c in reversed(stack)])


def _mended_json(s: pd.Series) -> pd.DataFrame:
    """Mended texts that are JSON then; null for hopeless ones, with the place of the fault in the
    text as it came."""

    def one(x: str | None) -> tuple[str | None, int | None]:
        if x is None:
            return None, None
        try:
            return json.dumps(json.loads(mended(x), strict=False), ensure_ascii=False), None
        except ValueError:
            try:
                json.loads(x, strict=False)
            except json.JSONDecodeError as e:
                return None, e.pos
            return None, 0

    return pd.DataFrame([one(x) for x in s], columns=["json", "at"]).astype({"json": object, "at": "Int32"})


CONTEXT = 80


def parse_responses(responses: DataFrame, details: bool = False, keys: Sequence[str] = ("group_key", "attempt")) -> DataFrame:
    """(group_key, attempt, or other ``keys``; status, json): ok, repaired or failed; with ``details`` also stage and
    context of failures: where the repair stopped, and the text around that place.

    Every reply is read and parsed once, step by step in projections of their own. The Python repair
    gets nulls for what the strict parse accepted."""
    p = responses.select(*keys, rules.strip(F.coalesce("raw", F.lit(""))).alias("s")).select(*keys, payload(F.col("s")).alias("s"))
    p = p.select(*keys, rules.strip(F.col("s")).alias("s")).select(*keys, without_marks(F.col("s")).alias("s")).select(*keys, collapsed(F.col("s")).alias("text"))
    p = p.withColumn("ok", F.expr("try_parse_json(text)").isNotNull())
    p = p.withColumn("m", F.pandas_udf(_mended_json, "json string, at int")(F.when(~F.col("ok"), F.col("text"))))
    fixed = F.col("m.json")
    status = F.when(F.col("ok"), "ok").when(fixed.isNull(), "failed").otherwise("repaired")
    out = p.select(*keys, status.alias("status"), F.when(F.col("ok"), F.col("text")).otherwise(fixed).alias("json"), "text", F.col("m.at").alias("at"))
    if not details:
        return out.drop("text", "at")
    failed = F.col("status") == "failed"
    around = F.substring("text", F.greatest(F.lit(1), F.col("at") - CONTEXT + 1), F.least(F.col("at"), F.lit(CONTEXT)) + CONTEXT)
    stage = F.when(F.col("text") == "", "empty").when(~F.contains("text", F.lit("{")), "no object").otherwise("lenient parse")
    return out.select(*keys, "status", "json", F.when(failed, stage).alias("stage"), F.when(failed, around).alias("context"))


def failures(parsed: DataFrame) -> DataFrame:
    """(group_key, attempt, stage, context) of groups without a usable reply, for their last one
    (parsed: ``parse_responses`` with details)."""
    g = parsed.groupBy("group_key").agg(F.count_if(F.col("status") != "failed").alias("good"), F.max_by(F.struct("attempt", "stage", "context"), "attempt").alias("x"))
    return g.where("good = 0").select("group_key", "x.*")


def first_usable(parsed: DataFrame, *further: str, failure: bool = False) -> DataFrame:
    """Each group's lowest attempt that isn't failed; groups without one have status failed. ``further`` keys part a
    group's replies. With ``failure`` also the last failed attempt (further, attempt, stage, context; of replies parsed with details)."""
    use = F.when(F.col("status") != "failed", F.struct("attempt"))
    last = [F.max(F.when(F.col("status") == "failed", F.struct(*further, "attempt", "stage", "context"))).alias("failure")] if failure else []
    return parsed.groupBy("group_key", *further).agg(F.coalesce(F.min_by("status", use), F.lit("failed")).alias("status"), F.min_by("attempt", use).alias("attempt"), F.min_by("json", use).alias("json"), F.max("attempt").alias("last_attempt"), *last)


def retry_queue(parsed: DataFrame) -> DataFrame:
    """Groups to ask again, with the number of the next attempt."""
    return first_usable(parsed).where("status = 'failed'").select("group_key", (F.col("last_attempt") + 1).alias("attempt"))


def flatten_result(parsed: DataFrame, expected: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(group_key, keep, record): the record under the expected path (expected: group_key, main_path),
    else the only one there is; null else."""
    return parsed.join(expected, "group_key").select("group_key", *keep, record_of("json", "main_path").alias("record"))


def record_of(reply: str, main_path: str) -> Column:
    """The record of a reply's JSON text under the path, else the only one there is; null else."""
    return rules.bind(F.from_json(reply, RESULT)["result"], lambda r: F.coalesce(r[F.col(main_path)], F.when(F.size(r) == 1, F.map_values(r)[0])))


RULES = ("three_keywords", "has_caption", "confidence_range", "import_date_form", "pattern_form", "date_keyword", "date_keyword_matches")


def conformance(analyses: DataFrame) -> DataFrame:
    """(group_key, ord, rule, ok) of every analysis and rule."""
    k, conf = F.col("keywords"), F.col("date_confidence")
    marker = F.array_max(F.filter(F.transform(k, rules.strip), lambda x: F.upper(x).startswith("DATE:")))
    checks = {
        "three_keywords": F.size(k) >= 3, "has_caption": rules.blank_to_null(F.col("caption")).isNotNull(), "confidence_range": conf.isNull() | conf.between(0, 1),
        "import_date_form": F.col("import_date").isNull() | F.col("import_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "pattern_form": F.col("pattern").isNull() | rules.valid_pattern(F.col("pattern")),
        "date_keyword": marker.isNotNull(), "date_keyword_matches": marker.isNull() | (marker == F.concat(F.lit("DATE: "), F.col("pattern"))),
    }
    named = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()])
    return analyses.select("group_key", "ord", F.explode(named).alias("r")).select("group_key", "ord", "r.rule", "r.ok")


def conformance_rates(analyses: DataFrame) -> DataFrame:
    return conformance(analyses).groupBy("rule").agg(F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("n"))


# The categories, scopes and fields of a record.
CATEGORIES = ("Portrait", "Group photo", "Photo Page", "Candid", "Landscape", "Cityscape", "Document", "Postcard", "Travel Photo", "Event", "Art photo")
SCOPES = ("general", "specific")
REQUIRED = ("keywords", "caption", "ai_caption", "title", "category", "location_guess", "date_guess")
FIELDS = {"record": (*REQUIRED, "proposed_new_keywords"), "location_guess": ("country", "state", "city", "sublocation", "confidence"), "date_guess": ("iso", "confidence", "import_date", "pattern"), "proposal": ("keyword", "note", "section", "scope")}
RECORD = (
    "keywords array<string>, caption string, ai_caption string, title string, category string, location_guess struct<country: string, state: string, city: string, sublocation: string, confidence: double>, "
    "date_guess struct<iso: string, confidence: double, import_date: string, pattern: string>, proposed_new_keywords array<struct<keyword: string, note: string, section: string, scope: string>>, analysis_notes string"
)
RECORD_RULES = (
    "is_object", "required_fields", "no_extra_fields", "category_known", "category_keyword", "provenance_keyword", "ai_caption_start", "ai_caption_end", "location_fields", "location_range", "date_fields", "date_range", "proposal_fields", "proposal_sections", "proposal_scopes",
)


def record_schema() -> dict:
    """The schema of one record."""
    text, maybe, share = {"type": "string"}, {"type": ["string", "null"]}, {"type": "number", "minimum": 0.0, "maximum": 1.0}
    sections = [s for s in SECTIONS if s != "date_reference"]
    proposal = schema.fixed_object({k: text for k in FIELDS["proposal"]} | {"section": {"type": "string", "enum": sections}, "scope": {"type": "string", "enum": list(SCOPES)}})
    fields = {
        "keywords": {"type": "array", "items": text, "minItems": 3}, "caption": text, "ai_caption": text, "title": maybe, "category": {"type": "string", "enum": list(CATEGORIES)},
        "location_guess": schema.fixed_object({k: maybe for k in FIELDS["location_guess"]} | {"confidence": share}),
        "date_guess": schema.fixed_object({k: text for k in FIELDS["date_guess"]} | {"confidence": share, "import_date": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}}),
        "proposed_new_keywords": {"type": "array", "items": proposal},
    }
    return schema.fixed_object(fields, optional=("proposed_new_keywords",))


def reply_schema() -> dict:
    """The schema of a whole reply: records keyed by path below ``result``."""
    return schema.fixed_object({"result": {"type": "object", "additionalProperties": record_schema()}})


def record_conformance(records: DataFrame) -> DataFrame:
    """(group_key, ord, rule, ok) of every record (group_key, ord, record as JSON text) and rule of
    ``RECORD_RULES``: fields that must and may stand, known values, ranges, and what keywords and the
    dated caption have to hold."""
    keys = lambda path, text="record": F.json_object_keys(F.get_json_object(text, path) if path else F.col(text))
    r = records.withColumn("r", F.from_json("record", RECORD)).withColumn("p", F.from_json(F.get_json_object("record", "$.proposed_new_keywords"), "array<string>"))
    has = lambda k, names: F.coalesce(F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(k, n)), F.lit(False))
    only = lambda k, names: F.coalesce(F.forall(k, lambda n: n.isin(*names)), F.lit(False))
    exact = lambda k, names: has(k, names) & only(k, names)
    conf = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    words, ai = F.coalesce("r.keywords", F.array().cast("array<string>")), F.coalesce("r.ai_caption", F.lit(""))
    heads = (F.length(ai) - F.length(F.replace(ai, F.lit("[AI Analysis]:"), F.lit("")))) / len("[AI Analysis]:")
    listed = F.coalesce("r.proposed_new_keywords", F.array().cast("array<struct<keyword: string, note: string, section: string, scope: string>>"))
    checks = {
        "is_object": keys(None).isNotNull(), "required_fields": has(keys(None), REQUIRED), "no_extra_fields": only(keys(None), FIELDS["record"]),
        "category_known": F.col("r.category").isin(*CATEGORIES), "category_keyword": F.array_contains(words, F.col("r.category")), "provenance_keyword": F.exists(words, lambda k: k.endswith(" Analyzed")),
        "ai_caption_start": ai.startswith("[AI Analysis]:") & (heads == 1), "ai_caption_end": ai.rlike(r"Inferred date: .+ \(confidence [01]?\.\d{2}; evidence: .+\)\.\s*$") & F.contains(ai, F.concat(F.lit("Inferred date: "), F.col("r.date_guess.iso"))),
        "location_fields": exact(keys("$.location_guess"), FIELDS["location_guess"]), "location_range": conf("r.location_guess.confidence"),
        "date_fields": exact(keys("$.date_guess"), FIELDS["date_guess"]), "date_range": conf("r.date_guess.confidence"),
        "proposal_fields": F.forall(F.coalesce("p", F.array().cast("array<string>")), lambda x: exact(F.json_object_keys(x), FIELDS["proposal"])),
        "proposal_sections": F.forall(listed, lambda x: F.coalesce(x["section"].isin(*[s for s in SECTIONS if s != "date_reference"]), F.lit(False))), "proposal_scopes": F.forall(listed, lambda x: F.coalesce(x["scope"].isin(*SCOPES), F.lit(False))),
    }
    named = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(checks[n], F.lit(False)).alias("ok")) for n in RECORD_RULES])
    return r.select("group_key", "ord", F.explode(named).alias("c")).select("group_key", "ord", "c.rule", "c.ok")


def record_analyses(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records (group_key, ord, keep, record as JSON text) as the analyses that the later jobs read, with the tokens that
    the record says were used."""
    r = records.withColumn("r", F.from_json("record", RECORD))
    loc = [F.col(f"r.location_guess.{k}").alias(f"loc_{k}") for k in ("country", "state", "city", "sublocation", "confidence")]
    date = [F.col(f"r.date_guess.{k}").alias(f"date_{n}") for k, n in (("iso", "iso"), ("import_date", "import"), ("pattern", "pattern"), ("confidence", "confidence"))]
    used = lambda k: F.get_json_object("record", f"$._usage.{k}")
    tokens = [used(k).try_cast("bigint").alias(k) for k in ("prompt_tokens", "completion_tokens")] + [used("model").alias("model")]
    return r.select("group_key", "ord", *keep, *tokens, "r.keywords", "r.caption", "r.ai_caption", "r.title", "r.category", "r.analysis_notes", *loc, *date, F.col("r.proposed_new_keywords").alias("proposals"))


# The services' names as settings give them, and as keywords show them.
PROVIDERS = {"claude": "anthropic", "anthropic": "anthropic", "gemini": "gemini", "google": "gemini", "openrouter": "openrouter"}
PROVIDER_NAMES = {"anthropic": "Claude", "gemini": "Gemini", "openrouter": "OpenRouter", "openai": "ChatGPT"}


def provider(c: Column) -> Column:
    """The service that a setting names; what isn't known is the default one."""
    known = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
    return F.coalesce(known[F.lower(rules.strip(c))], F.lit("openai"))


def provider_name(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROVIDER_NAMES.items() for x in kv])[provider(c)]


def model_name(answered: Column, requested: Column) -> Column:
    """The model that a reply names, else the one that was asked."""
    return F.coalesce(F.when(rules.blank_to_null(answered).isNotNull(), answered), requested)


def transport_sizes(parts: DataFrame, images: DataFrame, max_edge: int | None = 1024, quality: int | None = None) -> DataFrame:
    """(group_key, transport), one row a group: what was sent of it, in order. ``parts`` are assembled parts, ``images``
    planned payloads with one row a path (and ``bytes``, where they are known).

    transport: max_edge, jpeg_quality, part_count, parts (label, count), front_count and back_count (null for none),
    variants (path, part, bytes, mime, width, height, resized). A part whose image has no size keeps nulls."""
    size = F.col("bytes").cast("long") if "bytes" in images.columns else F.lit(None).cast("long")
    sent = images.select("path", size.alias("bytes"), "mime", F.col("sent_width").alias("width"), F.col("sent_height").alias("height"), "resized")
    seen = F.struct("part_ord", "img_ord", "path", F.col("label").alias("part"), "bytes", "mime", "width", "height", "resized")
    g = parts.join(sent, "path", "left").groupBy("group_key").agg(F.array_sort(F.collect_list(seen)).alias("v"))
    g = g.withColumn("v", F.transform("v", lambda x: x.dropFields("part_ord", "img_ord")))
    labels = F.array_distinct(F.transform("v", lambda x: x["part"]))
    count = lambda same: F.size(F.filter("v", same))
    g = g.withColumn("parts", F.transform(labels, lambda n: F.struct(n.alias("label"), count(lambda x: x["part"] == n).alias("count"))))
    of = lambda name: F.nullif(count(lambda x: F.lower(rules.strip(x["part"])) == name), F.lit(0)).alias(f"{name}_count")
    limits = (F.lit(max_edge).cast("int").alias("max_edge"), F.lit(quality).cast("int").alias("jpeg_quality"))
    return g.select("group_key", F.struct(*limits, F.size("parts").alias("part_count"), "parts", of("front"), of("back"), F.col("v").alias("variants")).alias("transport"))


def stamp_analyses(analyses: DataFrame, provider: str, model: str, day: str, sizes: DataFrame | None = None) -> DataFrame:
    """Provenance keyword and dated caption; with ``sizes`` (see ``transport_sizes``, one row a group) also what was
    sent."""
    if sizes is not None:
        analyses = analyses.join(sizes, "group_key", "left")
    return analyses.withColumn("keywords", rules.provenance(F.col("keywords"), provider, model)).withColumn("ai_caption", rules.dated_caption(F.col("ai_caption"), day))


def forbidden_audit(analyses: DataFrame, terms: Sequence[str] = rules.FORBIDDEN_TERMS, fail: bool = False) -> DataFrame:
    """(group_key, ord, keyword, term): keywords that hold a forbidden word. With ``fail`` such a
    keyword is an error when the rows are read."""
    hits = analyses.select("group_key", "ord", F.explode("keywords").alias("keyword")).withColumn("term", rules.forbidden_term(F.col("keyword"), terms)).where("term IS NOT NULL")
    return hits.withColumn("term", F.raise_error(F.concat(F.lit("forbidden keyword: "), "keyword")).cast("string")) if fail else hits
