"""Scalar rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and limits that the data format prescribes.
IMAGE_EXTENSIONS = ("tif", "tiff", "jpg", "jpeg", "png")
FORBIDDEN_TERMS = (
    "family", "parents", "siblings", "mother", "father", "son", "daughter", "friends", "boyfriend",
    "girlfriend", "husband", "wife", "happy", "sad", "angry", "excited", "smiling", "serious",
)
EMPTY_CAPTIONS = ("no text visible", "none", "blank", "empty", "n/a")
PLACEHOLDER_NOTES = ("auto-added", "auto added", "provide a reason", "n/a", "todo", "tbd", "placeholder")
MAX_CONTEXT_BYTES = 204_800


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """What the group matched, null where nothing did."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_path(c: Column, home: str = "/home/archive") -> Column:
    """Trimmed, without one pair of quotes, ``~`` expanded, and ``//``, ``.`` and ``..`` resolved. A
    path that is normal already, as most are, is told by one pattern."""
    normal = c.rlike(r"^(?:/(?!\.{1,2}(?:/|$))[^/\s\"']+)+$")
    return F.when(normal, c).otherwise(bind(strip(c), lambda x: bind(F.regexp_replace(F.regexp_replace(x, r"^([\"'])(.*)\1$", "$2"), r"^~(?=/|$)", home), _resolved)))


def _resolved(c: Column) -> Column:
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    # keep what no later ".." takes back: fold to a stack
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).when((p == "..") & c.startswith("/"), s).otherwise(F.array_append(s, p)))
    path = F.concat(F.when(c.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))
    return F.when(c == "", None).otherwise(F.when(path == "", ".").otherwise(path))


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot is part of the name."""
    name = F.substring_index(path, "/", -1)
    keep = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return F.when(keep > 0, F.substring(name, F.lit(1), keep)).otherwise(name)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas in it look at it often."""
    return F.transform(F.array(value), use)[0]


#: What parts the strings of a list in a text, and a text of them in which one begins or ends with what may be white, is blank or null.
PART, SURE = "\x01", "!-~\u00a1-\u167f"
UNCLEAN = rf"[^{SURE}](?:(?<={PART})[^{SURE}]|{PART})"


def clean(values: Column) -> Column:
    """Trimmed strings without blanks and nulls. Most lists are so already, which one look at all of their text tells."""
    text = lambda v: F.concat(F.lit(PART), F.array_join(v, PART, ""), F.lit(PART))
    return bind(values, lambda v: F.when(~text(v).rlike(UNCLEAN), v).otherwise(F.filter(F.transform(v, strip), lambda x: x.isNotNull() & (x != ""))))


def ci_distinct(values: Column) -> Column:
    """Trimmed strings without blanks, the first of those that differ in case only. Only lists in which some do are looked
    through string by string."""
    firsts = lambda c, low: F.filter(c, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1)
    return bind(F.array_distinct(clean(values)), lambda c: bind(F.transform(c, F.lower), lambda low: F.when(F.size(F.array_distinct(low)) == F.size(c), c).otherwise(firsts(c, low))))


def ci_union(first: Column, second: Column) -> Column:
    """``ci_distinct`` of two lists, one after the other, each of which is such a list already."""
    return F.concat(first, without(second, first))


def without(values: Column, others: Column) -> Column:
    """The values whose lower case isn't among the others'."""
    return bind(F.transform(others, F.lower), lambda low: F.filter(values, lambda x: ~F.array_contains(low, F.lower(x))))


def one_or_many(c: Column) -> Column:
    """A field that holds a JSON list of strings or one plain string."""
    return F.coalesce(F.from_json(c, "array<string>"), F.when(c.isNotNull(), F.array(c)))


def extract_year(c: Column) -> Column:
    """The first four digits, if they are a year from 1800 to 2100."""
    y = found(c, r"([0-9]{4})", 1).cast("int")
    return F.when(y.between(1800, 2100), y)


def valid_pattern(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike(r"^Y[!?~@](M[!?~@])?(D[!?~@])?$"), F.lit(False))


def has_date_marker(keywords: Column) -> Column:
    seen = F.contains(F.upper(F.array_join(keywords, PART, "DATE:")), F.lit("DATE:"))
    return F.when(seen, F.exists(keywords, lambda k: F.upper(strip(k)).startswith("DATE:"))).otherwise(F.when(keywords.isNotNull(), F.lit(False)))


def exif_date(c: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` of an EXIF or ISO date; offsets are dropped, not applied; null where
    the text is no full date."""
    c = strip(c)
    iso = F.regexp_replace(F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    full = F.when(c.rlike(r"^\d{8}$|^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.when(c.rlike(r"^\d{8}$|^\d{4}-\d{2}-\d{2}$"), F.substring(iso, 1, 10)).otherwise(iso))
    stamp = full.try_cast("timestamp_ntz")
    return F.when(c.rlike(r"^\d{4}:\d{2}:\d{2}$"), F.concat(c, F.lit(" 00:00:00"))).when(c.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), c).otherwise(F.date_format(stamp, "yyyy:MM:dd HH:mm:ss"))


def dated_caption(c: Column, day: str) -> Column:
    return F.regexp_replace(c, r"^(\s*)\[AI Analysis\]:", rf"$1[AI Analysis on {day}]:")


def without_empty_sections(caption: Column) -> Column:
    """``[Front]`` and ``[Back]`` sections that say something, each under its header; a caption
    without such headers as it is."""
    text = strip(F.coalesce(caption, F.lit("")))
    head = r"(?is)\[(Front|Back)\]\s*(.*?)(?=\n\[(?:Front|Back)\]|$)"
    sections = F.arrays_zip(F.regexp_extract_all(text, F.lit(head), 1).alias("h"), F.regexp_extract_all(text, F.lit(head), 2).alias("b"))
    norm = lambda b: F.lower(strip(F.regexp_replace(b, r"[\s\[\]()\-_:]+", " ")))
    kept = F.filter(sections, lambda s: ~norm(s["b"]).isin("", *EMPTY_CAPTIONS))
    return F.when(F.size(sections) == 0, text).otherwise(F.array_join(F.transform(kept, lambda s: F.concat(F.lit("["), F.initcap(s["h"]), F.lit("]\n"), strip(s["b"]))), "\n"))


def without_label(caption: Column, kind: str) -> Column:
    """The caption without a leading ``[Front b]:`` or ``Front:`` of this kind."""
    c = strip(caption)
    bracket = F.regexp_replace(c, rf"(?i)^\[{kind}(\s+[a-z])?\]\s*:?\s*", "")
    plain = F.regexp_replace(c, rf"(?i)^{kind}\b\s*:?\s*", "")
    return F.when((bracket != c) & (bracket != ""), bracket).when((plain != c) & (plain != ""), plain).otherwise(c)


def caption_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def placeholder_note(note: Column) -> Column:
    low = F.lower(strip(F.coalesce(note, F.lit(""))))
    out = low == ""
    for p in PLACEHOLDER_NOTES:
        out = out | low.contains(p)
    return out


def forbidden_term(keyword: Column, terms: Sequence[str] = FORBIDDEN_TERMS) -> Column:
    """The leftmost forbidden word; provenance keywords are exempt."""
    hit = found(F.lower(strip(keyword)), r"\b(" + "|".join(terms) + r")\b", 1)
    return F.when(~strip(keyword).endswith(" Analyzed"), hit)


def capped_utf8(text: Column, limit: int = MAX_CONTEXT_BYTES) -> Column:
    """At most ``limit`` bytes of UTF-8, never half a character."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.when(F.is_valid_utf8(x := F.substring(raw, 1, limit - k)), F.decode(x, "UTF-8")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def bare_tag(tag: Column) -> Column:
    return F.regexp_extract(tag, r"[^:]*$", 0)


def provenance(keywords: Column, provider: str, model: str) -> Column:
    """Any older provenance keyword gives way to the present one."""
    rest = F.filter(keywords, lambda k: ~k.endswith(" Analyzed"))
    return F.array_append(rest, F.lit(f"{provider} {model} Analyzed"))


def back_rule(keywords: Column, is_back: Column) -> Column:
    """Backs carry the keyword ``back``; other files don't, in any case. Lists in whose text it isn't, as in most, aren't
    looked through; one with a null is."""
    seen = F.contains(F.lower(F.array_join(keywords, PART, "back")), F.lit("back"))
    no = F.when(seen, F.filter(keywords, lambda k: F.lower(strip(k)) != "back")).otherwise(keywords)
    has = seen & F.exists(keywords, lambda k: F.lower(strip(k)) == "back")
    return F.when(is_back & ~has, F.array_append(keywords, F.lit("back"))).when(is_back, keywords).otherwise(no)


def scaled(side: Column, width: Column, height: Column, max_edge: int | None) -> Column:
    """A side's length after the longest edge is brought down to ``max_edge``."""
    if not max_edge or max_edge <= 0:
        return side
    longest = F.greatest(width, height)
    return F.when(longest > max_edge, F.greatest(F.lit(1), F.bround(side * (F.lit(float(max_edge)) / longest)).cast("int"))).otherwise(side)
