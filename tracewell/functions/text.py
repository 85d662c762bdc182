"""Scalar text functions: cuts, ids, hashes, keys, set similarity, JSON facts and labels."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ID_CUT

#: Package managers, shell commands that publish work, labels of fact types.
PACKAGE_MANAGERS = ("pnpm", "npm", "yarn")
PUBLISH_COMMANDS = ("git commit", "git push")
FACT_LABELS = ("project", "feedback", "error", "workflow")
#: Fixed value: letters and digits that stay in a slug.
SLUG_CHARACTERS = "0-9A-Za-z一-鿿"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(c: str | Column, limit: int, suffix: str = "") -> Column:
    """The first ``limit`` characters, with ``suffix`` if something was cut."""
    return F.when(F.length(_c(c)) > limit, F.concat(F.left(_c(c), F.lit(limit)), F.lit(suffix))).otherwise(_c(c))


def response_summary(variant: str | Column, limit: int = 500) -> Column:
    """The start of a response that is a string; null for any other JSON value."""
    v = _c(variant)
    return F.when(F.schema_of_variant(v) == "STRING", F.left(F.try_variant_get(v, "$", "string"), F.lit(limit)))


def content_hash(c: str | Column) -> Column:
    return F.sha2(_c(c), 256)


def slug(c: str | Column) -> Column:
    """Lower-case id of a text: other characters become single dashes; an empty one is a short hash."""
    text = _c(c)
    dashed = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), f"[^{SLUG_CHARACTERS}]+", "-"), "^-+|-+$", ""))
    return F.left(F.when(dashed == "", F.left(F.md5(text), F.lit(8))).otherwise(dashed), F.lit(ID_CUT))


def kebab_id(candidate: str | Column, fallback: str | Column) -> Column:
    """The candidate if it is a kebab-case id, else the slug of the fallback."""
    trimmed = F.trim(_c(candidate))
    valid = F.coalesce(trimmed.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))
    return F.when(valid, F.left(trimmed, F.lit(ID_CUT))).otherwise(slug(fallback))


def characters(c: str | Column) -> Column:
    """The set of characters of a text without ASCII spaces, sorted; null and empty text have none."""
    text = F.replace(F.coalesce(_c(c), F.lit("")), F.lit(" "), F.lit(""))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != "")))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def character_similarity(a: str | Column, b: str | Column) -> Column:
    return set_similarity(characters(a), characters(b))


def normal_keywords(c: str | Column) -> Column:
    """Trimmed lower-case keywords without blanks."""
    return F.filter(F.transform(F.coalesce(_c(c), F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != "")


def cacheable_text(body: str | Column, keywords: str | Column) -> Column:
    """Body and keywords as one text; nulls count as empty."""
    return F.concat(F.coalesce(_c(body), F.lit("")), F.lit(" "), F.coalesce(F.array_join(_c(keywords), " "), F.lit("")))


def publishes(c: str | Column) -> Column:
    """Whether a shell command commits or pushes."""
    text = F.coalesce(_c(c), F.lit(""))
    found = F.lit(False)
    for command in PUBLISH_COMMANDS:
        found = found | text.contains(command)
    return found


def named_managers(c: str | Column) -> Column:
    """The package managers named as whole words in a text."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.filter(F.array(*[F.when(text.rlike(rf"\b{m}\b"), F.lit(m)) for m in PACKAGE_MANAGERS]), lambda m: m.isNotNull())


def iso_time(c: str | Column) -> Column:
    """Time of an ISO text; null if it cannot be read."""
    return F.try_to_timestamp(_c(c))


def parse_time_us(c: str | Column) -> Column:
    """Microseconds of an ISO time stamp or of epoch milliseconds in text; null if unreadable."""
    text = F.trim(_c(c))
    return F.when(text.rlike(r"^\d{12,14}$"), text.cast("long") * 1000).otherwise(F.unix_micros(F.try_to_timestamp(text)))


def json_object_field(c: str | Column, name: str) -> Column:
    """A field of a JSON object as text; null if the text is no object or the field is missing."""
    v = F.try_parse_json(_c(c))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, f"$.{name}", "string"))


def is_typed_prompt(type_: str | Column, variant: str | Column) -> Column:
    """Whether a transcript line is a prompt: a user line whose content is a string, not a list of results."""
    v = _c(variant)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return (_c(type_) == "user") & is_object & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", F.lit(False))


def spoken_text(variant: str | Column) -> Column:
    """The text blocks of an assistant's content, joined by line ends; a plain string is taken as it is."""
    content = F.try_variant_get(_c(variant), "$.content", "variant")
    blocks = F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>"))
    texts = F.transform(F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "text", F.lit(False))), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(texts, "\n"), F.lit("")))


def canonical_json(c: str | Column) -> Column:
    """JSON with sorted keys in one fixed layout; text that is not JSON stays, null is an empty object."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            try:
                return json.dumps(json.loads(text), sort_keys=True)
            except (ValueError, RecursionError):
                return text

        return texts.map(one, na_action="ignore").astype(object)

    return run(F.coalesce(_c(c), F.lit("{}")))


def call_key(tool: str | Column, input_json: str | Column) -> Column:
    """Identity of a call: hash of the tool and its canonical input, taken before redaction."""
    return F.sha2(F.concat(F.coalesce(_c(tool), F.lit("")), F.lit(":"), canonical_json(input_json)), 256)


def fact_label(type_: str | Column) -> Column:
    """``[type]``, or ``[user]`` for unknown and missing types."""
    return F.when(_c(type_).isin(*FACT_LABELS), F.concat(F.lit("["), _c(type_), F.lit("]"))).otherwise(F.lit("[user]"))


def habit_line(domain: str | Column, trigger: str | Column) -> Column:
    return F.concat(F.lit("[habit]["), F.coalesce(_c(domain), F.lit("")), F.lit("] "), F.coalesce(_c(trigger), F.lit("")))
