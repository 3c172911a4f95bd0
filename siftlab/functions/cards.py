"""Note cards and guideline blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.tasks import canonical_task, task_family
from siftlab.functions.text import as_col, contains_any, let, squeeze, strip, text_or_empty


def card_fields(c) -> Column:
    """Map of known card fields; unknown keys and blank values are dropped, the last value wins."""
    body = F.regexp_replace(strip(text_or_empty(c)), K.CARD_PREFIX, "")
    parts = F.filter(F.split(body, ";"), lambda s: s.contains("="))
    pairs = F.transform(
        parts,
        lambda s: F.struct(
            F.upper(strip(F.substring_index(s, "=", 1))).alias("k"),
            strip(F.regexp_replace(s, r"(?s)^[^=]*=", "")).alias("v"),
        ),
    )
    known = F.array(*[F.lit(k) for k in K.CARD_FIELDS])
    kept = F.filter(pairs, lambda p: F.array_contains(known, p["k"]) & (p["v"] != ""))
    return let(
        lambda all_pairs: F.map_from_entries(
            F.filter(
                all_pairs,
                lambda p, i: ~F.exists(
                    F.slice(all_pairs, i + 2, F.size(all_pairs)), lambda q: q["k"] == p["k"]
                ),
            )
        ),
        kept,
    )


def split_list(c) -> Column:
    """Non-blank parts of text separated by commas or semicolons of either width."""
    parts = F.transform(F.split(text_or_empty(c), "[,，;；]"), strip)
    return F.filter(parts, lambda p: p != "")


def parse_card(c) -> Column:
    """Typed card: kind, all known fields, task, family; null for text that is not a card."""
    text = strip(text_or_empty(c))
    prefix = F.lower(F.regexp_extract(text, K.CARD_PREFIX, 1))
    typed = let(_typed_card, prefix, card_fields(text))
    return F.when(text.rlike(K.CARD_PREFIX), typed)


def _typed_card(prefix: Column, fields: Column) -> Column:
    def get(key: str) -> Column:
        return F.try_element_at(fields, F.lit(key))

    task = canonical_task(F.coalesce(get("TASK"), get("RT")))
    elements = split_list(get("ELEMENTS"))
    components = split_list(get("METALS"))
    plain = [k for k in K.CARD_FIELDS if k not in ("TASK", "RT", "ELEMENTS", "METALS")]

    def build(t: Column, own: Column, given: Column) -> Column:
        return F.struct(
            F.when(prefix == "materialcard", "material_card").otherwise("case").alias("kind"),
            F.coalesce(t, get("TASK")).alias("task_type"),
            task_family(t).alias("task_family"),
            F.when((prefix != "materialcard") & t.isNotNull(), t).otherwise(get("RT")).alias("reaction_type"),
            own.alias("elements"),
            F.when(F.size(given) > 0, given).otherwise(own).alias("components"),
            *[get(k).alias(K.CARD_FIELDS[k]) for k in plain],
            get("ANCHOR").alias("performance"),
        )

    return let(build, task, elements, components)


def guideline_blocks(c) -> Column:
    """Array of ``struct<id, text>``: one per ``[G<n>].`` block, continuation lines joined."""
    marked = F.regexp_replace(text_or_empty(c), r"(?m)^[ \t]*\[(G?\d+)\]\.", "\x01$1\x02")
    blocks = F.filter(F.split(marked, "\x01"), lambda b: b.contains("\x02"))
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            F.concat(F.lit("G"), F.regexp_extract(b, r"^G?0*(\d+)", 1)).alias("id"),
            squeeze(F.substring_index(b, "\x02", -1)).alias("text"),
        ),
    )
    return F.filter(parsed, lambda p: p["text"] != "")


def is_format_guideline(c) -> Column:
    """Guidelines about output format rather than content; blank text counts as format."""
    return let(_is_format, F.lower(text_or_empty(c)))


def _is_format(t: Column) -> Column:
    title = strip(F.substring_index(t, ":", 1))
    return (
        (strip(t) == "")
        | contains_any(t, ("<think", "</think", "<answer", "</answer", "format compliance", "no extraneous", "strict json"))
        | title.isin("tool-specific compliance", "tool specific compliance")
        | (t.contains("json dict") & t.contains("keys"))
        | (t.contains("key matching") & t.contains("metrics_to_predict"))
    )


def is_chemistry_guideline(c) -> Column:
    return let(lambda t: contains_any(t, K.CHEMISTRY_WORDS), F.lower(text_or_empty(c)))


def mentions_task(c, task: str) -> Column:
    """Card text tagged ``TASK=<task>`` or ``task_type: <task>``."""
    return text_or_empty(c).rlike(rf"(?i)(?:TASK|task_type)\s*[=:]\s*{task}(?:\b|;)")


def removed_for_reaction(c, reaction: str) -> Column:
    """Whether a block goes when ``reaction`` is pruned: tagged with it, or naming it untagged."""
    text = text_or_empty(c)
    tag = F.upper(strip(F.regexp_extract(text, r"\bRT=([^;]+);", 1)))
    return F.when(tag != "", tag == reaction).otherwise(F.upper(text).contains(reaction))


def search_text(fields: list[tuple[str, str]]) -> Column:
    """``label: value`` lines of the columns that hold text, in order."""
    lines = [
        F.when(strip(text_or_empty(as_col(col))) != "", F.concat(F.lit(f"{label}: "), as_col(col)))
        for label, col in fields
    ]
    return F.concat_ws("\n", *lines)
