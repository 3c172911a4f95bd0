"""Document, citation and sample identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.folding import nfkc
from siftlab.functions.text import all_matches, as_col, blank_to_null, let, strip, text_or_empty


def _trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def canonical_doi(c, profile: str = "join") -> Column:
    """Canonical document id.

    ``join``      empty text for missing ids; used for equality joins between tables
    ``document``  null unless a valid ``10.<digits>/<suffix>`` remains; used on ids found in text
    ``source``    wrapper and bracket stripping for citation ids
    ``plain``     trimmed text or null
    """
    if profile == "plain":
        return blank_to_null(as_col(c).cast("string"))
    if profile == "join":
        text = F.regexp_replace(F.lower(strip(nfkc(text_or_empty(c)))), K.DOI_PREFIX, "")
        return F.rtrim(_trim_chars(strip(text), "*`\"'"), F.lit(".,; "))
    if profile == "source":
        text = _trim_chars(strip(_trim_chars(strip(text_or_empty(c)), "<>")), "()[]{}")
        text = _trim_chars(strip(_trim_chars(text, "*_`")), "*_`")
        return F.lower(strip(F.rtrim(text, F.lit(".,;:!?\"'"))))
    if profile == "document":
        tail = ".,;:!?\"'"
        text = F.regexp_replace(strip(text_or_empty(c)), r"(?i)^doi\s*[:：]\s*", "")
        text = F.regexp_replace(text, r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
        text = F.regexp_replace(text, r"(?s)[?#].*$", "")
        text = _trim_chars(strip(text), "<>")
        text = F.rtrim(F.ltrim(text, F.lit("([{<\"'")), F.lit(tail))
        text = _trim_chars(text, "*_`")
        return let(lambda t: _checked_doi(t, tail), text)
    raise ValueError(f"unknown profile {profile!r}")


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _checked_doi(text: Column, tail: str) -> Column:
    """Closing brackets without an opening partner go; then the shape is checked."""

    def drop(t: Column) -> Column:
        unbalanced = F.lit(False)
        for closer, opener in ((")", "("), ("]", "["), ("}", "{"), (">", "<")):
            unbalanced = unbalanced | (t.endswith(closer) & (_count(t, opener) < _count(t, closer)))
        return F.when(unbalanced, F.rtrim(F.left(t, F.length(t) - 1), F.lit(tail))).otherwise(t)

    bad = F.lower(text).rlike(r"\]\(|doi\.org|https?://")
    # Balanced ids, nearly all, skip the loop; each round removes one bracket.
    rounds = F.sequence(F.lit(1), F.greatest(F.length(F.regexp_extract(text, r"[)\]}>.,;:!?\"']*$", 0)), F.lit(1)))
    trimmed = F.when(
        text.rlike(r"[)\]}>]$"), F.aggregate(rounds, text, lambda t, _: drop(t))
    ).otherwise(text)
    return let(lambda t: F.when(~bad & t.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(t)), trimmed)


def citation_id(collection, doc_id, chunk) -> Column:
    """``rag:chroma/<collection>/doi:<doc>#chunk:<n>``."""
    name = F.coalesce(blank_to_null(collection), F.lit("unknown"))
    doc = F.coalesce(blank_to_null(doc_id), F.lit("unknown"))
    return F.concat(F.lit("rag:chroma/"), name, F.lit("/doi:"), doc, F.lit("#chunk:"), as_col(chunk).cast("bigint").cast("string"))


def parse_citation(c) -> Column:
    """``struct<collection, doc_id, chunk>`` or null."""
    def parts(text: Column) -> Column:
        # The pattern is matched once. Where it fits, no part holds the mark that ends it.
        collection = F.substring_index(F.substring(text, len("rag:chroma/") + 1, 1 << 30), "/", 1)
        after = F.length(collection) + len("rag:chroma/" + "/doi:") + 1
        return F.struct(
            collection.alias("collection"),
            F.substring_index(F.substring(text, after, F.lit(1 << 30)), "#", 1).alias("doc_id"),
            F.substring_index(text, "#chunk:", -1).try_cast("bigint").alias("chunk"),
        )

    return let(lambda text: F.when(text.rlike(K.CITATION), parts(text)), strip(c))


def normalize_citation(c) -> Column:
    """Canonical form of a citation; trailing prose punctuation is salvaged, other text is kept."""
    def build(text: Column) -> Column:
        salvaged = F.rtrim(F.btrim(text, F.lit("`\"'")), F.lit(").,;:!?\"']}"))
        rebuilt = let(
            lambda ref: F.when(
                ref.isNotNull(),
                citation_id(ref["collection"], canonical_doi(ref["doc_id"], "source"), ref["chunk"]),
            ).otherwise(text),
            F.coalesce(parse_citation(text), parse_citation(salvaged)),
        )
        # Plain canonical citations, nearly all that come from a store, are their own result.
        return F.when(text.rlike(K.CANONICAL_CITATION), text).otherwise(rebuilt)

    return let(build, strip(text_or_empty(c)))


def citations_in_text(c) -> Column:
    """Distinct, sorted, valid citations in free text."""
    found = F.transform(all_matches(text_or_empty(c), K.CITATION_TOKEN), normalize_citation)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.rlike(K.CITATION))))


def sample_id(task, doi, identity, context, label) -> Column:
    """``mp19_`` and 20 hex digits of the compact key-sorted JSON of the five keys."""
    payload = F.to_json(
        F.struct(
            as_col(context).alias("context_key"),
            as_col(doi).alias("doi"),
            as_col(label).alias("label_key"),
            as_col(identity).alias("material_identity"),
            as_col(task).alias("task_type"),
        )
    )
    return F.concat(F.lit("mp19_"), F.substring(F.sha2(payload, 256), 1, 20))


def fallback_doc_id(path) -> Column:
    """``no-doi:<first 30 characters of the base name>_<16 hex digits>`` of a file path."""
    slug = strip(F.replace(text_or_empty(path), F.lit("\\"), F.lit("/")))
    slug = F.regexp_replace(slug, r"(?i)\.md$", "")
    slug = F.regexp_replace(F.regexp_replace(slug, r"\s+", "_"), r"[^0-9A-Za-z._/-]+", "_")
    slug = F.lower(F.btrim(slug, F.lit("_")))

    def build(s: Column) -> Column:
        base = F.btrim(F.substring(F.substring_index(s, "/", -1), 1, 30), F.lit("_"))
        base = let(lambda b: F.when(b == "", "doc").otherwise(b), base)
        named = F.concat(F.lit("no-doi:"), base, F.lit("_"), F.substring(F.sha2(s, 256), 1, 16))
        return F.when(strip(text_or_empty(path)) == "", "unknown").otherwise(named)

    return let(build, slug)


def split_experiment_id(c) -> Column:
    """``name_epoch_k`` -> ``struct<experiment, epoch>``; other ids keep their text, epoch null."""
    text = as_col(c)
    pattern = r"(?s)^(.*)_epoch_(.*)$"
    hit = text.contains("_epoch_")
    return F.struct(
        F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("experiment"),
        F.when(hit, F.regexp_extract(text, pattern, 2).try_cast("int")).alias("epoch"),
    )
