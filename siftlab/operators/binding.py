"""Binding of truth values and extractions to the records and materials they belong to.

All matching stays inside a document, and no operator emits all pairs of a document: candidates
are reduced to distinct keys first, containment is looked up through an index of short pieces, and element sets
meet through the rarest element only. A document may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.functions.names import is_generic_name, name_key
from siftlab.session import materialize

DOC = ["task_type", "doi"]


def truth_join(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Each record with the truth it matches: by (task, doi, row), else by (task, doi).

    Adds join_mode, n_targets, n_unique (distinct context and label) and has_conflict (one
    context with two labels). Truth is summed up per key before the join, so the result has one
    row per record. ``truth`` has task_type, doi, row_number (nullable), context, label.
    """
    def summed(keys: list[str], frame: DataFrame) -> DataFrame:
        exact = frame.groupBy(*keys, "context", "label").agg(F.count(F.lit(1)).alias("n"))
        context = exact.groupBy(*keys, "context").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")
        )
        return context.groupBy(*keys).agg(
            F.sum("n").alias("n_targets"),
            F.sum("labels").alias("n_unique"),
            (F.max("labels") > 1).alias("has_conflict"),
        )

    measures = ["n_targets", "n_unique", "has_conflict"]
    by_row = summed([*DOC, "row_number"], truth.where(F.col("row_number").isNotNull()))
    by_doc = summed(DOC, truth)
    joined = records.join(
        by_row.select(*DOC, "row_number", *[F.col(m).alias(f"r_{m}") for m in measures]), [*DOC, "row_number"], "left"
    ).join(by_doc.select(*DOC, *[F.col(m).alias(f"d_{m}") for m in measures]), DOC, "left")
    at_row = F.col("r_n_targets").isNotNull()
    mode = F.when(at_row, "task_doi_row").when(F.col("d_n_targets").isNotNull(), "task_doi").otherwise("none")
    return joined.select(
        *records.columns,
        mode.alias("join_mode"),
        F.coalesce("r_n_targets", "d_n_targets", F.lit(0)).alias("n_targets"),
        F.coalesce("r_n_unique", "d_n_unique", F.lit(0)).alias("n_unique"),
        F.coalesce("r_has_conflict", "d_has_conflict", F.lit(False)).alias("has_conflict"),
    )


def unambiguous_targets(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records expanded by their distinct targets where no context has two labels.

    The number of targets of such a record is its number of contexts. Conflicting documents stay
    out: their records are reported once by :func:`truth_join`.
    """
    matched = materialize(truth_join(records, truth).where(~F.col("has_conflict") & (F.col("n_targets") > 0)), "matched")
    distinct = truth.select(*DOC, "row_number", "context", "label").distinct()
    by_row = matched.where("join_mode = 'task_doi_row'").join(distinct, [*DOC, "row_number"])
    by_doc = matched.where("join_mode = 'task_doi'").join(distinct.drop("row_number").distinct(), DOC)
    return by_row.unionByName(by_doc)


def maskable(records: DataFrame, index_docs: DataFrame) -> DataFrame:
    """Adds ``maskable``: the record's (task, doi) occurs in the index."""
    known = index_docs.select(*DOC).distinct().withColumn("_known", F.lit(True))
    return records.join(known, DOC, "left").withColumn("maskable", F.coalesce("_known", F.lit(False))).drop("_known")


def bind_by_elements(targets: DataFrame, materials: DataFrame, doc: str = "doi") -> DataFrame:
    """Material of each target: the one with the same element set, else the only superset.

    ``targets`` has doi, target_id, elements; ``materials`` doi, material_index, elements. Adds
    material_index and binding_mode (null when not unique).
    """
    def key(c: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")

    sets = materials.withColumn("eset", key("elements")).groupBy(doc, "eset").agg(
        F.count(F.lit(1)).alias("n"), F.min("material_index").alias("material_index")
    )
    sets = materialize(sets, "sets")
    wanted = targets.withColumn("eset", key("elements"))
    distinct = wanted.where("eset <> ''").select(doc, "eset").distinct()
    exact = distinct.join(sets, [doc, "eset"]).where("n = 1").select(
        doc, "eset", "material_index", F.lit("unique_exact_element_match").alias("binding_mode")
    )
    # Any superset contains the target's rarest element, so only that posting list is read.
    postings = sets.select(doc, "eset", "n", "material_index", F.explode(F.split("eset", ",")).alias("element"))
    frequency = postings.groupBy(doc, "element").agg(F.count(F.lit(1)).alias("df"))
    open_sets = distinct.join(exact, [doc, "eset"], "left_anti")
    probes = (
        open_sets.select(doc, "eset", F.explode(F.split("eset", ",")).alias("element"))
        .join(frequency, [doc, "element"], "left")
        .groupBy(doc, "eset")
        .agg(F.min_by("element", F.struct(F.coalesce("df", F.lit(0)), F.col("element"))).alias("element"))
    )
    hits = probes.join(
        postings.select(doc, "element", F.col("eset").alias("mset"), "n", "material_index"), [doc, "element"]
    ).where(F.size(F.array_except(F.split("eset", ","), F.split("mset", ","))) == 0)
    subset = hits.groupBy(doc, "eset").agg(F.sum("n").alias("n"), F.min("material_index").alias("material_index")).where(
        "n = 1"
    ).select(doc, "eset", "material_index", F.lit("unique_element_subset_match").alias("binding_mode"))
    return wanted.join(exact.unionByName(subset), [doc, "eset"], "left").drop("eset")


# Length of the pieces that names and long texts are looked up by.
GRAM = 3
# Texts up to this length are looked up by all their substrings of the lengths that keys have.
BRIEF = 128


def grams(text: Column, size) -> Column:
    """All overlapping pieces of ``size`` characters in order, in one pass over the text."""
    return F.regexp_extract_all(text, F.concat(F.lit(r"(?=([\s\S]{"), F.lit(size), F.lit("}))")), F.lit(1))


def windows(text: Column, lengths: Column) -> Column:
    """All distinct substrings of a brief text with one of the given lengths."""
    def of_length(k: Column) -> Column:
        starts = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, k))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def contained_keys(patterns: DataFrame, texts: DataFrame, doc: str = "doi") -> DataFrame:
    """(doc, text_id, key): the keys that occur inside each text of the same document.

    ``patterns`` has doc, key (distinct, not empty); ``texts`` doc, text_id, text (distinct by id).
    Brief texts meet the keys through their substrings, a bounded number for each. Longer texts go
    through :func:`_indexed_keys`.
    """
    lengths = patterns.where(F.length("key") <= BRIEF).groupBy(doc).agg(F.collect_set(F.length("key")).alias("lengths"))
    inside = texts.where(F.length("text") <= BRIEF).join(lengths, doc)
    found = inside.select(doc, "text_id", F.explode(windows(F.col("text"), F.col("lengths"))).alias("key")).join(patterns, [doc, "key"])
    found = found.select(doc, "text_id", "key")
    longer = texts.where(F.length("text") > BRIEF)
    return found if longer.isEmpty() else found.unionByName(_indexed_keys(patterns, longer, doc))


def _indexed_keys(patterns: DataFrame, texts: DataFrame, doc: str) -> DataFrame:
    """Keys inside long texts by an inverted index of the positions of short pieces.

    The index holds the pieces of the texts that some key of the document has. Every key is looked
    up by its piece that is rarest in the texts, and a key with a piece that no text has is not
    looked up at all. Each place found is confirmed by further pieces of the key that cover it, at
    their distance from the first: equality joins only, and texts are never joined. Keys shorter
    than a piece meet the shorter pieces of the texts.
    """
    short = patterns.where(F.length("key") < GRAM)
    pieces = F.array_distinct(F.flatten(F.array(*[grams(F.col("text"), k) for k in range(1, GRAM)])))
    direct = texts.select(doc, "text_id", F.explode(pieces).alias("key")).join(short, [doc, "key"]).select(doc, "text_id", "key")

    own = patterns.where(F.length("key") >= GRAM).select(doc, "key", F.posexplode(grams(F.col("key"), GRAM)).alias("off", "gram"))
    listed = texts.select(doc, "text_id", F.posexplode(grams(F.col("text"), GRAM)).alias("pos", "gram"))
    postings = materialize(listed.join(own.select(doc, "gram").distinct(), [doc, "gram"], "left_semi"), "postings")
    frequency = postings.groupBy(doc, "gram").agg(F.count(F.lit(1)).alias("df"))
    probe = (
        own.join(frequency, [doc, "gram"], "left").groupBy(doc, "key")
        .agg(F.min(F.struct("df", "off", "gram")).alias("p"), F.count_if(F.col("df").isNull()).alias("missing"))
        .where("missing = 0").select(doc, "key", "p.off", "p.gram")
    )
    places = probe.join(postings, [doc, "gram"]).where("pos >= off").select(doc, "text_id", "key", (F.col("pos") - F.col("off")).alias("start"))
    # Pieces at 0, GRAM, 2 GRAM, ... and the last one leave no character of the key open.
    last = F.length("key") - GRAM
    cover = F.array_union(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last))
    asked = places.select(doc, "text_id", "key", "start", F.size(cover).alias("parts"), F.explode(cover).alias("off"))
    asked = asked.select("*", F.substring(F.col("key"), F.col("off") + 1, F.lit(GRAM)).alias("gram"), (F.col("start") + F.col("off")).alias("pos"))
    met = asked.join(postings, [doc, "text_id", "gram", "pos"]).groupBy(doc, "text_id", "key", "start", "parts").agg(F.count(F.lit(1)).alias("n"))
    return direct.unionByName(met.where("n = parts").select(doc, "text_id", "key").distinct())


def bind_by_name(extractions: DataFrame, materials: DataFrame, doc: str = "doi") -> DataFrame:
    """Material of each extraction by its stated name, in tiers.

    Equal key, then the only material whose key contains the name or is contained in it, then a
    record with one material; without a name a single material, then the only material mentioned
    in the evidence. ``extractions`` has doi, extraction_id, name, evidence; ``materials`` doi,
    material_index, name. Adds material_index, status and reason.
    """
    # Folding the names is the heavy part, so both sides are written with their keys.
    keyed = materials.select(doc, "material_index", name_key("name").alias("key"), is_generic_name("name").alias("generic"))
    keyed = materialize(keyed, "keyed")
    per_doc = keyed.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_materials"),
        F.min("material_index").alias("only_index"),
        F.max("generic").alias("only_generic"),
    )
    names = keyed.where("key <> ''").groupBy(doc, "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("material_index").alias("material_index"),
        F.max(F.col("generic").cast("int")).alias("generic"),
    )
    names = materialize(names, "names")
    asked = materialize(
        extractions.withColumn("_key", name_key("name")).withColumn("_evidence", name_key("evidence"))
        .withColumn("_key_id", F.sha2("_key", 256)).withColumn("_evidence_id", F.sha2("_evidence", 256)),
        "asked",
    )

    def counted(hits: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        return hits.groupBy(*keys).agg(
            F.sum("n").alias(f"{prefix}_n"),
            F.min("material_index").alias(f"{prefix}_index"),
            F.max("generic").alias(f"{prefix}_generic"),
        )

    distinct = asked.where("_key <> ''").select(doc, "_key").distinct()
    exact = counted(distinct.join(names.withColumnRenamed("key", "_key"), [doc, "_key"]), "e", [doc, "_key"])
    # Containment either way, for names that no material has alone and evidence where there is a
    # choice; hits are summed up per key before anything is joined back.
    settled = exact.where("e_n = 1 and e_generic = 0").select(doc, "_key")
    distinct = distinct.join(settled, [doc, "_key"], "left_anti")
    choice = per_doc.where("n_materials > 1").select(doc)
    text_id = lambda c: F.sha2(c, 256)
    unnamed = asked.where("_key = '' AND _evidence <> ''").select(doc, F.col("_evidence").alias("text")).distinct().join(choice, doc, "left_semi")
    searched = distinct.select(doc, F.col("_key").alias("text")).union(unnamed).distinct().select(doc, text_id("text").alias("text_id"), "text")
    searched = materialize(searched, "searched")
    stated_names = names.select(doc, "key").join(searched.select(doc).distinct(), doc, "left_semi")
    around = contained_keys(
        distinct.select(doc, F.col("_key").alias("key")), stated_names.select(doc, text_id("key").alias("text_id"), F.col("key").alias("text")), doc
    ).withColumnRenamed("key", "_key")
    containing = counted(
        around.join(names.withColumn("text_id", text_id("key")), [doc, "text_id"]).where("_key <> key"), "c", [doc, "_key"]
    )
    within = materialize(contained_keys(stated_names, searched, doc).join(names, [doc, "key"]), "within")
    inside = counted(within.where(F.col("text_id") != text_id("key")), "i", [doc, "text_id"]).withColumnRenamed("text_id", "_key_id")
    mentioned = counted(within, "m", [doc, "text_id"]).withColumnRenamed("text_id", "_evidence_id")
    joined = (
        asked.join(per_doc, doc, "left")
        .join(exact, [doc, "_key"], "left")
        .join(containing, [doc, "_key"], "left")
        .join(inside, [doc, "_key_id"], "left")
        .join(mentioned, [doc, "_evidence_id"], "left")
    )
    # "Contains either way" includes equality.
    near_n = sum((F.coalesce(f"{p}_n", F.lit(0)) for p in ("c", "i")), F.coalesce("e_n", F.lit(0)))
    near_index = F.coalesce("e_index", "c_index", "i_index")
    near_generic = F.coalesce("e_generic", "c_generic", "i_generic")
    single = (F.col("n_materials") == 1) & ~F.col("only_generic")
    stated = F.col("name").isNotNull() & (F.trim("name") != "")
    nothing = F.lit(None).cast("bigint")

    def result(status: str, index, reason: str = "") -> Column:
        at = F.col(index) if isinstance(index, str) else index
        return F.struct(
            F.lit(status).alias("status"), at.cast("bigint").alias("material_index"), F.lit(reason).alias("reason")
        )

    outcome = (
        F.when(stated & (F.col("e_n") == 1) & (F.col("e_generic") == 0), result("direct", "e_index"))
        .when(
            stated & (near_n == 1) & (near_generic == 0),
            result("recoverable", near_index, "material_name_requires_normalized_substring_match"),
        )
        .when(
            stated & single,
            result("recoverable", "only_index", "explicit_material_name_mismatch_but_record_is_singleton"),
        )
        .when(stated, result("manual_review", nothing, "explicit_material_name_not_uniquely_matched"))
        .when(single, result("direct", "only_index"))
        .when(F.col("n_materials").isNull(), result("manual_review", nothing, "missing_material_object"))
        .when(
            (F.col("m_n") == 1) & (F.col("m_generic") == 0),
            result("recoverable", "m_index", "material_bound_by_unique_evidence_mention"),
        )
        .otherwise(result("manual_review", nothing, "multiple_materials_without_material_name"))
    )
    return joined.withColumn("_o", outcome).select(*extractions.columns, "_o.*")
