"""Batch responses with dead letters, and debate traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.text import blank_to_null, first_match, let, strip, text_or_empty
from siftlab.functions.units import strict_property_text

RESPONSE = "_corrupt string, custom_id string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<content:string>>>>>"
ANSWER = "map<string,string>"


def _label(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "")


def _answer(text: Column, prop: str) -> Column:
    """``struct<reason, metals, metric>`` of a model's answer text."""
    metric_field, aliases = K.EXTRACTION_SCHEMAS[prop]
    metal = [e for e in K.ELEMENTS if e not in K.NON_METALS]
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)

    def judge(stripped: Column, obj: Column) -> Column:
        data = F.from_json(obj, ANSWER)

        def check(d: Column, metals: Column, value: Column) -> Column:
            stated = F.coalesce(*[F.try_element_at(d, F.lit(k)) for k in ("property_type", "property", "feature_type")])
            reason = (
                F.when(stripped == "", "empty_response")
                .when(stripped == "INVALID", "model_returned_INVALID")
                .when((obj == "") & stripped.contains("INVALID"), "model_returned_INVALID")
                .when(obj == "", "no_json_object_found")
                .when(F.try_parse_json(obj).isNull(), "json_decode_error")
                .when(F.coalesce(F.size(metals), F.lit(0)) == 0, "missing_or_invalid_metals")
                .when(_label(stated) != _label(F.lit(prop)), "property_type_mismatch")
                .when(value.isNull(), "missing_or_invalid_metric")
                .otherwise("kept")
            )
            return F.struct(reason.alias("reason"), metals.alias("metals"), value.alias("metric"))

        return let(
            lambda d: let(
                check,
                d,
                # An intersection would build the set of all metals in every row.
                F.array_distinct(F.filter(F.from_json(F.try_element_at(d, F.lit("metals")), "array<string>"), lambda e: e.isin(metal))),
                strict_property_text(
                    F.lit(prop), F.coalesce(*[F.try_element_at(d, F.lit(k)) for k in (metric_field, *aliases)])
                ),
            ),
            data,
        )

    return let(judge, strip(text), block)


def classify_responses(lines: DataFrame, requests: DataFrame, prop: str) -> DataFrame:
    """Every response line with its request, outcome and parsed values.

    ``lines`` has line; ``requests`` custom_id, row_number, doi. Outcomes: batch_json_decode_error,
    batch_http_error, an answer reason, missing_doi or kept.
    """
    item = F.from_json("line", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    content = F.coalesce(F.try_element_at("_i.response.body.choices", F.lit(1))["message"]["content"], F.lit(""))
    parsed = lines.where(strip("line") != "").select("line", item.alias("_i")).withColumn("content", content)
    failure = (
        F.when(F.col("_i._corrupt").isNotNull(), "batch_json_decode_error")
        .when(F.coalesce(F.col("_i.response.status_code"), F.lit(0)) != 200, "batch_http_error")
        .when(F.col("_a.reason") != "kept", F.col("_a.reason"))
    )
    judged = parsed.withColumn("_a", _answer(F.col("content"), prop)).select(
        F.col("_i.custom_id").alias("custom_id"), failure.alias("_failure"), F.col("_a.metals").alias("metals"),
        F.col("_a.metric").alias("metric"), "line", "content",
    )
    # Lines without an id meet no request; a key of their own keeps them out of one partition.
    own = F.concat(F.lit("\x00"), F.sha2("line", 256))
    known = judged.withColumn("_key", F.coalesce("custom_id", own)).join(requests.withColumnRenamed("custom_id", "_key"), "_key", "left")
    doi = blank_to_null(F.col("doi"))
    outcome = F.coalesce("_failure", F.when(doi.isNull(), "missing_doi"), F.lit("kept"))
    return known.select(
        "custom_id", "row_number", doi.alias("doi"), outcome.alias("outcome"), "metals", "metric", "line", "content"
    )


def kept_responses(classified: DataFrame) -> DataFrame:
    return classified.where("outcome = 'kept'").select("row_number", "doi", "metals", "metric")


def dead_letters(classified: DataFrame) -> DataFrame:
    """Rejected lines, whole so that they can be replayed, with the head of the line or of the answer for display."""
    head = F.when(F.col("outcome") == "batch_json_decode_error", F.substring("line", 1, 500)).otherwise(
        F.substring("content", 1, 800)
    )
    return classified.where("outcome <> 'kept'").select("row_number", "doi", F.col("outcome").alias("reason"), head.alias("raw_head"), F.col("line").alias("raw_line"))


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


EVENT = (
    "type:string, proposal_id:string, agent_name:string, claim:string, query:string, round:int, from_proposal_id:string, "
    "target_proposal_id:string, flaw_type:string, critique:string, valid:boolean"
)
PROPOSAL = "proposal_id:string, claim:string"
TRACE = (
    "debate_id string, experiment_id string, run_id string, timestamp string, engine string, reaction_type string, "
    f"components array<string>, result struct<debate_history:array<struct<{EVENT}>>, "
    f"surviving_proposals:array<struct<{PROPOSAL}>>, defeated_proposals:array<struct<{PROPOSAL}>>, "
    f"withdrawn_proposals:array<struct<{PROPOSAL}>>, winner_proposal_id:string>"
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row per debate file."""
    return spark.read.schema(TRACE).option("multiLine", True).json(path)


def parse_traces(df: DataFrame, json_col: str) -> DataFrame:
    return df.select(F.from_json(json_col, TRACE).alias("t")).select("t.*")


def _debate(traces: DataFrame) -> DataFrame:
    """Trace with coalesced ids and the task: stated, else the first one named in claim or query."""
    events = F.coalesce("result.debate_history", F.array())
    texts = F.flatten(F.transform(F.filter(events, lambda e: e["type"] == "propose"), lambda e: F.array(e["claim"], e["query"])))
    named = F.try_element_at(F.array_compact(F.transform(texts, lambda x: first_match(text_or_empty(x), K.TRACE_TASK))), F.lit(1))
    return traces.select(
        F.coalesce(blank_to_null(F.col("debate_id")), blank_to_null(F.col("experiment_id"))).alias("debate_id"),
        F.coalesce(blank_to_null(F.col("run_id")), blank_to_null(F.col("timestamp"))).alias("run_id"),
        F.coalesce(blank_to_null(F.col("reaction_type")), named).alias("reaction_type"),
        F.col("result").alias("result"),
    )


def _proposal_rows(traces: DataFrame) -> DataFrame:
    ids = lambda c: F.transform(F.coalesce(F.col(f"result.{c}"), F.array()), lambda p: p["proposal_id"])
    rows = _debate(traces).select(
        "debate_id", "run_id", "reaction_type", "result", F.posexplode("result.debate_history").alias("pos", "e")
    ).where((F.col("e.type") == "propose") & (F.coalesce(F.trim("e.proposal_id"), F.lit("")) != ""))
    status = (
        F.when(F.array_contains(ids("withdrawn_proposals"), F.col("e.proposal_id")), "withdrawn")
        .when(F.array_contains(ids("defeated_proposals"), F.col("e.proposal_id")), "defeated")
        .when(F.array_contains(ids("surviving_proposals"), F.col("e.proposal_id")), "surviving")
        .otherwise("unknown")
    )
    return rows.withColumn("status", status)


_PROPOSAL_COLUMNS = ["debate_id", "run_id", "reaction_type", "pos", "e.proposal_id", "e.agent_name", "e.claim", "status"]


def proposals(traces: DataFrame) -> DataFrame:
    """One row per proposal with the status its debate gave it."""
    return _proposal_rows(traces).select(*_PROPOSAL_COLUMNS, F.col("result.winner_proposal_id").alias("winner_id"))


def critiques(traces: DataFrame) -> DataFrame:
    """One row per review."""
    rows = _debate(traces).select("debate_id", F.posexplode("result.debate_history").alias("pos", "e"))
    fit = (F.col("e.type") == "review") & (F.coalesce(F.trim("e.target_proposal_id"), F.lit("")) != "")
    return rows.where(fit).select(
        "debate_id", "pos", "e.round", "e.from_proposal_id", "e.target_proposal_id", "e.flaw_type", "e.critique",
        F.coalesce("e.valid", F.lit(False)).alias("valid"),
    )


def reward_rows(traces: DataFrame, include_withdrawn: bool = False) -> DataFrame:
    """One row per proposal: reward 1 when it survived, with the valid critiques as reasoning.

    The critiques come from the proposal's own debate, that is from the same row: no join.
    """
    rows = _proposal_rows(traces)
    if not include_withdrawn:
        rows = rows.where("status <> 'withdrawn'")
    about = F.filter(
        "result.debate_history",
        lambda r: (r["type"] == "review")
        & (r["target_proposal_id"] == F.col("e.proposal_id"))
        & F.coalesce(r["valid"], F.lit(False))
        & (F.trim(text_or_empty(r["critique"])) != ""),
    )
    source = lambda r: F.trim(text_or_empty(r["from_proposal_id"]))
    lines = F.transform(
        about,
        lambda r: F.concat(
            F.lit("- ["), F.coalesce(blank_to_null(r["flaw_type"]), F.lit("issue")), F.lit("]"),
            F.when(source(r) != "", F.concat(F.lit(" from "), source(r))).otherwise(""),
            F.lit(": "), F.trim(r["critique"]),
        ),
    )
    return rows.select(
        *_PROPOSAL_COLUMNS,
        F.when(F.col("status") == "surviving", 1.0).otherwise(0.0).alias("reward"),
        F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("[No critique provided]")).alias("reasoning"),
    )
