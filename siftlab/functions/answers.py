"""Answer objects inside model responses, and judge verdicts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from siftlab.functions.text import as_col, first_match, let, strip, text_or_empty

MAP = "map<string,string>"


def _embedded_object():
    """Arrow UDF: first non-empty JSON object that starts at any brace of the text.

    Built inside a function so that the workers receive it by value.
    """

    def find(text):
        decoder = json.JSONDecoder()
        at = text.find("{") if text else -1
        while at >= 0:
            try:
                obj, _ = decoder.raw_decode(text, at)
                if obj:
                    return json.dumps(obj, ensure_ascii=False)
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    def find_all(texts: pd.Series) -> pd.Series:
        return texts.map(find)

    return F.pandas_udf(find_all, T.StringType())


def _object(c: Column) -> Column:
    """The text when it is one non-empty JSON object."""
    return let(
        lambda text: F.when(text.startswith("{") & (F.coalesce(F.size(F.json_object_keys(text)), F.lit(0)) > 0), text),
        strip(c),
    )


def tagged_answer(c) -> Column:
    return first_match(c, r"(?s)<answer>(.*?)</answer>")


def with_answer_object(df, response: str, name: str = "answer"):
    """Add the answer object (JSON text, null when there is none).

    Order: ``<answer>`` block, the whole response, the first object inside the text. Only rows
    the first two do not settle go through Python.
    """
    text = text_or_empty(response)
    out = df.withColumn("_direct", F.coalesce(_object(tagged_answer(text)), _object(text)))
    out = out.withColumn("_open", F.when(F.col("_direct").isNull() & text.contains("{"), text))
    out = out.withColumn("_found", F.coalesce(F.col("_direct"), _embedded_object()(F.col("_open"))))
    return out.withColumn(name, _unwrap(F.col("_found"))).drop("_direct", "_open", "_found")


def direct_answer_object(c) -> Column:
    """As :func:`with_answer_object` without the fallback inside the text (no Python)."""
    return let(
        lambda text: _unwrap(F.coalesce(_object(tagged_answer(text)), _object(text))), text_or_empty(c)
    )


def _unwrap(c: Column) -> Column:
    """The nested ``answer`` object when there is one."""
    return let(lambda found: F.coalesce(_object(F.get_json_object(found, "$.answer")), found), c)


def answer_map(c) -> Column:
    return F.from_json(as_col(c), MAP)


def key_difference(expected: Column, got: Column) -> Column:
    """``struct<missing, extra>`` of two maps, sorted."""
    return let(
        lambda a, b: F.struct(
            F.array_sort(F.array_except(a, b)).alias("missing"),
            F.array_sort(F.array_except(b, a)).alias("extra"),
        ),
        F.map_keys(expected),
        F.map_keys(got),
    )


def judge_verdict(c) -> Column:
    """``struct<answer, reasoning, correct, confidence>`` of a judge's text; bold marks removed."""
    return let(_verdict, F.replace(text_or_empty(c), F.lit("**"), F.lit("")))


def _verdict(text: Column) -> Column:
    def field(name: str, value: str = r"(.*?)") -> Column:
        return strip(F.regexp_extract(text, rf"(?s){name}:\s*{value}(?=\n\s*\w+:|$)", 1))

    return F.struct(
        field("extracted_final_answer").alias("answer"),
        field("reasoning").alias("reasoning"),
        (F.lower(field("correct")) == "yes").alias("correct"),
        F.regexp_extract(text, r"(?s)confidence:\s*(\d+)\s*%?(?=\n\s*\w+:|$)", 1).try_cast("int").alias("confidence"),
    )


def _plain(c: Column, punctuation: bool) -> Column:
    text = F.lower(F.regexp_replace(c, r"\s", ""))
    return text if punctuation else F.regexp_replace(text, r"\p{Punct}", "")


def _as_number(c: Column) -> Column:
    return F.regexp_replace(c, r"[$%,]", "").try_cast("double")


def answers_match(response, truth) -> Column:
    """Numeric truth compares as numbers, lists element by element, other text after folding."""
    want = let(lambda t: F.when(t == "", "unknown").otherwise(t), text_or_empty(truth))
    return let(_match, text_or_empty(response), want)


def _match(got: Column, want: Column) -> Column:
    number = want.try_cast("double")
    g = F.transform(F.split(got, r"[,;]"), strip)
    w = F.transform(F.split(want, r"[,;]"), strip)
    pairs = F.zip_with(
        g,
        w,
        lambda a, b: F.coalesce(
            F.when(b.try_cast("double").isNotNull(), F.coalesce(_as_number(a) == b.try_cast("double"), F.lit(False))),
            _plain(a, True) == _plain(b, True),
        ),
    )
    listed = (F.size(g) == F.size(w)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
    return (
        F.when(number.isNotNull(), F.coalesce(_as_number(got) == number, F.lit(False)))
        .when(want.rlike("[,;]"), listed)
        .otherwise(_plain(got, False) == _plain(want, False))
    )


def last_conclusion(messages: Column) -> Column:
    """JSON text of the last assistant message ``conclude(...)``; the nested conclusion wins."""
    bodies = F.transform(messages, lambda m: F.when(m["role"] == "assistant", strip(m["content"])))
    calls = F.filter(bodies, lambda b: b.rlike(r"(?s)^conclude\(.*\S.*\)$"))
    inner = strip(F.regexp_extract(F.try_element_at(calls, F.lit(-1)), r"(?s)^conclude\((.*)\)$", 1))
    return let(lambda t: F.coalesce(F.get_json_object(t, "$.conclusion"), F.nullif(t, F.lit(""))), inner)
