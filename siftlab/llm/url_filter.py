"""URL filter: site rules first, then an Aho-Corasick scan for weighted terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Terms that reject alone, and terms of which several different ones reject.
STRICT_TERMS = (
    "casino", "porn", "xxx", "viagra", "cialis", "escort", "escorts", "camgirls", "hentai", "phishing", "malware", "warez",
    "ads-track", "spam-farm",
)
SOFT_TERMS = (
    "adult", "ads", "bet", "bets", "bonus", "cheap", "click", "credit", "dating", "deal", "deals", "free", "gamble", "jackpot",
    "loan", "loans", "pills", "poker", "promo", "sex", "slots", "spam", "sexy", "track", "tracker", "win", "winner", "x",
)
SOFT_LIMIT = 2

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url) -> tuple:
    """Columns (host, path): the part after the first ``://`` cut at ``/``, ``?``, ``#``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, parts, 2)


def term_automaton(strict: Iterable[str], soft: Iterable[str]):
    automaton = ahocorasick.Automaton()
    for weight, terms in ((2, strict), (1, soft)):
        for term in terms:
            automaton.add_word(term.lower(), (term.lower(), weight))
    automaton.make_automaton()
    return automaton


def count_terms(automaton, url: str) -> tuple[int, int]:
    """Different strict and soft terms of the url that stand between boundaries."""
    found = set()
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if (start and url[start - 1] in _WORD) or (end + 1 < len(url) and url[end + 1] in _WORD):
            continue
        found.add((term, weight))
    strict = sum(weight == 2 for _, weight in found)
    return strict, len(found) - strict


def longest_rule(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """The longest fitting rule as (rule, verdict): host suffixes from the longest, then paths."""
    best = (None, None)
    at = host
    while at:
        for prefix, verdict in rules.get(at, ()):
            rule = at + prefix
            if path.startswith(prefix) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        at = at.partition(".")[2]
    return best


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, n_strict, n_soft.

    The longest fitting rule decides. Without one, a url with one strict term or with
    ``soft_limit`` different soft terms is blocked. Terms are matched in the A-Z lower-cased url
    by one Aho-Corasick pass and count only between characters other than a-z and 0-9. The work
    is row-local: no shuffle. A null url, or one without ``://``, has an empty host and path, and
    its terms still count; repeated rows give repeated results; an empty table gives none; other
    columns are ignored.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule_host, prefix, verdict in rules:
        by_host.setdefault(rule_host, []).append((prefix, verdict))
    strict, soft = tuple(strict), tuple(soft)
    host, path = host_and_path(F.col("url"))
    lowered = F.translate(F.coalesce(F.col("url"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host.alias("host"), path.alias("path"), lowered.alias("url")
    )
    kind = narrow.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = term_automaton(strict, soft)
        for batch in batches:
            rule_col, verdict_col, strict_col, soft_col = [], [], [], []
            columns = (batch.column(k).to_pylist() for k in ("host", "path", "url"))
            for at, prefix, url in zip(*columns, strict=True):
                n_strict, n_soft = count_terms(automaton, url)
                rule, verdict = longest_rule(by_host, at, prefix)
                rule_col.append(rule)
                verdict_col.append(verdict or ("block" if n_strict or n_soft >= soft_limit else "allow"))
                strict_col.append(n_strict)
                soft_col.append(n_soft)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rule_col, pa.string()),
                    pa.array(verdict_col, pa.string()), pa.array(strict_col, pa.int64()), pa.array(soft_col, pa.int64()),
                ],
                names=["id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    schema = f"id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long"
    return narrow.mapInArrow(judge, schema).withColumnRenamed("id", id_col)
