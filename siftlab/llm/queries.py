"""Registered queries of the subpackage and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlab.llm import alignment, decontaminate, embedding_dedup, html_extract, manifest, mixing, pii, simhash, substrings, token_counts, token_output, toxicity, url_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.token_output(_table(spark, folder, "documents"), tokenizer_file())


def op4_product_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, folder, "embeddings"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.with_training_rank(mixing.mix_plan(_table(spark, folder, "documents")))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"),
        F.round("position", 6).alias("position"), "training_rank",
    )


def op7_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, folder, "pages"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "kept")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify_tampered(manifest.build_manifest(_table(spark, folder, "documents")))


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return alignment.align_documents(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), tokenizer_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_url_filter": op2_url_filter,
    "op3_token_output": op3_token_output,
    "op4_product_quantisation": op4_product_quantisation,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_html_extract": op7_html_extract,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_token_counts": op13_token_counts,
}


def _terms(terms) -> str:
    return ", ".join(f"('{t}')" for t in terms)


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)

OP2_SQL = rf"""
with cut as (
  select page_id, coalesce(url, '') as raw,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from pages),
rules(rh, rp, rv) as (values {_RULE_ROWS}),
strict(t) as (values {_terms(url_filter.STRICT_TERMS)}),
soft(t) as (values {_terms(url_filter.SOFT_TERMS)}),
judged as (
  select page_id, host, path,
    (select arg_max(rh || rp, length(rh || rp)) from rules
     where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule,
    (select arg_max(rv, length(rh || rp)) from rules
     where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as ruled,
    (select count(*) from strict where regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')) as n_strict,
    (select count(*) from soft where regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')) as n_soft
  from cut)
select page_id, host, path, rule,
  coalesce(ruled, case when n_strict > 0 or n_soft >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end) as verdict,
  n_strict, n_soft
from judged"""

_WEIGHTS = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
_E = mixing.MAX_EPOCHS
_COPIES = " + ".join(f"({e} * source_size + begun + size / 2 < target)::int" for e in range(_E))



def _position_sql(share: str, rank: str) -> str:
    """Inverse of the integrated schedule: on the segment that holds the share, the root of its parabola."""
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        segments = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        whole, done, whens = sum(s[4] for s in segments), 0.0, ""
        for t0, w0, t1, w1, area in segments:
            rest = f"greatest({share} * {whole}::double - {done}::double, 0)"
            slope = (w1 - w0) / (t1 - t0)
            root = f"({w0}::double + sqrt(greatest({w0 * w0}::double + {rest} * {2 * slope}::double, 0)))"
            done += area
            whens += f" when {share} <= {done / whole}::double then least({t0}::double + {rest} * 2 / {root}, {t1}::double)"
        cases.append(f"when {k} then case{whens} else {knots[-1][0]}::double end")
    return f"(case {rank} % {len(mixing.SCHEDULES)} {' '.join(cases)} end)"


OP6_SQL = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    sha256('mix|' || coalesce(doc_id::varchar, '')) as k from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, ({_WEIGHTS})[1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}] as w, row_number() over (order by source nulls last) - 1 as rk from sources),
byratio as (
  select *, coalesce(sum({_E} * source_size) over o, 0) as held, (select sum(w) from ranked) - coalesce(sum(w) over o, 0) as open,
    (select sum(source_size) from ranked) as total
  from ranked
  window o as (order by {_E} * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select arg_min((total - held) / open, held) as v from byratio
  where open > 0 and (total - held) / open * w <= {_E} * source_size),
targets as (
  select source, source_size, rk, case when v * w > {_E} * source_size then ({_E} * source_size)::double else v * w end as target
  from ranked, level),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.rk,
    coalesce(sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as begun
  from sized s join targets t on s.source is not distinct from t.source),
counted as (
  select *, (case when size > 0 then {_COPIES} else 0 end)::bigint as copies, (begun + size / 2.0::double) / target as share from placed),
timed as (
  select *, case when copies > 0 then {_position_sql("share", "rk")} end as moment from counted)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies, round(moment, 6) as position,
  row_number() over (order by round(moment, 9) nulls last, doc_id nulls last, begun, size) - 1 as training_rank
from timed"""

OP4_SQL = f"""
with usable as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from usable a join usable b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {embedding_dedup.MIN_COSINE}),
reach as (
  with recursive r(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from r join links l on l.x = r.y)
  select x, min(y) as component_id from r group by x),
counted as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join reach r on r.x = e.vec_id left join counted c on c.x = e.vec_id"""

_FIELDS = ["doc_id", "source", "lang", "n_chars"]
_FRAMED = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in _FIELDS)
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# A byte, then eight shifts of the checksum.
_CRC_STEPS = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"""xor(4294967295, list_reduce({_CRC_STEPS},
    lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, 4294967295::bigint))"""

OP11_SQL = f"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as tree, sha256({_FRAMED} || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256({_FRAMED} || coalesce(strlen({_LOWERED}) || ':' || {_LOWERED}, '-')) as lowered,
    coalesce({_CRC} % 3 = 0, false) as touched
  from documents),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves),
low(tree, level, idx, n, digest) as (
  select tree, 0, pos, n, leaf from placed
  union all
  select tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx)) from low where n > 1 group by all),
roots as (select tree, digest, level as height, row_number() over (order by tree) - 1 as pos, count(*) over () as n from low where n = 1),
high(level, idx, n, digest) as (
  select 0, pos, n, digest from roots
  union all
  select level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx)) from high where n > 1 group by all),
steps as (
  select p.tree, p.pos as leaf_at, l.level,
    coalesce(string_agg(l.digest, '' order by l.idx) filter (l.idx < p.pos // (8 ** l.level)::bigint), '') as a,
    coalesce(string_agg(l.digest, '' order by l.idx) filter (l.idx > p.pos // (8 ** l.level)::bigint), '') as b
  from placed p join low l on l.tree = p.tree and l.n > 1 and l.idx // 8 = p.pos // (8 ** (l.level + 1))::bigint group by all
  union all
  select p.tree, p.pos, r.height + h.level,
    coalesce(string_agg(h.digest, '' order by h.idx) filter (h.idx < r.pos // (8 ** h.level)::bigint), ''),
    coalesce(string_agg(h.digest, '' order by h.idx) filter (h.idx > r.pos // (8 ** h.level)::bigint), '')
  from placed p join roots r on r.tree = p.tree join high h on h.n > 1 and h.idx // 8 = r.pos // (8 ** (h.level + 1))::bigint group by all),
paths as (select tree, leaf_at, list({{'a': a, 'b': b}} order by level) as path from steps group by all),
told as (
  select p.doc_id, p.leaf, r.digest as subroot, (select digest from high where n = 1) as root,
    sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.a || s.b), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(coalesce(path, []), lambda x, s: {{'a': sha256(s.a || x.a || s.b), 'b': ''}},
      {{'a': case when touched then lowered else leaf end, 'b': ''}}).a as folded_root
  from placed p join roots r on r.tree = p.tree left join paths q on q.tree = p.tree and q.leaf_at = p.pos)
select *, folded_root = root as verified from told"""

SQL: dict[str, str] = {"op11_merkle_manifest": OP11_SQL, "op4_product_quantisation": OP4_SQL, "op2_url_filter": OP2_SQL, "op6_mixing": OP6_SQL}
