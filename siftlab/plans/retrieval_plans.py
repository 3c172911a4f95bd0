"""Queries on search, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.functions import fixed as K
from siftlab.functions.documents import chunk_quality
from siftlab.operators import chunking as C, joins as J, pivots as P, retrieval as R
from siftlab.plans.common import pick, sql_list, sql_pick, text
from siftlab.plans.registry import query

_TOK = f"""select {{id}}, t from (select {{id}}, unnest(string_split_regex(lower({{text}}), '[^a-z0-9]+')) as t from {{table}})
  where len(t) >= 2 and not regexp_full_match(t, '[0-9]+') and t not in ({sql_list(K.STOPWORDS)[1:-1]})"""
_DOC_TOK = "dt as (select distinct doc_id, t from (" + _TOK.format(id="doc_id", text="text", table="documents") + "))"
_Q_TOK = "qt as (select distinct item_id, t from (" + _TOK.format(id="item_id", text="text", table="benchmark") + "))"


@query(
    "agg34_idf_table",
    f"""with {_DOC_TOK} select t as token, count(*) as df, round(1 + ln(((select count(*) from documents) + 1.0) / (count(*) + 1.0)), 6) as idf
    from dt group by t""",
)
def agg34(t):
    return R.idf_table(t.wide("documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


@query(
    "top3_idf_keyword_ranking",
    f"""with {_DOC_TOK}, {_Q_TOK}, df as (select t, count(*) as d from dt group by t),
      w as (select item_id, t, case when d is null then 1.0::double else 1 + ln(((select count(*) from documents) + 1.0::double) / (d + 1.0::double)) end as idf from qt left join df using (t)),
      m as (select item_id, sum(idf) as mx from w group by 1),
      s as (select item_id, doc_id, round(sum(idf) / any_value(mx), 9) as sim from w join dt using (t) join m using (item_id) group by all),
      r as (select *, row_number() over (partition by item_id order by sim desc, doc_id) as rank from s)
    select item_id, doc_id, round(sim, 6) as similarity, rank::int as rank from r where rank <= 5""",
)
def top3(t):
    out = R.keyword_rank(t.wide("documents"), t.benchmark, "doc_id", "text", "item_id", "text", 5)
    return out.withColumn("similarity", F.round("similarity", 6))


_SEARCHES = ["the of and", "ción que", "schlecht der und"]


def _hit(word: str) -> str:
    return f"(case when contains(ti, '{word}') then 2 else 0 end + case when contains(ab, '{word}') then 1 else 0 end)"


@query(
    "top4_token_like_search",
    "with d as (select doc_id, lower(source || ' ' || lang) as ti, lower(text) as ab, trim(regexp_replace(text, '\\s+', ' ', 'g')) as sq from documents), s as ("
    + " union all ".join(
        f"select '{q}' as query, doc_id, {' + '.join(_hit(w) for w in q.split())} as score, sq, coalesce("
        + ", ".join(f"nullif(instr(lower(sq), '{w}'), 0)" for w in q.split())
        + ") as hit_at from d"
        for q in _SEARCHES
    )
    + """), r as (select *, row_number() over (partition by query order by score desc, doc_id) as rank, greatest(hit_at - 1 - 200, 0) as st from s where score > 0)
    select query, doc_id, score::int as score, rank::int as rank, case when len(sq) <= 400 then sq when hit_at is null then substr(sq, 1, 400) || '...' else
      (case when st > 0 then '...' else '' end) || substr(sq, st + 1, least(st + 400, len(sq)) - st) || (case when least(st + 400, len(sq)) < len(sq) then '...' else '' end) end as snippet
    from r where rank <= 10""",
)
def top4(t):
    docs = t.wide("documents").withColumn("title", F.concat_ws(" ", "source", "lang"))
    return R.substring_search(docs, _SEARCHES, "doc_id", "title", "text", 10)


_CENTROIDS = """dim as (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings),
  av as (select label, i, avg(x) as x from dim group by all), cen as (select label as q, list(x order by i) as c from av group by label)"""


def _queries(t, tasks=None, masked=None):
    """One query vector per label: the mean of its vectors (dimensions are few and fixed)."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return centre.select(
        F.col("label").alias("qid"),
        F.col("p.x").alias("embedding"),
        (tasks if tasks is not None else F.lit(None)).cast("array<string>").alias("tasks"),
        (masked if masked is not None else F.lit(None)).cast("string").alias("masked_doc"),
    )


def _vectors(t):
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.concat(F.lit("D"), text(F.pmod("vec_id", F.lit(13)))).alias("doc_id"),
        pick(K.TASKS, "vec_id").alias("task_type"),
    )


def _vector_sql(where: str = "true", k: int = 5) -> str:
    return f"""with {_CENTROIDS}, s as (select q, vec_id, {sql_pick(K.TASKS, 'vec_id')} as task_type, 'd' || (vec_id % 13) as doc,
        round(list_cosine_similarity(embedding, c), 9) as score from embeddings, cen),
      r as (select *, row_number() over (partition by q order by score desc, vec_id::varchar) as rank from s where {where})
    select q::varchar as qid, vec_id::varchar as id, round(score, 6) as score, rank::int as rank from r where rank <= {k}"""


def _r6(df):
    return df.withColumn("score", F.round("score", 6))


@query("top1_vector_top_k", _vector_sql())
def top1(t):
    return _r6(R.vector_top_k(_vectors(t), _queries(t), 5))


@query("top1_vector_top_k_grid", _vector_sql())
def top1_grid(t):
    return _r6(R.vector_top_k(_vectors(t), _queries(t), 5, grid=3))


@query("top1_vector_top_k_pivots", _vector_sql())
def top1_pivots(t):
    return _r6(P.pivot_top_k(P.build_index(_vectors(t)), _queries(t), 5)[0])


@query(
    "top1_similar_records_pivots",
    f"""with p as (select vec_id as q, embedding::double[] as c from embeddings where vec_id % 100 = 0), s as (select q, vec_id, {sql_pick(K.TASKS, 'vec_id')} as task_type,
        round(list_cosine_similarity(embedding::double[], c), 9) as score from embeddings, p),
      r as (select *, row_number() over (partition by q order by score desc, vec_id::varchar) as rank from s where task_type in ('HER', 'OER') and score >= 0.2)
    select q::varchar as qid, vec_id::varchar as id, round(score, 6) as score, rank::int as rank from r where rank <= 10""",
)
def top1_similar(t):
    vectors = _vectors(t)
    tasks = F.array(F.lit("HER"), F.lit("OER"))
    asked = vectors.where(F.pmod("id", F.lit(100)) == 0).select(
        F.col("id").alias("qid"), "embedding", tasks.alias("tasks"), F.lit(None).cast("string").alias("masked_doc")
    )
    return _r6(P.pivot_top_k(P.build_index(vectors), asked, 10, max_distance=0.8)[0])


@query(
    "flt6_metadata_and_distance",
    _vector_sql("task_type in ('HER', 'OER', 'conductivity') and score >= 0.05"),
)
def flt6(t):
    tasks = F.array(F.lit("HER"), F.lit("OER"), F.lit("conductivity"))
    return _r6(R.vector_top_k(_vectors(t), _queries(t, tasks), 5, max_distance=0.95))


@query("jon5_leakage_mask", _vector_sql("doc <> 'd' || q"))
def jon5(t):
    return _r6(R.vector_top_k(_vectors(t), _queries(t, masked=F.concat(F.lit("D"), text("label"))), 5))


@query(
    "jon5_leakage_mask_after_ranking",
    f"""with h as ({_vector_sql()}) select qid, id, score from h where 'd' || (id::int % 13) <> 'd' || qid""",
)
def jon5_post(t):
    hits = _r6(R.vector_top_k(_vectors(t), _queries(t), 5)).withColumn(
        "doc", F.concat(F.lit("D"), text(F.pmod(F.col("id").cast("bigint"), F.lit(13))))
    )
    masks = _queries(t).select(text("qid").alias("qid"), F.concat(F.lit(" d"), text("qid")).alias("doc"))
    return J.mask_own_document(hits, masks, "qid", "doc").select("qid", "id", "score")


_SYM = ("Pt", "Fe", "Cu", "Zn", "O", "C")


@query(
    "top2_overfetch_and_rerank",
    f"""with h as ({_vector_sql(k=15)}), d as (select *, list_distinct([{sql_pick(_SYM, 'id::int')}, {sql_pick(_SYM, 'id::int // 6')}]) as det,
        list_distinct([{sql_pick(_SYM, 'qid::int')}, 'Fe']) as req, id::int % 2 = 0 as tm from h),
      c as (select *, len(list_intersect(det, req)) as m, len([x for x in det if not list_contains(req || ['O', 'C'], x)]) as f from d),
      r as (select *, row_number() over (partition by qid order by tm desc, m desc, f, score desc, id) as rk from c)
    select qid, id, m::int as n_matched, f::int as n_forbidden, rk::int as rank from r where rk <= 5""",
)
def top2(t):
    hits = _r6(R.vector_top_k(_vectors(t), _queries(t), 15)).drop("rank")
    i, q = F.col("id").cast("bigint"), F.col("qid").cast("bigint")
    hits = hits.select(
        "qid", "id", "score",
        (F.pmod(i, F.lit(2)) == 0).alias("task_match"),
        F.array_distinct(F.array(pick(_SYM, i), pick(_SYM, F.floor(i / 6)))).alias("detected"),
        F.array_distinct(F.array(pick(_SYM, q), F.lit("Fe"))).alias("required"),
    )
    return R.rerank(hits, "qid", 5, "id").select("qid", "id", "n_matched", "n_forbidden", "rank")


_LINES = r"""ln as (select doc_id, lang, unnest(string_split(text, chr(10))) as chunk from documents),
  q as (select doc_id, lang, trim(chunk) as s from ln),
  n as (select *, regexp_matches(s, '\b\d+\.\d+\b') or regexp_matches(s, '(?i)\bE\s*(?:_\{)?\s*1\s*/\s*2\s*(?:\})?') or
    regexp_matches(s, '(?i)\b\d+(?:\.\d+)?\s*(?:V|mV|mA|A|%|rpm|cm\s*(?:-2|\^-2)|A\s*g\s*(?:-1|\^-1)|mA\s*cm\s*(?:-2|\^-2))\b') as num from q),
  lab as (select *, case when s = '' then 'hard' when regexp_matches(s, '(?i)^(?:#{1,6}\s*)?keywords?\b') then 'hard'
    when regexp_matches(s, '^#{1,6}\s+\S.*$') and not num then 'hard' when len(s) < 80 and not num then 'soft' else 'keep' end as quality from n)"""


def _lines(t):
    return t.wide("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "chunk")).withColumn(
        "quality", chunk_quality("chunk")
    )


@query(
    "flt1_chunk_quality",
    f"with {_LINES} select lang, quality, count(*) as n from lab group by all",
)
def flt1(t):
    return _lines(t).groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt1_backfill_to_k",
    _LINES.replace("ln as", "with ln as").replace("unnest(string_split(text, chr(10))) as chunk", "unnest(string_split(text, chr(10))) as chunk, unnest(range(0, len(string_split(text, chr(10))))) as pos")
    .replace("select doc_id, lang, trim(chunk) as s", "select doc_id, lang, pos, trim(chunk) as s")
    + """, r as (select doc_id, pos, quality, row_number() over (partition by doc_id order by (quality = 'soft')::int, len(s) desc, pos) as rank from lab where quality <> 'hard')
    select doc_id, pos::int as pos, quality, rank::int as rank from r where rank <= 3""",
)
def flt1_backfill(t):
    scored = _lines(t).withColumn("score", F.length(F.trim("chunk")))
    return R.keep_informative(scored, "doc_id", 3, "quality", "score", "pos").select("doc_id", "pos", "quality", "rank")


_CHUNK_SQL = r"""src as (select doc_id, lang, source, regexp_replace('# ' || source || chr(10) || text, '(?m)^(#{1,6}\s)', chr(1) || '\1', 'g') as mk from documents),
  sec as (select doc_id, lang, unnest(string_split(mk, chr(1))) as s, unnest(range(0, len(string_split(mk, chr(1))))) as si from src),
  wd as (select doc_id, lang, si, [x for x in string_split_regex(s, '\s+') if x <> ''] as ws from sec),
  st as (select *, [true] || [regexp_matches(x, '[.!?。！？]["'')\]]*$') for x in ws] as sb, len(ws) as n,
    greatest(ceil((len(ws) - 50) / 206)::int - 1, 0) as last from wd where len(ws) > 0),
  win as (select *, unnest(range(0, last + 1))::int as w from st),
  bd as (select *, case when w = 0 then 0 else w * 206 + coalesce(nullif(list_position(sb[w * 206 + 1 : w * 206 + 51], true), 0) - 1, 0) end as b,
    case when w = last then n else coalesce((w + 1) * 206 + 51 - nullif(list_position(list_reverse(sb[(w + 1) * 206 + 1 : (w + 1) * 206 + 51]), true), 0), (w + 1) * 206 + 50) end as e from win),
  ch as (select doc_id, lang, si, w, array_to_string(ws[b + 1 : e], ' ') as chunk from bd),
  chunks as (select doc_id, lang, chunk, row_number() over (partition by doc_id order by si, w) - 1 as chunk_index, count(*) over (partition by doc_id) as total_chunks from ch)"""


def _chunks(t):
    docs = t.wide("documents").withColumn("text", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text")))
    return C.chunk_documents(docs.select("doc_id", "lang", "text"), "doc_id", "text")


@query(
    "vec1_two_level_chunking",
    f"with {_CHUNK_SQL} select doc_id, chunk_index::int as chunk_index, total_chunks::int as total_chunks, md5(chunk) as digest, len(chunk)::int as n_chars from chunks",
)
def vec1(t):
    return _chunks(t).select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


@query(
    "vec2_chunk_ids",
    """with c as (select doc_id as pos, case when doc_id % 3 = 0 then '10.1000/s' || (doc_id % 90) else source end as d, case when doc_id % 5 = 0 then null else doc_id % 4 end as ci, lang, text from documents),
      b as (select *, case when d like '10.%' and ci is not null then d || '#chunk:' || ci else 'hash_' || sha256(text) end as base from c),
      r as (select *, row_number() over (partition by base order by pos) as rn from b)
    select pos, case when rn = 1 then base else base || '#dup:' || substr(sha256(text || '|' || '{"chunk_index": ' || coalesce(ci::varchar, 'null') || ', "doc_id": "' || d || '", "reaction_type": "' || lang || '"}'), 1, 16) end as chunk_id from r""",
)
def vec2(t):
    chunks = t.documents.select(
        F.col("doc_id").alias("pos"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("10.1000/s"), text(F.pmod("doc_id", F.lit(90))))).otherwise(F.col("source")).alias("doc_id"),
        F.when(F.pmod("doc_id", F.lit(5)) != 0, F.pmod("doc_id", F.lit(4))).alias("chunk_index"),
        F.col("lang").alias("reaction_type"),
        "text",
    )
    return C.with_chunk_ids(chunks, "pos").select("pos", "chunk_id")


_HASH_SQL = f"""hv as (select doc_id, idx, sum(sg) as s from (select doc_id, (('0x' || substr(sha256(t), 1, 8))::bigint % 64)::int as idx,
    case when ('0x' || substr(sha256(t), 9, 2))::int % 2 = 1 then -1.0::double else 1.0 end as sg from ({_TOK.format(id='doc_id', text='text', table='documents')})) group by all),
  nm as (select doc_id, sqrt(sum(s * s)) as n from hv group by 1)"""


def _long(df):
    entries = df.select("doc_id", F.posexplode("embedding").alias("idx", "w"))
    return entries.where("w <> 0").select("doc_id", "idx", F.round("w", 6).alias("w"))


_HASH_OUT = f"with {_HASH_SQL} select doc_id, idx, round(s / n, 6) as w from hv join nm using (doc_id) where s <> 0"


@query("vec3_hash_embedding", _HASH_OUT)
def vec3(t):
    return _long(t.wide("documents").select("doc_id", C.hash_embedding("text", 64).alias("embedding")))


def _python_hash_embedder(dim: int, stopwords: tuple):
    """A pluggable embedder with the same rule as the built-in one, as plain Python."""

    def embed(texts):
        import hashlib
        import re

        out = []
        for s in texts:
            if not s.strip():
                raise ValueError("empty text")
            v = [0.0] * dim
            for tok in re.split("[^a-z0-9]+", s.lower()):
                if len(tok) >= 2 and not tok.isdigit() and tok not in stopwords:
                    h = hashlib.sha256(tok.encode()).digest()
                    v[int.from_bytes(h[:4], "big") % dim] += -1.0 if h[4] & 1 else 1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


@query("udf3_pluggable_embedder", _HASH_OUT)
def udf3(t):
    return _long(C.embed_with(t.wide("documents"), "doc_id", "text", _python_hash_embedder(64, tuple(K.STOPWORDS))))


@query(
    "vec4_batch_embedding_with_errors",
    """select count(*) as n, count_if(doc_id % 10 = 3)::bigint as n_failed, count_if(doc_id % 10 <> 3)::bigint as n_embedded from documents
      where doc_id not in (select doc_id from labels)""",
)
def vec4(t):
    missing = J.resume(t.documents, t.labels, "doc_id")
    body = F.when(F.pmod("doc_id", F.lit(10)) == 3, " ").otherwise(F.concat(F.lit("x "), F.col("text")))
    out = C.embed_with(missing.select("doc_id", body.alias("text")), "doc_id", "text", _python_hash_embedder(16, tuple(K.STOPWORDS)), batch=10)
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count("error").alias("n_failed"), F.count("embedding").alias("n_embedded")
    )


@query(
    "vec5_content_hash_invalidation",
    """with c as (select doc_id, sha256(case when toxic = 1 then text || '!' else text end) as h, case when quality = 0 then 'old' else 'm1' end as model
        from documents join labels using (doc_id))
    select d.doc_id, sha256(d.text) as text_hash from documents d left join c on c.doc_id = d.doc_id and c.model = 'm1' where c.h is null or c.h <> sha256(d.text)""",
)
def vec5(t):
    cache = t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_hash"),
        F.when(F.col("quality") == 0, "old").otherwise("m1").alias("model"),
    )
    return C.changed_texts(t.documents.select("doc_id", "text"), cache, "doc_id", "text", "m1").select("doc_id", "text_hash")


@query(
    "snk4_collection_copy",
    """select (select count(*) from documents) as source_rows, (select count(*) from labels) as present_rows,
      (select count(*) from documents where doc_id not in (select doc_id from labels)) as copied_rows, true as complete""",
)
def snk4(t):
    from siftlab.sources.sinks import copy_report

    return copy_report(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")
