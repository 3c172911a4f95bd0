"""Queries on samples, orders and splits of documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.operators import sampling as S, sets
from siftlab.operators.ordinals import hash_key
from siftlab.plans.common import text
from siftlab.plans.registry import query


@query(
    "win2_balanced_sample",
    """with h as (select doc_id, lang, sha256('42|' || lang || '|' || doc_id) as h from documents),
      r as (select *, row_number() over (partition by lang order by h, doc_id) as rn from h)
    select doc_id, lang from r where rn <= 12""",
)
def win2(t):
    return S.balanced_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 12, 42)


@query(
    "win2_balanced_orders",
    """with h as (select o_orderkey, o_orderpriority, sha256('7|' || o_orderpriority || '|' || o_orderkey) as h from orders),
      r as (select *, row_number() over (partition by o_orderpriority order by h, o_orderkey) as rn from h)
    select o_orderkey, o_orderpriority from r where rn <= 250""",
)
def win2_orders(t):
    return S.balanced_sample(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 250, 7)


def _chain(source: str, groups: int, quota: int, scarcity: str) -> str:
    """SQL of the scarce-first allocation: one step per group, each without the documents used."""
    steps = [
        f"""src as ({source}), pool as (select * from (select *, row_number() over (partition by g, doc order by h, id) as dr from src)
          where dr = 1), ord as (select g, row_number() over (order by {scarcity}, g) as k from src group by g)"""
    ]
    for i in range(1, groups + 1):
        used = " ".join(f"and doc not in (select doc from s{j})" for j in range(1, i))
        steps.append(
            f"""s{i} as (select g, doc, id, rn from (select *, row_number() over (order by h, id) as rn from pool
              where g = (select g from ord where k = {i}) {used}) where rn <= {quota})"""
        )
    union = " union all ".join(f"select * from s{i}" for i in range(1, groups + 1))
    return "with " + ", ".join(steps) + f", picked as ({union})"


_DOC_SRC = """select lang as g, 'd' || (doc_id % 97) as doc, doc_id as id, sha256('11|' || lang || '|' || doc_id) as h from documents"""


def _shared_documents(t):
    return t.documents.select(
        F.col("lang").alias("g"), F.concat(F.lit("d"), text(F.pmod("doc_id", F.lit(97)))).alias("doc"), F.col("doc_id").alias("id")
    )


@query(
    "win3_document_disjoint_allocation",
    _chain(_DOC_SRC, 4, 15, "count(distinct doc)") + " select g, doc, id from picked",
)
def win3(t):
    return S.disjoint_sample(_shared_documents(t), "g", "doc", "id", 15, 11)


@query(
    "win4_train_validation_split",
    _chain(_DOC_SRC, 4, 15, "count(*)") + " select g, doc, id, case when rn <= 10 then 'train' else 'validation' end as split from picked",
)
def win4(t):
    return S.disjoint_split(_shared_documents(t), "g", "doc", "id", 10, 5, 11)


@query(
    "set5_overlap_check",
    _chain(_DOC_SRC, 4, 15, "count(*)")
    + """, a as (select id, doc from picked where rn <= 10), b as (select id, doc from picked where rn > 10)
    select 'id' as key, (select count(*) from a) as expected, (select count(*) from b) as got, 0::bigint as shared,
      (select count(*) from a) as missing, (select count(*) from b) as extra, false as equal
    union all select 'doc', (select count(*) from a), (select count(*) from b), 0,
      (select count(*) from a), (select count(*) from b), false""",
)
def set5(t):
    split = S.disjoint_split(_shared_documents(t), "g", "doc", "id", 10, 5, 11)
    train, validation = split.where("split = 'train'"), split.where("split = 'validation'")
    ids = sets.set_report(train, validation, ["id"]).withColumn("key", F.lit("id"))
    docs = sets.set_report(train, validation, ["doc"]).withColumn("key", F.lit("doc"))
    return ids.unionByName(docs)


@query(
    "win5_round_robin",
    """with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from documents),
      o as (select *, case lang when 'fr' then 0 when 'en' then 1 when 'de' then 2 else 3 end as slot from r)
    select doc_id, lang, row_number() over (order by rn, slot) - 1 as position from o""",
)
def win5(t):
    return S.round_robin(t.documents.select("doc_id", "lang"), "lang", "doc_id", ["fr", "en"])


@query(
    "win6_k_fold_replication",
    """select c_custkey, unnest(range(1, 4))::int as attempt from customer""",
)
def win6(t):
    return S.replicate(t.customer.select("c_custkey"), 3)


@query(
    "win7_batch_slice",
    """with r as (select event_id, user_id, event_type, row_number() over (order by user_id, event_id) - 1 as i from events)
    select event_id, user_id from r where i >= 3 * 2 * 64 and i < 4 * 2 * 64 and event_type <> 'error'""",
)
def win7(t):
    rows = t.events.select(
        "event_id", "user_id", F.when(F.col("event_type") == "error", "init").otherwise("rollout").alias("stage")
    )
    return S.batch_slice(rows, ["user_id", "event_id"], 3, 64, k=2, stage="rollout").drop("stage")


@query(
    "win7_batch_numbers",
    """with r as (select user_id, (row_number() over (order by user_id, event_id) - 1) // 128 as batch from events)
    select batch::bigint as batch, count(*) as n, min(user_id) as first_user, max(user_id) as last_user from r group by 1""",
)
def win7_numbers(t):
    rows = S.batch_numbers(t.events.select("event_id", "user_id"), ["user_id", "event_id"], 64, k=2)
    return rows.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user")
    )


@query(
    "win9_retain_last",
    "select event_id, event_type, value from events order by ts desc, event_id desc limit 200",
)
def win9(t):
    last = S.retain_last(t.events, [F.col("ts").desc(), F.col("event_id").desc()], 200)
    return last.select("event_id", "event_type", "value")


@query(
    "top8_prefix_then_shuffle",
    """select row_number() over (order by sha256('3|' || o_orderkey)) - 1 as position, o_orderkey
    from (select o_orderkey from orders order by o_orderkey limit 500)""",
)
def top8(t):
    from pyspark.sql import Window

    # The prefix has 500 rows by definition, so numbering it takes one task.
    prefix = S.shuffled_prefix(t.orders.select("o_orderkey"), "o_orderkey", 500, 3)
    position = F.row_number().over(Window.orderBy(hash_key(3, "o_orderkey"))) - 1
    return prefix.select(position.cast("bigint").alias("position"), "o_orderkey")


@query(
    "jon6_exclusion_anti_join",
    """select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)
      and source not in (select source from documents join labels using (doc_id) where toxic = 1 and quality = 0)""",
)
def jon6(t):
    docs = t.documents.select("doc_id", "source")
    labelled = docs.join(t.labels, "doc_id")
    earlier_ids = labelled.where("toxic = 1").select("doc_id")
    earlier_docs = labelled.where("toxic = 1 AND quality = 0").select("source")
    kept = docs.join(earlier_ids, "doc_id", "left_anti")
    return kept.join(earlier_docs.distinct(), "source", "left_anti").select("doc_id", "source")


@query(
    "jon6_exclude_earlier_sets",
    """with e as (select l_orderkey, l_partkey from lineitem where l_quantity = 50 and l_returnflag = 'A')
    select o_orderkey as id, o_custkey as doc from orders where o_orderkey not in (select l_orderkey from e)
      and o_custkey not in (select l_partkey from e)""",
)
def jon6_earlier(t):
    earlier = t.lineitem.where("l_quantity = 50 AND l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("doc")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"))
    return S.exclude_earlier(rows, earlier, "id", "doc").select("id", "doc")


@query(
    "jon15_complete_pairs",
    """with f as (select l_orderkey, l_linenumber, l_returnflag from lineitem)
    select l_orderkey, l_linenumber, count(*) as n from f where l_orderkey in
      (select l_orderkey from f group by 1 having count_if(l_returnflag = 'A') > 0 and count_if(l_returnflag = 'R') > 0) group by all""",
)
def jon15(t):
    rows = S.complete_pairs(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_returnflag", ["A", "R"])
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set2_key_difference",
    """select c_custkey as id, 'missing' as side from customer where c_custkey not in (select o_custkey from orders)
    union all select distinct o_custkey, 'extra' from orders where o_custkey not in (select c_custkey from customer)
    union all select -1 - s_suppkey, 'extra' from supplier""",
)
def set2(t):
    got = t.orders.select(F.col("o_custkey").alias("id")).unionByName(
        t.supplier.select((F.lit(-1) - F.col("s_suppkey")).alias("id"))
    )
    return sets.key_difference(t.customer.select(F.col("c_custkey").alias("id")), got, ["id"])


@query(
    "set3_distinct_in_first_order",
    "select user_id, event_type, min(event_id) as event_id from events group by all",
)
def set3(t):
    return sets.distinct_first(t.events, ["user_id", "event_type"], "event_id")


@query(
    "set4_set_equality",
    """with e as (select distinct l_orderkey as k from lineitem), g as (select o_orderkey as k from orders)
    select (select count(*) from e) as expected, (select count(*) from g) as got, (select count(*) from e join g using (k)) as shared,
      (select count(*) from e where k not in (select k from g)) as missing,
      (select count(*) from g where k not in (select k from e)) as extra, false as equal""",
)
def set4(t):
    return sets.set_report(
        t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), ["k"]
    )
