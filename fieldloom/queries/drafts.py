"""Drafts of conversations and orders: alternatives, manifest, tables, names, containment, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import artefacts, drafts, space
from ..sources import documents as sources
from ..plans.storage import shared_folder, stored
from .rendered import conversation_json, customer_yaml, order_xml, table


def _schemas(spark, sf_dir: str) -> dict[str, DataFrame]:
    graphs = drafts.drafts(conversation_json(spark, sf_dir)).select(F.col("doc_id").alias("schema_id"), "graph")
    return drafts.exploded(graphs)


def d4_alternatives(spark, sf_dir: str) -> DataFrame:
    return drafts.alternatives(drafts.drafts(conversation_json(spark, sf_dir))).select("count", "doc_id")


def d5_manifest(spark, sf_dir: str) -> DataFrame:
    made = drafts.drafts(order_xml(spark, sf_dir))
    m = drafts.manifest(drafts.alternatives(made), made)
    return m.select(F.array_join("formats", ",").alias("formats"), "syntax", "documents", "errors", "alternatives", "suggested_count")


def d5_analysis(spark, sf_dir: str) -> DataFrame:
    """The whole manifest of the orders' analysis, read back: its head, and its root alternatives by their counts."""
    path = f"{shared_folder(spark)}/analysis-{uuid.uuid4().hex}/orders.manifest.json"
    docs = order_xml(spark, sf_dir)
    made = stored(drafts.drafts(docs), "drafted")
    found = stored(drafts.alternatives(made), "alternatives")
    artefacts.write_manifest(path, "orders", {"resource": "analysis", "id": "a1", "revision": "1"}, found, made, space.build(sources.summaries(docs)))
    lines = spark.read.option("lineSep", "\n").text(path)
    head = lines.where("value like '{\"contractVersion\"%'").select(F.concat(F.regexp_replace("value", ",$", ""), F.lit("}")).alias("j"))
    get = lambda p: F.get_json_object("j", p)
    rows = lines.where("value like '{\"id\":%'").select(F.regexp_replace("value", ",$", "").alias("j")).select(get("$.id").alias("id"), get("$.count").cast("long").alias("count"))
    top = head.select(get("$.suggestedDraft.suggestedRootAlternativeId").alias("id"), F.lit(True).alias("suggested"))
    said = head.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), get(p).alias("value")) for n, p in (("formats", "$.inputFormats"), ("dialect", "$.profile.dialect"), ("documents", "$.statistics.documents"), ("fields", "$.statistics.fields"))])).alias("s")).select("s.*", F.lit(1).cast("long").alias("n"))
    counted = rows.join(top, "id", "left").groupBy(F.when(F.col("suggested"), "suggested").otherwise("alternative").alias("what"), F.col("count").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return said.unionByName(counted)


def d6_members(spark, sf_dir: str) -> DataFrame:
    t = _schemas(spark, sf_dir)
    kind = lambda c: F.get_json_object("data", f"$.{c}")
    nodes = t["nodes"].groupBy("schema_id", kind("kind").alias("kind")).agg(F.count("*").alias("n"))
    members = t["members"].groupBy("schema_id", kind("kind").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.unionByName(members)


def d6_rows(spark, sf_dir: str) -> DataFrame:
    """The nodes and members of the nested customers, with all that they say."""
    tables = drafts.exploded(_nested(spark, sf_dir).select(F.col("doc_id").alias("schema_id"), "graph"))
    none = F.lit(None)
    nodes = tables["nodes"].select("schema_id", "id", none.cast("string").alias("collection_id"), none.cast("long").alias("position"), "data")
    return nodes.unionByName(tables["members"].select("schema_id", "id", "collection_id", "position", "data"))


def d6_rebuilt(spark, sf_dir: str) -> DataFrame:
    back = drafts.rebuilt(_schemas(spark, sf_dir))
    return back.select("schema_id", F.size("items").cast("long").alias("n")).groupBy("schema_id").agg(F.count("*").alias("collections"), F.sum("n").alias("members"))


def j7_contained(spark, sf_dir: str) -> DataFrame:
    graphs = drafts.drafts(conversation_json(spark, sf_dir)).select(F.col("doc_id").alias("schema_id"), "graph")
    roots = graphs.select("schema_id", F.get_json_object("graph", "$.rootNodeId").alias("ancestor"))
    return drafts.contained(drafts.edges(drafts.exploded(graphs)), roots).groupBy("schema_id").agg(F.count("*").alias("nodes"))


def j8_member_counts(spark, sf_dir: str) -> DataFrame:
    return drafts.member_counts(_schemas(spark, sf_dir)).groupBy("schema_id", "members").agg(F.count("*").alias("nodes"))


def _nested(spark, sf_dir: str, more: int = 0) -> DataFrame:
    """Customers as objects of three fields below up to six arrays, and more."""
    depth = (F.col("c_custkey") % 7).cast("int") + more
    body = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    content = F.concat(F.repeat(F.lit("["), depth), body, F.repeat(F.lit("]"), depth))
    return drafts.drafts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("json").alias("format"), content.alias("content")))


def d2_graph(spark, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).select(F.col("doc_id").alias("schema_id"), "graph")


def d2_yaml(spark, sf_dir: str) -> DataFrame:
    """Kinds and types of the nodes of YAML drafts."""
    graphs = drafts.drafts(customer_yaml(spark, sf_dir)).select(F.col("doc_id").alias("schema_id"), "graph")
    nodes = drafts.exploded(graphs)["nodes"]
    kind = F.coalesce(F.get_json_object("data", "$.scalarType"), F.get_json_object("data", "$.kind"))
    return nodes.groupBy("schema_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def j8_nested(spark, sf_dir: str) -> DataFrame:
    graphs = _nested(spark, sf_dir).select(F.col("doc_id").alias("schema_id"), "graph")
    return drafts.member_counts(drafts.exploded(graphs)).groupBy("schema_id", "members").agg(F.count("*").alias("nodes"))


def j7_pairs(spark, sf_dir: str) -> DataFrame:
    """What each node of the nested customers contains."""
    tables = drafts.exploded(_nested(spark, sf_dir).select(F.col("doc_id").alias("schema_id"), "graph"))
    return drafts.contained(drafts.edges(tables), tables["nodes"].select("schema_id", F.col("id").alias("ancestor")))


def j8_deep(spark, sf_dir: str) -> DataFrame:
    """The members behind a hundred arrays and more."""
    graphs = _nested(spark, sf_dir, 100).select(F.col("doc_id").alias("schema_id"), "graph")
    return drafts.member_counts(drafts.exploded(graphs)).groupBy("schema_id", "members").agg(F.count("*").alias("nodes"))


def c7_drafts(spark, sf_dir: str) -> DataFrame:
    """A draft of each alternative of the conversations, and of one that there isn't."""
    made = drafts.drafts(conversation_json(spark, sf_dir))
    found = stored(drafts.alternatives(made), "alternatives")
    title = F.concat(F.lit("draft of "), F.col("count").cast("string"))
    asked = found.select(F.col("doc_id").alias("schema_id"), F.col("id").alias("alternative_id"), title.alias("title"))
    unknown = found.groupBy().agg(F.lit(-1).cast("long").alias("schema_id"), F.lit("alternative-none").alias("alternative_id"), F.lit("unknown").alias("title"))
    return drafts.created(asked.unionByName(unknown), found, made).drop("graph")


def j9_repeated_names(spark, sf_dir: str) -> DataFrame:
    """Turns in which role and turn are given one name."""
    m = _schemas(spark, sf_dir)["members"]
    cut = m.withColumn("data", F.regexp_replace("data", '"name":"(role|turn)"', '"name":"same"'))
    return drafts.repeated_names(cut).groupBy("name").agg(F.count("*").alias("collections"))


def k2_page(spark, sf_dir: str) -> DataFrame:
    t = _schemas(spark, sf_dir)
    p = drafts.page(t["members"], t["nodes"], "collection-1", 0, 1)
    return p.select("schema_id", "position", "value_kind", "label", "total", F.get_json_object(F.unbase64(F.translate("next", "-_", "+/")).cast("string"), "$[4]").cast("long").alias("next_offset"))


def k1_suggested(spark, sf_dir: str) -> DataFrame:
    s = space.build(sources.summaries(order_xml(spark, sf_dir)))
    return space.suggested(space.roots(s)).select("count", "total")


def k3_listing(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderdate").alias("created"))
    return drafts.newest(rows, "1-URGENT", 50)


QUERIES = {
    "c7_drafts": c7_drafts,
    "d2_graph": d2_graph,
    "d2_yaml": d2_yaml,
    "j8_nested": j8_nested,
    "j8_deep": j8_deep,
    "j7_pairs": j7_pairs,
    "d4_alternatives": d4_alternatives,
    "d5_manifest": d5_manifest,
    "d5_analysis": d5_analysis,
    "d6_members": d6_members,
    "d6_rebuilt": d6_rebuilt,
    "d6_rows": d6_rows,
    "j7_contained": j7_contained,
    "j8_member_counts": j8_member_counts,
    "j9_repeated_names": j9_repeated_names,
    "k1_suggested": k1_suggested,
    "k2_page": k2_page,
    "k3_listing": k3_listing,
}

#: For each conversation, whether it has turns of users, of others, and whose turn comes first.
_KINDS = "with c as (select conv_id, bool_or(role = 'user') as u, bool_or(role <> 'user') as o, arg_min(role = 'user', turn) as f from conversations group by 1)"

ORACLE = {
    "d4_alternatives": f"{_KINDS} select count(*) as count, min(conv_id) as doc_id from c group by u, o, f",
    "d5_manifest": """
with s as (select o_orderkey % 2 as a, case when o_orderkey % 5 < 3 then o_orderkey % 5 else 9 end as n, o_orderkey % 7 = 0 as p, o_orderstatus is null as z, count(*) as c from orders group by all)
select 'xml' as formats, 'xml' as syntax, (select count(*) from orders) as documents, cast(0 as bigint) as errors, count(*) as alternatives, max(c) as suggested_count from s
""",
    "d5_analysis": """
with s as (select o_orderkey % 2 as a, case when o_orderkey % 5 < 3 then o_orderkey % 5 else 9 end as n, o_orderkey % 7 = 0 as p, o_orderstatus is null as z, count(*) as c from orders group by all)
select 'formats' as what, '["xml"]' as value, 1 as n union all select 'dialect', 'xsd-1.0', 1 union all select 'documents', count(*)::varchar, 1 from orders union all select 'fields', '6', 1
union all select 'suggested', max(c)::varchar, 1 from s
union all select 'alternative', c::varchar, count(*) - (c = (select max(c) from s))::int from s group by c having count(*) > (c = (select max(c) from s))::int
""",
    "d6_members": f"""{_KINDS}, n as (
  select conv_id, 'object' as kind, 1 + u::int + o::int as n from c union all select conv_id, 'array', 1 from c union all select conv_id, 'union', 1 from c where u and o
  union all select conv_id, 'scalar', 1 + case when u then 3 else 0 end + case when o then 2 else 0 end from c
  union all select conv_id, 'property', 2 + case when u then 3 else 0 end + case when o then 2 else 0 end from c union all select conv_id, 'option', 2 from c where u and o)
select conv_id as schema_id, kind, cast(n as bigint) as n from n
""",
    "d6_rebuilt": f"""{_KINDS}
select conv_id as schema_id, cast(1 + u::int + o::int + (u and o)::int as bigint) as collections,
       cast(2 + case when u then 3 else 0 end + case when o then 2 else 0 end + case when u and o then 2 else 0 end as bigint) as members from c
""",
    "j7_contained": f"{_KINDS} select conv_id as schema_id, cast(3 + u::int + o::int + (u and o)::int + case when u then 3 else 0 end + case when o then 2 else 0 end as bigint) as nodes from c",
    "j8_member_counts": f"""{_KINDS}, n as (
  select conv_id, 2 as m, 1 as k from c union all select conv_id, case when u and not o then 3 else 2 end, 1 from c union all select conv_id, 2, 1 from c where u and o
  union all select conv_id, 3, 1 from c where u union all select conv_id, 2, 1 from c where o
  union all select conv_id, 0, 1 + case when u then 3 else 0 end + case when o then 2 else 0 end from c)
select conv_id as schema_id, cast(m as bigint) as members, cast(sum(k) as bigint) as nodes from n group by all
""",
    "j8_nested": """
select c_custkey as schema_id, cast(m as bigint) as members, cast(case when m = 3 then c_custkey % 7 + 1 else 3 end as bigint) as nodes from customer, (values (0), (3)) v(m)
""",
    "j8_deep": """
select c_custkey as schema_id, cast(m as bigint) as members, cast(case when m = 3 then c_custkey % 7 + 101 else 3 end as bigint) as nodes from customer, (values (0), (3)) v(m)
""",
    "j7_pairs": """
with n as (select c_custkey as schema_id, unnest(range(1, c_custkey % 7 + 5)) as a from customer)
select schema_id, 'node-' || a as ancestor, 'node-' || unnest(case when a < 4 then [a] else range(1, a + 1) end) as node from n
""",
    "d6_rows": """
with k as (select c_custkey as schema_id, c_custkey % 7 as depth from customer)
select schema_id, 'node-' || i as id, null as collection_id, null::bigint as position, '{"constraints":{},"id":"node-' || i || '","kind":"scalar","scalarType":"' || t || '"}' as data from k, (values (1, 'integer'), (2, 'string'), (3, 'integer')) v(i, t)
union all select schema_id, 'node-4', null, null, '{"additionalProperties":false,"id":"node-4","kind":"object","properties":{"id":"collection-1","totalItems":3}}' from k
union all select schema_id, 'node-' || (4 + i), null, null, '{"id":"node-' || (4 + i) || '","itemsNodeId":"node-' || (3 + i) || '","kind":"array","maxItems":null,"minItems":0}' from (select schema_id, unnest(range(1, depth + 1)) as i from k)
union all select schema_id, 'member-' || i, 'collection-1', i - 1, '{"id":"member-' || i || '","kind":"property","name":"' || n || '","required":true,"valueNodeId":"node-' || i || '"}' from k, (values (1, 'key'), (2, 'name'), (3, 'nation')) v(i, n)
""",
    "d2_graph": """
with k as (select c_custkey as schema_id, c_custkey % 7 as depth from customer),
n as (
  select schema_id, 'node-' || i as id, '{"constraints":{},"id":"node-' || i || '","kind":"scalar","scalarType":"' || t || '"}' as body from k, (values (1, 'integer'), (2, 'string'), (3, 'integer')) v(i, t)
  union all select schema_id, 'node-4', '{"additionalProperties":false,"id":"node-4","kind":"object","properties":{"id":"collection-1","totalItems":3}}' from k
  union all select schema_id, 'node-' || (4 + i), '{"id":"node-' || (4 + i) || '","itemsNodeId":"node-' || (3 + i) || '","kind":"array","maxItems":null,"minItems":0}'
  from (select schema_id, unnest(range(1, depth + 1)) as i from k)),
m as (select string_agg('{"id":"member-' || i || '","kind":"property","name":"' || name || '","required":true,"valueNodeId":"node-' || i || '"}', ',' order by i) as body
      from (values (1, 'key'), (2, 'name'), (3, 'nation')) v(i, name))
select k.schema_id, '{"collections":{"collection-1":[' || any_value(m.body) || ']},"nodes":{' || string_agg('"' || n.id || '":' || n.body, ',' order by n.id)
  || '},"profile":{"dialect":"json-schema-2020-12","syntax":"json"},"rootNodeId":"node-' || (4 + any_value(depth)) || '"}' as graph
from k join n using (schema_id), m group by k.schema_id
""",
    "d2_yaml": """
with c as (select c_custkey as schema_id, c_custkey % 4 = 0 as t from customer)
select schema_id, kind, cast(n as bigint) as n from (
  select schema_id, 'object' as kind, 2 as n from c union all select schema_id, 'integer', 1 + t::int from c union all select schema_id, 'string', 1 + t::int from c
  union all select schema_id, 'boolean', 1 from c union all select schema_id, 'date', 1 from c union all select schema_id, 'null', 1 from c
  union all select schema_id, 'array', 1 from c where t union all select schema_id, 'union', 1 from c where t)
""",
    "c7_drafts": f"""{_KINDS}, a as (select u, o, f, count(*) as n, min(conv_id) as first from c group by u, o, f)
select first as schema_id, 'draft of ' || n as title, 'created' as outcome, 's1' as revision, 'json' as syntax, 'json-schema-2020-12' as dialect,
  'node-' || (3 + u::int + o::int + (u and o)::int + case when u then 3 else 0 end + case when o then 2 else 0 end) as root_node_id from a
union all select -1, 'unknown', 'not_found', null, null, null, null
""",
    "j9_repeated_names": f"{_KINDS} select 'same' as name, cast(sum(u::int + o::int) as bigint) as collections from c",
    "k1_suggested": "with s as (select o_orderkey % 5 < 3 as n, o_orderkey % 7 = 0 as p, count(*) as c from orders group by all) select max(c) as count, (select count(*) from orders) as total from s",
    "k2_page": f"{_KINDS} select conv_id as schema_id, cast(0 as bigint) as position, 'scalar' as value_kind, 'integer' as label, cast(case when f then 3 else 2 end as bigint) as total, cast(1 as bigint) as next_offset from c",
    "k3_listing": "select o_orderkey as id, o_orderpriority as owner, o_orderdate as created from orders where o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey limit 50",
}
