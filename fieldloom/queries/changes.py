"""Changeset replay: customers' graphs, edited by a log made of their orders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import changes, exports
from ..plans import drafts
from ..plans.storage import stored
from .rendered import table


def _graphs(spark, sf_dir: str) -> DataFrame:
    """A graph a customer: an object with key, name, segment and, below home, nation."""
    body = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("home")))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("json").alias("format"), body.alias("content"))
    return drafts.drafts(docs).select(F.col("doc_id").alias("schema_id"), "graph")


def _log(spark, sf_dir: str) -> DataFrame:
    """Each order renames a property of its customer's graph; the n-th order of a customer expects revision n, but every
    fifth expects s1, and every seventh repeats the mutation id of its customer."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("schema_id"), F.col("o_orderkey").alias("seq"))
    n = F.row_number().over(Window.partitionBy("schema_id").orderBy("seq"))
    o = o.withColumn("n", n)
    return o.select(
        "schema_id", "seq", F.concat(F.lit("m-"), F.when(F.col("seq") % 7 == 0, F.lit("again")).otherwise(F.col("seq").cast("string"))).alias("mutation_id"),
        F.concat(F.lit("s"), F.when(F.col("seq") % 5 == 0, F.lit(1)).otherwise(F.col("n")).cast("string")).alias("base_revision"),
        F.to_json(F.array(F.struct(F.lit("renameProperty").alias("kind"), F.lit("member-1").alias("memberId"), F.concat(F.lit("f"), (F.col("seq") % 4).cast("string")).alias("name")))).alias("operations"),
    )


def c4_receipts(spark, sf_dir: str) -> DataFrame:
    receipts, _ = changes.replayed(_graphs(spark, sf_dir), _log(spark, sf_dir))
    return receipts.groupBy("outcome").agg(F.count("*").alias("n"))


def c6_revisions(spark, sf_dir: str) -> DataFrame:
    """Accepted changes and the last revision of each schema agree."""
    receipts, after = changes.replayed(_graphs(spark, sf_dir), _log(spark, sf_dir))
    accepted = receipts.where("outcome = 'accepted'").groupBy("schema_id").agg(F.count("*").alias("accepted"))
    return after.join(accepted, "schema_id", "left").select("schema_id", "revision", F.coalesce("accepted", F.lit(0)).alias("accepted"))


def c5_replays(spark, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("digest", F.sha2(F.concat("base_revision", "operations"), 256))
    return changes.deduplicated(log).groupBy("schema_id", "outcome").agg(F.count("*").alias("n"))


def _members(after: DataFrame) -> DataFrame:
    """schema_id, members: collections in order, each with the names of its members in order."""
    rows = drafts.rebuilt(drafts.exploded(after.select("schema_id", "graph")))
    names = F.array_join(F.transform("items", lambda m: F.get_json_object(m, "$.name")), ",")
    return rows.groupBy("schema_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("collection_id", F.lit(":"), names))), " ").alias("members"))


def c3_moves(spark, sf_dir: str) -> DataFrame:
    """One batch a customer: moves out of an object and into it, below itself, before itself; a name that is taken; a batch
    whose second operation fails, so its first is undone."""
    move = lambda member, to, before=None: {"kind": "moveMember", "memberId": member, "targetCollectionId": to, "beforeMemberId": before}
    rename = lambda member, name: {"kind": "renameProperty", "memberId": member, "name": name}
    batches = [
        [move("member-4", "collection-2", "member-1")], [move("member-1", "collection-1")], [move("member-5", "collection-1")],
        [rename("member-1", "name")], [rename("member-1", "id"), move("member-2", "collection-9")], [move("member-3", "collection-2", "member-3"), rename("member-2", "title")],
    ]
    key = F.col("c_custkey")
    chosen = F.get(F.array(*[F.lit(json.dumps(b)) for b in batches]), (key % len(batches)).cast("int"))
    log = table(spark, sf_dir, "customer").select(key.alias("schema_id"), key.alias("seq"), F.lit("m").alias("mutation_id"), F.lit("s1").alias("base_revision"), chosen.alias("operations"))
    receipts, after = changes.replayed(_graphs(spark, sf_dir), log)
    return receipts.select("schema_id", "outcome").join(_members(after), "schema_id").join(after.select("schema_id", "revision"), "schema_id")


def c2_xml_names(spark, sf_dir: str) -> DataFrame:
    """Parts as XML drafts, in which an element or an attribute gets another name, or one that it may not have."""
    key = F.col("p_partkey")
    content = F.concat(F.lit('<part size="'), F.col("p_size").cast("string"), F.lit('"><name>'), F.col("p_name"), F.lit("</name><brand/></part>"))
    made = drafts.drafts(table(spark, sf_dir, "part").select(key.alias("doc_id"), F.lit("xml").alias("format"), content.alias("content")))
    graphs = stored(made.select(F.col("doc_id").alias("schema_id"), "graph"), "xml-drafts")
    tables = drafts.exploded(graphs)
    get = lambda path: F.get_json_object("data", path)
    element = tables["nodes"].where((get("$.kind") == "xmlElement") & (get("$.name.localName") == "name")).select("schema_id", F.lit("node").alias("kind"), "id", F.lit(0).alias("which"))
    attribute = tables["members"].where(get("$.kind") == "xmlAttribute").select("schema_id", F.lit("member").alias("kind"), "id", F.lit(1).alias("which"))
    target = F.struct(F.col("kind"), F.col("id"))
    way = F.col("schema_id") % 4
    local = F.when(way == 0, "title").when(way == 1, "weight").when(way == 2, "2nd").otherwise("xmlns")
    uri = F.when(way == 3, "http://www.w3.org/2000/xmlns/")
    name = F.struct(uri.alias("namespaceUri"), local.alias("localName"))
    operation = F.to_json(F.array(F.struct(F.lit("renameXmlName").alias("kind"), target.alias("target"), name.alias("name"))), {"ignoreNullFields": "false"})
    log = element.unionByName(attribute).where(F.col("which") == way % 2).select("schema_id", F.lit(1).cast("long").alias("seq"), F.lit("m").alias("mutation_id"), F.lit("s1").alias("base_revision"), operation.alias("operations"))
    receipts, after = changes.replayed(graphs, log)
    after = drafts.exploded(after.select("schema_id", "graph"))
    named = after["nodes"].where(get("$.kind") == "xmlElement").select("schema_id", get("$.name.localName").alias("n")).unionByName(after["members"].where(get("$.kind") == "xmlAttribute").select("schema_id", F.concat(F.lit("@"), get("$.name.localName")).alias("n")))
    names = named.groupBy("schema_id").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("names"))
    return receipts.select("schema_id", "outcome").join(names, "schema_id")


def _selections(spark, sf_dir: str) -> DataFrame:
    """A selection a part: an object with an attribute and two scalar elements, of which some don't hold."""
    k = F.col("p_partkey")

    def row(n: int, name, kind: str, type_, low, high, parent: int | None = None):
        at = lambda i: F.concat(k.cast("string"), F.lit(f"/{i}"))
        return F.struct(
            at(n).alias("id"), (F.lit(None).cast("string") if parent is None else at(parent)).alias("parent_id"), F.lit(n).alias("position"), name.alias("name"),
            F.lit(kind).alias("kind"), type_.cast("string").alias("type"), low.cast("long").alias("min_occurs"), high.alias("max_occurs"),
        )

    one = F.lit("1")
    size = F.when(k % 4 == 0, "dateTime").when(k % 4 == 1, "anyURI").when(k % 11 == 2, "number").otherwise("decimal")
    rows = F.array(
        row(0, F.lit("part"), "object", F.lit(None), F.lit(1), one), row(1, F.lit("key"), "attribute", F.lit("integer"), F.lit(1), one, 0),
        row(2, F.when(k % 5 == 0, "2nd").otherwise("name"), "scalar", size, F.lit(1), one, 0), row(3, F.lit("brand"), "scalar", F.lit("null"), F.lit(0), F.when(k % 7 == 0, "-1").otherwise("unbounded"), 0),
    )
    return table(spark, sf_dir, "part").select(k.cast("long").alias("schema_id"), F.explode(rows).alias("r")).select("schema_id", "r.*")


def n11_violations(spark, sf_dir: str) -> DataFrame:
    return scalars.selection_violations(_selections(spark, sf_dir))


def e4_xsd(spark, sf_dir: str) -> DataFrame:
    return exports.xsd(_selections(spark, sf_dir))


QUERIES = {"c2_xml_names": c2_xml_names, "c3_moves": c3_moves, "c4_receipts": c4_receipts, "c5_replays": c5_replays, "c6_revisions": c6_revisions, "n11_violations": n11_violations, "e4_xsd": e4_xsd}

_XS = "http://www.w3.org/2001/XMLSchema"
#: The log, entry by entry: the revision so far (v) and what was accepted under the id that repeats (a).
_REPLAY = """
with recursive o as (select o_custkey as schema_id, o_orderkey as seq, row_number() over (partition by o_custkey order by o_orderkey) as i, c_custkey is null as lost
  from orders left join customer on c_custkey = o_custkey),
l as (select schema_id, i, seq % 7 = 0 as again, case when seq % 5 = 0 then 1 else i end as base, case when seq % 5 = 0 then 1 else i end || '/' || seq % 4 as d, lost from o),
r as (
  select distinct schema_id, cast(0 as bigint) as i, cast(1 as bigint) as v, cast(null as varchar) as a, cast(null as varchar) as outcome from l
  union all
  select schema_id, i, v + (outcome = 'accepted')::int, case when outcome = 'accepted' and again then d else a end, outcome from (
    select l.schema_id, l.i, r.v, r.a, l.d, l.again,
      case when l.again and r.a = l.d then 'replayed' when l.again and r.a is not null then 'idempotency_conflict' when l.lost then 'no_schema' when l.base = r.v then 'accepted' else 'revision_conflict' end as outcome
    from r join l on l.schema_id = r.schema_id and l.i = r.i + 1))
"""
ORACLE = {
    "c2_xml_names": """
select p_partkey as schema_id, case when p_partkey % 4 < 2 then 'accepted' else 'rejected' end as outcome,
  case p_partkey % 4 when 0 then '@size,brand,part,title' when 1 then '@weight,brand,name,part' else '@size,brand,name,part' end as names from part
""",
    "c3_moves": """
select c_custkey as schema_id, case when c_custkey % 6 in (0, 1, 5) then 'accepted' else 'rejected' end as outcome, case when c_custkey % 6 in (0, 1, 5) then 's2' else 's1' end as revision,
  case c_custkey % 6 when 0 then 'collection-1: collection-2:nation,key,name,segment,home' when 1 then 'collection-1:nation,key collection-2:name,segment,home'
  when 5 then 'collection-1:nation collection-2:key,title,segment,home' else 'collection-1:nation collection-2:key,name,segment,home' end as members from customer
""",
    "c5_replays": """
with o as (select o_custkey as schema_id, o_orderkey as seq, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
l as (select *, case when seq % 7 = 0 then 'again' else cast(seq as varchar) end as m, (case when seq % 5 = 0 then 1 else n end, seq % 4) as d from o),
r as (select *, row_number() over w as i, first_value(d) over w as f from l window w as (partition by schema_id, m order by seq))
select schema_id, case when i = 1 then 'first' when d = f then 'replayed' else 'idempotency_conflict' end as outcome, count(*) as n from r group by all
""",
    "n11_violations": """
select 'bad_name' as "check", p_partkey || '/2' as id from part where p_partkey % 5 = 0 union all select 'bad_max_occurs', p_partkey || '/3' from part where p_partkey % 7 = 0
union all select 'bad_type', p_partkey || '/2' from part where p_partkey % 4 > 1 and p_partkey % 11 = 2
""",
    "e4_xsd": f"""
select cast(p_partkey as bigint) as schema_id, '<xs:schema xmlns:xs="{_XS}" elementFormDefault="qualified" attributeFormDefault="unqualified"><xs:element name="part"><xs:complexType><xs:sequence>'
  || '<xs:element name="name" minOccurs="1" maxOccurs="1" type="xs:' || case p_partkey % 4 when 0 then 'dateTime' when 1 then 'anyURI' else 'decimal' end
  || '" /><xs:element name="brand" nillable="true" minOccurs="0" maxOccurs="unbounded" type="xs:string" /></xs:sequence>'
  || '<xs:attribute name="key" type="xs:integer" use="required" /></xs:complexType></xs:element></xs:schema>' as xsd
from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and not (p_partkey % 4 > 1 and p_partkey % 11 = 2)
""",
    "c4_receipts": f"{_REPLAY} select outcome, count(*) as n from r where i > 0 group by outcome",
    "c6_revisions": f"""{_REPLAY}
select c_custkey as schema_id, 's' || (1 + count(*) filter (outcome = 'accepted')) as revision, count(*) filter (outcome = 'accepted') as accepted
from customer left join r on schema_id = c_custkey group by c_custkey
""",
}
