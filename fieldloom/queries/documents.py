"""Sources, normalisation, fields, distributions, variants, provenance and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import checks, exports
from ..plans import space
from ..sources import documents as sources
from .rendered import conversation_json, customer_yaml, event_json, order_json, order_xml, table


def _path():
    return F.array_join("path", "/").alias("path")


def _space(docs: DataFrame) -> space.Space:
    return space.build(sources.summaries(docs))


def fields(render):
    def query(spark, sf_dir: str) -> DataFrame:
        return _space(render(spark, sf_dir)).fields.select(_path(), "name", "occurrences", "parent_occurrences", "presence_count", "presence_probability")

    return query


def distribution(render, dimension: str):
    def query(spark, sf_dir: str) -> DataFrame:
        return _space(render(spark, sf_dir)).distributions.where(F.col("dimension") == dimension).select(_path(), "value", "count", "total", "probability")

    return query


def a9_variants(spark, sf_dir: str) -> DataFrame:
    """Variants by the names that they hold (ids are hashes, so they are counted, not compared)."""
    v = _space(conversation_json(spark, sf_dir)).variants
    held = F.array_join(F.array_sort(F.array_distinct(F.transform("children", lambda c: F.element_at(c["path"], -1)))), ",")
    return v.select(_path(), "kind", held.alias("held"), "count").groupBy("path", "kind", "held").agg(F.count("*").alias("variants"), F.sum("count").alias("count"))


def a10_roots(spark, sf_dir: str) -> DataFrame:
    r = space.roots(_space(order_xml(spark, sf_dir)))
    held = F.array_join(F.array_sort(F.transform("children", lambda c: F.element_at(c["path"], -1))), ",")
    return r.select(held.alias("held"), "count", "total", "probability")


def a11_sources(spark, sf_dir: str) -> DataFrame:
    docs = order_json(spark, sf_dir)
    observed = sources.errors(sources.observations(docs, columns=sources.PROVENANCE))[0]
    return space.sources(observed, _space(docs)).select(_path(), "doc_id", F.array_join("position", ".").alias("position"), "name", "representation")


def a12_summary(spark, sf_dir: str) -> DataFrame:
    return _space(order_json(spark, sf_dir)).summary.select("documents", "fields", F.size("warnings").cast("long").alias("warnings"))


def s5_bad_documents(spark, sf_dir: str) -> DataFrame:
    """Raw web pages, read as XML, among orders: pages that aren't well-formed go to the errors."""
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.lit("xml").alias("format"), F.col("html").alias("content"))
    both = sources.observations(order_xml(spark, sf_dir).unionByName(pages), columns=("doc_id",))
    good, bad = sources.errors(both)
    counted = lambda df, what: df.select("doc_id", (F.col("doc_id") < 0).alias("page")).distinct().groupBy("page").count().select(F.lit(what).alias("outcome"), "page", F.col("count").alias("documents"))
    return counted(good, "read").unionByName(counted(bad, "error"))


def n8_budgets(spark, sf_dir: str) -> DataFrame:
    """Orders under limits that they just meet, and under each limit less one: the collection is rejected as a whole."""
    have = sources.held(sources.budgeted_summaries(order_xml(spark, sf_dir), sources.Limits(None, None, None)))
    rows = []
    for less in (None, *have):
        try:
            sources.Limits(**{what: n - (what == less) for what, n in have.items()}).hold(have)
            rows.append(("kept", None, have["documents"]))
        except sources.OverBudget as e:
            rows += [("rejected", what, n) for what, n in e.exceeded.items()]
    return spark.createDataFrame(rows, "outcome string, exceeded string, n long")


def s6_intake(spark, sf_dir: str) -> DataFrame:
    """Web pages by thousands as collections: sizes, names and formats that don't hold."""
    p = table(spark, sf_dir, "pages")
    docs = p.select(
        (F.col("page_id") % 7).alias("collection_id"), F.concat(F.lit("page-"), (F.col("page_id") / F.when(F.col("page_id") % 7 == 3, 2).otherwise(1)).cast("long").cast("string")).alias("name"),
        F.when(F.col("page_id") % 50 == 0, "html").when(F.col("page_id") % 7 == 1, "json").otherwise("xml").alias("format"),
        (F.octet_length("html") + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0)).cast("long").alias("size"), F.col("html").alias("content"),
    )
    return sources.intake_violations(docs, max_documents=30).groupBy("check", "collection_id").agg(F.count("*").alias("n"))


def s7_serialized(spark, sf_dir: str) -> DataFrame:
    j = space.serialized(_space(order_json(spark, sf_dir)))
    get = lambda p: F.get_json_object("json", p)
    return j.select(get("$.name").alias("name"), get("$.format").alias("format"), get("$.occurrences").cast("long").alias("occurrences"), get("$.data_types[0].value").alias("first_type"), get("$.data_types[0].count").cast("long").alias("first_count"))


def n1_types(spark, sf_dir: str) -> DataFrame:
    """Type of texts made from the tables: numbers in several forms, days that exist and that don't, times, words."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.concat(F.lit("2024-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 33).cast("string"), 2, "0"))
    forms = [
        k.cast("string"), F.concat(F.lit("0"), k.cast("string")), F.concat(F.lit(" +"), k.cast("string"), F.lit(" ")), F.concat(k.cast("string"), F.lit(".50")), F.concat(F.lit("-."), k.cast("string")),
        F.concat(k.cast("string"), F.lit("e"), (k % 600).cast("string")), day, F.concat(day, F.lit("T10:00:00Z")), F.when(k % 2 == 0, "true").otherwise("True"), F.lit("  "), F.col("o_orderpriority"),
    ]
    text = o.select(F.posexplode(F.array(*forms)).alias("form", "text"))
    return text.groupBy("form", scalars.xml_type(F.col("text")).alias("type")).agg(F.count("*").alias("n"))


def _text_forms(spark, sf_dir: str) -> DataFrame:
    """Types and values of pages' texts: blanks of several kinds, words, numbers."""
    blank = F.when(F.col("page_id") % 4 == 0, F.lit("")).when(F.col("page_id") % 4 == 1, F.lit(" \n\u00a0\u2003")).when(F.col("page_id") % 4 == 2, F.col("url"))
    kind = F.when(F.col("page_id") % 3 == 0, "integer").otherwise("string")
    return table(spark, sf_dir, "pages").select(kind.alias("data_type"), blank.alias("value"))


def n2_blanks(spark, sf_dir: str) -> DataFrame:
    kind, value = scalars.empty_to_null(F.col("data_type"), F.col("value"))
    return _text_forms(spark, sf_dir).groupBy(kind.alias("data_type"), value.isNull().alias("nothing")).agg(F.count("*").alias("n"))


def n4_attributes(spark, sf_dir: str) -> DataFrame:
    """Attributes of customers, those of the schema-instance namespace dropped."""
    nil = F.lit(sources.XSI + "nil")
    rows = table(spark, sf_dir, "customer").select(F.map_from_arrays(F.array(F.lit("key"), nil, F.col("c_mktsegment")), F.array(F.col("c_custkey").cast("string"), F.lit("1"), F.lit("x"))).alias("attributes"))
    return rows.select(F.explode(scalars.plain_attributes(F.col("attributes"))).alias("name", "value")).groupBy("name").agg(F.count("*").alias("n"))


def n9_names(spark, sf_dir: str) -> DataFrame:
    """Names of parts by namespace and local name."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("{urn:"), F.lower("p_type"), F.lit("}"))).otherwise(""), F.regexp_replace("p_name", " ", "-"))
    return table(spark, sf_dir, "part").groupBy(scalars.namespace(name).alias("namespace"), scalars.local(name).alias("local")).agg(F.count("*").alias("n"))


def n10_draft_types(spark, sf_dir: str) -> DataFrame:
    """The types of n1_types as the scalar types of drafts."""
    return n1_types(spark, sf_dir).select("form", "n", scalars.draft_type(F.col("type")).alias("scalar"))


_DAY = "'2024-' || lpad(cast(k % 14 as varchar), 2, '0') || '-' || lpad(cast(k % 33 as varchar), 2, '0')"
_N1 = f"""
with t as (select o_orderkey as k, o_orderpriority as p from orders),
forms as (
  select 0 as form, cast(k as varchar) as s from t union all select 1, '0' || k from t union all select 2, ' +' || k || ' ' from t union all select 3, k || '.50' from t
  union all select 4, '-.' || k from t union all select 5, k || 'e' || (k % 600) from t union all select 6, {_DAY} from t union all select 7, {_DAY} || 'T10:00:00Z' from t
  union all select 8, case when k % 2 = 0 then 'true' else 'True' end from t union all select 9, '  ' from t union all select 10, p from t)
select form, case when trim(s) = '' then 'null' when s in ('true', 'false') then 'boolean' when regexp_full_match(trim(s), '[+-]?(0|[1-9][0-9]*)') then 'integer'
  when regexp_full_match(trim(s), '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)') then 'decimal'
  when regexp_full_match(trim(s), '[+-]?[0-9]+(\\.[0-9]+)?[eE][+-]?[0-9]+') and coalesce(isfinite(try_cast(trim(s) as double)), false) then 'double'
  when form = 6 and try_cast(s as date) is not null then 'date' when form = 7 and try_cast(s[1:10] as date) is not null then 'dateTime' else 'string' end as type, count(*) as n
from forms group by all
"""
_ITEMS = "(select count(*) from lineitem join orders on l_orderkey = o_orderkey)"
_DOCS = "(select count(distinct o_orderkey) from orders join lineitem on l_orderkey = o_orderkey)"
_ORDER_FIELDS = f"""
with o as (select distinct o_orderkey as k, o_orderpriority as p from orders join lineitem on l_orderkey = o_orderkey),
f as (
  select '$document' as path, '$document' as name, {_DOCS} as occurrences, {_DOCS} as parent_occurrences, {_DOCS} as presence_count
  union all select '$document/' || n, n, {_DOCS}, {_DOCS}, {_DOCS} from unnest(['id', 'status', 'total', 'items']) u(n)
  union all select '$document/priority', 'priority', c, {_DOCS}, c from (select count(*) as c from o where k % 3 = 0 and p is not null)
  union all select '$document/items/[]', '[]', {_ITEMS}, {_DOCS}, {_DOCS}
  union all select '$document/items/[]/' || n, n, {_ITEMS}, {_ITEMS}, {_ITEMS} from unnest(['sku', 'qty']) u(n)
  union all select '$document/items/[]/flag', 'flag', c, {_ITEMS}, c from (select count(*) as c from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 2 = 1 and l_returnflag is not null))
select path, name, occurrences, parent_occurrences, presence_count, presence_count / parent_occurrences as presence_probability from f where occurrences > 0
"""
_XML = """
with o as (select o_orderkey as k, o_custkey as c from orders), n as (select count(*) as n from o),
f as (
  select 'order' as path, 'order' as name, n as occ, n as par, n as pre from n
  union all select 'order/' || x, x, n, n, n from n, unnest(['id', 'day', 'price']) u(x)
  union all select 'order/price/amount', 'amount', count(*), (select n from n), count(*) from o where k % 7 = 0
  union all select 'order/note', 'note', count(*), (select n from n), count(*) from o where k % 5 < 3)
select path, name, occ as occurrences, par as parent_occurrences, pre as presence_count, pre / par as presence_probability from f
"""
_YAML = """
with c as (select count(*) as n, count(*) filter (c_custkey % 4 = 0) as t from customer),
f as (
  select 'customer' as path, 'customer' as name, n as occ, n as par, n as pre from c
  union all select 'customer/' || x, x, n, n, n from c, unnest(['key', 'name', 'active', 'since', 'note']) u(x)
  union all select 'customer/tags', 'tags', t, n, t from c union all select 'customer/tags/[]', '[]', 2 * t, t, t from c)
select path, name, occ as occurrences, par as parent_occurrences, pre as presence_count, pre / par as presence_probability from f
"""


def _shares(body: str) -> str:
    return f"with d(path, value, count) as ({body}) select path, value, cast(count as bigint) as count, cast(sum(count) over (partition by path) as bigint) as total, count / sum(count) over (partition by path) as probability from d where count > 0"


_N = "(select count(*) from orders)"
_JSON_TYPES = _shares(f"""
select '$document', 'parent', {_DOCS} union all select '$document/id', 'integer', {_DOCS} union all select '$document/status', 'string', {_DOCS} union all select '$document/total', 'number', {_DOCS}
union all select '$document/items', 'parent', {_DOCS} union all select '$document/items/[]', 'parent', {_ITEMS} union all select '$document/items/[]/sku', 'integer', {_ITEMS}
union all select '$document/items/[]/qty', 'number', {_ITEMS}
union all select '$document/items/[]/flag', 'string', (select count(*) from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 2 = 1)
union all select '$document/priority', 'string', (select count(distinct o_orderkey) from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 3 = 0)""")
_XML_REPRESENTATIONS = _shares(f"""
select 'order', 'element', {_N} union all select 'order/id', case when o_orderkey % 2 = 0 then 'attribute' else 'element' end, count(*) from orders group by 2
union all select 'order/day', 'element', {_N} union all select 'order/price', 'element', {_N}
union all select 'order/price/amount', 'element', count(*) from orders where o_orderkey % 7 = 0 union all select 'order/note', 'element', count(*) from orders where o_orderkey % 5 < 3""")
_XML_TYPES = _shares(f"""
select 'order', 'parent', {_N} union all select 'order/id', 'integer', {_N} union all select 'order/day', 'date', {_N}
union all select 'order/price', case when o_orderkey % 7 = 0 then 'parent' else 'integer' end, count(*) from orders group by 2
union all select 'order/price/amount', 'decimal', count(*) from orders where o_orderkey % 7 = 0
union all select 'order/note', case when o_orderkey % 5 < 2 then 'null' else 'string' end, count(*) from orders where o_orderkey % 5 < 3 group by 2""")
_YAML_TYPES = _shares("""
select 'customer', 'parent', (select count(*) from customer) union all select 'customer/' || x, t, (select count(*) from customer)
from (values ('key', 'integer'), ('name', 'string'), ('active', 'boolean'), ('since', 'date'), ('note', 'null')) v(x, t)
union all select 'customer/tags', 'parent', count(*) from customer where c_custkey % 4 = 0
union all select 'customer/tags/[]', 'integer', count(*) from customer where c_custkey % 4 = 0 union all select 'customer/tags/[]', 'string', count(*) from customer where c_custkey % 4 = 0""")

QUERIES = {
    "s3_json_fields": fields(order_json),
    "s2_xml_fields": fields(order_xml),
    "s4_yaml_fields": fields(customer_yaml),
    "a7_json_types": distribution(order_json, "data_type"),
    "a7_xml_types": distribution(order_xml, "data_type"),
    "a7_yaml_types": distribution(customer_yaml, "data_type"),
    "a8_xml_representations": distribution(order_xml, "representation"),
    "a9_variants": a9_variants,
    "a10_roots": a10_roots,
    "a11_sources": a11_sources,
    "a12_summary": a12_summary,
    "s5_bad_documents": s5_bad_documents,
    "s6_intake": s6_intake,
    "n8_budgets": n8_budgets,
    "s7_serialized": s7_serialized,
    "n1_types": n1_types,
    "n2_blanks": n2_blanks,
    "n4_attributes": n4_attributes,
    "n9_names": n9_names,
    "n10_draft_types": n10_draft_types,
    "a2_event_fields": fields(event_json),
}

ORACLE = {
    "s3_json_fields": _ORDER_FIELDS,
    "s2_xml_fields": _XML,
    "s4_yaml_fields": _YAML,
    "a7_json_types": _JSON_TYPES,
    "a7_xml_types": _XML_TYPES,
    "a7_yaml_types": _YAML_TYPES,
    "a8_xml_representations": _XML_REPRESENTATIONS,
    "a9_variants": """
with t as (select conv_id, role from conversations), c as (select conv_id, bool_or(role = 'user') as u, bool_or(role <> 'user') as o, count(*) as n, count(*) filter (role = 'user') as users from t group by 1),
v as (
  select '$document' as path, 'fields' as kind, 'id,turns' as held, count(distinct (u, o)) as variants, count(*) as count from c
  union all select '$document/turns', 'fields', '[]', count(distinct (u, o)), count(*) from c
  union all select '$document/id', 'value', '', 1, count(*) from c
  union all select '$document/turns/[]', 'fields', case when role = 'user' then 'chars,role,turn' else 'role,turn' end, 1, count(*) from t group by 3
  union all select '$document/turns/[]/' || x, 'value', '', 1, count(*) from t, unnest(['role', 'turn']) u(x) group by 1
  union all select '$document/turns/[]/chars', 'value', '', 1, count(*) from t where role = 'user')
select path, kind, held, cast(variants as bigint) as variants, count from v where count > 0
""",
    "a10_roots": """
with r as (select 'day,id,' || case when o_orderkey % 5 < 3 then 'note,' else '' end || 'price' as held, o_orderkey % 7 = 0 as amount, count(*) as count from orders group by 1, 2)
select held, count, cast(sum(count) over () as bigint) as total, count / sum(count) over () as probability from r
""",
    "a12_summary": f"select {_DOCS} as documents, (select count(*) from ({_ORDER_FIELDS})) as fields, cast(0 as bigint) as warnings",
    "s6_intake": """
with d as (select page_id % 7 as collection_id, 'page-' || cast(floor(page_id / case when page_id % 7 = 3 then 2 else 1 end) as bigint) as name,
  case when page_id % 50 = 0 then 'html' when page_id % 7 = 1 then 'json' else 'xml' end as format, page_id from pages),
e as (
  select 'size_differs' as "check", collection_id from d where page_id % 11 = 0 union all select 'bad_format', collection_id from d where format = 'html'
  union all select 'too_many', collection_id from d group by 2 having count(*) > 30
  union all select 'names_repeat', collection_id from d group by 2 having count(distinct name) < count(*)
  union all select 'mixed_syntax', collection_id from d group by 2 having bool_or(format = 'xml') and bool_or(format <> 'xml'))
select "check", collection_id, count(*) as n from e group by all
""",
    "s7_serialized": f"""
with t as ({_JSON_TYPES}), first as (select path, min(value) as value, arg_min(count, value) as n from t group by path)
select f.name, 'document-probability-space' as format, f.occurrences, first.value as first_type, first.n as first_count from ({_ORDER_FIELDS}) f join first using (path)
""",
    "n1_types": _N1,
    "n2_blanks": """
with t as (select case when page_id % 3 = 0 then 'integer' else 'string' end as k, page_id % 4 as f, url from pages), b as (select *, k = 'string' and (f <> 2 or trim(url) = '') as blank from t)
select case when blank then 'null' else k end as data_type, blank or f = 3 as nothing, count(*) as n from b group by all
""",
    "n4_attributes": "select name, count(*) as n from (select 'key' as name from customer union all select c_mktsegment from customer) group by 1",
    "n9_names": "select case when p_partkey % 2 = 0 then 'urn:' || lower(p_type) else '' end as namespace, replace(p_name, ' ', '-') as \"local\", count(*) as n from part group by all",
    "n10_draft_types": f"select form, n, case type when 'double' then 'number' when 'dateTime' then 'datetime' else type end as scalar from ({_N1})",
    "n8_budgets": """
with n as (select count(*) as docs, sum(4 + (o_orderkey % 7 = 0)::int + case o_orderkey % 5 when 2 then 2 when 0 then 1 when 1 then 1 else 0 end)::bigint as nodes, 2 + bool_or(o_orderkey % 7 = 0 or o_orderkey % 5 = 2)::int as levels from orders)
select 'kept' as outcome, null as exceeded, docs as n from n union all select 'rejected', 'documents', docs from n union all select 'rejected', 'nodes', nodes from n union all select 'rejected', 'levels', levels from n
""",
    "a2_event_fields": """
with e as (select count(*) as n, count(value) as v from events), f as (
  select '$document' as path, '$document' as name, n as occ, n as par from e union all select '$document/type', 'type', n, n from e union all select '$document/value', 'value', v, n from e where v > 0
  union all select '$document/props', 'props', n, n from e union all select '$document/props/k', 'k', n, n from e)
select path, name, occ as occurrences, par as parent_occurrences, occ as presence_count, occ / par as presence_probability from f
""",
}
