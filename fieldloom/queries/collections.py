"""Collections as files, and whole results as files: folders of documents, spaces, evaluations, expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import checks, exports
from ..plans import artefacts, space
from ..plans.storage import shared_folder, stored
from ..sources import documents as sources
from ..sources import files
from .documents import _ORDER_FIELDS, _JSON_TYPES
from .names import _PARTY, domain_lexicon
from .rendered import conversation_json, order_json, party_xml, table


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _customer_files(spark, sf_dir: str) -> DataFrame:
    """A file a customer in one of 16 folders: JSON (UTF-16, or UTF-8 for every sixth), XML (ISO 8859-1), YAML; every fiftieth is a text."""
    key = F.col("c_custkey")
    name, number = F.col("c_name"), key.cast("string")
    as_json = F.concat(F.lit('{"key":'), number, F.lit(',"name":"'), name, F.lit('","note":"é"}'))
    as_xml = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><customer><key>'), number, F.lit("</key><name>"), name, F.lit("</name><note>é</note></customer>"))
    as_yaml = F.concat(F.lit("customer:\n  key: "), number, F.lit("\n  name: '"), name, F.lit("'\n  note: é\n"))
    content = (
        F.when(key % 6 == 0, F.encode(as_json, "UTF-8")).when(key % 3 == 0, F.encode(as_json, "UTF-16")).when(key % 3 == 1, F.encode(as_xml, "ISO-8859-1")).otherwise(F.encode(as_yaml, "UTF-8"))
    )
    ending = F.when(key % 50 == 0, "txt").when(key % 6 == 0, "JSON").when(key % 3 == 0, "json").when(key % 3 == 1, "xml").when(key % 6 == 2, "yml").otherwise("yaml")
    path = F.concat(F.lit("part-"), (key % 16).cast("string"), F.lit("/c"), number, F.lit("."), ending)
    return table(spark, sf_dir, "customer").select(path.alias("path"), content.alias("content"))


def _read_customers(spark, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "customer-files")
    files.write_files(_customer_files(spark, sf_dir), folder)
    return files.read_files(spark, folder, unknown="reject", splitBytes=str(1 << 20))


def s1_files(spark, sf_dir: str) -> DataFrame:
    found = _read_customers(spark, sf_dir)
    return found.groupBy(F.coalesce("format", F.lit("rejected")).alias("format")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count("error").alias("errors"), F.sum(F.length("content")).alias("chars"), F.count_distinct("doc_id").alias("ids")
    )


def s1_fields(spark, sf_dir: str) -> DataFrame:
    docs = _read_customers(spark, sf_dir).where("error is null")
    return space.build(sources.summaries(docs)).fields.select(F.array_join("path", "/").alias("path"), "occurrences", "parent_occurrences", "presence_count")


def _listed(section: str, df: DataFrame, node: str, item: Column, count: Column, share: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(node).alias("node"), item.alias("item"), count.cast("long").alias("count"), share.cast("double").alias("share"))


def s7_document(spark, sf_dir: str) -> DataFrame:
    """Everything that the document of a space holds, read back from it."""
    path = f"{_folder(spark, 'space')}/orders.space.json"
    artefacts.write_space(space.build(sources.summaries(order_json(spark, sf_dir))), path)
    found = artefacts.read_space(spark, path)
    none = F.lit(None)
    nodes = found["nodes"].withColumn("at", F.array_join("path", "/"))
    outcome = lambda c: _listed(c, nodes.select("at", F.explode(c).alias("o")), "at", F.col("o.value"), F.col("o.count"), F.col("o.probability"))
    held = F.array_join(F.array_sort(F.transform("children", lambda c: F.concat(c["node"], F.lit("="), c["variant"]))), ",")
    alternatives = found["alternatives"].join(nodes.select(F.col("id").alias("node"), "at"), "node")
    named = found["roots"].join(nodes.select(F.col("id").alias("node"), "at"), "node")
    statistics = found["statistics"].select(F.lit("").alias("at"), "*")
    parts = [
        _listed("statistics", statistics, "at", F.lit("documents"), F.col("documents"), none),
        _listed("statistics", statistics, "at", F.lit("fields"), F.col("fields"), none),
        _listed("roots", named, "at", F.col("variant"), F.col("count"), F.col("probability")),
        _listed("presence", nodes, "at", F.col("name"), F.col("presence_count"), F.col("presence_probability")),
        _listed("occurrences", nodes, "at", F.col("id"), F.col("occurrences"), F.col("parent_occurrences")),
        *[outcome(c) for c in ("name_alternatives", "typos", "alternative_names", "data_types", "representations")],
        _listed("alternatives", alternatives, "at", F.concat_ws(" ", "id", "kind", held), F.col("count"), F.col("probability")),
        _listed("warnings", found["warnings"].select(F.lit("").alias("at"), "warning"), "at", F.col("warning"), none, none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def s8_artefacts(spark, sf_dir: str) -> DataFrame:
    """The three artefacts of the renamed orders, by what their lines hold: two payment roles may not merge; each
    order's payer must be found under its spelling, and one that there isn't is missing."""
    folder = _folder(spark, "artefacts")
    docs = party_xml(spark, sf_dir)
    s = space.build(sources.summaries(docs), domain_lexicon())
    src = stored(space.sources(sources.errors(sources.observations(docs, columns=sources.PROVENANCE))[0], s), "sources")
    role = F.struct(F.array(F.lit(0), F.lit(0)).alias("position"), F.lit("payer").alias("role"))
    lost = F.struct(F.array(F.lit(7)).alias("position"), F.lit("nobody").alias("role"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(role, lost)).alias("r")).select("doc_id", "r.*", F.lit("").alias("attribute"))
    matched = checks.annotated(src, expected)
    missing = checks.missing_annotations(matched, src.limit(0).select("doc_id", "position"))
    forbidden = checks.forbidden_merges(src.select("path", F.col("name").alias("role")), spark.createDataFrame([("tariff", "tarfif"), ("customer", "tariff")], "left string, right string"))
    artefacts.write_artefacts(folder, "orders", s, src, forbidden, missing, checks.field_violations(s.fields, s.distributions), compression="gzip")
    lines = lambda name: spark.read.option("lineSep", "\n").text(f"{folder}/{name}").select(F.regexp_replace("value", ",$", "").alias("value"))
    audit, written = lines("orders.evaluation.json"), spark.read.schema("node string, document long, position array<int>, name string, representation string, variant string").json(f"{folder}/orders.sources")
    get = lambda p: F.get_json_object("value", p)
    parts = [
        audit.where("value like '{\"documents\":%'").select(F.lit("documents").alias("what"), F.lit("").alias("item"), get("$.documents").cast("long").alias("n")),
        audit.where("value like '{\"path\":%'").select(F.lit("forbidden"), F.concat_ws(" ", F.get_json_object("value", "$.left"), F.get_json_object("value", "$.right")), F.lit(1).cast("long")),
        audit.where("value like '{\"document\":%'").groupBy(get("$.role").alias("item")).agg(F.count("*").alias("n")).select(F.lit("missing"), "item", "n"),
        audit.where("value like '{\"check\":%'").groupBy(get("$.check").alias("item")).agg(F.count("*").alias("n")).select(F.lit("invalid"), "item", "n"),
        written.groupBy("name").agg(F.count("*").alias("n")).select(F.lit("sources"), "name", "n"),
        artefacts.read_space(spark, f"{folder}/orders.space.json")["nodes"].select(F.lit("typos"), F.explode("typos").alias("t")).select(F.lit("typos"), "t.value", "t.count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _two_roots(spark, sf_dir: str) -> DataFrame:
    """Parts (with a label if even, a box of a size for every third) and suppliers (some in debt), as YAML."""
    part = F.concat(
        F.lit("part:\n  key: "), F.col("p_partkey").cast("string"), F.lit("\n"), F.when(F.col("p_partkey") % 2 == 0, "  label: 'made'\n").otherwise(""),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  box:\n    size: "), F.col("p_size").cast("string"), F.lit("\n"))).otherwise(""),
    )
    supplier = F.concat(F.lit("supplier:\n  key: "), F.col("s_suppkey").cast("string"), F.lit("\n"), F.when(F.col("s_suppkey") % 4 == 0, "  debt: 1.5\n").otherwise(""))
    docs = table(spark, sf_dir, "part").select(part.alias("content")).unionByName(table(spark, sf_dir, "supplier").select(supplier.alias("content")))
    return docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit("yaml").alias("format"), "content")


def _expression_lines(spark, docs: DataFrame) -> DataFrame:
    path = f"{_folder(spark, 'expression')}/expression.json"
    exports.write_expression(space.build(sources.summaries(docs)), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.where("length(value) > 1").select(F.regexp_replace("value", ",$", "").alias("line"))


def e3_two_roots(spark, sf_dir: str) -> DataFrame:
    """The expression of two root fields of several variants, line by line: an OR of leaves."""
    return _expression_lines(spark, _two_roots(spark, sf_dir))


def e3_one_root(spark, sf_dir: str) -> DataFrame:
    """That of one root field: an OR of ANDs."""
    return _expression_lines(spark, _two_roots(spark, sf_dir).where("content like 'part:%'"))


def e3_one_variant(spark, sf_dir: str) -> DataFrame:
    """That of one root variant: its AND."""
    return _expression_lines(spark, _two_roots(spark, sf_dir).where("content like '%label:%' and content like '%box:%'"))


def a11_provenance(spark, sf_dir: str) -> DataFrame:
    docs = conversation_json(spark, sf_dir)
    observed = sources.errors(sources.observations(docs, columns=sources.PROVENANCE))[0]
    found = space.sources(observed, space.build(sources.summaries(docs)))
    return found.select(F.array_join("path", "/").alias("path"), "doc_id", F.array_join("position", ".").alias("position"), "name", "representation", "variant_id")


QUERIES = {
    "s1_files": s1_files,
    "s1_fields": s1_fields,
    "s7_document": s7_document,
    "s8_artefacts": s8_artefacts,
    "e3_two_roots": e3_two_roots,
    "e3_one_root": e3_one_root,
    "e3_one_variant": e3_one_variant,
    "a11_provenance": a11_provenance,
}

#: Customers with the text of their file and its format.
_FILES = """
with t as (
  select c_custkey as k, '{"key":' || c_custkey || ',"name":"' || c_name || '","note":"é"}' as j,
    '<?xml version="1.0" encoding="ISO-8859-1"?><customer><key>' || c_custkey || '</key><name>' || c_name || '</name><note>é</note></customer>' as x,
    'customer:' || chr(10) || '  key: ' || c_custkey || chr(10) || '  name: ' || chr(39) || c_name || chr(39) || chr(10) || '  note: é' || chr(10) as y from customer),
f as (
  select k, case when k % 50 = 0 then 'rejected' when k % 3 = 0 then 'json' when k % 3 = 1 then 'xml' else 'yaml' end as format,
    case when k % 6 = 0 then strlen(j) when k % 3 = 0 then 2 + 2 * length(j) when k % 3 = 1 then length(x) else strlen(y) end as bytes,
    case when k % 50 = 0 then null when k % 3 = 0 then length(j) when k % 3 = 1 then length(x) else length(y) end as chars from t)
"""

#: A shape's hash, of kind and sorted (name, hash) pairs.
_SCALAR = "sha256('[\"value\", []]')"


def _pair(name: str, shape: str) -> str:
    return f"'[\"{name}\", \"' || {shape} || '\"]'"


def _item(*names: str) -> str:
    return "sha256('[\"fields\", [' || " + " || ', ' || ".join(_pair(n, _SCALAR) for n in names) + " || ']]')"


def _set(shapes: str) -> str:
    return f"sha256('[\"fields\", [' || array_to_string(list_transform(list_sort(list_distinct({shapes})), lambda h: '[\"[]\", \"' || h || '\"]'), ', ') || ']]')"


#: Orders with the shapes of their items and of the whole, and every field's alternatives.
_ORDER_SHAPES = f"""
with line as (select l_orderkey as k, l_linenumber % 2 = 1 and l_returnflag is not null as flag from lineitem join orders on l_orderkey = o_orderkey),
shaped as (select k, flag, case when flag then {_item("flag", "qty", "sku")} else {_item("qty", "sku")} end as item from line),
o as (select k, o_orderpriority is not null and k % 3 = 0 as priority, list_sort(list_distinct(list(item))) as items, {_set("list(item)")} as held from shaped join orders on k = o_orderkey group by 1, 2),
root as (
  select *, sha256('["fields", [' || {_pair("id", _SCALAR)} || ', ' || {_pair("items", "held")} || ', ' || case when priority then {_pair("priority", _SCALAR)} || ', ' else '' end
    || {_pair("status", _SCALAR)} || ', ' || {_pair("total", _SCALAR)} || ']]') as whole from o),
reference as (select '$document/' || x as path, sha256('$document/' || x) || '=' as r from unnest(['id', 'items', 'priority', 'status', 'total', 'items/[]', 'items/[]/flag', 'items/[]/qty', 'items/[]/sku']) u(x)),
field as ({_ORDER_FIELDS}), type as ({_JSON_TYPES}),
top as (select whole, held, priority, count(*) as count from root group by all),
kind as (select item, flag, count(*) as count from shaped group by all),
alternative as (
  select '$document' as path, whole as id, 'fields' as kind, array_to_string(list_sort(list(r || case when path = '$document/items' then held else {_SCALAR} end)), ',') as held, any_value(count) as count
    from top join reference on path not like '%[]%' and (priority or path <> '$document/priority') group by whole
  union all
  select '$document/items', held, 'fields', array_to_string(list_sort(list_transform(items, lambda h: sha256('$document/items/[]') || '=' || h)), ','), count(*) from root group by held, items
  union all
  select '$document/items/[]', item, 'fields', array_to_string(list_sort(list(r || {_SCALAR})), ','), any_value(count) from kind join reference on path like '%[]/%' and (flag or path <> '$document/items/[]/flag') group by item
  union all select path, {_SCALAR}, 'value', '', occurrences from field where name not in ('$document', 'items', '[]'))
"""


def _part(kind: str, value: str, probability: str) -> str:
    """SQL of a part of an expression up to its children."""
    return f"""'{{"type":"{kind}","value":"' || {value} || '","probability":' || {probability} || ',"minOccurs":1,"maxOccurs":1,"children":['"""


_AND, _LEAF = _part("AND", "''", "'1.0'"), _part("LEAF", "key", "'1.0'")


def _expression(variants: str, begin: str, branch: str, presence: str) -> str:
    """The lines of an expression. variants: root, id, c, label, box, debt; begin: the name of its entry; branch: how a
    variant's AND (body) begins, which is called key and has the share p; presence of the first root."""
    return f"""
with s as (select *, (c / sum(c) over ())::double as p from ({variants})), v as (
  select *, case when root = 'part' then 2 + label::int + 2 * box::int else 2 + debt::int end as size from s
), placed as (
  select *, coalesce(sum(size) over (order by root, c desc, id rows between unbounded preceding and 1 preceding), 0)::bigint + 1 as n from v
), member as (
  select n, p, 0 as place, root as name from placed union all select n, p, 1, 'box' from placed where box union all select n, p, 2, 'size' from placed where box
  union all select n, p, 1 + 2 * box::int + debt::int, 'key' from placed union all select n, p, 2 + 2 * box::int, 'label' from placed where label union all select n, p, 1, 'debt' from placed where debt
), node as (
  select *, 'context' || (n + place) || '-c/' || name || case when name in ('part', 'supplier', 'box') then '-c' else '-s' end as key from member
), leaf as (
  select *, {_LEAF} || case when name = 'box' then {_AND} || {_part("LEAF", "lead(key) over (partition by n order by place)", "'1.0'")} || ']}}]}}' else '' end || ']}}' as text from node
), body as (
  select n, p, max(key) filter (place = 0) as key, {_AND} || string_agg(text, ',' order by place) filter (place > 0 and name <> 'size') || ']}}' as body from leaf group by n, p
), share as (
  select sum(c) filter (root = 'part') as part, sum(c) filter (root = 'supplier') as supplier, sum(c) filter (label) as label, sum(c) filter (box) as box, sum(c) filter (debt) as debt from s
)
select '"begin-c/{begin}-c":{{"expression":' || {_part("OR", "''", "'1.0'")} || string_agg({branch} || body || ']}}', ',' order by n) || ']}},"typoSpace":{{}},"semanticSpace":{{}},"XSDTypes":{{"parent":1.0}},"attributes":{{}}}}' as line from body
union all
select '"' || key || '":{{"expression":{{}},"typoSpace":{{}},"semanticSpace":{{}},"XSDTypes":' || case when name in ('part', 'supplier', 'box') then '{{"parent":1.0}}' when name = 'label' then '{{"string":1.0}}'
  when name = 'debt' then '{{"double":1.0}}' else '{{"integer":1.0}}' end || ',"attributes":{{}},"presence_probability":' || (case name when 'part' then {presence} when 'supplier' then supplier / (part + supplier)
  when 'box' then box / part when 'label' then label / part when 'debt' then debt / supplier else 1 end)::double || '}}'
from leaf, share
"""


_PART_SHAPE = f"sha256('[\"fields\", [' || case when box then {_pair('box', _item('size'))} || ', ' else '' end || {_pair('key', _SCALAR)} || case when label then ', ' || {_pair('label', _SCALAR)} else '' end || ']]')"
_PARTS = f"select 'part' as root, {_PART_SHAPE} as id, c, label, box, false as debt from (select p_partkey % 2 = 0 as label, p_partkey % 3 = 0 as box, count(*) as c from part group by all)"
_SUPPLIERS = f"select 'supplier', case when debt then {_item('debt', 'key')} else {_item('key')} end, c, false, false, debt from (select s_suppkey % 4 = 0 as debt, count(*) as c from supplier group by all)"

ORACLE = {
    "s1_files": _FILES + "select format, count(*) as files, sum(bytes)::bigint as bytes, count(*) filter (format = 'rejected') as errors, sum(chars)::bigint as chars, count(*) as ids from f group by 1",
    "s1_fields": _FILES
    + """
, n as (select count(*) as n, count(*) filter (format = 'json') as j, count(*) filter (format <> 'json') as c from f where format <> 'rejected'),
r as (select '$document' as root, j as m, n from n union all select 'customer', c, n from n)
select root as path, m as occurrences, n as parent_occurrences, m as presence_count from r where m > 0
union all select root || '/' || x, m, m, m from r, unnest(['key', 'name', 'note']) u(x) where m > 0
""",
    "s7_document": _ORDER_SHAPES
    + """
select 'statistics' as section, '' as node, 'documents' as item, (select count(*) from o) as count, null::double as share
union all select 'statistics', '', 'fields', (select count(*) from field), null
union all select 'roots', '$document', id, count, count / sum(count) over () from alternative where path = '$document'
union all select 'presence', path, name, presence_count, presence_probability from field
union all select 'occurrences', path, sha256(path), occurrences, parent_occurrences from field
union all select 'name_alternatives', path, name, occurrences, 1 from field
union all select 'data_types', path, value, count, probability from type
union all select 'representations', path, case name when '$document' then 'document' when '[]' then 'item' else 'field' end, occurrences, 1 from field
union all select 'alternatives', path, id || ' ' || kind || ' ' || held, count, count / sum(count) over (partition by path) from alternative
""",
    "s8_artefacts": _PARTY
    + """
select 'documents' as what, '' as item, count(*) as n from orders
union all select 'forbidden', 'tariff tarfif', 1
union all select 'missing', 'nobody', count(*) from orders
union all select 'sources', x, count(*) from orders, unnest(['order', 'who', 'pay']) u(x) group by 2
union all select 'sources', value, sum(n)::bigint from m group by 2
union all select 'typos', value, n from c where value = 'tarfif' and value <> canonical
""",
    "e3_two_roots": _expression(f"{_PARTS} union all {_SUPPLIERS}", "documents", _part("LEAF", "key", "p"), "part / (part + supplier)"),
    "e3_one_root": _expression(_PARTS, "part", _part("AND", "''", "p"), "1"),
    "e3_one_variant": f"""
with k(n, key, body, type) as (values
  (1, 'context1-c/box-c', {_AND} || {_part("LEAF", "'context2-c/size-s'", "'1.0'")} || ']}}]}}', '{{"parent":1.0}}'), (2, 'context2-c/size-s', null, '{{"integer":1.0}}'),
  (3, 'context3-c/key-s', '', '{{"integer":1.0}}'), (4, 'context4-c/label-s', '', '{{"string":1.0}}')),
rest as (select ',"typoSpace":{{}},"semanticSpace":{{}},"XSDTypes":' as a, ',"attributes":{{}},"presence_probability":1.0}}' as b where exists (select 1 from part where p_partkey % 6 = 0))
select '"' || key || '":{{"expression":{{}}' || a || type || b as line from k, rest
union all
select '"begin-c/part-c":{{"expression":' || {_AND} || string_agg({_LEAF} || body || ']}}', ',' order by n) filter (body is not null) || ']}}' || any_value(a) || '{{"parent":1.0}}' || any_value(b)
from k, rest having count(*) > 0
""",
    "a11_provenance": f"""
with t as (select conv_id as d, row_number() over (partition by conv_id order by turn, role) - 1 as i, role = 'user' and text is not null as chars from conversations),
s as (select *, case when chars then {_item("chars", "role", "turn")} else {_item("role", "turn")} end as item from t),
c as (select d, {_set("list(item)")} as held from s group by d),
r as (
  select '$document' as path, d, '' as position, '$document' as name, 'document' as representation, sha256('["fields", [' || {_pair("id", _SCALAR)} || ', ' || {_pair("turns", "held")} || ']]') as variant from c
  union all select '$document/id', d, '0', 'id', 'field', {_SCALAR} from c union all select '$document/turns', d, '1', 'turns', 'field', held from c
  union all select '$document/turns/[]', d, '1.' || i, '[]', 'item', item from s
  union all select '$document/turns/[]/' || n, d, '1.' || i || '.' || k, n, 'field', {_SCALAR} from s, (values (0, 'turn'), (1, 'role'), (2, 'chars')) x(k, n) where k < 2 or chars)
select path, d as doc_id, position, name, representation, variant as variant_id from r
""",
}
