"""Field-name matching: tokens, single edits, lexicon tables, merged fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import checks, exports, names
from ..plans import space
from ..plans.storage import stored
from ..sources import documents as sources
from .rendered import order_xml, party_xml, table

#: A small domain lexicon: words, a synonym group, an abbreviation, opposite words.
WORDS = ("order", "who", "pay", "tariff", "charge", "customer", "client", "buyer", "seller")
PARTIES = ("customer", "client", "buyer")


def domain_lexicon() -> names.Lexicon:
    return names.Lexicon(dict.fromkeys(WORDS, names.TERM_FLOOR), {w: frozenset({"party"}) for w in PARTIES}, {}, {"chg": ("charge",)}, frozenset({("buyer", "seller")}))


def _party_space(spark, sf_dir: str) -> space.Space:
    return space.build(sources.summaries(party_xml(spark, sf_dir)), domain_lexicon())


def a6_names(spark, sf_dir: str) -> DataFrame:
    d = _party_space(spark, sf_dir).distributions.where("dimension = 'name'")
    return d.select(F.array_join("path", "/").alias("path"), "value", "relation", "count", "total")


def a9_merged_variants(spark, sf_dir: str) -> DataFrame:
    v = _party_space(spark, sf_dir).variants
    return v.where(F.size("path") == 1).select("count", F.size("children").cast("long").alias("children"), "total")


def m1_tokens(spark, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("{urn:x}"), F.lower("c_mktsegment"), F.lit("Key_"), F.col("c_name"), F.lit("-é"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(names.chunks(raw), " ").alias("tokens"))


def m5_single_edits(spark, sf_dir: str) -> DataFrame:
    """Part names against forms with a swap, a missing, a replaced, a doubled character, and two changes."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", "").alias("a"))
    at = (F.col("p_partkey") % 3 + 2).cast("int")
    head, one, two, tail = F.substring("a", F.lit(1), at - 1), F.substring("a", at, F.lit(1)), F.substring("a", at + 1, F.lit(1)), F.substring("a", at + 2, F.lit(99))
    forms = [F.concat(head, two, one, tail), F.concat(head, two, tail), F.concat(head, F.lit("#"), two, tail), F.concat(head, one, one, two, tail), F.concat(head, F.lit("##"), tail), F.col("a")]
    each = p.select("p_partkey", "a", F.posexplode(F.array(*forms)).alias("form", "b"))
    return each.groupBy("form", names.one_edit_column(F.col("a"), F.col("b")).alias("edit")).agg(F.count("*").alias("n"))


def m7_together(spark, sf_dir: str) -> DataFrame:
    s = sources.summaries(order_xml(spark, sf_dir)).where("what = 'names'")
    return s.select(F.array_join("path", "/").alias("path"), F.array_join("items", ",").alias("names"), F.col("n").alias("parents"))


def m11_lexicon(spark, sf_dir: str) -> DataFrame:
    """A lexicon out of the parts: words of names are terms, brands synonyms by type, counts frequencies."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word"))
    tables = names.lexicon_tables(
        words.distinct(),
        p.select(F.col("p_type").alias("word"), (F.col("p_size") % 3).alias("group")),
        p.select(F.substring("p_type", 1, 3).alias("word"), F.col("p_type").alias("expansion")).distinct(),
        p.select(F.col("p_name").alias("phrase"), F.col("p_type").alias("canonical")).distinct(),
        p.select(F.col("p_type").alias("a"), F.col("p_brand").alias("b")).distinct(),
        p.groupBy(F.col("p_brand").alias("word")).agg(F.sum("p_retailprice").alias("freq")),
    )
    return tables["unigrams"].select("word", F.round("freq", 2).alias("freq"))


def _glued(part: str = "p_name") -> Column:
    """A part's words and type as one chunk; every fifth with a number, which no word covers."""
    return F.concat(F.regexp_replace(part, " ", ""), F.lower("p_type"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size").cast("string")).otherwise(""))


def _part_lexicon(spark, sf_dir: str) -> names.Lexicon:
    """Words of parts by how often they come, and their first two letters and what follows as seldom words; phrases of a
    whole part for every seventh size."""
    p = table(spark, sf_dir, "part")
    word = p.select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("word")).groupBy("word").agg((1000 * F.count("*")).cast("double").alias("freq"))
    piece = word.select(F.explode(F.array(F.substring("word", 1, 2), F.expr("substring(word, 3)"))).alias("word"), (F.col("freq") / 1000).alias("freq")).where("length(word) > 1")
    every = word.unionByName(piece).groupBy("word").agg(F.max("freq").alias("freq"))
    phrase = p.where("p_size % 7 = 0").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("phrase"), F.lit("weekly part").alias("canonical")).distinct()
    empty = lambda *c: spark.createDataFrame([], ", ".join(f"{x} string" for x in c))
    found = {"unigrams": every, "synonyms": empty("word", "group"), "phrases": phrase, "abbreviations": empty("word", "expansion"), "opposites": empty("a", "b")}
    return names.lexicon_of(found)


def m3_splits(spark, sf_dir: str) -> DataFrame:
    """Glued names of parts and the words that they are split into (M3), whole parts by their phrase (M4)."""
    named = table(spark, sf_dir, "part").select(_glued().alias("name"))
    return names.tokenised(named, _part_lexicon(spark, sf_dir)).select("name", F.array_join("tokens", " ").alias("tokens"))


def j3_violations(spark, sf_dir: str) -> DataFrame:
    """All checks over a merged space and its sources; a sound space has none."""
    docs = party_xml(spark, sf_dir)
    s = space.build(sources.summaries(docs), domain_lexicon())
    src = stored(space.sources(sources.errors(sources.observations(docs, columns=sources.PROVENANCE))[0], s), "sources")
    found = checks.field_violations(s.fields, s.distributions).unionByName(checks.source_violations(src, s.distributions))
    found = found.unionByName(checks.space_violations(s.fields, s.variants, docs.count(), src))
    lost = checks.unreachable_variants(s.variants).select(F.lit("unreachable").alias("check"), F.array_join("path", "/").alias("key"), F.col("variant_id").alias("detail"))
    every = found.unionByName(lost)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = every.select(one.alias("violations"), zero.alias("documents")).unionByName(s.summary.select(zero.alias("violations"), "documents"))
    return both.agg(F.sum("violations").alias("violations"), F.sum("documents").alias("documents"))


def j3_broken(spark, sf_dir: str) -> DataFrame:
    """A space with a wrong name, a share over one and a count too many in each field: what the checks say of it."""
    s = space.build(sources.summaries(order_xml(spark, sf_dir)))
    wrong = s.fields.withColumns({"name": F.concat("name", F.lit("?")), "presence_probability": F.lit(1.5), "occurrences": F.col("occurrences") + 1})
    found = checks.field_violations(wrong, s.distributions).unionByName(checks.space_violations(s.fields.where(F.size("path") > 1), s.variants, 1))
    return found.groupBy("check").agg(F.count("*").alias("n"))


def j1_annotations(spark, sf_dir: str) -> DataFrame:
    """Expected roles of orders (id, price, note text) met with the fields found; below notes they were normalised."""
    docs = order_xml(spark, sf_dir)
    s = space.build(sources.summaries(docs))
    src = stored(space.sources(sources.errors(sources.observations(docs, columns=sources.PROVENANCE))[0], s), "sources")
    key = F.col("o_orderkey")
    even = key % 2 == 0
    at = lambda n: F.array(F.when(even, n).otherwise(n + 1))
    rows = F.array(
        F.struct(F.when(even, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))).alias("position"), F.when(even, "id").otherwise("").alias("attribute"), F.lit("identity").alias("role")),
        F.struct(at(1).alias("position"), F.lit("").alias("attribute"), F.lit("price").alias("role")),
        F.struct(F.array(F.when(even, 2).otherwise(3), F.lit(0)).alias("position"), F.lit("").alias("attribute"), F.lit("stress").alias("role")),
    )
    expected = table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.explode(F.filter(rows, lambda r: (r["role"] != "stress") | (key % 5 == 2))).alias("r")).select("doc_id", "r.*")
    matched = stored(checks.annotated(src, expected), "matched")
    dropped = src.where(F.element_at("path", -1) == "note").select("doc_id", "position")
    missing = checks.missing_annotations(matched, dropped).groupBy("outcome", "role").agg(F.count("*").alias("n"))
    return matched.where("path is not null").groupBy(F.lit("met").alias("outcome"), "role").agg(F.count("*").alias("n")).unionByName(missing)


def j2_forbidden(spark, sf_dir: str) -> DataFrame:
    """Roles of the payment elements: merged typos hold two roles, which a rule may forbid."""
    docs = party_xml(spark, sf_dir)
    s = space.build(sources.summaries(docs), domain_lexicon())
    src = stored(space.sources(sources.errors(sources.observations(docs, columns=sources.PROVENANCE))[0], s), "sources")
    matched = src.select("path", F.col("name").alias("role"))
    rules = spark.createDataFrame([("tariff", "tarfif"), ("tariff", "charge"), ("client", "buyer")], "left string, right string")
    return checks.forbidden_merges(matched, rules).select(F.array_join(F.slice("path", 1, 2), "/").alias("parent"), "left", "right")


def e1_shares(spark, sf_dir: str) -> DataFrame:
    s = space.build(sources.summaries(order_xml(spark, sf_dir)))
    each = exports.type_shares(s.distributions).select(F.array_join("path", "/").alias("path"), F.explode("types").alias("type", "share"))
    return each


def e2_spellings(spark, sf_dir: str) -> DataFrame:
    maps = exports.spelling_maps(_party_space(spark, sf_dir).distributions).select(F.array_join("path", "/").alias("path"), "typos", "alternative_names")
    each = lambda c: maps.select("path", F.lit(c).alias("map"), F.explode(c).alias("value", "share"))
    return each("typos").unionByName(each("alternative_names"))


def m8_veto(spark, sf_dir: str) -> DataFrame:
    """A spelling one edit from two words that have nothing to do with each other stays a field of its own."""
    name = F.when(F.col("o_orderkey") % 3 == 0, "mallet").when(F.col("o_orderkey") % 3 == 1, "ballet").otherwise("wallet")
    content = F.to_json(F.map_from_arrays(F.array(name), F.array(F.col("o_custkey"))))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("json").alias("format"), content.alias("content"))
    known = names.Lexicon(dict.fromkeys(("mallet", "ballet"), names.TERM_FLOOR), {}, {}, {}, frozenset())
    d = space.build(sources.summaries(docs), known).distributions.where("dimension = 'name' and size(path) = 2")
    return d.select(F.array_join("path", "/").alias("path"), "value", "relation", "count")


def m10_overflow(spark, sf_dir: str) -> DataFrame:
    """Contexts of more names than may be compared: all names stay, and the space says so."""
    s = space.build(sources.summaries(party_xml(spark, sf_dir)), domain_lexicon(), max_names=3)
    d = s.distributions.where("dimension = 'name' and size(path) = 3").select(F.array_join("path", "/").alias("item"), F.col("relation"), "count")
    warned = s.summary.select(F.explode("warnings").alias("item"), F.lit("warning").alias("relation"), F.lit(1).cast("long").alias("count"))
    return d.unionByName(warned)


def e3_expressions(spark, sf_dir: str) -> DataFrame:
    s = space.build(sources.summaries(order_xml(spark, sf_dir)))
    return exports.alternatives(s).select("field", "variants", "type", F.round("probability", 9).alias("probability"))


QUERIES = {
    "a6_names": a6_names,
    "a9_merged_variants": a9_merged_variants,
    "m1_tokens": m1_tokens,
    "m5_single_edits": m5_single_edits,
    "m7_together": m7_together,
    "m3_splits": m3_splits,
    "m11_lexicon": m11_lexicon,
    "j1_annotations": j1_annotations,
    "j2_forbidden": j2_forbidden,
    "j3_violations": j3_violations,
    "j3_broken": j3_broken,
    "e1_shares": e1_shares,
    "e2_spellings": e2_spellings,
    "m8_veto": m8_veto,
    "m10_overflow": m10_overflow,
    "e3_expressions": e3_expressions,
}

_PARTY = """
with o as (select case o_custkey % 3 when 0 then 'customer' when 1 then 'client' else 'buyer' end as who,
                  case o_custkey % 6 when 0 then 'tarfif' when 1 then 'chg' when 2 then 'charge' else 'tariff' end as pay from orders),
w as (select 'order/who/' as up, 'party' as grp, who as value, count(*) as n from o group by 3),
p as (select 'order/pay/' as up, case when pay in ('chg', 'charge') then 'charge' else 'tariff' end as grp, pay as value, count(*) as n from o group by 2, 3),
m as (select * from w union all select * from p),
c as (select *, first_value(value) over (partition by up, grp order by value = 'tarfif', n desc, value) as canonical from m)
"""

ORACLE = {
    "a6_names": _PARTY
    + """
select path, value, relation, count, cast(sum(count) over (partition by path) as bigint) as total from (
  select up || canonical as path, value, case when value = canonical then 'original' when value = 'tarfif' then 'typo' else 'alias' end as relation, n as count from c
  union all select p, v, 'original', (select count(*) from orders) from (values ('order', 'order'), ('order/who', 'who'), ('order/pay', 'pay')) x(p, v))
""",
    "a9_merged_variants": _PARTY + "select cast(sum(n) as bigint) as count, cast(2 as bigint) as children, (select count(*) from orders) as total from p group by grp",
    "m1_tokens": """
select c_custkey, array_to_string(regexp_extract_all(lower(regexp_replace(lower(c_mktsegment) || 'Key_' || c_name || '-é', '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), ' ') as tokens from customer
""",
    "m5_single_edits": """
with p as (select replace(p_name, ' ', '') as a, cast(p_partkey % 3 + 2 as integer) as i from part),
f as (
  select a, 0 as form, a[:i-1] || a[i+1:i+1] || a[i:i] || a[i+2:] as b from p union all select a, 1, a[:i-1] || a[i+1:i+1] || a[i+2:] from p
  union all select a, 2, a[:i-1] || '#' || a[i+1:] from p union all select a, 3, a[:i-1] || a[i:i] || a[i:] from p union all select a, 4, a[:i-1] || '##' || a[i+2:] from p union all select a, 5, a from p)
select form, damerau_levenshtein(a, b) = 1 and least(length(a), length(b)) >= 4 as edit, count(*) as n from f group by all
""",
    "m3_splits": """
with recursive word as (select w, 1000.0 * count(*) as f from (select unnest(string_split(p_name || ' ' || lower(p_type), ' ')) as w from part) group by w),
known as (select w, max(f) as f from (select w, f from word union all select w[:2], f / 1000 from word union all select w[3:], f / 1000 from word) where length(w) > 1 group by w),
name as (select distinct replace(p_name, ' ', '') || lower(p_type) || case when p_partkey % 5 = 0 then p_size::varchar else '' end as name from part),
phrase as (select distinct p_name || ' ' || lower(p_type) as phrase from part where p_size % 7 = 0),
way as (
  select name, 0 as pos, 0.0::double as score, ''::varchar as words from name
  union all
  select way.name, pos + length(w), score + ln(1 + f) - 18, words || case when pos = 0 then '' else ' ' end || w from way join known on way.name[pos + 1:pos + length(w)] = w where pos < length(way.name)
), best as (select name, max({'s': round(score, 9), 'w': string_split(words, ' ')}) as b from way where pos = length(name) group by name)
select name, coalesce(case when phrase is not null then 'weekly part' end, array_to_string(b.w, ' '), name) as tokens
from name left join best using (name) left join phrase on array_to_string(b.w, ' ') = phrase
""",
    "m7_together": """
with o as (select o_orderkey as k from orders), e as (
  select '' as path, 'order' as names, count(*) as parents from o
  union all select 'order', 'day,id,' || case when k % 5 < 3 then 'note,' else '' end || 'price', count(*) from o group by 2
  union all select 'order/price', 'amount', count(*) from o where k % 7 = 0)
select * from e where parents > 0
""",
    "m11_lexicon": """
with e as (
  select lower(unnest(string_split(p_name, ' '))) as word, 1e6 as freq from part union all select lower(p_type[:3]), 1e6 from part union all select lower(p_type), 1e6 from part
  union all select lower(p_type), 100 from part union all select lower(p_brand), 100 from part union all select lower(p_brand), s from (select p_brand, sum(p_retailprice) as s from part group by 1))
select word, round(max(freq), 2) as freq from e where word <> '' group by 1
""",
    "j1_annotations": """
select 'met' as outcome, r as role, count(*) as n from orders, unnest(['identity', 'price']) u(r) group by 2
union all select 'normalised', 'stress', count(*) from orders where o_orderkey % 5 = 2
""",
    "j2_forbidden": _PARTY
    + """
select x.up[:-2] as parent, l as "left", r as "right" from (values ('tariff', 'tarfif'), ('tariff', 'charge'), ('client', 'buyer')) v(l, r)
join c x on x.value = l join c y on y.value = r and y.up = x.up and y.canonical = x.canonical
""",
    "j3_broken": """
with f as (select 5 + bool_or(o_orderkey % 7 = 0)::int as n, 4 as dimensions from orders)
select "check", n * k as n from f, (values ('path_ends_elsewhere', 1), ('presence_not_a_share', 1), ('distribution_sum', 4), ('distribution_total', 4)) v("check", k)
union all select 'no_parent', n - 1 - (n = 6)::int from f union all select 'roots_cover_documents', 1
""",
    "j3_violations": "select cast(0 as bigint) as violations, count(*) as documents from orders",
    "e1_shares": """
with n as (select count(*) as n from orders), t as (
  select 'order/id' as path, 'integer' as type, 1.0 as share from n union all select 'order/day', 'date', 1.0 from n union all select 'order/price', 'integer', 1.0 from n
  union all select 'order/price/amount', 'decimal', 1.0 from n
  union all select 'order/note', case when o_orderkey % 5 < 2 then 'empty' else 'string' end, count(*) / (select count(*) from orders where o_orderkey % 5 < 3) from orders where o_orderkey % 5 < 3 group by 2)
select path, type, cast(share as double) as share from t
""",
    "e2_spellings": _PARTY
    + """
select up || canonical as path, case when value = 'tarfif' then 'typos' else 'alternative_names' end as map, value, n / sum(n) over (partition by up, canonical) as share from c qualify value <> canonical
""",
    "m8_veto": """
select '$document/' || n as path, n as value, 'original' as relation, count(*) as count from (select case o_orderkey % 3 when 0 then 'mallet' when 1 then 'ballet' else 'wallet' end as n from orders) group by n
""",
    "m10_overflow": _PARTY
    + """
select up || canonical as item, case when value = canonical then 'original' else 'alias' end as relation, n as count from c where up = 'order/who/'
union all select up || value, 'original', n from m where up = 'order/pay/' union all select 'name_comparison_limit_reached:order/pay', 'warning', 1
""",
    "e3_expressions": "select 'order' as field, count(distinct (o_orderkey % 5 < 3, o_orderkey % 7 = 0)) as variants, 'OR' as type, 1.0::double as probability from orders",
}
