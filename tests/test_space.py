"""The probability space against a model that counts random documents field by field, and properties of its parts."""

import calendar
import itertools
import json
import math
import random
from collections import Counter

import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.operators import checks
from fieldloom.operators.names import Lexicon, match_context, one_edit, one_edit_column, split_chunk, tokens
from fieldloom.plans import space
from fieldloom.sources import documents as sources

WORDS = ["harbour", "lantern", "meadow", "granite", "thistle", "copper"]
SCALARS = {"integer": lambda r: r.randrange(1000), "string": lambda r: r.choice(["oak", "elm"]), "boolean": lambda r: r.random() < 0.5, "null": lambda r: None}


def collection(spark, rows):
    """rows: (format, content)."""
    return spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(rows)], "doc_id long, format string, content string")


def build(spark, rows, lexicon=None, **more):
    """The space of documents, which must hold all its invariants, those of its sources included."""
    docs = collection(spark, rows)
    s = space.build(sources.summaries(docs), lexicon, **more)
    src = space.sources(sources.errors(sources.observations(docs))[0], s)
    bad = checks.field_violations(s.fields, s.distributions).unionByName(checks.source_violations(src, s.distributions)).unionByName(checks.space_violations(s.fields, s.variants, len(rows), src))
    assert bad.collect() == [] and checks.unreachable_variants(s.variants).count() == 0
    return s


def fields_of(s):
    return {tuple(r.path): (r.occurrences, r.parent_occurrences, r.presence_count) for r in s.fields.collect()}


def outcomes_of(s, dimension):
    return {(tuple(r.path), r.value): r["count"] for r in s.distributions.where(F.col("dimension") == dimension).collect()}


class Model:
    """What trees hold. A tree is (name, kind, representation, below): below is a list of trees, or of none."""

    def __init__(self, trees):
        self.found, self.present, self.types, self.ways, self.shapes = Counter(), Counter(), Counter(), Counter(), Counter()
        for t in trees:
            self.present[(t[0],)] += 1
            self.walk((), t)
        n = len(trees)
        self.fields = {p: (c, self.found[p[:-1]] if p[:-1] else n, self.present[p]) for p, c in self.found.items()}

    def walk(self, above, tree):
        name, kind, way, below = tree
        path = (*above, name)
        self.found[path] += 1
        self.types[path, kind] += 1
        self.ways[path, way] += 1
        for n in {b[0] for b in below}:
            self.present[(*path, n)] += 1
        shape = (kind == "parent", frozenset((b[0], self.walk(path, b)) for b in below))
        self.shapes[path, shape] += 1
        return shape

    def variants(self):
        """How often each of a path's shapes was met, without their names."""
        out = {}
        for (path, _), n in self.shapes.items():
            out.setdefault(path, []).append(n)
        return {p: sorted(ns) for p, ns in out.items()}


def variants_of(s):
    out = {}
    for r in s.variants.collect():
        out.setdefault(tuple(r.path), []).append(r["count"])
    return {p: sorted(ns) for p, ns in out.items()}


def agree(s, m):
    assert fields_of(s) == m.fields
    assert outcomes_of(s, "data_type") == dict(m.types) and outcomes_of(s, "representation") == dict(m.ways)
    assert variants_of(s) == m.variants()


def random_value(r, depth):
    """(value, tree without a name) of a JSON value."""
    what = r.choice(["scalar", "object", "list"] if depth else ["scalar"])
    if what == "object":
        made = {w: random_value(r, depth - 1) for w in r.sample(WORDS, r.randint(0, 3))}
        return {w: v for w, (v, _) in made.items()}, ("parent", [(w, k, "field", b) for w, (_, (k, b)) in made.items()])
    if what == "list":
        made = [random_value(r, depth - 1) for _ in range(r.randint(0, 3))]
        return [v for v, _ in made], ("parent", [("[]", k, "item", b) for _, (k, b) in made])
    kind = r.choice(list(SCALARS))
    return SCALARS[kind](r), (kind, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_json_and_yaml_collections(spark, seed):
    r = random.Random(seed)
    made = [random_value(r, 3) for _ in range(40)]
    trees = [("$document", k, "document", b) for _, (k, b) in made]
    agree(build(spark, [("json", json.dumps(v)) for v, _ in made]), Model(trees))
    # a YAML list is read under the same root; JSON text is YAML
    lists = [[v] for v, _ in made]
    trees = [("$document", "parent", "document", [("[]", k, "item", b)]) for _, (k, b) in made]
    agree(build(spark, [("yaml", json.dumps(v)) for v in lists]), Model(trees))


def random_element(r, name, depth):
    """(XML text, tree): attributes may repeat the names of elements; some elements are nil, mixed or empty."""
    xsi = "http://www.w3.org/2001/XMLSchema-instance"
    attributes = [(w, r.choice(["7", "tin"])) for w in r.sample(WORDS, r.randint(0, 2))]
    listed = "".join(f' {w}="{v}"' for w, v in attributes)
    below = [(w, "integer" if v == "7" else "string", "attribute", []) for w, v in attributes]
    inner = [random_element(r, w, depth - 1) for w in r.choices(WORDS, k=r.randint(1, 3))] if depth else []
    what = r.choice(["nil", "mixed", "plain", "plain", "plain"])
    if what == "nil":
        return f'<{name} xmlns:i="{xsi}" i:nil=" 1 "{listed}>{"".join(x for x, _ in inner)}</{name}>', (name, "null", "element", below)
    if what == "mixed" and inner:
        return f"<{name}{listed}>{inner[0][0]} and {''.join(x for x, _ in inner[1:])}</{name}>", (name, "string", "element", below)
    if inner:
        return f"<{name}{listed}>{''.join(x for x, _ in inner)}</{name}>", (name, "parent", "element", below + [t for _, t in inner])
    text, kind = r.choice([("", "null"), (" \n", "null"), ("-4", "integer"), (".5", "decimal"), ("tin", "string")])
    return f"<{name}{listed}>{text}</{name}>", (name, kind, "element", below)


@pytest.mark.parametrize("seed", [3, 4])
def test_xml_collections(spark, seed):
    r = random.Random(seed)
    made = [random_element(r, r.choice(["inn", "barn"]), 3) for _ in range(40)]
    s, m = build(spark, [("xml", x) for x, _ in made]), Model([t for _, t in made])
    agree(s, m)
    shuffled = [("xml", x) for x, _ in r.sample(made, len(made))]
    agree(build(spark, shuffled), m)


def misspelled(r, word):
    i = r.randrange(1, len(word) - 2)
    ways = [word[:i] + word[i + 1 :], word[:i] + "q" + word[i:], word[:i] + "q" + word[i + 1 :]]
    if word[i] != word[i + 1]:
        ways.append(word[:i] + word[i + 1] + word[i] + word[i + 2 :])
    return r.choice(ways)


def test_spellings_of_one_field(spark):
    """Each word is written with some slips, with another word of its group, or by its short form, never two in one parent."""
    r = random.Random(9)
    groups = {"copper": "metal", "granite": "stone"}
    others = {"copper": "bronze", "granite": "basalt"}
    lexicon = Lexicon(dict.fromkeys([*WORDS, *others.values()], 1e6), {w: frozenset({g}) for w, g in groups.items()} | {o: frozenset({groups[w]}) for w, o in others.items()}, {}, {"lntn": ("lantern",)}, frozenset())
    slips = {w: misspelled(r, w) for w in ("harbour", "meadow", "thistle")}
    ways = {**{w: [w, w, slips[w]] for w in slips}, **{w: [w, w, o] for w, o in others.items()}, "lantern": ["lantern", "lantern", "lntn"]}
    docs, counts = [], Counter()
    for _ in range(60):
        written = [(w, r.choice(ways[w])) for w in r.sample(WORDS, r.randint(1, len(WORDS)))]
        counts.update(written)
        docs.append(("json", json.dumps({n: 1 for _, n in written})))
    s = build(spark, docs, lexicon)
    rows = s.distributions.where("dimension = 'name' and size(path) = 2").collect()
    assert {(x.path[1], x.value): x["count"] for x in rows} == dict(counts)
    kinds = {x.value: x.relation for x in rows if x.relation != "original"}
    assert kinds == {**dict.fromkeys(slips.values(), "typo"), **dict.fromkeys(others.values(), "alias"), "lntn": "alias"}


GROUPS = {"copper": "m", "bronze": "m", "pewter": "m", "granite": "s", "basalt": "s"}
NAMES = [*GROUPS, "bronce", "coper", "basalts", "granitte", "unrelated", "pewetr"]
RULES = Lexicon(dict.fromkeys(GROUPS, 1e6), {w: frozenset({g}) for w, g in GROUPS.items()}, {}, {}, frozenset({("bronze", "pewter")}))


@settings(max_examples=150, deadline=None)
@cases(st.dictionaries(st.sampled_from(NAMES), st.integers(1, 9), min_size=1), st.sets(st.sampled_from(list(itertools.combinations(sorted(NAMES), 2))), max_size=12))
def test_matches_hold_together(counts, together):
    out = match_context(counts, together, RULES)
    assert out.keys() == counts.keys()
    for name, (canonical, relation) in out.items():
        assert out[canonical] == (canonical, "original") and (relation == "original") == (name == canonical)
        if relation == "typo":
            assert one_edit(name, canonical) and (name in GROUPS) != (canonical in GROUPS)
        if relation == "alias":
            assert GROUPS[name] == GROUPS[canonical]
    for a, b in itertools.combinations(sorted(counts), 2):
        if out[a][0] == out[b][0]:
            assert (a, b) not in together and (a, b) != ("bronze", "pewter")
    free = [n for n in counts if out[n] == (n, "original") and n in GROUPS]
    for a, b in itertools.combinations(sorted(free), 2):  # what could merge, alone, has a reason not to
        if GROUPS[a] == GROUPS[b] and set(counts) == {a, b}:
            assert (a, b) in together or (a, b) == ("bronze", "pewter")


def test_a_name_between_two_fields_stays_alone():
    """It resembles both, and these resemble each other in nothing."""
    known = Lexicon({"mallet": 1e6, "ballet": 1e6}, {}, {}, {}, frozenset())
    for counts in ({"mallet": 4, "ballet": 3, "wallet": 1}, {"ballet": 1, "wallet": 9, "mallet": 1}):
        assert match_context(counts, set(), known) == {n: (n, "original") for n in counts}
    assert match_context({"mallet": 4, "wallet": 1}, set(), known)["wallet"] == ("mallet", "typo")


@settings(max_examples=150, deadline=None)
@cases(st.text("abc", min_size=2, max_size=9), st.dictionaries(st.text("abc", min_size=2, max_size=4), st.sampled_from([1.0, 1e3, 1e6, 1e9]), max_size=8))
def test_split_is_the_best_of_all(chunk, words):
    def ways(rest):
        return [()] if not rest else [(rest[:n], *w) for n in range(1, len(rest) + 1) if rest[:n] in words for w in ways(rest[n:])]

    best = max(((sum(math.log1p(words[w]) - 18 for w in way), way) for way in ways(chunk)), default=(0, (chunk,)))
    assert split_chunk(chunk, words) == ((chunk,) if chunk in words else best[1])


def test_tokens():
    known = Lexicon(dict.fromkeys(WORDS, 1e6), {}, {("copper", "meadow"): ("thistle",)}, {"hb": ("harbour",)}, frozenset())
    assert tokens("{urn:z}hbLantern9_granite", known) == ("harbour", "lantern9", "granite")
    assert tokens("coppermeadow", known) == ("thistle",) and tokens("ß", known) == ()


@settings(max_examples=300, deadline=None)
@cases(st.text("xyz", max_size=7), st.text("xyz", max_size=7))
def test_single_edits(a, b):
    def near(x):
        for i in range(len(x) + 1):
            yield x[:i] + x[i + 1 :]
            yield x[:i] + x[i : i + 2][::-1] + x[i + 2 :]
            for c in "xyz":
                yield x[:i] + c + x[i:]
                yield x[:i] + c + x[i + 1 :]

    far = abs(len(a) - len(b)) if a != b else 0
    assert one_edit(a, b) == (min(len(a), len(b)) >= 4 and a != b and far <= 1 and b in set(near(a))) or a == b


def test_single_edits_as_a_column(spark):
    r = random.Random(5)
    words = ["".join(r.choices("xyz", k=r.randint(3, 7))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in [*r.sample(words, 8), misspelled(r, a) if len(a) > 4 else a] if a != b]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", one_edit_column(F.col("a"), F.col("b")).alias("near")).collect()
    assert {(x.a, x.b): x.near for x in got} == {(a, b): one_edit(a, b) for a, b in pairs}


def test_names_over_the_limit_stay(spark):
    written = [*WORDS, misspelled(random.Random(2), "granite")]
    docs = [("json", json.dumps({w: 1})) for w in written]
    lexicon = Lexicon(dict.fromkeys(WORDS, 1e6), {}, {}, {}, frozenset())
    s = build(spark, docs, lexicon, max_names=len(WORDS))
    assert fields_of(s) == {("$document",): (7, 7, 7)} | {("$document", w): (1, 7, 1) for w in written}
    assert s.summary.first().warnings == ["name_comparison_limit_reached:$document"]
    assert len(fields_of(build(spark, docs, lexicon, max_names=len(written)))) == 1 + len(WORDS)


def broken():
    """Sound documents, each spoiled in one way."""
    pair = json.dumps({"copper": 3})
    yield "json", f"{pair[:-1]}, {pair[1:]}"  # a name twice
    yield "json", pair.replace("copper", "")
    for number in ("NaN", "-Infinity", f"7e{sum(range(40))}"):
        yield "json", pair.replace("3", number)
    yield "json", pair[:-1]
    yield "json", None
    yield "xml", "<barn><copper></barn></copper>"
    yield "xml", ""
    yield "xml", '<barn xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="maybe"/>'
    yield "yaml", "copper: &c {granite: 1}\nmeadow: *c"
    yield "yaml", "copper: 1\ncopper: 2"
    yield "yaml", "3.5: copper"
    yield "yaml", "copper: .inf"
    yield "yaml", "copper: !!binary aGk="
    yield "csv", "copper,3"


def test_bad_documents(spark):
    rows = list(broken())
    docs = collection(spark, [*rows, ("json", "{}")])
    good, bad = sources.errors(sources.observations(docs))
    assert {r.doc_id for r in bad.collect()} == set(range(len(rows))) and [r.doc_id for r in good.collect()] == [len(rows)]
    assert sources.errors(sources.observations(docs), "DROPMALFORMED")[1].count() == 0
    with pytest.raises(Exception):  # noqa: B017
        sources.errors(sources.observations(docs), "FAILFAST")[0].collect()
    sums = {r.what: r.n for r in sources.summaries(docs).where("what in ('documents', 'errors')").collect()}
    assert sums == {"documents": 1, "errors": len(rows)}


def typed_texts():
    """Texts and the type that each must have, by rule."""
    for n in (0, 5, 90, 123456789012345678901):
        for sign in ("", "+", "-"):
            yield f"{sign}{n}", "integer"
            yield f" {sign}{n}.\t", "decimal"
            yield f"{sign}.{n}", "decimal"
            yield f"{sign}0{n}", "string"
    for power in (0, 3, 307, 309, 5000):
        yield f"1.5E{power}", "double" if power < 308 else "string"
        yield f"-2e-{power}", "double"
    for year, month, day in itertools.product((0, 1, 1900, 2000, 2023), (0, 2, 4, 13), (0, 28, 29, 30, 31)):
        real = year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]
        yield f"{year:04}-{month:02}-{day:02}", "date" if real else "string"
    for hour in (0, 23, 25):
        yield f"2023-04-05T{hour:02}:30:00Z", "dateTime" if hour < 24 else "string"
    yield from (("true", "boolean"), ("TRUE", "string"), (" ", "null"), ("Tin", "string"), ("١", "string"))


def test_types_of_texts(spark):
    rows = list(typed_texts())
    assert {t: sources.xml_type(t) for t, _ in rows} == dict(rows)
    got = spark.createDataFrame(rows, "t string, want string").select("t", scalars.xml_type(F.col("t")).alias("kind")).collect()
    assert {r.t: r.kind for r in got} == dict(rows)


def test_values_are_kept_as_written(spark):
    wide = 10**25 + 7
    docs = collection(spark, [("yaml", f"[0{5}, '0{5}', {wide}, 2023-04-05, ~, yes, '', 1.50]"), ("json", json.dumps([wide, "", [], {}, 0.5, " tin "]))])
    rows = sources.observations(docs).where("depth = 1").orderBy("doc_id", "obs_id").collect()
    assert [(r.data_type, r.value) for r in rows if r.doc_id == 0] == [("integer", "5"), ("string", "05"), ("integer", str(wide)), ("date", "2023-04-05"), ("null", None), ("boolean", "true"), ("null", None), ("number", "1.5")]
    assert [(r.data_type, r.value) for r in rows if r.doc_id == 1] == [("integer", str(wide)), ("null", None), ("parent", None), ("parent", None), ("number", "0.5"), ("string", " tin ")]


def test_no_documents(spark):
    s = build(spark, [])
    assert s.fields.count() == 0 and s.summary.first().documents == 0


def test_limits(spark):
    """Nodes inside nil and mixed fields count, but give no fields."""
    xml = f'<a x="1"><b xmlns:i="{sources.XSI[1:-1]}" i:nil="1"><c y="2"/></b><d>t<e><f/></e></d></a>'
    docs = collection(spark, [("xml", xml), ("json", "[[1]]"), ("json", "[")])
    have = {"documents": 3, "nodes": 11, "levels": 4}
    sums = sources.budgeted_summaries(docs, sources.Limits(**have))
    assert sorted(map(str, sums.collect())) == sorted(map(str, sources.summaries(docs).collect()))
    assert sources.budgeted_summaries(docs, sources.Limits(None, None, None)).count() == sums.count()
    for what, n in have.items():
        with pytest.raises(sources.OverBudget) as e:
            sources.budgeted_summaries(docs, sources.Limits(**{**have, what: n - 1}))
        assert e.value.exceeded == {what: n}
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            sources.Limits(documents=bad)


def test_provenance_of_hot_shapes(spark):
    """A dictionary too large to broadcast gives the same, with hot shapes in parts and seldom ones whole."""
    r = random.Random(8)
    docs = collection(spark, [("json", json.dumps({"copper": 1} if i % 4 else random_value(r, 2)[0])) for i in range(200)])
    s = space.build(sources.summaries(docs))
    observed = sources.errors(sources.observations(docs))[0]
    rows = lambda df: sorted(map(str, df.collect()))
    plan = space.sources(observed, s, broadcast_bytes=-1)
    assert rows(plan) == rows(space.sources(observed, s)) and len(rows(plan)) == observed.count()
