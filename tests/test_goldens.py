"""Values computed by hand for small ontologies."""

import json
import math

import pytest
from pyspark.sql import functions as F

import fixtures
from arborspark.functions.letters import best_matches, complex_similarity, text_similarity
from arborspark.model import Ontology
from arborspark.operators import enrichment, graph, information, items, lookup, profiles, similarity, statistics, texts
from arborspark.sources.bundle import read_bundle, write_bundle
from arborspark.sources.obo import read_obo

HALF = -math.log10(1 / 2)


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    made = {}

    def build(name: str) -> Ontology:
        if name not in made:
            path = tmp_path_factory.mktemp("obo") / f"{name}.obo"
            path.write_text(getattr(fixtures, name))
            made[name] = read_obo(spark, f"file://{path}")
        return made[name]

    return build


def long(spark, **lists):
    return spark.createDataFrame([(k, t, i) for k, v in lists.items() for i, t in enumerate(v)], "profile_id string, term string, pos int")


def sets(df, key="profile_id", value="term"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r[value])
    return {k: sorted(v) for k, v in out.items()}


def cohort(spark):
    return long(spark, A=["Child2", "Parental"], B=["Child2", "Parental"], C=["Child2", "Parental"], D=["Parental"])


def test_closure_and_structure(load):
    circle = load("CIRCULAR")
    assert sets(circle.closed, "term", "ancestor") == {"A": ["B", "C"], "B": ["A", "C"], "C": ["A", "B"]}
    assert [load(x).structure for x in ("HIERARCHICAL", "CIRCULAR", "ATOMIC", "SPARSE")] == ["hierarchical", "circular", "atomic", "sparse"]
    assert sets(load("SPARSE").closed, "term", "ancestor") == {"B": ["A"], "C": ["A"]}
    assert [r.term for r in graph.roots(load("HIERARCHICAL").terms, load("HIERARCHICAL").edges).collect()] == ["Parental"]


def test_meta_levels_paths(load):
    onto = load("HIERARCHICAL")
    assert {r.term: (r.ancestors, r.descendants, r.struct_freq, r.level) for r in onto.meta.collect()} == {"Parental": (0, 1, 2, 1), "Child2": (1, 0, 1, 2)}
    assert onto.stats == {"n_terms": 2, "max_struct_freq": 2.0, "max_depth": 2.0}
    paths = graph.root_paths(onto.terms, onto.edges)
    assert {r.term: r.path for r in paths.collect()} == {"Parental": ["Parental"], "Child2": ["Child2", "Parental"]}
    assert {r.term: (r.total_paths, r.largest_path, r.shortest_path) for r in graph.path_summary(paths).collect()} == {"Parental": (1, 1, 1), "Child2": (1, 2, 2)}
    assert {r.term: r.path for r in graph.parental_path(paths).collect()} == {"Parental": [], "Child2": ["Parental"]}
    assert {r.level: r.terms for r in lookup.terms_by_level(onto).collect()} == {1: ["Parental"], 2: ["Child2"]}
    assert {r.term: r.level for r in graph.longest_levels(onto.terms, onto.edges).collect()} == {"Parental": 1, "Child2": 2}
    dangling = load("DANGLING")
    assert {r.term: r.level for r in dangling.meta.collect()} == {"T1": 2, "T3": 3}
    assert graph.roots(dangling.terms, dangling.edges).isEmpty()


def test_ids_and_names(load, spark):
    onto = load("HIERARCHICAL")
    ids = spark.createDataFrame([("Parental",), ("FakeID",), ("Child3",), ("Child1",), ("Child5",)], "id string")
    assert {r.id: r.main for r in lookup.resolved(onto, ids).collect()} == {"Parental": "Parental", "FakeID": None, "Child3": "Child2", "Child1": "Child2", "Child5": None}
    assert {r.id: (r.is_term, r.is_obsolete) for r in lookup.flagged(onto, ids).collect()}["Child1"] == (False, True)
    names = spark.createDataFrame([("All",), ("1,6-alpha-mannosyltransferase activity",), ("Erroneous name",)], "name string")
    assert {r.name: r.term for r in lookup.terms_of_names(onto, names).collect()} == {"All": "Parental", "1,6-alpha-mannosyltransferase activity": "Child2", "Erroneous name": None}
    assert {r.id: r.name for r in lookup.names_of(load("BRANCHES"), spark.createDataFrame([("root",), ("branchAChild3",), ("FakeID",)], "id string")).collect()} == {"root": "All", "branchAChild3": "Child2", "FakeID": None}
    assert {tuple(r) for r in lookup.term_attributes(onto).collect()} == {("Parental", "All", 1), ("Child2", "Child2", 2)}


def test_relation_listing(load, spark):
    onto, root = load("BRANCHES"), spark.createDataFrame([("root",)], "term string")
    assert {r.term for r in lookup.relation_listing(onto, root).collect()} == {"branchA", "branchAChild1", "branchAChild2", "branchB"}
    assert {tuple(r) for r in lookup.relation_listing(onto, root, "rh0").collect()} == {("root", "branchA"), ("root", "branchB")}
    assert {tuple(r) for r in lookup.relation_listing(onto, root, "rn").collect()} == {("All", "Child1"), ("All", "Child5"), ("Child1", "Child2"), ("Child1", "Child4")}
    leaf = spark.createDataFrame([("branchAChild1",)], "term string")
    assert {tuple(r) for r in lookup.relation_listing(onto, leaf, "ar").collect()} == {("branchA", "branchAChild1"), ("root", "branchA")}


def test_information(load, spark):
    onto = load("HIERARCHICAL")
    assert {r.term: r.ic for r in information.information(onto).collect()} == pytest.approx({"Parental": 0, "Child2": HALF})
    seen = information.observed(onto, long(spark, x=["Parental", "Child2", "Child2"]))
    assert {r.term: r.observed_freq for r in seen.collect()} == {"Parental": 3, "Child2": 2}
    rows = cohort(spark)
    seen = information.observed(onto, rows)
    both = {r.profile_id: (r.mean_structural, r.mean_observed) for r in information.dual_means(rows, information.information(onto), information.information(onto, "resnik_observed", seen)).collect()}
    assert both["A"] == pytest.approx((HALF / 2, -math.log10(3 / 7) / 2)) and both["D"] == pytest.approx((0, 0))
    ic = {k: {r.term: r.ic for r in information.information(load("BRANCHES"), k).collect()} for k in ("seco", "zhou", "sanchez")}
    assert ic["seco"]["branchA"] == pytest.approx(1 - math.log10(3) / math.log10(5)) and ic["zhou"]["branchB"] == -math.inf
    assert ic["sanchez"]["branchA"] == pytest.approx(-math.log10((2 / 1 + 1) / 4)) and ic["sanchez"]["root"] == -math.inf
    assert {r.ic for r in information.information(load("ATOMIC")).collect()} == {0.0}


def test_common_ancestors(load, spark):
    onto = load("BRANCHES")
    pairs = spark.createDataFrame([("branchAChild1", "branchAChild2"), ("branchAChild1", "branchB"), ("branchB", "branchB")], "a string, b string")
    found = {(r.a, r.b): (r.mica, r.ic) for r in similarity.best_common(onto, pairs, information.information(onto)).collect()}
    assert found[("branchAChild1", "branchAChild2")] == ("branchA", pytest.approx(-math.log10(3 / 5)))
    assert found[("branchAChild1", "branchB")][1] == 0 and found[("branchB", "branchB")][0] == "branchB"
    sparse = load("SPARSE")
    assert similarity.best_common(sparse, spark.createDataFrame([("B", "D")], "a string, b string"), information.information(sparse)).isEmpty()
    lin = {(r.a, r.b): r.similarity for r in similarity.term_similarity(onto, pairs, "lin").collect()}
    assert lin[("branchB", "branchB")] == pytest.approx(1) and lin[("branchAChild1", "branchAChild2")] == pytest.approx(-2 * math.log10(3 / 5) / (2 * -math.log10(1 / 5)))
    best = similarity.best_in_profile(onto, spark.createDataFrame([("branchA",)], "term string"), long(spark, p=["branchAChild1", "branchB"])).collect()
    assert [(r.mica, r.ic) for r in best] == [("branchA", pytest.approx(-math.log10(3 / 5)))]


def test_compare_profiles(load, spark):
    onto = load("HIERARCHICAL")
    rows = long(spark, A=["Child2"], D=["Parental", "Child2"])
    both = {(r.profile_a, r.profile_b): r.similarity for r in similarity.compare_profiles(onto, rows).collect()}
    one = {(r.profile_a, r.profile_b): r.similarity for r in similarity.compare_profiles(onto, rows, bidirectional=False).collect()}
    assert one[("A", "D")] == pytest.approx(HALF) and one[("D", "A")] == pytest.approx(HALF / 2)
    assert both[("D", "A")] == pytest.approx((HALF / 2 * 2 + HALF) / 3) == pytest.approx(both[("A", "D")])
    outside = similarity.compare_profiles(onto, rows, long(spark, C=["Parental"]))
    assert {(r.profile_a, r.profile_b): r.similarity for r in outside.collect()}[("A", "C")] == 0


def test_compare_many_equal_profiles(load, spark):
    """Profiles of the same terms are compared once: no step makes more rows than there are pairs of profiles."""
    onto = load("BRANCHES")
    kinds = [["root", "branchA", "branchB", "branchAChild1", "branchAChild2"], ["branchA", "branchB"], ["branchA", "branchB", "branchB"]]
    rows = [(f"{i}", t) for i in range(60) for t in kinds[i % 3 if i < 6 else 0]]
    made = similarity.compare_profiles(onto, spark.createDataFrame(rows, "profile_id string, term string"))
    got = {(int(r.profile_a), int(r.profile_b)): r.similarity for r in made.collect()}
    ic = {(r.a, r.b): r.similarity for r in similarity.term_similarity(onto, similarity.pair_index(spark.createDataFrame([(t,) for t in kinds[0]], "term string"))).collect()}
    total = lambda p, q: sum(max(ic[min(a, b), max(a, b)] for b in q) for a in p)
    of = [kinds[i % 3 if i < 6 else 0] for i in range(60)]
    assert got == {(i, j): pytest.approx((total(p, q) + total(q, p)) / (len(p) + len(q))) for i, p in enumerate(of) for j, q in enumerate(of)}

    def most(plan) -> int:
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return most(plan.executedPlan())
        inner = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(most, inner)])

    assert most(made._jdf.queryExecution().executedPlan()) == 60 * 60


def test_cleaning(load, spark):
    onto, branches = load("HIERARCHICAL"), load("BRANCHES")
    prof = long(spark, p=["Parental", "Child2"])
    scores = spark.createDataFrame([("Parental", 3.0), ("Child2", 7.0)], "term string, score double")
    by = lambda p, s, **k: sets(profiles.cleaned_by_score(onto, p, s, **k)).get("p")
    assert by(prof, scores) == ["Child2"] and by(prof, scores, greatest=False) == ["Parental"]
    assert by(prof, scores.where("term = 'Child2'")) == ["Child2"] == by(prof, scores.where("term = 'Child2'"), greatest=False)
    prof2 = long(spark, p=["Parental", "Child3"])
    assert by(prof2, scores) == ["Parental"] == by(prof2, scores, greatest=False) and by(prof2, scores, greatest=False, remove_unscored=False) == ["Child3", "Parental"]
    assert sets(profiles.hard_cleaned(onto, long(spark, p=["Child2", "Parental", "Child5", "Child1"]))) == {"p": ["Child2"]}
    assert sets(profiles.hard_cleaned(branches, long(spark, p=["root", "branchB", "branchAChild1", "branchAChild2"]), "branchA")) == {"p": ["branchAChild1", "branchAChild2"]}
    kept, gone = profiles.without_ancestors(onto, long(spark, p=["Child2", "Parental"]))
    assert sets(kept) == {"p": ["Child2"]} and sets(gone) == {"p": ["Parental"]}
    kept, gone = profiles.without_alternatives(onto, long(spark, p=["Child2", "Parental", "Child3"]))
    assert sets(kept) == {"p": ["Child2", "Parental"]} and sets(gone) == {"p": ["Child3"]}
    assert sets(profiles.cleaned(onto, cohort(spark))) == {"A": ["Child2"], "B": ["Child2"], "C": ["Child2"], "D": ["Parental"]}


def test_loading_expanding_translating(load, spark):
    onto, branches = load("HIERARCHICAL"), load("BRANCHES")
    kept, rejected = profiles.checked(onto, long(spark, A=["Child1", "Parental"], B=["Child3", "Child4", "Parental", "FakeID"]), substitute=False)
    assert sets(kept) == {"A": ["Child1", "Parental"], "B": ["Child3", "Child4", "Parental"]} and sets(rejected) == {"B": ["FakeID"]}
    rows = long(spark, A=["branchAChild1", "branchB"], B=["branchAChild2", "branchA", "branchB"])
    assert sets(profiles.expanded(branches, rows)) == {"A": ["branchA", "branchAChild1", "branchB", "root"], "B": ["branchA", "branchAChild2", "branchB", "root"]}
    named, _ = profiles.translated(onto, cohort(spark))
    assert {r.profile_id: r.terms for r in profiles.as_arrays(named, "name").collect()} == {"A": ["Child2", "All"], "B": ["Child2", "All"], "C": ["Child2", "All"], "D": ["All"]}
    back, _ = profiles.from_names(onto, named)
    assert sets(back) == sets(cohort(spark))
    table = profiles.childs_table(onto, long(spark, p=["Parental"])).first()
    assert (table.term, table.name, [tuple(x) for x in table.children]) == ("Parental", "All", [("Child2", "Child2")])
    assert {r.term: r.level for r in profiles.with_levels(onto, long(spark, p=["Child2", "Child1", "Parental"])).collect()} == {"Child2": 2, "Child1": None, "Parental": 1}


def test_statistics(load, spark):
    onto, rows = load("HIERARCHICAL"), cohort(spark)
    stats = statistics.profile_stats(rows).first().asDict()
    assert stats == pytest.approx({"average": 1.75, "variance": 0.1875, "standard_deviation": 0.1875**0.5, "max": 2, "min": 1, "count": 4, "count_non_zero": 4, "q1": 1.5, "median": 2.0, "q3": 2.0})
    at = lambda p, up: statistics.size_at_percentile(rows, p, up).first()[0]
    assert (at(0, True), at(200 / 3, True), at(100, True), at(100, False)) == (1, 2, 2, 1)
    assert statistics.mean_size(rows).first()[0] == 1.75
    freq = {r.term: r.frequency for r in statistics.term_frequency(onto, rows, True, False).collect()}
    assert freq == {"Parental": 1.0, "Child2": 0.75}
    assert {r.level: r.terms for r in statistics.levels_of_profiles(onto, rows, False).collect()} == {1: ["Parental"] * 4, 2: ["Child2"] * 3}
    three = long(spark, A=["Child2"], B=["Parental"], C=["Child2", "Parental"])
    assert sorted(tuple(r) for r in statistics.level_distribution(onto, three).collect()) == [(1, 1, 2, 1, 50.0, 50.0, 50.0), (2, 1, 2, 1, 50.0, 50.0, 50.0)]
    section = spark.createDataFrame([(1, 0.5), (2, 0.7)], "level int, diff double")
    assert round(statistics.weighted_contribution(section, 3, 3).first()[0], 3) == 0.967
    four = long(spark, A=["branchB", "branchAChild1", "root"], B=["root", "branchA", "branchB", "branchAChild2", "branchAChild1"], C=["root", "branchC", "branchAChild1", "branchAChild2"], D=["root", "branchAChild1", "branchAChild2"])
    dsi = lambda mode: statistics.specificity_index(load("BRANCHES2"), four, mode).first()[0]
    assert round(dsi("weighted"), 4) == 1.3334 and dsi("uniq") == 0


def test_items(load, spark):
    onto, other = load("SHORT"), load("BRANCHES")
    start = spark.createDataFrame([("root", "branchA"), ("Child1", "branchAChild1"), ("Child2", "branchAChild1"), ("Child2", "branchAChild2"), ("Child2", "branchB")], "term string, item string")
    same = {"Child1": ["branchAChild1"], "Child2": ["branchAChild1", "branchAChild2", "branchB"]}
    assert sets(items.propagated(onto, start), "term", "item") == same | {"root": ["branchA", "branchAChild1"]}
    assert sets(items.propagated(onto, start, other=other, clean=False), "term", "item") == same | {"root": ["branchA", "branchAChild1"]}
    assert sets(items.propagated(onto, start, other=other), "term", "item") == same | {"root": ["branchAChild1"]}
    bare = spark.createDataFrame([("Child1", "branchAChild1"), ("Child2", "branchAChild2"), ("Child2", "branchB")], "term string, item string")
    assert sets(items.propagated(onto, bare, other=other, clean=False), "term", "item") == {"root": ["branchA"], "Child1": ["branchAChild1"], "Child2": ["branchAChild2", "branchB"]}
    assert sets(items.from_dictionary(load("HIERARCHICAL"), "is_a"), "term", "item") == {"Child2": ["Parental"]}
    new = spark.createDataFrame([("root", "x")], "term string, item string")
    assert sets(items.loaded(start, new), "term", "item")["root"] == ["x"] and sets(items.loaded(start, new, expand=True), "term", "item")["root"] == ["branchA", "x"]
    assert sets(items.to_profiles(new)) == {"x": ["root"]} and sets(items.from_profiles(long(spark, p=["t"])), "term", "item") == {"t": ["p"]}


def test_enrichment(load, spark):
    onto = load("CHAIN")
    lists = {"GO:0004396": [1, 2, 3, 4, 5, 6, 7, 9, 20], "GO:0016772": [1, 2, 3, 4, 8, 21, 22, 23]}
    held = spark.createDataFrame([(t, i) for t, v in lists.items() for i in v], "term string, item int")
    external = spark.createDataFrame([(i,) for i in [*range(1, 10), 20, 21, 22, 23]], "item int")
    found = {r.term: r.p_value for r in enrichment.elim(onto, held, external, 100, 0.01).collect()}
    assert found == pytest.approx({"GO:0004396": 3.758742740199465e-10, "GO:0016773": 1.0, "GO:0016772": 2.5502234633309746e-07}, rel=1e-9)
    found = {r.term: r.p_value for r in enrichment.weight(onto, held, external, 100).collect()}
    assert found == pytest.approx({"GO:0004396": 3.758742740199465e-10, "GO:0016773": 2.12513531849739e-07, "GO:0016772": 1.4063624541000068e-16}, rel=1e-9)
    assert enrichment.enrichment(onto, held, external, 100, "other").isEmpty()


@pytest.mark.parametrize("a, b, wanted", [("", "", -1), ("", "abc", -1), (None, "abc", -1), ("abcde", "abcde", 1), ("abcdf", "abcde", 0.75), ("!a%b#d", "!a%b#d", 1), ("abc\n", "abc\t", 1), ("\nabc", "\tabc", 1), ("abcd", "abc", 0.8), ("abcd", "def", 0), ("abcd", "asdabcde", 0.6), ("abcd", "abcefd", 0.5)])
def test_text_similarity(spark, a, b, wanted):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(wanted)


def test_text_sets_and_networks(spark):
    rows = spark.createDataFrame([([], ["abc", "def"]), (["abc", "def"], ["def", "abc"]), (["abc", "def"], ["abc"]), (["abc", "def"], ["cfg"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(best_matches(F.col("a"), F.col("b"))).collect()] == [[-1], [1, 1], [1, 0], [0, 0]]
    cases = [("", "abc|def", "", -1), ("abc|def", "abc|def", "", 1), ("abc|def", "abc|de%f", "%", 1), ("abc|def", "abc|ajk", "", 0.5), ("abc", "abc|def", "", 0.75), ("abc|def", "ghk|jlmn", "", 0)]
    for a, b, removed, wanted in cases:
        assert spark.createDataFrame([(a, b)], "a string, b string").select(complex_similarity(F.col("a"), F.col("b"), "|", removed)).first()[0] == pytest.approx(wanted)
    net = lambda xs, **k: [tuple(r) for r in texts.network(spark.createDataFrame(list(enumerate(xs)), "id int, text string"), **k).collect()]
    assert net(["a"]) == [] and net(["abc", "def", "abc"], distinct=True) == [("abc", "def", 0.0)]
    assert net(["abcdf", "abcde", "abcdf"], distinct=True) == [("abcdf", "abcde", 0.75)] and net(["abcdf", "abcdf"]) == [("abcdf", "abcdf", 1.0)]
    assert net(["abc|def", "abc"], separator="|") == [("abc|def", "abc", 0.75)]


def test_bundle_and_rerooting(load, spark, tmp_path):
    onto = load("HIERARCHICAL")
    write_bundle(onto, f"file://{tmp_path}/b", cohort(spark))
    again, rows, held = read_bundle(spark, f"file://{tmp_path}/b")
    assert again.same_as(onto) and sets(rows) == sets(cohort(spark)) and held.isEmpty()
    assert not again.same_as(load("SHORT"))
    part = load("BRANCHES").rerooted_at("branchA")
    assert {r.term for r in part.terms.collect()} == {"branchA", "branchAChild1", "branchAChild2"} and part.structure == "sparse"


def test_parser(load, spark, tmp_path):
    onto = load("HIERARCHICAL")
    assert {tuple(r) for r in onto.header.collect()} == {("format-version", "1.2"), ("data-version", "test/a/b/c/")}
    assert {tuple(r) for r in onto.alternatives.collect()} == {("Child1", "Child2"), ("Child3", "Child2"), ("Child4", "Child2")}
    assert {r.term for r in onto.obsoletes.collect()} == {"Child1", "Child5"}
    assert {tuple(r) for r in load("DANGLING").closed.select("term", "ancestor").collect()} == {("T3", "T1")}
    path = tmp_path / "x.obo"
    path.write_text(fixtures.BRANCHES)
    assert {r.term for r in read_obo(spark, f"file://{path}", removed=["branchA"]).terms.collect()} == {"root", "branchAChild1", "branchAChild2", "branchB"}
    path.write_text(fixtures.HEAD + "\n[Term]\nid: A\nname: x\nname: y\n")
    with pytest.raises(Exception, match="repeated tag"):
        read_obo(spark, f"file://{path}").terms.collect()
    path.write_text(fixtures.HEAD)
    empty = read_obo(spark, f"file://{path}")
    assert empty.terms.isEmpty() and empty.closed.isEmpty()


def test_dump(load, spark, tmp_path):
    from arborspark.sources.dump import read_dump, write_dump

    onto = load("HIERARCHICAL")
    held = spark.createDataFrame([("Child2", "x"), ("Child2", "y")], "term string, item string")
    write_dump(onto, f"file://{tmp_path}/d", cohort(spark), held)
    again, rows, more = read_dump(spark, f"file://{tmp_path}/d")
    assert again.same_as(onto) and sets(rows) == sets(cohort(spark)) and sets(more, "term", "item") == {"Child2": ["x", "y"]}
    assert {r.term for r in again.obsoletes.collect()} == {"Child1", "Child5"}
    assert json.loads(next((tmp_path / "d").glob("part-*")).read_text())["terms"]["Parental"] == {"id": "Parental", "name": "All", "comment": "none"}


def test_ways_of_more_than_a_hundred_nodes(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(104)], "child string, parent string").coalesce(1).cache()
    ways = graph.root_paths(spark.createDataFrame([("n0",)], "term string").coalesce(1), edges).collect()
    assert [list(r.path) for r in ways] == [[f"n{i}" for i in range(105)]]


def test_long_chains_of_alternatives(spark):
    terms = spark.createDataFrame([("t", "t", 0)], "term string, name string, ord int")
    edges = spark.createDataFrame([], "child string, parent string, pos int")
    chain = [(f"a{i}", f"a{i + 1}") for i in range(299)] + [("a299", "t"), ("x", "y"), ("y", "z"), ("z", "x")]
    onto = Ontology(terms, edges, alternatives=spark.createDataFrame(chain, "alt string, main string"))
    assert {tuple(r) for r in onto.resolver.collect()} == {(f"a{i}", "t") for i in range(300)} | {("t", "t")}
