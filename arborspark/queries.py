"""One query per operator over the relational tables, each with the same result in DuckDB SQL.

Reals are rounded to six digits on both sides; minus infinity is written as -9999.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.letters import complex_similarity
from .model import Ontology
from .operators import enrichment, graph, information, items, lookup, profiles, similarity, statistics, texts
from .sources import adapters
from .streaming.observations import observed_in_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOW = -9999.0


def six(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(F.when(x < LOW, F.lit(LOW)).otherwise(x), 6) + F.lit(0.0)


def s6(x: str) -> str:
    return f"(round(CASE WHEN {x} < {LOW} THEN {LOW} ELSE {x} END, 6) + 0.0)"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


GEO = """SELECT 'R:' || r_regionkey AS child, 'WORLD' AS parent FROM region UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation
UNION SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer UNION SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier"""
NATIONS = "SELECT 'R:' || r_regionkey AS child, 'WORLD' AS parent FROM region UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation"
PARTS = """SELECT 'TYPE:' || p_type AS child, 'PART' AS parent FROM part UNION SELECT 'BRAND:' || p_brand, 'PART' FROM part
UNION SELECT 'P:' || p_partkey, 'TYPE:' || p_type FROM part UNION SELECT 'P:' || p_partkey, 'BRAND:' || p_brand FROM part"""
CALENDAR = """SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS child, strftime(l_shipdate, '%Y-%m') AS parent FROM lineitem
UNION SELECT strftime(l_shipdate, '%Y-%m'), strftime(l_shipdate, '%Y') FROM lineitem UNION SELECT strftime(l_shipdate, '%Y'), 'ALL' FROM lineitem"""
CUSTOMER_PROFILES = "SELECT DISTINCT 'C:' || o_custkey AS profile_id, 'P:' || l_partkey AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
SUPPLIER_PROFILES = """SELECT DISTINCT 'S:' || l_suppkey AS profile_id, 'N:' || c_nationkey AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
SEGMENT_PROFILES = "SELECT DISTINCT c_mktsegment AS profile_id, 'R:' || n_regionkey AS term FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"
MIXED_PROFILES = """SELECT DISTINCT 'S:' || l_suppkey AS profile_id, CASE WHEN l_discount < 0.075 THEN 'P:' || p_partkey WHEN l_discount < 0.085 THEN 'TYPE:' || p_type ELSE 'BRAND:' || p_brand END AS term
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.065"""
ORDER_ITEMS = """SELECT DISTINCT term, item FROM (SELECT 'TYPE:' || p_type AS term, l_orderkey AS item FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'BRAND:' || p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def onto_sql(edges: str, more: str, last: str) -> str:
    """Common tables of an ontology: e, terms, clo, rclo, meta, st; then more tables and the last select."""
    return f"""WITH RECURSIVE e AS ({edges}), terms AS (SELECT child AS term FROM e UNION SELECT parent FROM e),
walk AS (SELECT child AS term, parent AS ancestor, 1 AS d FROM e UNION SELECT w.term, e.parent, w.d + 1 FROM walk w JOIN e ON w.ancestor = e.child),
clo AS (SELECT term, ancestor, min(d) AS distance FROM walk GROUP BY ALL), rclo AS (SELECT term, ancestor FROM clo UNION ALL SELECT term, term FROM terms),
meta AS (SELECT term, (SELECT count(*) FROM clo c WHERE c.term = t.term)::DOUBLE AS ancestors, coalesce(n, 0)::DOUBLE AS descendants, coalesce(n, 0) + 1.0::DOUBLE AS sf,
 (1 + coalesce((SELECT min(distance) FROM clo c WHERE c.term = t.term AND c.ancestor NOT IN (SELECT child FROM e)), 0))::INT AS level
 FROM terms t LEFT JOIN (SELECT ancestor AS term, count(*) AS n FROM clo GROUP BY 1) USING (term)),
st AS (SELECT count(*) AS n, max(sf) AS msf, max(level)::DOUBLE AS depth FROM meta){', ' + more if more else ''} {last}"""


RESNIK = "ic AS (SELECT term, -log10(sf / msf) + 0.0 AS ic FROM meta, st)"
MICA = "mica AS (SELECT a.term AS a, b.term AS b, max(CASE WHEN a.term = b.term THEN CASE WHEN a.ancestor = a.term THEN i.ic END ELSE i.ic END) AS ic FROM rclo a JOIN rclo b ON a.ancestor = b.ancestor JOIN ic i ON i.term = a.ancestor GROUP BY 1, 2)"


@query("ic_resnik_geo", onto_sql(GEO, RESNIK, f"SELECT term, {s6('ic')} AS ic FROM ic"))
def _(spark, d):
    return information.information(adapters.geography(spark, d)).select("term", six("ic").alias("ic"))


@query("closure_parts", onto_sql(PARTS, "", "SELECT term, ancestor, distance::INT AS distance FROM clo"))
def _(spark, d):
    return adapters.parts(spark, d).closed


@query("closure_geo", onto_sql(GEO, "", "SELECT term, ancestor, distance::INT AS distance FROM clo"))
def _(spark, d):
    return adapters.geography(spark, d).closed


@query("roots_calendar", onto_sql(CALENDAR, "", "SELECT term FROM terms WHERE term NOT IN (SELECT child FROM e)"))
def _(spark, d):
    onto = adapters.calendar(spark, d)
    return graph.roots(onto.terms, onto.edges)


@query("meta_parts", onto_sql(PARTS, "", "SELECT term, ancestors, descendants, sf AS struct_freq, level FROM meta"))
def _(spark, d):
    return adapters.parts(spark, d).meta


@query("levels_calendar", onto_sql(CALENDAR, "", "SELECT level, count(*) AS n_terms, min(term) AS first, max(term) AS last FROM meta GROUP BY 1"))
def _(spark, d):
    return adapters.calendar(spark, d).meta.groupBy("level").agg(F.count("*").alias("n_terms"), F.min("term").alias("first"), F.max("term").alias("last"))


@query("longest_levels_parts", f"WITH RECURSIVE e AS ({PARTS}), w AS (SELECT 'PART' AS term, 1 AS level UNION SELECT e.child, level + 1 FROM w JOIN e ON w.term = e.parent) SELECT term, max(level)::INT AS level FROM w GROUP BY 1")
def _(spark, d):
    onto = adapters.parts(spark, d)
    return graph.longest_levels(onto.terms, onto.edges)


WAYS = f"WITH RECURSIVE e AS ({PARTS}), t AS (SELECT child AS term FROM e UNION SELECT parent FROM e), w AS (SELECT term, term AS node, term AS path, 1 AS n FROM t UNION ALL SELECT w.term, e.parent AS node, w.path || '/' || e.parent, n + 1 FROM w JOIN e ON w.node = e.child), p AS (SELECT * FROM w WHERE node NOT IN (SELECT child FROM e))"


@query("root_paths_parts", f"{WAYS} SELECT term, path FROM p")
def _(spark, d):
    onto = adapters.parts(spark, d)
    return graph.root_paths(onto.terms, onto.edges).select("term", F.array_join("path", "/").alias("path"))


@query("path_counts_parts", f"{WAYS} SELECT term, count(*) AS total_paths, max(n)::INT AS largest_path, min(n)::INT AS shortest_path FROM p GROUP BY 1")
def _(spark, d):
    onto = adapters.parts(spark, d)
    return graph.path_summary(graph.root_paths(onto.terms, onto.edges))


@query("parental_path_parts", f"{WAYS} SELECT term, coalesce(min(path[length(term) + 2:]), '') AS path FROM p GROUP BY 1")
def _(spark, d):
    onto = adapters.parts(spark, d)
    return graph.parental_path(graph.root_paths(onto.terms, onto.edges)).select("term", F.array_join("path", "/").alias("path"))


@query("direct_children_geo", f"SELECT parent AS term, child AS relative FROM ({GEO})")
def _(spark, d):
    return lookup.direct_relatives(adapters.geography(spark, d), above=False)


@query("descendants_geo", onto_sql(GEO, "", "SELECT ancestor AS term, term AS relative FROM clo"))
def _(spark, d):
    return lookup.relatives(adapters.geography(spark, d), above=False)


@query("subtree_geo", onto_sql(GEO, "", "SELECT term FROM clo WHERE ancestor = 'R:1' UNION SELECT 'R:1'"))
def _(spark, d):
    return adapters.geography(spark, d).rerooted_at("R:1").terms.select("term")


@query("term_attributes_geo", onto_sql(GEO, "nm AS (SELECT 'R:' || r_regionkey AS term, r_name AS name FROM region UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'C:' || c_custkey, c_name FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'WORLD', 'WORLD')", "SELECT term, name, level FROM meta LEFT JOIN nm USING (term)"))
def _(spark, d):
    return lookup.term_attributes(adapters.geography(spark, d))


@query("relation_hops_geo", onto_sql(GEO, "", "SELECT e.parent, e.child FROM e JOIN meta ON e.parent = term WHERE level <= 2"))
def _(spark, d):
    return lookup.relation_listing(adapters.geography(spark, d), spark.createDataFrame([("WORLD",)], "term string"), "rh1")


def _aliased(spark, d) -> Ontology:
    """Parts that are also known by an id ALT:, and its brand's parts by ALTALT: through that."""
    onto = adapters.parts(spark, d)
    part = adapters.table(spark, d, "part")
    alt = part.select(F.concat(F.lit("ALT:"), "p_partkey").alias("alt"), F.concat(F.lit("P:"), "p_partkey").alias("main"))
    twice = part.select(F.concat(F.lit("ALTALT:"), "p_partkey").alias("alt"), F.concat(F.lit("ALT:"), "p_partkey").alias("main"))
    return Ontology(onto.terms, onto.edges, alternatives=alt.union(twice))


IDS = "SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'P:' WHEN 1 THEN 'ALT:' WHEN 2 THEN 'ALTALT:' ELSE 'FAKE:' END || l_partkey AS id, l_partkey FROM lineitem"


def _ids(spark, d) -> DataFrame:
    kind = F.col("l_linenumber") % 4
    return adapters.table(spark, d, "lineitem").select(F.concat(F.when(kind == 0, "P:").when(kind == 1, "ALT:").when(kind == 2, "ALTALT:").otherwise("FAKE:"), F.col("l_partkey").cast("string")).alias("id")).distinct()


@query("resolve_alternatives", f"SELECT id, CASE WHEN id NOT LIKE 'FAKE%' AND l_partkey IN (SELECT p_partkey FROM part) THEN 'P:' || l_partkey END AS main FROM ({IDS})")
def _(spark, d):
    return lookup.resolved(_aliased(spark, d), _ids(spark, d))


@query("id_flags", f"SELECT id, id LIKE 'P:%' AND l_partkey IN (SELECT p_partkey FROM part) AS is_term, id LIKE 'ALT%' AND l_partkey IN (SELECT p_partkey FROM part) AS is_alternative, false AS is_obsolete FROM ({IDS})")
def _(spark, d):
    return lookup.flagged(_aliased(spark, d), _ids(spark, d))


@query("translate_names", "SELECT name, CASE WHEN c_custkey IS NOT NULL THEN 'C:' || c_custkey END AS term FROM (SELECT c_name AS name FROM customer UNION SELECT 'no ' || s_name FROM supplier) LEFT JOIN customer ON name = c_name")
def _(spark, d):
    names = adapters.table(spark, d, "customer").select(F.col("c_name").alias("name")).union(adapters.table(spark, d, "supplier").select(F.concat(F.lit("no "), "s_name"))).distinct()
    return lookup.terms_of_names(adapters.geography(spark, d), names)


@query("translate_ids", f"SELECT profile_id, n_name AS name FROM ({SUPPLIER_PROFILES}) JOIN nation ON term = 'N:' || n_nationkey")
def _(spark, d):
    return profiles.translated(adapters.geography(spark, d), adapters.supplier_profiles(spark, d))[0].select("profile_id", "name")


OBSERVED = f"prof AS ({CUSTOMER_PROFILES}), seen AS (SELECT ancestor AS term, count(*)::DOUBLE AS f FROM prof JOIN rclo USING (term) GROUP BY 1), obs AS (SELECT term, coalesce(f, 0) AS f FROM terms LEFT JOIN seen USING (term)), oic AS (SELECT term, CASE WHEN f > 0 THEN -log10(f / (SELECT max(f) FROM obs)) END + 0.0 AS oic FROM obs)"


@query("observed_frequency", onto_sql(PARTS, OBSERVED, "SELECT term, f AS observed_freq FROM obs"))
def _(spark, d):
    return information.observed(adapters.parts(spark, d), adapters.customer_profiles(spark, d))


@query("ic_resnik_observed", onto_sql(PARTS, OBSERVED, f"SELECT term, {s6('oic')} AS ic FROM oic"))
def _(spark, d):
    onto = adapters.parts(spark, d)
    return information.information(onto, "resnik_observed", information.observed(onto, adapters.customer_profiles(spark, d))).select("term", six("ic").alias("ic"))


SECO = "1 - log10(sf) / log10(n)"
for _name, _sql in (
    ("seco", SECO),
    ("zhou", f"CASE WHEN descendants = 0 THEN {LOW} * 2 ELSE 0.5 * ({SECO}) + 0.5 * log10(descendants) / log10(depth) END"),
    ("sanchez", f"CASE WHEN ancestors = 0 THEN {LOW} * 2 ELSE -log10((descendants / ancestors + 1) / (depth + 1)) END"),
):
    query(f"ic_{_name}", onto_sql(PARTS, "", f"SELECT term, {s6(_sql)} AS ic FROM meta, st"))(lambda spark, d, kind=_name: information.information(adapters.parts(spark, d), kind).select("term", six("ic").alias("ic")))


@query("profile_dual_ic", onto_sql(PARTS, f"{RESNIK}, {OBSERVED}", f"SELECT profile_id, {s6('avg(ic)')} AS mean_structural, {s6('avg(oic)')} AS mean_observed FROM prof JOIN ic USING (term) JOIN oic USING (term) GROUP BY 1"))
def _(spark, d):
    onto, rows = adapters.parts(spark, d), adapters.customer_profiles(spark, d)
    made = information.dual_means(rows, information.information(onto), information.information(onto, "resnik_observed", information.observed(onto, rows)))
    return made.select("profile_id", six("mean_structural").alias("mean_structural"), six("mean_observed").alias("mean_observed"))


def _nation_pairs(onto: Ontology) -> DataFrame:
    return similarity.pair_index(onto.terms.select(F.lit(0).alias("profile_id"), "term"))


@query("common_ancestors_nations", onto_sql(NATIONS, "", "SELECT a.term AS a, b.term AS b, a.ancestor FROM rclo a JOIN rclo b ON a.ancestor = b.ancestor WHERE a.term <= b.term"))
def _(spark, d):
    onto = adapters.nations(spark, d)
    return similarity.common_ancestors(onto, _nation_pairs(onto))


@query("mica_nations", onto_sql(NATIONS, f"{RESNIK}, {MICA}", f"SELECT a, b, {s6('ic')} AS ic FROM mica WHERE a <= b"))
def _(spark, d):
    onto = adapters.nations(spark, d)
    return similarity.best_common(onto, _nation_pairs(onto), information.information(onto)).select("a", "b", six("ic").alias("ic"))


for _name, _sql in (("resnik", "m.ic"), ("lin", "CASE WHEN x.ic + y.ic <> 0 THEN 2 * m.ic / (x.ic + y.ic) END"), ("jiang_conrath", "x.ic + y.ic - 2 * m.ic")):
    query(f"similarity_{_name}", onto_sql(NATIONS, f"{RESNIK}, {MICA}", f"SELECT a, b, {s6(_sql)} AS similarity FROM mica m JOIN ic x ON x.term = a JOIN ic y ON y.term = b WHERE a <= b"))(
        lambda spark, d, kind=_name: (lambda onto: similarity.term_similarity(onto, _nation_pairs(onto), kind).select("a", "b", six("similarity").alias("similarity")))(adapters.nations(spark, d)))


def compare_sql(ours: str, theirs: str) -> str:
    more = f"""{RESNIK}, {MICA}, pa AS ({ours}), pb AS ({theirs}),
f1 AS (SELECT p, q, sum(best) AS s FROM (SELECT pa.profile_id AS p, pa.term, pb.profile_id AS q, max(coalesce(m.ic, 0)) AS best FROM pa, pb, mica m WHERE m.a = pa.term AND m.b = pb.term GROUP BY 1, 2, 3) GROUP BY 1, 2),
f2 AS (SELECT p, q, sum(best) AS s FROM (SELECT pa.profile_id AS p, pb.term, pb.profile_id AS q, max(coalesce(m.ic, 0)) AS best FROM pa, pb, mica m WHERE m.a = pa.term AND m.b = pb.term GROUP BY 1, 2, 3) GROUP BY 1, 2),
na AS (SELECT profile_id AS p, count(*) AS na FROM pa GROUP BY 1), nb AS (SELECT profile_id AS q, count(*) AS nb FROM pb GROUP BY 1)"""
    return onto_sql(NATIONS, more, f"SELECT p AS profile_a, q AS profile_b, {s6('(f1.s + f2.s) / (na + nb)')} AS similarity FROM f1 JOIN f2 USING (p, q) JOIN na USING (p) JOIN nb USING (q)")


@query("profile_compare", compare_sql(SUPPLIER_PROFILES, SUPPLIER_PROFILES))
def _(spark, d):
    return similarity.compare_profiles(adapters.nations(spark, d), adapters.supplier_profiles(spark, d)).select("profile_a", "profile_b", six("similarity").alias("similarity"))


def _segments(spark, d) -> DataFrame:
    rows = adapters.table(spark, d, "customer").where("c_acctbal > 9000").join(adapters.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_mktsegment").alias("profile_id"), F.concat(F.lit("R:"), F.col("n_regionkey").cast("string")).alias("term")).distinct().withColumn("pos", F.lit(0))


@query("profile_compare_external", compare_sql(SUPPLIER_PROFILES, SEGMENT_PROFILES))
def _(spark, d):
    return similarity.compare_profiles(adapters.nations(spark, d), adapters.supplier_profiles(spark, d), _segments(spark, d)).select("profile_a", "profile_b", six("similarity").alias("similarity"))


@query("term_vs_profile", onto_sql(NATIONS, f"{RESNIK}, {MICA}, pb AS ({SUPPLIER_PROFILES})", f"SELECT a AS term, profile_id, {s6('max(ic)')} AS ic FROM mica JOIN pb ON b = pb.term GROUP BY 1, 2"))
def _(spark, d):
    onto = adapters.nations(spark, d)
    return similarity.best_in_profile(onto, onto.terms.select("term"), adapters.supplier_profiles(spark, d)).select("term", "profile_id", six("ic").alias("ic"))


@query("profiles_expand", onto_sql(PARTS, f"prof AS ({CUSTOMER_PROFILES})", "SELECT DISTINCT profile_id, ancestor AS term FROM prof JOIN rclo USING (term)"))
def _(spark, d):
    return profiles.expanded(adapters.parts(spark, d), adapters.customer_profiles(spark, d))


CLEAN = "up AS (SELECT DISTINCT profile_id, ancestor AS term FROM prof JOIN clo USING (term))"


@query("profiles_clean", onto_sql(PARTS, f"prof AS ({MIXED_PROFILES}), {CLEAN}", "SELECT profile_id, term FROM prof WHERE (profile_id, term) NOT IN (SELECT (profile_id, term) FROM up)"))
def _(spark, d):
    return profiles.cleaned(adapters.parts(spark, d), adapters.mixed_profiles(spark, d)).select("profile_id", "term")


@query("profiles_removed_ancestors", onto_sql(PARTS, f"prof AS ({MIXED_PROFILES}), {CLEAN}", "SELECT profile_id, term FROM prof JOIN up USING (profile_id, term)"))
def _(spark, d):
    return profiles.without_ancestors(adapters.parts(spark, d), adapters.mixed_profiles(spark, d))[1].select("profile_id", "term")


@query("profiles_hard_clean", onto_sql(PARTS, f"raw AS ({MIXED_PROFILES}), prof AS (SELECT raw.* FROM raw JOIN clo USING (term) WHERE ancestor = 'TYPE:SMALL'), {CLEAN}", "SELECT profile_id, term FROM prof WHERE (profile_id, term) NOT IN (SELECT (profile_id, term) FROM up)"))
def _(spark, d):
    return profiles.hard_cleaned(adapters.parts(spark, d), adapters.mixed_profiles(spark, d), "TYPE:SMALL").select("profile_id", "term")


@query("profiles_clean_by_score", onto_sql(PARTS, f"prof AS ({MIXED_PROFILES}), sc AS (SELECT term, (length(term) * 100 + ancestors * 7)::DOUBLE AS score FROM meta), near AS (SELECT term, ancestor AS other FROM clo UNION SELECT ancestor, term FROM clo UNION SELECT term, term FROM terms)",
    "SELECT DISTINCT profile_id, arg_min(other, (-score, other)) AS term FROM prof p JOIN near n USING (term) JOIN (SELECT profile_id, term AS other, score FROM prof JOIN sc USING (term)) q USING (profile_id, other) GROUP BY profile_id, p.term"))
def _(spark, d):
    onto = adapters.parts(spark, d)
    scores = onto.meta.select("term", (F.length("term") * 100 + F.col("ancestors") * 7).cast("double").alias("score"))
    return profiles.cleaned_by_score(onto, adapters.mixed_profiles(spark, d), scores)


@query("childs_table", f"SELECT term, r_name AS name, count(*) AS n_children FROM (SELECT DISTINCT profile_id, term FROM ({SEGMENT_PROFILES})) JOIN region ON term = 'R:' || r_regionkey JOIN (SELECT 'R:' || n_regionkey AS term, 'N:' || n_nationkey FROM nation UNION ALL SELECT 'R:' || n_regionkey, 'C:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'R:' || n_regionkey, 'S:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) USING (term) GROUP BY profile_id, term, r_name")
def _(spark, d):
    return profiles.childs_table(adapters.geography(spark, d), _segments(spark, d)).select("term", "name", F.size("children").cast("long").alias("n_children"))


SIZES = f"prof AS ({CUSTOMER_PROFILES}), z AS (SELECT profile_id, count(*) AS size FROM prof GROUP BY 1), o AS (SELECT list(size ORDER BY size) AS s, count(*) AS n FROM z)"
QUANTILE = lambda p: f"(s[floor(round((n - 1) * {p}, 9))::INT + 1] + s[ceil(round((n - 1) * {p}, 9))::INT + 1]) / 2.0"


@query("profile_stats", f"WITH {SIZES} SELECT {s6('avg(size)')} AS average, {s6('var_pop(size)')} AS variance, {s6('stddev_pop(size)')} AS standard_deviation, max(size) AS max, min(size) AS min, count(*) AS count, count(*) AS count_non_zero, any_value({QUANTILE(0.25)})::DOUBLE AS q1, any_value({QUANTILE(0.5)})::DOUBLE AS median, any_value({QUANTILE(0.75)})::DOUBLE AS q3 FROM z, o")
def _(spark, d):
    return statistics.profile_stats(adapters.customer_profiles(spark, d)).withColumns({c: six(c) for c in ("average", "variance", "standard_deviation")})


@query("size_at_percentile", f"WITH {SIZES} SELECT ({QUANTILE(0.2)})::DOUBLE AS size FROM o")
def _(spark, d):
    return statistics.size_at_percentile(adapters.customer_profiles(spark, d), 80)


@query("profile_sizes", f"WITH {SIZES} SELECT profile_id, size FROM z")
def _(spark, d):
    return statistics.sizes(adapters.customer_profiles(spark, d))


@query("term_frequency", f"WITH prof AS ({SUPPLIER_PROFILES}) SELECT term, n_name AS name, {s6('count(*) / (SELECT count(DISTINCT profile_id) FROM prof)')} AS frequency FROM prof JOIN nation ON term = 'N:' || n_nationkey GROUP BY ALL")
def _(spark, d):
    return statistics.term_frequency(adapters.geography(spark, d), adapters.supplier_profiles(spark, d)).select("term", "name", six("frequency").alias("frequency"))


DISTRIBUTION = f"""prof AS ({MIXED_PROFILES}), c AS (SELECT term, count(*) AS n FROM prof GROUP BY 1),
lv AS (SELECT level, count(*) AS n_ontology, coalesce(sum(n), 0)::BIGINT AS n_cohort, count(n) AS n_distinct FROM meta LEFT JOIN c USING (term) GROUP BY 1),
ld AS (SELECT *, round(n_ontology / sum(n_ontology) OVER () * 100, 3) AS pct_ontology, round(n_cohort / sum(n_cohort) OVER () * 100, 3) AS pct_cohort, round(n_distinct / sum(n_distinct) OVER () * 100, 3) AS pct_distinct FROM lv)"""


@query("level_distribution", onto_sql(PARTS, DISTRIBUTION, "SELECT * FROM ld"))
def _(spark, d):
    return statistics.level_distribution(adapters.parts(spark, d), adapters.mixed_profiles(spark, d))


def dsi_sql(column: str) -> str:
    more = f"""{DISTRIBUTION}, sh AS (SELECT arg_max(level, (pct_ontology, level)) AS peak, count(*) AS k FROM ld),
df AS (SELECT level, peak, k, ({column} - pct_ontology) * CASE WHEN peak - level >= 0 THEN peak - level + 1 ELSE level - peak END AS w FROM ld, sh WHERE {column} - pct_ontology > 0)"""
    return onto_sql(PARTS, more, f"SELECT {s6('coalesce(sum(w) FILTER (level > peak) / any_value(k - peak) / (sum(w) FILTER (level <= peak) / any_value(peak)), 0.0)')} AS dsi FROM df")


for _name, _column in (("uniq", "pct_distinct"), ("weighted", "pct_cohort")):
    query(f"dsi_{_name}", dsi_sql(_column))(lambda spark, d, mode=_name: statistics.specificity_index(adapters.parts(spark, d), adapters.mixed_profiles(spark, d), mode).select(six(F.coalesce("dsi", F.lit(0.0))).alias("dsi")))


@query("items_of_profiles", f"SELECT term, profile_id AS item FROM ({SUPPLIER_PROFILES})")
def _(spark, d):
    return items.from_profiles(adapters.supplier_profiles(spark, d))


def _upper_parts(spark, d) -> Ontology:
    part = adapters.table(spark, d, "part")
    return adapters.from_edges(part.select(F.concat(F.lit("TYPE:"), "p_type").alias("child"), F.lit("PART").alias("parent")).union(part.select(F.concat(F.lit("BRAND:"), "p_brand"), F.lit("PART"))))


@query("items_propagate", f"WITH it AS ({ORDER_ITEMS}) SELECT term, item FROM it UNION SELECT 'PART', item FROM it GROUP BY item HAVING count(*) >= 4")
def _(spark, d):
    return items.propagated(_upper_parts(spark, d), adapters.order_items(spark, d), least=4)




def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Two-sided p-value from log-gammas; a to d are columns."""
    g = lambda x: f"lgamma(({x})::DOUBLE + 1)"
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    p = lambda x: f"({g(row)} + {g(f'{n} - {row}')} + {g(col)} + {g(f'{n} - {col}')} - {g(n)} - {g(x)} - {g(f'{row} - {x}')} - {g(f'{col} - {x}')} - {g(f'{n} - {row} - {col} + {x}')})"
    return f"least(1.0, list_sum(list_transform(range(greatest(0, {row} + {col} - {n}), least({row}, {col}) + 1), lambda x: CASE WHEN {p('x')} <= {p(a)} + 1e-7 THEN exp({p('x')}) ELSE 0 END)))"


EXTERNAL = "ext AS (SELECT o_orderkey AS item FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 7 = 0)"


def _external(spark, d) -> tuple[DataFrame, int]:
    orders = adapters.table(spark, d, "orders")
    return orders.where("o_orderpriority = '1-URGENT' or o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("item")), orders.count()


@query("fisher_by_term", f"WITH it AS ({ORDER_ITEMS}), {EXTERNAL}, k AS (SELECT term, count(ext.item) AS a, (SELECT count(*) FROM ext) - count(ext.item) AS b, count(*) - count(ext.item) AS c, (SELECT count(*) FROM orders) - count(*) - (SELECT count(*) FROM ext) + count(ext.item) AS d FROM it LEFT JOIN ext USING (item) GROUP BY 1) SELECT term, {s6(fisher_sql('a', 'b', 'c', 'd'))} AS p_value FROM k")
def _(spark, d):
    external, total = _external(spark, d)
    return enrichment.fisher_by_term(adapters.order_items(spark, d), external, total).select("term", six("p_value").alias("p_value"))


ELIM = f"""WITH it AS ({ORDER_ITEMS}), {EXTERNAL}, u AS (SELECT count(*) AS u FROM orders), x AS (SELECT count(*) AS x FROM ext),
k AS (SELECT term, count(ext.item) AS a, any_value(x) - count(ext.item) AS b, count(*) - count(ext.item) AS c, any_value(u) - count(*) - any_value(x) + count(ext.item) AS d FROM it LEFT JOIN ext USING (item), u, x GROUP BY 1),
p2 AS (SELECT term, 2 AS level, {fisher_sql('a', 'b', 'c', 'd')} AS p FROM k),
gone AS (SELECT DISTINCT item FROM it JOIN p2 USING (term) WHERE p <= 0.3),
own AS (SELECT item FROM (SELECT item FROM it UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') WHERE item NOT IN (SELECT item FROM gone)),
ex AS (SELECT item FROM ext WHERE item NOT IN (SELECT item FROM gone)),
k1 AS (SELECT a, (SELECT count(*) FROM ex) - a AS b, n - a AS c, u - n - (SELECT count(*) FROM ex) + a AS d FROM (SELECT count(ex.item) AS a, count(*) AS n FROM own LEFT JOIN ex USING (item)), u)
SELECT term, level, {s6('p')} AS p_value FROM p2 UNION ALL SELECT 'PART', 1, {s6(fisher_sql('a', 'b', 'c', 'd'))} FROM k1"""


def _items_with_root(spark, d) -> DataFrame:
    """The items of types and brands, and some of PART itself, so that both levels are tested."""
    waiting = adapters.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit("PART").alias("term"), F.col("o_orderkey").alias("item"))
    return adapters.order_items(spark, d).union(waiting)


@query("enrich_elim", ELIM)
def _(spark, d):
    external, total = _external(spark, d)
    return enrichment.elim(_upper_parts(spark, d), _items_with_root(spark, d), external, total, 0.3).select("term", "level", six("p_value").alias("p_value"))


@query("enrich_weight")
def _(spark, d):
    external, total = _external(spark, d)
    return enrichment.weight(_upper_parts(spark, d), _items_with_root(spark, d), external, total).select("term", "level", six("p_value").alias("p_value"))


PAIRS = lambda x: f"flatten(list_transform(list_filter(regexp_split_to_array(upper(ltrim({x})), '\\s+'), lambda w: length(w) > 1), lambda w: list_transform(range(1, length(w)), lambda i: w[i:i + 1])))"
DICE = lambda a, b: f"coalesce(2.0 * list_sum(list_transform(list_distinct({a}), lambda q: least(len(list_filter({a}, lambda z: z = q)), len(list_filter({b}, lambda z: z = q))))) / nullif(len({a}) + len({b}), 0), 0)"


@query("text_network", f"WITH t AS (SELECT DISTINCT p_name AS t, {PAIRS('p_name')} AS g FROM part) SELECT x.t AS a, y.t AS b, {s6(DICE('x.g', 'y.g'))} AS similarity FROM t x JOIN t y ON x.t < y.t")
def _(spark, d):
    names = adapters.table(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_name").alias("o")).distinct()
    return texts.network(texts.numbered(names, "o")).select("a", "b", six("similarity").alias("similarity"))


def _directed(one: str, two: str) -> str:
    return f"list_avg(list_transform({one}, lambda g: list_max(list_transform({two}, lambda h: {DICE('g', 'h')}))))"


@query("text_complex", f"WITH f AS (SELECT DISTINCT p_name AS a, p_type || ' ' || p_brand AS b FROM part), g AS (SELECT a, b, list_transform(string_split(a, ' '), lambda v: {PAIRS('v')}) AS ga, list_transform(string_split(b, ' '), lambda v: {PAIRS('v')}) AS gb FROM f) SELECT a, b, {s6(f'({_directed("ga", "gb")} + {_directed("gb", "ga")}) / 2')} AS similarity FROM g")
def _(spark, d):
    pairs = adapters.table(spark, d, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", "p_type", "p_brand").alias("b")).distinct()
    return pairs.select("a", "b", six(complex_similarity(F.col("a"), F.col("b"), " ")).alias("similarity"))


@query("observed_windows", "WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type FROM events) SELECT window_start, event_type AS term, count(*)::DOUBLE AS observed_freq FROM w GROUP BY ALL UNION ALL SELECT window_start, 'EVENT', count(*)::DOUBLE FROM w GROUP BY ALL")
def _(spark, d):
    events = adapters.table(spark, d, "events")
    onto = adapters.from_edges(events.select(F.col("event_type").alias("child"), F.lit("EVENT").alias("parent")).distinct())
    return observed_in_windows(events.select("ts", F.col("event_type").alias("term")), onto)
