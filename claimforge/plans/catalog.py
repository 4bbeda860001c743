"""Registered queries of the deductive operators on the star-schema tables, each with its SQL for DuckDB.

Knowledge bases are made from the tables: customers and suppliers are below nations, nations below regions, regions below
'world'; segments are properties; events give rules. Questions are made from rows. The SQL states the same results from the
tables directly, without parsing any question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from claimforge.functions import constants as C
from claimforge.functions import text as T
from claimforge.operators import evaluate as E
from claimforge.operators import generate as G
from claimforge.operators import metrics as M
from claimforge.operators import validate as V
from claimforge.operators.changes import changed, reduced
from claimforge.operators.closure import closure, inherited, reachable
from claimforge.operators.labels import labelled, reachable_by
from claimforge.operators.running import numbered_rows
from claimforge.operators.tables import new_folder as files
from claimforge.plans import reports as R
from claimforge.plans.golden import QUESTIONS
from claimforge.sources import ingest as I
from claimforge.sources import theories as TH
from claimforge.sources.answers import LOG, replayed
from claimforge.sources.large_json import list_entries
from claimforge.sources.sharded import read_lines
from claimforge.sources.kb import KnowledgeBase, builtin, extend, merge_pairs, read_json, stats, write_json

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- carriers
def token(c: str):
    return F.lower(F.replace(F.col(c), F.lit("#"), F.lit("")))


def geography(spark, d) -> KnowledgeBase:
    t = lambda n: table(spark, d, n)
    nation = t("nation")
    below = lambda n, key, name: t(n).join(nation, F.col(key) == F.col("n_nationkey")).select(token(name).alias("child"), F.lower("n_name").alias("parent"))
    isa = below("customer", "c_nationkey", "c_name").unionByName(below("supplier", "s_nationkey", "s_name"))
    isa = isa.unionByName(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("child"), F.lower("r_name").alias("parent")))
    isa = isa.unionByName(t("region").select(F.lower("r_name").alias("child"), F.lit("world").alias("parent")))
    prop = t("customer").where("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("entity"), F.lower("c_mktsegment").alias("prop")).distinct()
    rule = t("events").where("event_type != 'signup' and cast(get_json_object(props, '$.k') as int) % 20 < 12").select(F.concat("event_type", F.lit(" happens")).alias("condition"), F.concat(F.lit("level_"), level()).alias("consequence")).distinct()
    return KnowledgeBase(isa, prop, rule)


def level():
    return (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")


GEO = """nat AS (SELECT n_nationkey, lower(n_name) AS n, lower(r_name) AS r, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, lower(replace(c_name, '#', '')) AS c, n, r, n_regionkey, lower(c_mktsegment) AS seg, c_acctbal FROM customer JOIN nat ON c_nationkey = n_nationkey),
sup AS (SELECT lower(replace(s_name, '#', '')) AS s, n, r FROM supplier JOIN nat ON s_nationkey = n_nationkey),
prop AS (SELECT DISTINCT n AS entity, seg AS prop FROM cust WHERE c_acctbal > 9000),
edges AS (SELECT c AS child, n AS parent FROM cust UNION SELECT s, n FROM sup UNION SELECT n, r FROM nat UNION SELECT DISTINCT r, 'world' FROM nat)"""


def geo_questions(spark, d) -> DataFrame:
    """One taxonomic or categorical question for each customer; the subject of every fifth is unknown."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.lower("r_name").alias("own")), F.col("n_regionkey") == F.col("k"))
    c = c.join(table(spark, d, "region").select(F.col("r_regionkey").alias("k2"), F.lower("r_name").alias("other")), (F.col("n_regionkey") + 1) % 5 == F.col("k2"))
    m, name, seg = F.col("c_custkey") % 5, token("c_name"), F.lower("c_mktsegment")
    q = (
        F.when(m == 0, F.concat(F.lit("Are all "), name, F.lit(" a "), F.col("own"), F.lit("?")))
        .when(m == 1, F.concat(F.lit("are all "), name, F.lit(" "), F.col("other"), F.lit("??")))
        .when(m == 2, F.concat(F.lit(" Is "), name, F.lit(" a "), F.lower("n_name"), F.lit("? ")))
        .when(m == 3, F.concat(F.lit("Are all ghost"), F.col("c_custkey").cast("string"), F.lit(" "), F.col("own"), F.lit("?")))
        .otherwise(F.concat(F.lit("Do all "), name, F.lit(" have the "), seg, F.lit("?")))
    )
    return c.select(F.col("c_custkey").alias("idx"), q.alias("question"), F.when(m == 4, "categorical").otherwise("taxonomic").alias("type"))


GEO_ASKED = """SELECT c_custkey AS idx, CASE c_custkey % 5 WHEN 0 THEN 'Are all ' || c || ' a ' || r || '?' WHEN 1 THEN 'are all ' || c || ' ' || other || '??' WHEN 2 THEN ' Is ' || c || ' a ' || n || '? '
WHEN 3 THEN 'Are all ghost' || c_custkey || ' ' || r || '?' ELSE 'Do all ' || c || ' have the ' || seg || '?' END AS question
FROM (SELECT c_custkey, lower(replace(c_name, '#', '')) AS c, lower(n_name) AS n, lower(o.r_name) AS r, lower(x.r_name) AS other, lower(c_mktsegment) AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region o ON o.r_regionkey = n_regionkey JOIN region x ON x.r_regionkey = (n_regionkey + 1) % 5)"""


GEO_VERDICT = f"""WITH {GEO}, v AS (SELECT c_custkey AS idx, c_custkey % 5 <> 3 AS covered,
CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN EXISTS (SELECT 1 FROM prop p WHERE p.entity = cust.n AND p.prop = cust.seg) END AS graph_answer FROM cust)
SELECT idx, covered, graph_answer, CASE WHEN graph_answer THEN 'YAQEEN' WHEN NOT graph_answer THEN 'WAHM' ELSE 'UNKNOWN' END AS epistemic_state FROM v"""


# ---------------------------------------------------------------- graph
@register(f"WITH RECURSIVE {GEO}, up AS (SELECT child, parent AS ancestor FROM edges UNION SELECT up.child, e.parent FROM up JOIN edges e ON up.ancestor = e.child) SELECT child, ancestor FROM up")
def g1_transitive_closure(spark, d):
    return closure(geography(spark, d).isa)


@register(f"WITH {GEO} SELECT c AS child, x AS ancestor, x IN (c, n, r, 'world') AS reached FROM (SELECT c, n, r, CASE c_custkey % 4 WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 'asia' ELSE 'world' END AS x FROM cust)")
def g2_reachability(spark, d):
    kb, m = geography(spark, d), F.col("c_custkey") % 4
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    goal = F.when(m == 0, token("c_name")).when(m == 1, F.lower("r_name")).when(m == 2, "asia").otherwise("world")
    return reachable(c.select(token("c_name").alias("child"), goal.alias("ancestor")), closure(kb.isa))


@register(f"WITH {GEO} SELECT DISTINCT c AS entity, prop FROM cust JOIN prop ON entity = n UNION SELECT s, prop FROM sup JOIN prop ON entity = n UNION SELECT entity, prop FROM prop")
def g3_property_inheritance(spark, d):
    kb = geography(spark, d)
    return inherited(kb.has_prop, closure(kb.isa))


PAIRS = "p AS (SELECT p_partkey % 2 AS half, replace(lower(p_brand), '#', '') AS child, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN replace(lower(p_brand), '#', '') ELSE lower(p_type) || (p_size % 3) END AS parent FROM part)"


def part_pairs(spark, d) -> DataFrame:
    k, brand = F.col("p_partkey"), token("p_brand")
    parent = F.when(k % 11 == 0, "").when(k % 13 == 0, brand).otherwise(F.concat(F.lower("p_type"), (F.col("p_size") % 3).cast("string")))
    return table(spark, d, "part").select((k % 2).alias("half"), brand.alias("child"), parent.alias("parent"))


@register(f"WITH {PAIRS} SELECT child, parent FROM p WHERE half = 1 AND child <> '' AND parent <> '' AND child <> parent EXCEPT SELECT child, parent FROM p WHERE half = 0")
def g4_merge_new_pairs(spark, d):
    p = part_pairs(spark, d)
    return merge_pairs(p.where("half = 0"), p.where("half = 1"))[1]


@register(f"WITH {PAIRS} SELECT child, parent FROM p WHERE half = 0 UNION SELECT child, parent FROM p WHERE half = 1 AND child <> '' AND parent <> '' AND child <> parent")
def u2_j5_kb_union(spark, d):
    p = part_pairs(spark, d)
    return merge_pairs(p.where("half = 0").select("child", "parent").distinct(), p.where("half = 1"))[0]


@register(f"WITH {GEO} SELECT 'taxonomies' AS part, count(DISTINCT child) AS n_keys, count(*) AS n_pairs FROM edges UNION ALL SELECT 'properties', count(DISTINCT entity), count(*) FROM prop UNION ALL SELECT 'conditionals', count(DISTINCT c), count(*) FROM (SELECT DISTINCT event_type AS c, (props->>'$.k')::INT % 20 AS k FROM events WHERE event_type <> 'signup' AND (props->>'$.k')::INT % 20 < 12)")
def g5_kb_stats(spark, d):
    return stats(geography(spark, d))


#: pairs that come and go: the first region is above the world then, which makes a cycle; some nations change their region
MOVES = """gone AS (SELECT n AS child, r AS parent FROM nat WHERE n_nationkey % 3 = 0 UNION SELECT c, n FROM cust WHERE c_custkey % 7 = 0),
new AS (SELECT 'world' AS child, min(lower(r_name)) AS parent FROM region UNION SELECT n, lower(o.r_name) FROM nat JOIN region o ON o.r_regionkey = (nat.n_regionkey + 1) % 5 WHERE n_nationkey % 4 = 0 UNION SELECT s, 'trader' FROM sup),
after AS (SELECT child, parent FROM edges WHERE (child, parent) NOT IN (SELECT (child, parent) FROM gone) UNION SELECT child, parent FROM new)"""
UP = "{0}(child, ancestor) AS (SELECT child, parent FROM {1} UNION SELECT u.child, e.parent FROM {0} u JOIN {1} e ON u.ancestor = e.child)"


def moves(spark, d) -> tuple[DataFrame, DataFrame]:
    """(added, removed) pairs of the geography."""
    t = lambda n: table(spark, d, n)
    nation, k = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey")
    gone = nation.where(k % 3 == 0).select(F.lower("n_name").alias("child"), F.lower("r_name").alias("parent"))
    gone = gone.unionByName(t("customer").where("c_custkey % 7 = 0").join(nation, F.col("c_nationkey") == k).select(token("c_name").alias("child"), F.lower("n_name").alias("parent")))
    new = t("region").agg(F.lit("world").alias("child"), F.min(F.lower("r_name")).alias("parent"))
    other = t("region").select(F.col("r_regionkey").alias("k"), F.lower("r_name").alias("parent"))
    new = new.unionByName(nation.where(k % 4 == 0).join(other, (F.col("n_regionkey") + 1) % 5 == F.col("k")).select(F.lower("n_name").alias("child"), "parent"))
    return new.unionByName(t("supplier").select(token("s_name").alias("child"), F.lit("trader").alias("parent"))), gone


def moved(spark, d):
    edges = geography(spark, d).isa
    return changed(edges, closure(edges), *moves(spark, d))


@register(f"WITH RECURSIVE {GEO}, {MOVES}, {UP.format('up', 'after')} SELECT child, ancestor FROM up")
def g1_g4_closure_under_change(spark, d):
    """The closure of the geography after pairs have gone and come, kept up to date and not built again."""
    return moved(spark, d).closed


@register(f"WITH RECURSIVE {GEO}, {MOVES}, {UP.format('was', 'edges')}, {UP.format('up', 'after')} SELECT 'lost' AS change, * FROM (SELECT * FROM was EXCEPT SELECT * FROM up) UNION ALL SELECT 'gained', * FROM (SELECT * FROM up EXCEPT SELECT * FROM was)")
def g1_g4_what_a_change_does(spark, d):
    """The closed pairs that the change took and gave."""
    x = moved(spark, d)
    say = lambda df, what: df.select(F.lit(what).alias("change"), "child", "ancestor")
    return say(x.lost, "lost").unionByName(say(x.gained, "gained"))


@register(f"WITH {GEO} SELECT child, parent FROM edges")
def g1_reduction(spark, d):
    """The geography's pairs again, from its closure alone."""
    return reduced(closure(geography(spark, d).isa).select("child", F.col("ancestor").alias("parent")))


@register("SELECT event_id AS idx, 'e' || event_id AS child, 'e' || b AS ancestor, b >= event_id AND b // 2000 = event_id // 2000 AND b <= (SELECT max(event_id) + 1 FROM events) AS reached FROM (SELECT event_id, (event_id * 7919 + 13) % 10000 AS b FROM events WHERE event_id < 10000) UNION ALL SELECT event_id, 'e' || event_id, 'e' || (event_id + 40), event_id // 2000 = (event_id + 40) // 2000 AND event_id + 39 <= (SELECT max(event_id) FROM events) FROM events")
def g2_reachability_by_labels(spark, d):
    """Chains of two thousand events each, whose closure would be quadratic: who comes after whom, by two-hop labels."""
    e = table(spark, d, "events").select("event_id")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    k = F.col("event_id")
    edges = e.where(k % 2000 != 1999).select(name(k).alias("child"), name(k + 1).alias("parent"))
    far = e.where("event_id < 10000").select(k.alias("idx"), name(k).alias("child"), name((k * 7919 + 13) % 10000).alias("ancestor"))
    near = e.select(k.alias("idx"), name(k).alias("child"), name(k + 40).alias("ancestor"))
    return reachable_by(far.unionByName(near), labelled(edges))


# ---------------------------------------------------------------- validation
def verdict_columns(df: DataFrame) -> DataFrame:
    return df.select("idx", "covered", "graph_answer", "epistemic_state")


@register(GEO_VERDICT)
def v1_v2_v4_validate_geography(spark, d):
    return verdict_columns(V.validate(geo_questions(spark, d), geography(spark, d)))


@register(GEO_VERDICT.replace("'UNKNOWN'", "'SHAKK'"))
def v5_validate_loose(spark, d):
    return verdict_columns(V.validate(geo_questions(spark, d), geography(spark, d), loose=True))


RULES = "rules AS (SELECT DISTINCT event_type AS e, (props->>'$.k')::INT % 20 AS k FROM events WHERE event_type <> 'signup' AND (props->>'$.k')::INT % 20 < 12), ev AS (SELECT event_id, event_type AS e, (props->>'$.k')::INT % 20 AS k FROM events)"


def event_questions(spark, d) -> DataFrame:
    word = F.when(F.col("event_id") % 2 == 0, "is it level ").otherwise("is it not level ")
    link = F.when(F.col("event_id") % 3 == 0, " then ").otherwise(", ")
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), F.concat(F.lit("If "), F.col("event_type"), F.lit(" happens"), link, word, level(), F.lit("?")).alias("question"), F.lit("hypothetical").alias("type"))


@register(f"WITH {RULES}, v AS (SELECT event_id AS idx, e <> 'signup' AS covered, CASE WHEN e <> 'signup' THEN (EXISTS (SELECT 1 FROM rules r WHERE r.e = ev.e AND r.k = ev.k)) <> (event_id % 2 = 1) END AS graph_answer FROM ev) SELECT idx, covered, graph_answer, CASE WHEN graph_answer THEN 'YAQEEN' WHEN NOT graph_answer THEN 'WAHM' ELSE 'UNKNOWN' END AS epistemic_state FROM v")
def v3_v8_validate_rules(spark, d):
    return verdict_columns(V.validate(event_questions(spark, d), geography(spark, d)))


FIRST = """rules AS (SELECT DISTINCT CASE WHEN (props->>'$.k')::INT % 20 < 6 THEN 'it is ' || event_type ELSE event_type END AS c, (props->>'$.k')::INT % 20 AS k FROM events WHERE event_type <> 'signup' AND (props->>'$.k')::INT % 20 < 12 AND NOT (event_type = 'click' AND (props->>'$.k')::INT % 20 < 6)),
ev AS (SELECT event_id, event_type AS e, (props->>'$.k')::INT % 20 AS k FROM events), h AS (SELECT ev.*, coalesce((SELECT min(c) FROM rules WHERE c = 'it is ' || e), (SELECT min(c) FROM rules WHERE c = e)) AS head FROM ev)"""


def spelled_rules(spark, d) -> DataFrame:
    """Rules under two spellings of a condition with different consequences; clicks have one spelling, signups none."""
    k = F.get_json_object("props", "$.k").cast("int") % 20
    x = table(spark, d, "events").where((F.col("event_type") != "signup") & (k < 12) & ~((F.col("event_type") == "click") & (k < 6)))
    return x.select(F.when(k < 6, F.concat(F.lit("it is "), "event_type")).otherwise(F.col("event_type")).alias("condition"), F.concat(F.lit("level_"), level()).alias("consequence")).distinct()


@register(f"WITH {FIRST}, v AS (SELECT event_id AS idx, head IS NOT NULL AS covered, CASE WHEN head IS NOT NULL THEN EXISTS (SELECT 1 FROM rules r WHERE r.c = head AND r.k = h.k) END AS graph_answer FROM h) SELECT *, CASE WHEN NOT covered THEN 'UNKNOWN' WHEN graph_answer THEN 'YAQEEN' ELSE 'WAHM' END AS epistemic_state FROM v")
def v8_first_spelling_decides(spark, d):
    """The condition's first spelling that heads a rule decides, where others would say something else."""
    q = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.concat(F.lit("If it is "), F.col("event_type"), F.lit(", is it level "), level(), F.lit("?")).alias("question"), F.lit("hypothetical").alias("type"))
    none = geography(spark, d)
    return verdict_columns(V.validate(q, KnowledgeBase(none.isa, none.has_prop, spelled_rules(spark, d)), first=True))


@register(f"WITH {GEO}, v AS ({GEO_VERDICT}) SELECT CASE WHEN idx % 5 = 4 THEN 'categorical' ELSE 'taxonomic' END AS pattern_type, count(*) AS total, count(*) FILTER (WHERE covered) AS covered, round(100.0 * count(*) FILTER (WHERE covered) / count(*), 2) AS coverage_rate, round(100.0 * count(*) FILTER (WHERE NOT covered) / count(*), 2) AS non_interference FROM v GROUP BY 1")
def v9_a11_coverage_by_pattern(spark, d):
    q = geo_questions(spark, d).withColumn("category", F.lit("geography"))
    return M.coverage_rates(V.coverage(q.drop("type"), geography(spark, d)), "pattern_type")


@register(f"WITH v AS ({GEO_VERDICT}), n AS (SELECT CASE WHEN idx % 5 = 4 THEN 'categorical' ELSE 'taxonomic' END AS pattern_type, covered FROM v) SELECT ord, p AS pattern_type, count(covered) AS total, count(*) FILTER (WHERE covered) AS covered, round(100.0 * count(covered) / (SELECT count(*) FROM n), 1) AS share FROM (VALUES (0, 'taxonomic'), (1, 'categorical'), (2, 'hypothetical'), (3, 'other')) o(ord, p) LEFT JOIN n ON n.pattern_type = p GROUP BY ord, p")
def a12_r12_coverage_table(spark, d):
    q = geo_questions(spark, d).withColumn("category", F.lit("geography"))
    return R.coverage_table(V.coverage(q.drop("type"), geography(spark, d)))


# ---------------------------------------------------------------- text
def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(pairs)) + " END"


WORDS = ("mice", "rhombuses", "appendices", "berries", "wolves", "horses", "foxes", "benches", "dishes", "glass", "cactus", "axis", "dogs", "ies", "  Dogs ", "bird")
SINGULAR = ("mouse", "rhombus", "appendix", "berry", "wolf", "hors", "fox", "bench", "dish", "glass", "cactus", "axis", "dog", "ie", "dog", "bird")
LOOSE_SINGULAR = ("mouse", "rhombus", "appendice", "berry", "wolf", "hors", "fox", "benche", "dishe", "glass", "cactus", "axis", "dog", "ie", "dog", "bird")


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


ENDINGS = ("", "s", "es", "ies", "ves", "ses", "xes", "ches", "shes", "ss", "us", "is")
ONE = """CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN left(w, -3) || 'y' WHEN w LIKE '%ves' AND length(w) > 3 THEN left(w, -3) || 'f' WHEN (w LIKE '%ses' OR w LIKE '%xes') AND length(w) > 3 THEN left(w, -2)
WHEN (w LIKE '%ches' OR w LIKE '%shes') AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' AND w NOT LIKE '%is' THEN left(w, -1) ELSE w END"""


@register(f"SELECT p_partkey, {_case('p_partkey % 16', SINGULAR)} AS strict, {_case('p_partkey % 16', LOOSE_SINGULAR)} AS loose, {ONE} AS own FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || {_case('p_size % 12', ENDINGS)} AS w FROM part)")
def f2_f3_singular(spark, d):
    """Fixed words, and every part's own word with all endings that the rules tell apart."""
    own = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), _pick(F.col("p_size") % 12, ENDINGS))
    word = _pick(F.col("p_partkey") % 16, WORDS)
    return table(spark, d, "part").select("p_partkey", T.singular(word).alias("strict"), T.singular(word, True).alias("loose"), T.singular(own).alias("own"))


@register("SELECT o_orderkey, lower(o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END AS cleaned FROM orders")
def f1_clean_question(spark, d):
    tail = F.when(F.col("o_orderkey") % 2 == 0, " ??").otherwise("?")
    return table(spark, d, "orders").select("o_orderkey", T.clean_question(F.concat(F.lit("\t "), "o_orderpriority", tail, F.lit(" \n"))).alias("cleaned"))


@register("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'living_thing' WHEN 1 THEN 'warm_blooded' WHEN 2 THEN regexp_replace(lower(o_orderstatus), 's$', '') || ' thing' ELSE 'mouse' END AS node FROM orders")
def f4_predicate(spark, d):
    p = F.element_at(F.array(F.lit(" Living things"), F.lit("warm blooded"), F.concat(F.lower("o_orderstatus"), F.lit(" things")), F.lit("mice")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.predicate(p).alias("node"))


@register("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'x' || c_custkey WHEN 1 THEN 'y' || c_custkey END AS lhs, CASE WHEN c_custkey % 4 < 2 THEN lower(c_mktsegment) || ' thing' END AS rhs FROM customer")
def f5_taxonomic(spark, d):
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    q = F.element_at(F.array(F.concat(F.lit("Are all x"), k, F.lit(" an "), seg, F.lit(" things?")), F.concat(F.lit("is y"), k, F.lit("  a "), seg, F.lit(" things!")), F.concat(F.lit("Is "), k, F.lit(" "), seg), F.concat(F.lit("are any "), seg)), (F.col("c_custkey") % 4 + 1).cast("int"))
    x = table(spark, d, "customer").select("c_custkey", T.taxonomic(q).alias("x"))
    return x.select("c_custkey", "x.lhs", "x.rhs")


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'x' || c_custkey END AS lhs, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) || ' parts, all' WHEN 1 THEN lower(c_mktsegment) END AS rhs FROM customer")
def f6_categorical(spark, d):
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    q = F.element_at(F.array(F.concat(F.lit("Do all x"), k, F.lit(" have the "), seg, F.lit(" parts, all?")), F.concat(F.lit("do all x"), k, F.lit(" need "), seg, F.lit("?")), F.concat(F.lit("Do all x"), k, F.lit(" like "), seg)), (F.col("c_custkey") % 3 + 1).cast("int"))
    x = table(spark, d, "customer").select("c_custkey", T.categorical(q).alias("x"))
    return x.select("c_custkey", "x.lhs", "x.rhs")


HYPO = (  # opening, rest after it, negated strict, rest loose, negated loose
    (", is there no ", "{}", True, "{}", True), (", does it ", "{}", False, "{}", False), (" then ", "{}", False, "{}", False), (", do we need ", "{}", False, "do we need {}", False), (", is the ", "{}", False, "{}", False),
)


@register(
    "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN event_type || ' ends' END AS lhs, CASE WHEN event_id % 6 < 5 THEN 'm' || event_type END AS strict, event_id % 6 = 0 AS negated, CASE WHEN event_id % 6 = 3 THEN 'do we need m' || event_type WHEN event_id % 6 < 5 THEN 'm' || event_type END AS loose FROM events"
)
def f7_f8_hypothetical(spark, d):
    e = F.col("event_type")
    forms = [F.concat(F.lit("If "), e, F.lit(" ends"), F.lit(o), F.lit("m"), e, F.lit("?")) for o, *_ in HYPO] + [F.concat(F.lit("If "), e, F.lit(" ends"))]
    q = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    x = table(spark, d, "events").select("event_id", T.hypothetical(q).alias("s"), T.hypothetical(q, True).alias("l"))
    return x.select("event_id", "s.lhs", F.col("s.rhs").alias("strict"), "s.negated", F.col("l.rhs").alias("loose"))


@register("SELECT c_custkey, unnest(list_distinct([s || ' has parts', s || '_has_parts', 'parts', s, s || '_has_parts', s || ' has part', s || '_has_part', 'part', s || 's'])) AS form FROM (SELECT c_custkey, lower(c_mktsegment) AS s FROM customer WHERE c_mktsegment <> 'x')")
def f10_consequence_forms(spark, d):
    return table(spark, d, "customer").where("c_mktsegment != 'x'").select("c_custkey", F.explode(T.consequence_forms(F.concat("c_mktsegment", F.lit(" has parts ")))).alias("form"))


@register("SELECT c_custkey, unnest(list_distinct(['if it is ' || s, 'if_it_is_' || s, 'if   ' || s, 'if ' || s, 'it is ' || s])) AS form FROM (SELECT c_custkey, lower(c_mktsegment) AS s FROM customer)")
def f12_condition_forms(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.explode(T.condition_forms(F.concat(F.lit("If it is "), "c_mktsegment"))).alias("form"))


REPLIES = ("Yes.", " no", "NO, because of it", "true", "incorrect", "It is correct", "That is not so", "nothing", "", C.ERROR_REPLY, "perhaps", "All are so, certainly", "well yes", "I don't know if it is true")
TIDY = ("yes", "no", "no", "true", "incorrect", "it is correct", "no", "no", "", C.ERROR_REPLY, "perhaps", "all are so, certainly", "yes", "no")
#: the same after tidying, as records are made
PARSED_TIDY = ("true", "false", "false", "true", "false", "true", "false", "false", "null", "null", "null", "true", "true", "false")
PARSED = ("true", "false", "false", "true", "false", "true", "false", "false", "null", "null", "null", "true", "null", "null")


@register(f"SELECT o_orderkey, {_case('o_orderkey % 14', TIDY)} AS tidy, CAST({_case('o_orderkey % 14', PARSED).replace(chr(39) + 'null' + chr(39), 'NULL')} AS BOOLEAN) AS answer FROM orders")
def f14_f15_replies(spark, d):
    raw = _pick(F.col("o_orderkey") % 14, REPLIES)
    return table(spark, d, "orders").select("o_orderkey", T.tidy_reply(raw).alias("tidy"), T.yes_no(raw).alias("answer"))


KINDS = ("Are all dogs animals?", "is x an animal", "Do all dogs have hair?", "Does life need then?", "Different, so what", "Why is it so?", "what if")
KIND_OF = ("taxonomic", "taxonomic", "categorical", "hypothetical", "hypothetical", "other", "other")


@register(f"SELECT {_case('o_orderkey % 7', KIND_OF)} AS kind, count(*) AS n FROM orders GROUP BY 1")
def f16_question_type(spark, d):
    return table(spark, d, "orders").groupBy(T.question_type(_pick(F.col("o_orderkey") % 7, KINDS)).alias("kind")).agg(F.count("*").alias("n"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN split_part(p_name, ' ', 1) END AS child, CASE WHEN p_partkey % 3 <> 2 THEN split_part(p_name, ' ', 2) END AS parent FROM part")
def f17_isa_fact(spark, d):
    a, b, m = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 3
    s = F.when(m == 0, F.concat(F.lit(" "), F.upper(a), F.lit(" is a "), b, F.lit(".. "))).when(m == 1, F.concat(a, F.lit(" is an "), b)).otherwise(F.concat(a, F.lit("7 is a "), b))
    x = table(spark, d, "part").select("p_partkey", T.isa_fact(s, 2).alias("x"))
    return x.select("p_partkey", "x.child", "x.parent")


# ---------------------------------------------------------------- evaluation
REC = """base AS (SELECT d.doc_id AS idx, 'doc ' || (d.doc_id % 300) AS question, lang AS type, quality = 1 AS ground_truth, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE toxic = 0 END AS p, n_chars > 1000 AS graph_answer, n_chars % 3 <> 0 AS covered FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
runs AS (SELECT b.*, m, g, CASE WHEN m = 'm1' AND idx % 5 = 0 THEN NOT p ELSE p END AS llm_parsed FROM base b, (VALUES ('m0'), ('m1')) AS a(m), (VALUES (false), (true)) AS c(g)),
rec AS (SELECT idx, m || CASE WHEN g THEN '_guarded' ELSE '_baseline' END AS run_key, m, g AS guarded, question, type, ground_truth, llm_parsed, graph_answer, covered,
CASE WHEN g AND covered THEN graph_answer ELSE llm_parsed END AS final_answer,
CASE WHEN NOT (g AND covered) THEN 'llm_only' WHEN llm_parsed IS DISTINCT FROM graph_answer THEN 'guard_override' ELSE 'guard_agree' END AS method,
g AND covered AND llm_parsed IS DISTINCT FROM graph_answer AND graph_answer = ground_truth AS caught,
coalesce(CASE WHEN g AND covered THEN graph_answer ELSE llm_parsed END = ground_truth, false) AS is_correct FROM runs)"""
CM = "count(*) FILTER (WHERE coalesce(final_answer, false) AND ground_truth) AS tp, count(*) FILTER (WHERE NOT coalesce(final_answer, false) AND NOT ground_truth) AS tn, count(*) FILTER (WHERE coalesce(final_answer, false) AND NOT ground_truth) AS fp, count(*) FILTER (WHERE NOT coalesce(final_answer, false) AND ground_truth) AS fn, count(*) AS total"
RATES = """round(100.0 * coalesce(tp / nullif(tp + fp, 0), 0), 1) AS "precision", round(100.0 * coalesce(tp / nullif(tp + fn, 0), 0), 1) AS recall, round(100.0 * coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 1) AS f1, round(100.0 * (tp + tn) / total, 1) AS accuracy, round(100.0 * coalesce(tn / nullif(tn + fp, 0), 0), 1) AS specificity"""


def records(spark, d) -> DataFrame:
    """Evaluation records of two models, with and without guard, from labelled documents; questions repeat."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels")
    x = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("doc "), (F.col("doc_id") % 300).cast("string")).alias("question"), F.col("lang").alias("type"), (F.col("quality") == 1).alias("ground_truth"),
        F.when(F.col("doc_id") % 17 != 0, F.col("toxic") == 0).alias("p"), (F.col("n_chars") > 1000).alias("graph_answer"), (F.col("n_chars") % 3 != 0).alias("covered"),
    )
    x = x.withColumn("m", F.explode(F.array(F.lit("m0"), F.lit("m1")))).withColumn("guarded", F.explode(F.array(F.lit(False), F.lit(True))))
    x = x.withColumn("llm_parsed", F.when((F.col("m") == "m1") & (F.col("idx") % 5 == 0), ~F.col("p")).otherwise(F.col("p")))
    x = x.select("*", *E.override(F.col("guarded"), F.col("llm_parsed"), F.col("graph_answer"), F.col("covered"), F.col("ground_truth")))
    key = F.concat("m", F.when(F.col("guarded"), "_guarded").otherwise("_baseline"))
    return x.withColumn("is_correct", E.correct(F.col("final_answer"), F.col("ground_truth"))).withColumn("run_key", key).withColumnRenamed("covered", "graph_covered")


@register(f"WITH {REC} SELECT idx, run_key, final_answer, method, caught, is_correct FROM rec")
def v6_v7_e1_e2_override(spark, d):
    return records(spark, d).select("idx", "run_key", "final_answer", "method", "caught", "is_correct")


@register(f"WITH {REC} SELECT run_key, {CM} FROM rec GROUP BY run_key")
def a1_confusion(spark, d):
    return M.confusion(records(spark, d), "run_key")


@register(f"WITH {REC}, cm AS (SELECT run_key, {CM} FROM rec GROUP BY run_key) SELECT *, {RATES} FROM cm")
def a2_rates(spark, d):
    return M.rates(M.confusion(records(spark, d), "run_key"))


@register(f"WITH {REC}, cm AS (SELECT run_key, type, {CM}, CAST(grouping(type) AS TINYINT) AS whole FROM rec GROUP BY GROUPING SETS ((run_key), (run_key, type))) SELECT *, {RATES} FROM cm")
def a3_a4_per_type(spark, d):
    return M.overall_and_per_type(records(spark, d))


@register(f"WITH {REC} SELECT run_key, type, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 1) AS accuracy_strict FROM rec GROUP BY run_key, type")
def a5_a16_summary(spark, d):
    return M.summary(records(spark, d), "run_key", "type")


@register(f"WITH {REC} SELECT run_key, count(*) FILTER (WHERE guarded AND caught) AS caught, count(*) FILTER (WHERE guarded AND covered AND llm_parsed <> ground_truth) AS llm_errors FROM rec GROUP BY run_key")
def a6_caught_and_errors(spark, d):
    return M.caught_and_errors(records(spark, d))


OUT = f"{REC}, last AS (SELECT m, question, arg_max(is_correct, idx) AS b FROM rec WHERE NOT guarded GROUP BY m, question), pairs AS (SELECT rec.m AS base_model, idx, rec.question, CASE WHEN NOT b AND is_correct THEN 'intercepted' WHEN b AND NOT is_correct THEN 'false_alarm' WHEN b THEN 'both_correct' ELSE 'both_wrong' END AS outcome FROM rec JOIN last ON rec.m = last.m AND rec.question = last.question WHERE guarded)"


@register(f"WITH {OUT}, n AS (SELECT base_model, count(*) FILTER (WHERE outcome = 'intercepted') AS intercepted, count(*) FILTER (WHERE outcome = 'false_alarm') AS false_alarm, count(*) FILTER (WHERE outcome = 'both_correct') AS both_correct, count(*) FILTER (WHERE outcome = 'both_wrong') AS both_wrong FROM pairs GROUP BY 1) SELECT *, intercepted + both_wrong AS llm_errors, CASE WHEN intercepted + both_wrong > 0 THEN round(100.0 * intercepted / (intercepted + both_wrong), 1) ELSE 100.0 END AS interception_rate, coalesce(round(100.0 * intercepted / nullif(intercepted + both_wrong, 0), 1), 0.0) AS rate_or_zero FROM n")
def a7_a15_r4_interception(spark, d):
    return R.interception_table(records(spark, d))


@register(f"WITH {OUT} SELECT base_model, idx, question, outcome FROM pairs")
def j2_w1_last_wins_pairs(spark, d):
    df = records(spark, d).withColumn("base_model", F.col("m"))
    return M.paired(df.where("not guarded"), df.where("guarded"), "base_model").select("base_model", "idx", "question", "outcome")


@register(f"WITH {OUT} SELECT idx, question FROM pairs WHERE outcome = 'intercepted' AND base_model = 'm1' ORDER BY idx LIMIT 10")
def o3_first_intercepted(spark, d):
    df = records(spark, d).where("m = 'm1'")
    return M.outcome_questions(M.paired(df.where("not guarded"), df.where("guarded")), "intercepted", 10)


@register("SELECT o_orderpriority AS type, o_orderstatus AS source, count(*) AS total, count(*) FILTER (WHERE t) AS true_n, count(*) FILTER (WHERE NOT t) AS false_n FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice > 200000 END AS t FROM orders) GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))")
def a8_query_set_stats(spark, d):
    truth = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") > 200000)
    return M.query_set_stats(table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("source"), truth.alias("ground_truth")))


@register("SELECT ord, k AS event_type, count(event_id) AS n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'refund'), (3, 'purchase')) o(ord, k) LEFT JOIN events ON event_type = k GROUP BY ord, k")
def a9_type_counts(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return M.fixed_rows(counts, "event_type", ("view", "click", "refund", "purchase"), ("n",))


@register("SELECT count(*) AS total, count(*) FILTER (WHERE value > 10) AS covered, round(100.0 * count(*) FILTER (WHERE value > 10) / count(*), 2) AS coverage_rate, round(100.0 * count(*) FILTER (WHERE NOT value > 10) / count(*), 2) AS non_interference FROM events")
def a10_coverage_totals(spark, d):
    return M.coverage_rates(table(spark, d, "events").select((F.col("value") > 10).alias("covered")))


@register("SELECT idx, covered, round(100.0 * covered / idx, 2) AS rate FROM (SELECT event_id + 1 AS idx, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS covered FROM events) WHERE idx % 100 = 0")
def a13_w2_running_coverage(spark, d):
    return M.running_coverage(table(spark, d, "events").select((F.col("event_id") + 1).alias("idx"), (F.col("value") > 10).alias("covered")))


@register(f"WITH {REC}, s AS (SELECT m AS model, type, guarded, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 1) AS a FROM rec GROUP BY ALL) SELECT b.model, b.type, b.a AS baseline, g.a AS guarded, round(g.a - b.a, 1) AS delta FROM s b JOIN s g ON b.model = g.model AND b.type = g.type AND NOT b.guarded AND g.guarded")
def a14_j6_r13_deltas(spark, d):
    return M.deltas(records(spark, d))


def _wide(column: str, missing: str) -> str:
    return ", ".join(f"coalesce(max({column}) FILTER (WHERE type = '{t}'), {missing}) AS {t}" for t in ("en", "de", "fr", "xx"))


@register(f"WITH {REC}, cm AS (SELECT run_key, type, {CM} FROM rec GROUP BY ALL), r AS (SELECT *, printf('%5.1f%%', round(100.0 * (tp + tn) / total, 1)) AS a FROM cm) SELECT run_key, {_wide('a', chr(39) + 'N/A' + chr(39))} FROM r GROUP BY run_key")
def r3_per_type_table(spark, d):
    return R.per_type_table(records(spark, d), ("en", "de", "fr", "xx"))


@register(f"WITH {REC}, s AS (SELECT run_key, type, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 1) AS a FROM rec GROUP BY ALL), w AS (SELECT run_key, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 1) AS overall FROM rec GROUP BY 1) SELECT w.run_key, overall, {_wide('a', '0.0')} FROM w JOIN s ON w.run_key = s.run_key GROUP BY w.run_key, overall")
def r6_cross_model_table(spark, d):
    return R.cross_model_table(records(spark, d), ("en", "de", "fr", "xx"))


@register(f"WITH {REC} SELECT ord, label, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 1) AS accuracy_strict FROM rec JOIN (VALUES (0, 'm1_guarded', 'Second'), (1, 'm0_baseline', 'First')) o(ord, k, label) ON run_key = k GROUP BY ord, label")
def r8_j4_o5_accuracy_table(spark, d):
    return R.accuracy_table(records(spark, d), (("m1_guarded", "Second"), ("m0_baseline", "First")))


@register(f"WITH {REC}, cm AS (SELECT run_key, {CM} FROM rec GROUP BY run_key) SELECT run_key, 0 AS ord, printf('%-10s %6d  %-10s %6d', 'TP', tp, 'FN', fn) AS line FROM cm UNION ALL SELECT run_key, 1, printf('%-10s %6d  %-10s %6d', 'FP', fp, 'TN', tn) FROM cm")
def r1_r10_confusion_block(spark, d):
    return R.confusion_block(records(spark, d))


@register(f"""WITH {REC}, cm AS (SELECT run_key, {CM} FROM rec GROUP BY run_key), r AS (SELECT *, {RATES} FROM cm) SELECT run_key, rpad(run_key, 20, ' ') || printf(' %5.1f%% %5.1f%% %5.1f%% %5.1f%% %5.1f%%', "precision", recall, f1, accuracy, specificity) AS line FROM r""")
def r2_r9_f20_rates_table(spark, d):
    return R.rates_table(records(spark, d))


@register(f"WITH {REC} SELECT run_key, replace(replace(run_key, '_baseline', ''), '_guarded', '') AS model, contains(run_key, 'guarded') AS is_guarded, count(*) AS n FROM rec WHERE run_key IN ('m0_baseline', 'm1_guarded', 'nope') GROUP BY run_key")
def p7_p8_f19_run_selection(spark, d):
    df = E.select_runs(records(spark, d), ("m0_baseline", "m1_guarded", "nope"))
    return df.groupBy("run_key").agg(F.first(E.base_model(F.col("run_key"))).alias("model"), F.first("guarded").alias("is_guarded"), F.count("*").alias("n"))


@register("SELECT * FROM (VALUES (1, 'nope'), (2, '')) t(ord, key)")
def p8_unknown_keys(spark, d):
    return E.unknown_keys(records(spark, d), ("m0_baseline", "nope", "", "m1_guarded"))


@register("SELECT l AS path, pos, name FROM (SELECT l_orderkey // 100 AS l, l_linenumber + 10 * l_orderkey AS name, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_linenumber + 10 * l_orderkey, l_partkey) - 1 AS pos FROM lineitem) WHERE pos < 5 AND l IN (SELECT DISTINCT l_orderkey // 100 AS l FROM lineitem ORDER BY l LIMIT 30)")
def o1_o2_w3_first_of_files(spark, d):
    """The first five entries of the first thirty files by path, as the limit of a loader."""
    x = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("long").alias("path"), (F.col("l_linenumber") + 10 * F.col("l_orderkey")).cast("long").alias("name"))
    return I.capped(I.numbered(x, "path", "name"), 30, 5).select("path", F.col("pos").cast("long").alias("pos"), "name")


@register(f"WITH {PAIRS} SELECT child AS question FROM p WHERE half = 0 UNION ALL SELECT parent FROM p WHERE half = 1")
def u1_union_all(spark, d):
    p = part_pairs(spark, d)
    return G.combined(p.where("half = 0").select(F.col("child").alias("question")), p.where("half = 1").select(F.col("parent").alias("question")))


@register("SELECT doc_id, substr(text, 1, 50) AS head FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0")
def p3_o4_blank_and_truncate(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.col("text").alias("question"), F.col("source").alias("category"))
    return I.question_rows(q).select("doc_id", T.head(F.col("question"), 50).alias("head"))


GEN = f"""WITH {GEO}, {RULES}, t AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY parent) AS n FROM edges), q AS (SELECT entity, prop, row_number() OVER (PARTITION BY entity ORDER BY prop) AS n FROM prop),
w AS (SELECT 'Are all ' || CASE WHEN child LIKE '%s' THEN child ELSE child || 's' END || ' ' || parent || 's?' AS x, 'taxonomic' AS type FROM t WHERE n <= 2 AND length(child) > 2 AND length(parent) > 2
UNION SELECT 'Do all ' || entity || 's have ' || replace(prop, '_', ' ') || '?', 'categorical' FROM q WHERE n <= 2 AND length(entity) > 2
UNION SELECT 'If ' || e || ' happens, does level ' || min(k::VARCHAR) || ' occur?', 'hypothetical' FROM rules GROUP BY e),
y AS (SELECT replace(replace(x, 'ss?', 's?'), 'ys?', 'ies?') AS x, type FROM w), g AS (SELECT DISTINCT upper(x[1:1]) || lower(x[2:]) AS question, type FROM y)"""


@register(f"{GEN} SELECT question, true AS ground_truth, type, 'kb_generated' AS source FROM g")
def d9_generate_questions(spark, d):
    return G.questions_from_kb(geography(spark, d))


@register(f"{GEN} SELECT DISTINCT question, type FROM g WHERE type = 'categorical' AND question NOT LIKE '%furniture%'")
def d11_not_yet_asked(spark, d):
    q = G.questions_from_kb(geography(spark, d)).where("type = 'categorical'")
    return G.not_yet(q, q.where(F.contains("question", F.lit("furniture"))).select(F.upper("question").alias("question"))).select("question", "type")


@register(f"WITH {GEO}, k AS (SELECT child AS key FROM edges UNION SELECT entity FROM prop), x AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'What of ' || upper(c) || 'S, then?' WHEN 1 THEN 'In ' || upper(n) || ', who?' WHEN 2 THEN 'What of x' || c_custkey || '?' ELSE 'of ' || r END AS question FROM cust) SELECT DISTINCT question FROM x WHERE length(question) >= 10 AND EXISTS (SELECT 1 FROM k WHERE contains(lower(question), key))")
def d8_mentions(spark, d):
    """Keys within words, as of a plural, count; questions without one go, and those of fewer than ten letters."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = F.col("c_custkey") % 4
    q = F.when(m == 0, F.concat(F.lit("What of "), F.upper(token("c_name")), F.lit("S, then?"))).when(m == 1, F.concat(F.lit("In "), F.upper("n_name"), F.lit(", who?"))).when(m == 2, F.concat(F.lit("What of x"), F.col("c_custkey").cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("of "), F.lower("r_name")))
    return G.mentions(c.select(q.alias("question")), geography(spark, d))


# ---------------------------------------------------------------- records of models, theories
@register(
    f"""WITH v AS ({GEO_VERDICT}), x AS (SELECT v.*, m, g, {_case('idx % 14', TIDY)} AS llm_raw, CAST({_case('idx % 14', PARSED_TIDY).replace(chr(39) + 'null' + chr(39), 'NULL')} AS BOOLEAN) AS p, idx % 3 <> 0 AS truth FROM v, (VALUES ('m0'), ('m1')) AS a(m), (VALUES (false), (true)) AS b(g)),
y AS (SELECT *, CASE WHEN m = 'm1' THEN NULL ELSE p END AS parsed, CASE WHEN m = 'm1' THEN '[llm_error]' ELSE llm_raw END AS raw, g AND covered AS used FROM x)
SELECT idx, m || CASE WHEN g THEN '_guarded' ELSE '_baseline' END AS run_key, raw AS llm_raw, parsed AS llm_parsed, CASE WHEN used THEN graph_answer ELSE parsed END AS final_answer,
CASE WHEN NOT used THEN 'llm_only' WHEN parsed IS DISTINCT FROM graph_answer THEN 'guard_override' ELSE 'guard_agree' END AS method, coalesce(CASE WHEN used THEN graph_answer ELSE parsed END = truth, false) AS is_correct FROM y"""
)
def e1_e2_s10_p1_evaluation(spark, d):
    """Verdicts, an answers table of two models (one always in error) and both kinds of run."""
    q = geo_questions(spark, d).withColumn("ground_truth", F.col("idx") % 3 != 0).withColumn("source", F.lit("geography"))
    raw = F.element_at(F.array(*[F.lit(v) for v in REPLIES]), (F.col("idx") % 14 + 1).cast("int"))
    answers = q.withColumn("model", F.explode(F.array(F.lit("m0"), F.lit("m1")))).select("model", "question", F.when(F.col("model") == "m0", raw).alias("raw"))
    rec = E.records(V.validate(q, geography(spark, d)), answers)
    return rec.select("idx", "run_key", "llm_raw", "llm_parsed", "final_answer", "method", "is_correct")


@register("SELECT DISTINCT split_part(p_name, ' ', 1) AS child, split_part(p_name, ' ', 2) AS parent FROM part WHERE p_partkey % 5 < 3")
def s3_s4_theory_pairs(spark, d):
    """Theories of every shape, made from parts: an object of sentences, a list, a wrapped list, a broken and an unrelated one."""
    s = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" is a "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("."))
    quoted = F.concat(F.lit('"'), s, F.lit('"'))
    shapes = [F.concat(F.lit('{"triples": {'), quoted, F.lit(": 1}}")), F.concat(F.lit('[{"triples": ['), quoted, F.lit("]}]")), F.concat(F.lit('{"meta": 0, "dev": [{"triples": ['), quoted, F.lit("]}]}")), F.concat(F.lit('{"triples": ['), quoted), F.concat(F.lit('{"other": ['), quoted, F.lit("]}"))]
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.element_at(F.array(*shapes), (F.col("p_partkey") % 5 + 1).cast("int")).alias("text"))
    return I.isa_pairs(I.theory_entries(docs))


@register("SELECT doc_id, text AS question, source AS category FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, text, 'Unknown' FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0 AND doc_id % 2 = 1")
def s8_p3_question_rows(spark, d):
    """Blank questions go, a missing category is Unknown."""
    return I.question_rows(table(spark, d, "documents").select("doc_id", F.col("text").alias("question"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("category")))


def part_theories(spark, d) -> DataFrame:
    """One theory with a question for each part: a text, a list of texts, a list of objects, or an object of triples."""
    a, b, m = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 4
    s = [F.concat(F.lit("All "), a, F.lit("s are "), b, F.lit("s")), F.concat(a, F.lit(" has big "), b, F.lit("s")), F.concat(a, F.lit(" is cold-blooded"))]
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    ask = F.concat(F.lit('"question": "'), F.when(m == 3, "Why?").otherwise(F.concat(F.lit("Are all "), a, F.lit("s "), b, F.lit("s?"))), F.lit('", "answer": "'), F.when(m == 1, "False").when(m == 2, "maybe").otherwise("True"), F.lit('"'))
    theory = (
        F.when(m == 0, F.concat(F.lit('"theory": "'), s[0], F.lit(". "), s[1], F.lit(". "), s[2], F.lit('. x.", "questions": [{'), ask, F.lit("}]")))
        .when(m == 1, F.concat(F.lit('"theory": ['), q(s[0]), F.lit(","), q(s[1]), F.lit('], "questions": {"k": {'), ask, F.lit("}}")))
        .when(m == 2, F.concat(F.lit('"context": [{"text": '), q(s[1]), F.lit('}], "questions": [{'), ask, F.lit("}]")))
        .otherwise(F.concat(F.lit('"theory": {"triples": ['), q(s[2]), F.lit(']}, "questions": [{'), ask, F.lit("}]")))
    )
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("{"), theory, F.lit("}")).alias("text"))
    return I.theory_entries(docs)


PART = "pt AS (SELECT p_partkey % 4 AS m, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"


@register(f"WITH {PART}, f AS (SELECT a || 's' AS lhs, b || 's' AS rhs, 'class' AS kind FROM pt WHERE m < 2 UNION ALL SELECT a, 'big_' || b || 's', 'property' FROM pt WHERE m < 3 UNION ALL SELECT a, 'cold_blooded', 'property' FROM pt WHERE m IN (0, 3)) SELECT kind, lhs, rhs, count(*) AS n FROM f GROUP BY ALL")
def d1_d2_d3_theory_facts(spark, d):
    s = TH.sentences(part_theories(spark, d)).select(TH.class_fact(F.col("sentence")).alias("c"), TH.property_fact(F.col("sentence")).alias("p"))
    facts = s.where("c is not null").select(F.lit("class").alias("kind"), F.col("c.a").alias("lhs"), F.col("c.b").alias("rhs")).unionByName(s.where("p is not null").select(F.lit("property").alias("kind"), F.col("p.a").alias("lhs"), F.col("p.b").alias("rhs")))
    return facts.groupBy("kind", "lhs", "rhs").agg(F.count("*").alias("n"))


@register(f"WITH {PART} SELECT 'Are all ' || a || 's ' || b || 's?' AS question, m = 0 AS ground_truth, 'taxonomic' AS type, 'theory' AS source, CASE m WHEN 0 THEN 'All ' || a || 's are ' || b || 's. ' || a || ' has big ' || b || 's. ' || a || ' is cold-blooded.' ELSE 'All ' || a || 's are ' || b || 's ' || a || ' has big ' || b || 's' END AS theory FROM pt WHERE m < 2")
def d4_d5_d6_theory_questions(spark, d):
    return TH.questions(part_theories(spark, d))


# ---------------------------------------------------------------- readers and writers, through files
def write_jsonl(lines: DataFrame, path: str) -> None:
    """Lines as text files whose names end in .jsonl."""
    lines.write.text(path)
    sc = lines.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(where):
        name = status.getPath().toString()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), sc._jvm.org.apache.hadoop.fs.Path(f"{name[:-4]}.jsonl"))


def sentence():
    """'colour is a thing.' of a part's name."""
    return F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" is a "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("."))


@register("SELECT DISTINCT split_part(p_name, ' ', 1) AS child, split_part(p_name, ' ', 2) AS parent FROM part")
def s2_s3_d10_theory_files(spark, d):
    """A folder of .jsonl files with one theory a line, and one of documents with a wrapped list of a thousand parts each; read back from the files."""
    at, p = files(spark), table(spark, d, "part")
    line = F.to_json(F.struct(F.array(sentence()).alias("triples")))
    write_jsonl(p.where("p_partkey % 2 = 0").select(line.alias("value")), f"{at}/lines")
    whole = p.where("p_partkey % 2 = 1").groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.array_agg(F.struct(F.array(sentence()).alias("triples"))).alias("train"))
    whole.write.partitionBy("k").json(f"{at}/whole")
    return I.isa_pairs(I.theory_entries(I.theory_documents(spark, at)))


BAD = "p_partkey % 7 = 0"


@register(f"SELECT p_partkey % 3 AS part, count(*) FILTER (WHERE NOT {BAD} AND p_partkey % 5 <> 0) AS n_entries, count(*) FILTER (WHERE {BAD} AND p_partkey % 5 <> 0) AS n_rejected, count(*) FILTER (WHERE p_partkey % 5 = 0) AS n_skipped FROM part GROUP BY 1")
def s3_rejected_lines(spark, d):
    """Lines of .jsonl files by folder: entries, lines that begin like one and don't parse, and all others."""
    at = files(spark)
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), sentence())).when(F.expr(BAD), F.concat(F.lit('{"triples": ["'), sentence())).otherwise(F.to_json(F.struct(F.array(sentence()).alias("triples"))))
    for part in range(3):
        write_jsonl(table(spark, d, "part").where(F.col("p_partkey") % 3 == part).select(line.alias("value")), f"{at}/part={part}")
    counts = I.line_counts(I.theory_lines(spark, at)).withColumn("part", F.regexp_extract("path", r"/part=(\d)/", 1).cast("long"))
    return counts.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n_entries", "n_rejected", "n_skipped")])


@register("SELECT p_partkey // 500 AS k, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS pos, split_part(p_name, ' ', 1) || ' \"is\" a {' || split_part(p_name, ' ', 2) || '}.' AS said FROM part")
def s4_large_lists(spark, d):
    """Documents that are one list of five hundred entries each, cut at braces and put together again; entries hold braces and quotes."""
    at = files(spark)
    said = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(' "is" a {'), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("}."))
    entries = F.array_sort(F.array_agg(F.struct("p_partkey", F.array(said).alias("triples"))))
    table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("k")).agg(F.to_json(entries).alias("value")).write.partitionBy("k").text(at)
    x = list_entries(spark, at, glob="*.txt")
    return x.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k"), F.col("pos").cast("long").alias("pos"), F.try_variant_get("entry", "$.triples[0]", "string").alias("said"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx FROM lineitem")
def w3_row_numbers(spark, d):
    """The place of each row among all rows."""
    rows = numbered_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "idx")


@register(f"WITH {REC} SELECT run_key, idx, count(*) OVER w AS seen, CAST(sum(is_correct::INT) OVER w AS BIGINT) AS correct, round(100.0 * sum(is_correct::INT) OVER w / count(*) OVER w, 1) AS accuracy_strict FROM rec WINDOW w AS (PARTITION BY run_key ORDER BY idx ROWS UNBOUNDED PRECEDING)")
def a16_running_accuracy(spark, d):
    """Right answers and accuracy so far at every row of each run."""
    return M.running_accuracy(records(spark, d), "run_key")


UNSAID = ("Are all horses mammals?", "Are all vehicles cars?", "Are all vehicles aircraft?", "Are all shapes polygons?", "Do all birds lay eggs?", "Do all fish live in water?", "Do all living things need water?", "Do all mammals give milk?",
          "Do all living things grow?", "Do all reptiles lay eggs?", "Do all fish give milk?", "Do all birds live in water?", "Do all mammals lay eggs?", "Do all living things need food?", "Do all living things die?", "If it is daytime, is it night?")
WRONG = ("Do all circles have a curved edge?", "If it is raining, do we need an umbrella?", "Do all mammals have warm blood?", "Do all reptiles have cold blood?")
_rows = ", ".join(f"({i}, '{q}', {str(truth).lower()}, {str(q not in UNSAID).lower()}, {'NULL' if q in UNSAID else str(truth and q not in WRONG).lower()})" for i, (q, truth, *_) in enumerate(QUESTIONS))


@register(f"SELECT c_custkey AS idx, question, covered, CAST(answer AS BOOLEAN) AS graph_answer, CASE WHEN NOT covered THEN 'UNKNOWN' WHEN answer THEN 'YAQEEN' ELSE 'WAHM' END AS epistemic_state FROM customer JOIN (VALUES {_rows}) g(k, question, truth, covered, answer) ON k = c_custkey % 175")
def s1_v4_built_in_questions(spark, d):
    """Each customer asks one of the 175 labelled questions; the built-in knowledge base covers all but 16 and is wrong about 4."""
    asked = spark.createDataFrame([(i, q, kind) for i, (q, _, kind, _) in enumerate(QUESTIONS)], "k int, question string, type string")
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") % len(QUESTIONS)).alias("k")).join(asked, "k").drop("k")
    return V.validate(q, builtin(spark)).select("idx", "question", "covered", "graph_answer", "epistemic_state")


@register("SELECT c_custkey AS idx, c_custkey % 4 <> 3 AS covered, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) = 'building' WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment) <> 'furniture' ELSE false END AS graph_answer FROM customer")
def f9_loose_properties(spark, d):
    """Questions about synonyms of properties in the loose form: warm blood is had by one segment, a heart by all but one, a wing by none."""
    m, seg = F.col("c_custkey") % 4, F.lower("c_mktsegment")
    q = F.concat(F.lit("Do all "), F.when(m == 3, "ghosts").otherwise(seg), F.lit(" have "), F.when(m == 0, "warm blood?").when(m == 1, "a heart?").when(m == 2, "a wing?").otherwise("a heart?"))
    segments = table(spark, d, "customer").select(seg.alias("entity")).distinct()
    prop = segments.where("entity = 'building'").select("entity", F.lit("warm_blooded").alias("prop")).unionByName(segments.where("entity != 'furniture'").select("entity", F.lit("heart").alias("prop"))).unionByName(segments.select("entity", F.lit("other").alias("prop")))
    kb = KnowledgeBase(segments.select(F.col("entity").alias("child"), F.lit("segment").alias("parent")), prop, spelled_rules(spark, d))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), q.alias("question"), F.lit("categorical").alias("type"))
    return V.validate(asked, kb, loose=True).select("idx", "covered", "graph_answer")


@register(f"{GEN} SELECT question, type FROM g WHERE type <> 'hypothetical' ORDER BY question LIMIT 100")
def d11_capped(spark, d):
    """The first hundred new questions by their text."""
    q = G.questions_from_kb(geography(spark, d))
    return G.not_yet(q, q.where("type = 'hypothetical'"), least=0, most=100).select("question", "type")


@register("SELECT 'm' || (o_custkey % 3) AS model, 'q' || o_orderkey AS question, CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'late' WHEN 2 THEN '[llm_error]' WHEN 3 THEN '[llm_error]' ELSE 'second' END AS raw FROM orders")
def s10_replayed_answers(spark, d):
    """Answers from a log: at once, rewritten by a task that ran again, never, too late, or at the second attempt."""
    o, m = table(spark, d, "orders"), F.col("o_orderkey") % 5
    entry = lambda attempt, second, raw: F.struct(F.lit(attempt).alias("attempt"), (F.col("o_orderdate") + F.expr(f"interval {second} seconds")).alias("at"), F.lit(raw).alias("raw"))
    log = F.when(m == 0, F.array(entry(1, 0, "yes"), entry(2, 1, "no"))).when(m == 1, F.array(entry(1, 9, "late"), entry(1, 3, "early"))).when(m == 2, F.array(entry(1, 0, None), entry(2, 1, C.ERROR_REPLY))).when(m == 3, F.array(entry(4, 0, "yes"))).otherwise(F.array(entry(1, 0, None), entry(2, 1, "second")))
    key = [F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question")]
    at = files(spark)
    o.select(*key, F.explode(log).alias("x")).select("model", "question", "x.*").write.json(at)
    return replayed(spark.read.schema(LOG).json(at), o.select(*key))


@register("SELECT c_custkey AS idx, c_name AS question, c_acctbal > 0 AS ground_truth, c_mktsegment AS type, 'n' || c_nationkey AS source FROM customer")
def s6_s11_questions_documents(spark, d):
    """Documents of a thousand questions each, written and read back."""
    at, source = files(spark), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    I.write_questions(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.col("c_name").alias("question"), (F.col("c_acctbal") > 0).alias("ground_truth"), F.col("c_mktsegment").alias("type"), source.alias("source")), at, 1000)
    return I.read_questions(spark, at)


@register("SELECT 'there' AS document, count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS letters FROM customer UNION ALL SELECT 'missing', 0, 0")
def s9_optional_documents(spark, d):
    """A document that is there and one that isn't, neither required."""
    at = files(spark)
    I.write_questions(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.col("c_name").alias("question"), F.lit(True).alias("ground_truth"), F.lit("t").alias("type"), F.lit("s").alias("source")), f"{at}/there", 1000)
    schema = StructType([StructField("queries", ArrayType(StructType([StructField("question", StringType())])))])
    one = lambda name: I.optional_json(spark, f"{at}/{name}", schema, required=False).select(F.explode("queries").alias("q")).agg(F.lit(name).alias("document"), F.count("*").alias("n"), F.coalesce(F.sum(F.length("q.question")), F.lit(0)).alias("letters"))
    return one("there").unionByName(one("missing"))


@register(f"WITH {REC} SELECT run_key, idx, question, is_correct, method FROM rec")
def s7_s11_results_document(spark, d):
    """Results documents of all runs, a thousand questions each, written and read back."""
    at, x = files(spark), records(spark, d).select("run_key", "idx", "question", "is_correct", "method")
    I.write_results(x, at, block=1000)
    return I.read_results(spark, at, StructType([StructField("idx", LongType()), StructField("question", StringType()), StructField("is_correct", BooleanType()), StructField("method", StringType())]))


@register("SELECT trim(c_name) AS question, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment || ', \"x\"' END AS category FROM customer WHERE c_custkey % 11 <> 0")
def s8_question_table(spark, d):
    """A CSV with blank questions, missing categories, quotes, commas and blanks around; written and read back."""
    at, k = files(spark), F.col("c_custkey")
    c = table(spark, d, "customer").select(F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("Question"), F.when(k % 3 != 0, F.concat("c_mktsegment", F.lit(', "x"'))).alias("Category"))
    c.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", None).csv(at)
    return I.read_question_table(spark, at)


@register(f"WITH {GEO} SELECT 'isa' AS part, child AS k, parent AS v FROM edges UNION ALL SELECT 'property', entity, prop FROM prop UNION ALL SELECT DISTINCT 'rule', event_type || ' happens', 'level_' || ((props->>'$.k')::INT % 20) FROM events WHERE event_type <> 'signup' AND (props->>'$.k')::INT % 20 < 12")
def s1_s5_s11_kb_document(spark, d):
    """The knowledge base as one document, written and read back."""
    at = files(spark)
    write_json(geography(spark, d), at)
    kb = read_json(spark, at)
    one = lambda df, name, k, v: df.select(F.lit(name).alias("part"), F.col(k).alias("k"), F.col(v).alias("v"))
    return one(kb.isa, "isa", "child", "parent").unionByName(one(kb.has_prop, "property", "entity", "prop")).unionByName(one(kb.rule, "rule", "condition", "consequence"))


LISTS = "p AS (SELECT p_partkey AS pl, lower(p_brand) AS k, lower(p_type) AS v, p_partkey % 2 AS half FROM part), o AS (SELECT k, v, min(pl) AS pl FROM p WHERE half = 0 GROUP BY k, v), n AS (SELECT k, v, min(pl) AS pl FROM p WHERE half = 1 GROUP BY k, v), m AS (SELECT k, v, 0 AS half, pl FROM o UNION ALL SELECT k, v, 1, pl FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.v = n.v))"


@register(f"WITH {LISTS} SELECT part, k, v, row_number() OVER (PARTITION BY part, k ORDER BY half, pl) AS place FROM m, (VALUES ('isa'), ('property'), ('rule')) t(part)")
def d7_extend_all_parts(spark, d):
    """Lists of all three parts with more items, in upper case, behind them; old and new keep their order."""
    from pyspark.sql import Window

    p = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("pos"), F.lower("p_brand").alias("k"), F.lower("p_type").alias("v"))
    old, new = p.where("pos % 2 = 0"), p.where("pos % 2 = 1").select("pos", F.upper("k").alias("k"), F.upper("v").alias("v"))
    names = (("isa", "child", "parent"), ("property", "entity", "prop"), ("rule", "condition", "consequence"))
    as_ = lambda df: [df.select(F.col("k").alias(a), "pos", F.col("v").alias(b)) for _, a, b in names]
    kb = extend(KnowledgeBase(*(x.groupBy(x.columns[0], x.columns[2]).agg(F.min("pos").alias("pos")) for x in as_(old))), *as_(new))
    out = [df.select(F.lit(n).alias("part"), F.col(a).alias("k"), F.col(b).alias("v"), "pos") for df, (n, a, b) in zip((kb.isa, kb.has_prop, kb.rule), names)]
    return G.combined(*out).withColumn("place", F.row_number().over(Window.partitionBy("part", "k").orderBy("pos")).cast("long")).drop("pos")


# ---------------------------------------------------------------- loose spellings, proofs, reports
@register("SELECT c_custkey, unnest(list_distinct(['there is ' || s || ' parts', 'there_is_' || s || '_parts', 'parts', 'there', 'there_' || s || '_parts', 'there is ' || s || ' part', 'there_is_' || s || '_part', 'part', 'theres', 'there_' || s || '_part'])) AS form FROM (SELECT c_custkey, lower(c_mktsegment) AS s FROM customer)")
def f11_loose_consequence_forms(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.explode(T.consequence_forms(F.concat(F.lit("There is "), "c_mktsegment", F.lit(" parts")), True)).alias("form"))


@register("SELECT c_custkey, unnest(list_distinct(['if it is ' || s, 'if_it_is_' || s, 'if   ' || s, 'if ' || s])) AS form FROM (SELECT c_custkey, lower(c_mktsegment) AS s FROM customer)")
def f13_loose_condition_forms(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.explode(T.condition_forms(F.concat(F.lit("If it is "), "c_mktsegment"), True)).alias("form"))


@register(f"""WITH {GEO}, reg AS (SELECT r_regionkey AS k, lower(r_name) AS other FROM region) SELECT c_custkey AS idx, CASE c_custkey % 5 WHEN 0 THEN 'BFS: ' || c || ' → ' || r || ' = True' WHEN 1 THEN 'BFS: ' || c || ' → ' || other || ' = False' WHEN 2 THEN 'BFS: ' || c || ' → ' || n || ' = True'
WHEN 3 THEN 'Entity not in KB: ghost' || c_custkey ELSE 'Property: ' || c || '.' || seg || ' = ' || CASE WHEN EXISTS (SELECT 1 FROM prop p WHERE p.entity = n AND p.prop = seg) THEN 'True' ELSE 'False' END END AS proof FROM cust JOIN reg ON (n_regionkey + 1) % 5 = k""")
def f18_proofs(spark, d):
    return V.validate(geo_questions(spark, d), geography(spark, d)).select("idx", "proof")


@register(f"WITH {RULES} SELECT event_id AS idx, CASE WHEN e = 'signup' THEN 'Condition not in KB: signup happens' ELSE 'Modus Ponens: ' || e || ' happens → level ' || k || CASE WHEN event_id % 2 = 1 THEN ' (neg=True) = ' ELSE ' (neg=False) = ' END || CASE WHEN (EXISTS (SELECT 1 FROM rules r WHERE r.e = ev.e AND r.k = ev.k)) <> (event_id % 2 = 1) THEN 'True' ELSE 'False' END END AS proof FROM ev")
def f18_rule_proofs(spark, d):
    return V.validate(event_questions(spark, d), geography(spark, d)).select("idx", "proof")


def geo_coverage(spark, d, closed=None) -> DataFrame:
    return V.coverage(geo_questions(spark, d).withColumn("category", F.lit("geography")).drop("type"), geography(spark, d), closed)


@register(f"WITH v AS ({GEO_VERDICT.replace(chr(39) + 'UNKNOWN' + chr(39), chr(39) + 'SHAKK' + chr(39))}) SELECT v.idx, epistemic_state, CASE WHEN v.idx % 5 = 4 THEN 'categorical' ELSE 'taxonomic' END AS pattern_type, question, 'geography' AS category FROM v JOIN ({GEO_ASKED}) q ON v.idx = q.idx WHERE covered")
def p5_covered_details(spark, d):
    return M.covered_details(geo_coverage(spark, d))


@register(f"""WITH {GEO}, v AS ({GEO_VERDICT}), x AS (SELECT idx, covered, epistemic_state AS e, CASE WHEN idx % 5 = 4 THEN 'categorical' ELSE 'taxonomic' END AS p FROM v), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE covered) AS c FROM x),
o AS (SELECT ord, o.p, count(x.p) AS n, count(*) FILTER (WHERE covered) AS c FROM (VALUES (0, 'taxonomic'), (1, 'categorical'), (2, 'hypothetical'), (3, 'other')) o(ord, p) LEFT JOIN x ON x.p = o.p GROUP BY ord, o.p)
SELECT '1 0' AS ord, printf('%-24s: %d', 'Questions', n) AS line FROM t UNION ALL SELECT '1 1', printf('%-24s: %d', 'Classes known', (SELECT count(DISTINCT child) FROM edges)) UNION ALL SELECT '1 2', printf('%-24s: %d (%.1f%%)', 'Covered', c, round(100.0 * c / n, 2)) FROM t
UNION ALL SELECT '1 3', printf('%-24s: %d (%.1f%%)', 'Not covered', n - c, round(100.0 * (n - c) / n, 2)) FROM t UNION ALL SELECT '2 ' || ord, printf('%-16s total=%4d covered=%3d (%.1f%%)', p, n, c, round(coalesce(100.0 * c / nullif(n, 0), 0), 1)) FROM o
UNION ALL SELECT printf('3 %019d', x.idx), printf('[%-6s] [%-12s] %s', replace(e, 'UNKNOWN', 'SHAKK'), p, question) FROM x JOIN ({GEO_ASKED}) q ON x.idx = q.idx WHERE covered""")
def r16_coverage_report(spark, d):
    """All lines of the report."""
    closed = closure(geography(spark, d).isa)
    return R.coverage_report(geo_coverage(spark, d, closed), closed.select("child").distinct())


@register(f"""WITH {OUT}, cm AS (SELECT run_key, {CM} FROM rec GROUP BY run_key), r AS (SELECT *, {RATES} FROM cm), ct AS (SELECT run_key, type, round(100.0 * (tp + tn) / total, 1) AS a FROM (SELECT run_key, type, {CM} FROM rec GROUP BY ALL)),
w AS (SELECT run_key, {_wide('a', '0.0')} FROM ct GROUP BY run_key), c AS (SELECT base_model || '_guarded' AS run_key, count(*) FILTER (WHERE outcome = 'intercepted') || '/' || count(*) FILTER (WHERE outcome IN ('intercepted', 'both_wrong')) AS caught FROM pairs GROUP BY 1)
SELECT r.run_key, "precision", recall, f1, accuracy AS overall, en, de, fr, xx, coalesce(caught, '0/0 (none)') AS caught FROM r JOIN w ON r.run_key = w.run_key LEFT JOIN c ON c.run_key = r.run_key""")
def r5_figures(spark, d):
    return R.figures(records(spark, d), ("en", "de", "fr", "xx"))


@register(f"""WITH {OUT}, n AS (SELECT base_model, count(*) FILTER (WHERE outcome = 'intercepted') AS i, count(*) FILTER (WHERE outcome = 'both_wrong') AS b FROM pairs GROUP BY 1), f AS (SELECT m, count(*) FILTER (WHERE coalesce(final_answer, false) AND NOT ground_truth) AS fp FROM rec WHERE guarded GROUP BY m)
SELECT ord, label, i + b AS llm_errors, i AS caught, CASE WHEN i + b > 0 THEN round(100.0 * i / (i + b), 1) ELSE 100.0 END AS rate, fp AS false_alarms FROM (VALUES (0, 'm1', 'Second'), (1, 'm0', 'First'), (2, 'm9', 'None')) o(ord, k, label) JOIN n ON base_model = k JOIN f ON m = k""")
def r11_interception_by_name(spark, d):
    return R.interception_by_name(records(spark, d), (("m1", "Second"), ("m0", "First"), ("m9", "None")))


@register(f"""WITH {GEO} SELECT 'taxonomies' AS part, count(DISTINCT child) AS n_keys, count(*) AS n_pairs FROM edges UNION ALL SELECT 'properties', count(DISTINCT entity), count(*) FROM prop UNION ALL SELECT 'conditionals', count(DISTINCT c), count(*) FROM (SELECT DISTINCT event_type AS c, (props->>'$.k')::INT % 20 AS k FROM events WHERE event_type <> 'signup' AND (props->>'$.k')::INT % 20 < 12)""")
def r7_kb_table(spark, d):
    return R.kb_table(geography(spark, d))


@register(f"""WITH {OUT}, cm AS (SELECT run_key, {CM} FROM rec GROUP BY run_key), r AS (SELECT *, {RATES} FROM cm), n AS (SELECT base_model, count(*) FILTER (WHERE outcome = 'intercepted') AS i, count(*) FILTER (WHERE outcome = 'false_alarm') AS f, count(*) FILTER (WHERE outcome = 'both_wrong') AS b FROM pairs GROUP BY 1)
SELECT '1 ' || run_key AS ord, rpad(run_key, 20, ' ') || printf(' %5.1f%% %5.1f%% %5.1f%% %5.1f%% %5.1f%%', "precision", recall, f1, accuracy, specificity) AS line FROM r
UNION ALL SELECT '2 ' || run_key || ' 0', printf('%-10s %6d  %-10s %6d', 'TP', tp, 'FN', fn) FROM cm UNION ALL SELECT '2 ' || run_key || ' 1', printf('%-10s %6d  %-10s %6d', 'FP', fp, 'TN', tn) FROM cm
UNION ALL SELECT '3 ' || base_model, printf('%-20s %d intercepted, %d false alarms, %5.1f%%', base_model, i, f, CASE WHEN i + b > 0 THEN round(100.0 * i / (i + b), 1) ELSE 100.0 END) FROM n""")
def r15_metrics_report(spark, d):
    return R.metrics_report(records(spark, d))


@register(f"SELECT row_number() OVER (ORDER BY ord) - 1 AS idx, line FROM ({SQL['r15_metrics_report']})")
def s12_report_lines(spark, d):
    """The report written in order with its manifest, and read back."""
    at = files(spark)
    I.write_report(R.metrics_report(records(spark, d)), at)
    return read_lines(spark, at)


def run_inputs(spark, d, at: str) -> dict[str, str]:
    """A knowledge base, questions and answers of two models in files."""
    q = geo_questions(spark, d).withColumn("ground_truth", F.col("idx") % 3 != 0).withColumn("source", F.lit("geography"))
    raw = F.element_at(F.array(*[F.lit(v) for v in REPLIES]), (F.col("idx") % 14 + 1).cast("int"))
    write_json(geography(spark, d), f"{at}/kb")
    I.write_questions(q, f"{at}/questions", 1000)
    q.withColumn("model", F.explode(F.array(F.lit("m0"), F.lit("m1")))).select("model", "question", F.when(F.col("model") == "m0", raw).alias("raw")).write.parquet(f"{at}/answers")
    return {"kb": f"{at}/kb", "questions": f"{at}/questions", "answers": f"{at}/answers"}


@register(f"SELECT idx, run_key, final_answer, method, is_correct FROM ({SQL['e1_e2_s10_p1_evaluation']})")
def x1_run_from_files(spark, d):
    """All steps by the runner, from a knowledge base, questions and answers in files; the second call has nothing left to do."""
    from claimforge.plans.run import run

    at = files(spark)
    inputs = run_inputs(spark, d, at)
    run(spark, f"{at}/out", ["validate", "metrics", "report"], **inputs)
    if again := run(spark, f"{at}/out", ["validate", "metrics", "report"], resume=True, **inputs):
        raise RuntimeError(f"done twice: {again}")
    return spark.read.parquet(f"{at}/out/records").select("idx", "run_key", "final_answer", "method", "is_correct")


@register(f"""WITH e AS ({SQL['e1_e2_s10_p1_evaluation']}), p AS (SELECT split_part(g.run_key, '_', 1) AS base_model, b.is_correct AS b, g.is_correct AS g FROM e b JOIN e g ON b.idx = g.idx AND b.run_key = replace(g.run_key, 'guarded', 'baseline') WHERE g.run_key LIKE '%guarded' AND g.run_key LIKE 'm0%')
SELECT base_model, count(*) FILTER (WHERE NOT b AND g) AS intercepted, count(*) FILTER (WHERE b AND NOT g) AS false_alarm, count(*) FILTER (WHERE b AND g) AS both_correct, count(*) FILTER (WHERE NOT b AND NOT g) AS both_wrong FROM p GROUP BY 1""")
def x2_command_line(spark, d):
    """The same by the command line, step by step, for one of the models."""
    from claimforge.plans.run import main

    at = files(spark)
    named = [x for k, v in run_inputs(spark, d, at).items() for x in (f"--{k}", v)]
    for step in ("validate", "metrics"):
        main(["--out", f"{at}/out", "--steps", step, "--models", "m0", *named])
    return spark.read.parquet(f"{at}/out/metrics").select("base_model", "intercepted", "false_alarm", "both_correct", "both_wrong")


# ---------------------------------------------------------------- registry by inventory
#: Which queries stand for which rows of the inventory; rows not named here are readers, writers or command lines, tested in tests/.
INVENTORY = {
    "G": ("g1_g4_closure_under_change", "g1_g4_what_a_change_does", "g1_reduction", "g2_reachability_by_labels", "g1_transitive_closure", "g2_reachability", "g3_property_inheritance", "g4_merge_new_pairs", "g5_kb_stats"),
    "X": ("x1_run_from_files", "x2_command_line"),
    "V": ("v8_first_spelling_decides", "s1_v4_built_in_questions", "v1_v2_v4_validate_geography", "v3_v8_validate_rules", "v5_validate_loose", "v6_v7_e1_e2_override", "v9_a11_coverage_by_pattern"),
    "F": ("f9_loose_properties", "f1_clean_question", "f2_f3_singular", "f4_predicate", "f5_taxonomic", "f6_categorical", "f7_f8_hypothetical", "f10_consequence_forms", "f12_condition_forms", "f14_f15_replies", "f11_loose_consequence_forms", "f13_loose_condition_forms", "f16_question_type", "f17_isa_fact", "f18_proofs", "f18_rule_proofs", "p7_p8_f19_run_selection", "r2_r9_f20_rates_table"),
    "A": ("a16_running_accuracy", "a1_confusion", "a2_rates", "a3_a4_per_type", "a5_a16_summary", "a6_caught_and_errors", "a7_a15_r4_interception", "a8_query_set_stats", "a9_type_counts", "a10_coverage_totals", "a12_r12_coverage_table", "a13_w2_running_coverage", "a14_j6_r13_deltas"),
    "J": ("u2_j5_kb_union", "j2_w1_last_wins_pairs", "r8_j4_o5_accuracy_table", "a14_j6_r13_deltas"),
    "W, O": ("w3_row_numbers", "j2_w1_last_wins_pairs", "a13_w2_running_coverage", "o1_o2_w3_first_of_files", "o3_first_intercepted", "p3_o4_blank_and_truncate"),
    "U": ("u1_union_all", "u2_j5_kb_union"),
    "R": ("r1_r10_confusion_block", "r2_r9_f20_rates_table", "r3_per_type_table", "r6_cross_model_table", "r8_j4_o5_accuracy_table", "r5_figures", "r7_kb_table", "r11_interception_by_name", "r15_metrics_report", "r16_coverage_report"),
    "S, P": ("s1_v4_built_in_questions", "s3_rejected_lines", "s4_large_lists", "s9_optional_documents", "s10_replayed_answers", "s12_report_lines", "s1_s5_s11_kb_document", "s2_s3_d10_theory_files", "s6_s11_questions_documents", "s7_s11_results_document", "s8_question_table", "p5_covered_details", "p8_unknown_keys", "s3_s4_theory_pairs", "s8_p3_question_rows", "e1_e2_s10_p1_evaluation", "p7_p8_f19_run_selection"),
    "D": ("d11_capped", "d1_d2_d3_theory_facts", "d4_d5_d6_theory_questions", "d7_extend_all_parts", "d8_mentions", "d9_generate_questions", "d11_not_yet_asked"),
}
