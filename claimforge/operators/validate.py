"""Validation of questions against a knowledge base: parse, look up, decide. Joins and column expressions only.

Look-ups are left equi-joins with distinct keys, so a row of questions stays one row; small knowledge bases are broadcast by Spark
by their size. Rules are met by exploding a question's condition spellings, at most seven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions import constants as C
from claimforge.functions import text as T
from claimforge.operators.closure import closure, inherited
from claimforge.sources.kb import KnowledgeBase


def parsed(questions: DataFrame, loose: bool = False) -> DataFrame:
    """questions (question, type) with lhs, rhs, negated: the proposition by the question's type, nulls if it doesn't parse."""
    q, kind = F.col("question"), F.col("type")
    none = F.lit(None).cast("string")
    out = questions.withColumn("p_", F.when(kind == "taxonomic", F.struct(*[T.taxonomic(q, loose)[c].alias(c) for c in ("lhs", "rhs")], F.lit(False).alias("negated"))).when(kind == "categorical", F.struct(*[T.categorical(q)[c].alias(c) for c in ("lhs", "rhs")], F.lit(False).alias("negated"))).when(kind == "hypothetical", T.hypothetical(q, loose)))
    ok = F.col("p_.lhs").isNotNull() & F.col("p_.rhs").isNotNull()
    return out.select(*questions.columns, F.when(ok, F.col("p_.lhs")).otherwise(none).alias("lhs"), F.when(ok, F.col("p_.rhs")).otherwise(none).alias("rhs"), F.when(ok, F.col("p_.negated")).alias("negated"))


def _word(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def rule_verdicts(pairs: DataFrame, rule: DataFrame, loose: bool = False, first: bool = False) -> DataFrame:
    """Distinct pairs (lhs, rhs) whose condition heads a rule, with fired (some spelling of both is a rule) and known.

    Any pair of spellings decides, so results don't depend on an order of spellings; with first, the first spelling of the condition (in the order of
    `condition_forms`) that heads a rule decides alone, and what later ones say doesn't count. A condition's rules are never one row: its
    spellings meet the heads first, and only what is left meets the rules, spelling by spelling.
    """
    heads = rule.select("condition").where("condition is not null").distinct()
    forms = pairs.select("lhs", "rhs", F.posexplode(T.condition_forms(F.col("lhs"), loose)).alias("rank", "condition")).join(heads, "condition")
    spelled = forms.select("lhs", "rhs", "rank", "condition", F.explode(T.consequence_forms(F.col("rhs"), loose)).alias("consequence"))
    facts = rule.select("condition", "consequence").distinct().withColumn("fact", F.lit(True))
    met = spelled.join(facts, ["condition", "consequence"], "left")
    hit = F.coalesce("fact", F.lit(False))
    fired = F.max(F.struct(-F.col("rank"), hit.alias("fired")))["fired"] if first else F.bool_or(hit)  # false sorts before true
    return met.groupBy("lhs", "rhs").agg(fired.alias("fired"), F.lit(True).alias("known"))


def _kinds(questions: DataFrame) -> tuple[bool, bool]:
    """Whether there are questions about the graph, and about rules: one pass over the types."""
    some = lambda *kinds: F.coalesce(F.bool_or(F.col("type").isin(*kinds)), F.lit(False))
    return tuple(questions.agg(some("taxonomic", "categorical"), some("hypothetical")).first())


def _with_graph(q: DataFrame, kb: KnowledgeBase, closed: DataFrame, loose: bool) -> DataFrame:
    """q with is_node, has_own (of the subject), raw_node (the subject as it stands is a node), fact and raw_fact: what the graph says."""
    nodes = closed.select(F.col("child").alias("node")).distinct()
    entities = kb.has_prop.select(F.col("entity").alias("node")).distinct()
    subjects = nodes.withColumn("is_node", F.lit(True)).join(entities.withColumn("has_own", F.lit(True)), "node", "full")
    q = q.join(subjects.withColumnRenamed("node", "subject_"), "subject_", "left")
    q = q.join(nodes.select(F.col("node").alias("lhs"), F.lit(True).alias("raw_node")), "lhs", "left")
    up = closed.select(F.col("child").alias("subject_"), F.col("ancestor").alias("goal_"), F.lit("taxonomic").alias("type"))
    have = inherited(kb.has_prop, closed)
    spelled = have.where(~(F.contains("prop", F.lit(" ")) & F.contains("prop", F.lit("_")))).select(F.col("entity").alias("subject_"), F.replace("prop", F.lit(" "), F.lit("_")).alias("goal_"), F.lit("categorical").alias("type"))
    facts = up.unionByName(spelled).distinct().withColumn("fact", F.lit(True))
    q = q.join(facts, ["subject_", "goal_", "type"], "left")
    if not loose:
        return q.withColumn("raw_fact", F.lit(None).cast("boolean"))
    return q.join(have.select(F.col("entity").alias("subject_"), F.col("prop").alias("raw_"), F.lit(True).alias("raw_fact")).distinct(), ["subject_", "raw_"], "left")


def validate(questions: DataFrame, kb: KnowledgeBase, closed: DataFrame | None = None, loose: bool = False, first: bool = False) -> DataFrame:
    """questions (idx unique, question, type, ...) with graph_answer, epistemic_state, proof and covered.

    A question is covered if the knowledge base can say yes or no to it: its subject is a child of isa (taxonomic), or has
    properties itself (categorical), or its condition heads a rule (hypothetical). loose gives the variant with fewer spellings, property
    synonyms and the label SHAKK. first: see `rule_verdicts`. Null questions and unknown types are uncovered. closed: the closure of kb.isa, if at hand.
    """
    graph, rules = _kinds(questions)
    q = parsed(questions, loose)
    kind, no = F.col("type"), F.lit(None).cast("boolean")
    tax, cat, hyp = kind == "taxonomic", kind == "categorical", kind == "hypothetical"
    raw = T.strip(F.lower(F.col("rhs")))
    plain = F.replace(raw, F.lit(" "), F.lit("_"))
    prop = T._lookup(raw, C.PROPERTY_SYNONYMS, plain) if loose else plain
    q = q.withColumn("subject_", T.singular(F.col("lhs"), loose)).withColumn("goal_", F.when(tax, T.singular(F.col("rhs"), loose)).when(cat, prop)).withColumn("raw_", F.when(cat, raw))
    if graph:
        q = _with_graph(q, kb, closure(kb.isa) if closed is None else closed, loose)
    else:
        q = q.withColumns(dict.fromkeys(("is_node", "has_own", "raw_node", "fact", "raw_fact"), no))
    if rules:
        fired = rule_verdicts(q.where(hyp & F.col("lhs").isNotNull()).select("lhs", "rhs").distinct(), kb.rule, loose, first)
        q = q.join(fired.withColumn("type", F.lit("hypothetical")), ["lhs", "rhs", "type"], "left")
    else:
        q = q.withColumns({"fired": no, "known": no})
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = F.col("lhs").isNotNull()
    covered = ok & F.when(tax, yes("is_node") | yes("raw_node")).when(cat, yes("is_node") | yes("has_own")).when(hyp, yes("known")).otherwise(False)
    answer = F.when(tax, (F.col("subject_") == F.col("goal_")) | yes("fact")).when(cat, yes("fact") | yes("raw_fact")).when(hyp, F.col("fired") != F.col("negated"))
    q = q.withColumn("covered", F.coalesce(covered, F.lit(False))).withColumn("graph_answer", F.when(F.col("covered"), answer))
    unknown = C.UNKNOWN_LOOSE if loose else C.UNKNOWN
    state = F.when(F.col("graph_answer"), C.CERTAIN).when(~F.col("graph_answer"), C.DENIED).otherwise(unknown)
    a = _word(F.col("graph_answer"))
    subject = F.col("subject_")
    proof = (
        F.when(~F.coalesce(kind.isin(*C.TYPES), F.lit(False)), "Unknown type")
        .when(~ok, F.concat(F.lit("Parse failed: "), F.coalesce(T.strip(F.col("question")), F.lit(""))))
        .when(hyp & ~F.col("covered"), F.concat(F.lit("Condition not in KB: "), F.col("lhs")))
        .when(~F.col("covered"), F.concat(F.lit("Entity not in KB: "), subject))
        .when(tax, F.concat(F.lit("BFS: "), subject, F.lit(" → "), F.col("rhs"), F.lit(" = "), a))
        .when(cat, F.concat(F.lit("Property: "), subject, F.lit("."), F.col("rhs"), F.lit(" = "), a))
        .otherwise(F.concat(F.lit("Modus Ponens: "), F.col("lhs"), F.lit(" → "), F.col("rhs"), F.lit(" (neg="), _word(F.col("negated")), F.lit(") = "), a))
    )
    return q.select(*questions.columns, "graph_answer", state.alias("epistemic_state"), proof.alias("proof"), "covered")


def coverage(questions: DataFrame, kb: KnowledgeBase, closed: DataFrame | None = None, loose: bool = True) -> DataFrame:
    """Coverage records of free questions (idx, question, category): their type is found by patterns, no model is asked."""
    typed = questions.withColumn("type", T.question_type(F.col("question")))
    out = validate(typed, kb, closed, loose)
    return out.select("idx", "question", "category", F.col("type").alias("pattern_type"), "covered", "epistemic_state", "graph_answer")
