"""Text to propositions as column expressions: cleaning, singular forms, extraction, variants, answers.

Every function takes and returns columns, so Catalyst sees plain expressions; there is no Python on the executors. Regular
expressions are Unicode-aware. Nulls give nulls unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimforge.functions import constants as C

U = "(?U)"


def let(c: Column, f) -> Column:
    """f of a column that is computed once; without it, a column used n times is n copies of its expression."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def head(c: Column, most: int) -> Column:
    """The first characters, for a report."""
    return F.substring(c, 1, most)


def clean_question(q: Column) -> Column:
    """Lower case, stripped, then without question marks at the end; space before these stays."""
    return F.regexp_replace(strip(F.lower(strip(q))), r"\?+$", "")


def _lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), otherwise)


def singular(word: Column, loose: bool = False) -> Column:
    """Singular of a word by irregular forms, then endings in a fixed order; the first rule that fits decides."""
    table = {k: v for k, v in C.IRREGULAR.items() if not (loose and k in C.STRICT_ONLY_IRREGULAR)}

    def rules(w: Column) -> Column:
        n = F.length(w)
        drop = lambda k: F.substring(w, F.lit(1), n - k)
        rule = F.when(w.endswith("ies") & (n > 3), F.concat(drop(3), F.lit("y"))).when(w.endswith("ves") & (n > 3), F.concat(drop(3), F.lit("f"))).when((w.endswith("ses") | w.endswith("xes")) & (n > 3), drop(2))
        if not loose:
            rule = rule.when((w.endswith("ches") | w.endswith("shes")) & (n > 4), drop(2))
        rule = rule.when(w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us") & ~w.endswith("is"), drop(1)).otherwise(w)
        return _lookup(w, table, rule)

    return let(strip(F.lower(word)), rules)


def predicate(p: Column, loose: bool = False) -> Column:
    """A predicate of one or more words as a node's name."""
    return let(strip(F.lower(p)), lambda w: _lookup(w, C.PREDICATE_SYNONYMS, singular(w, loose)))


def taxonomic(q: Column, loose: bool = False) -> Column:
    """struct(lhs, rhs) of 'are all X (a) Y' or 'is X a Y'; nulls if it doesn't parse."""
    first, second = U + r"^are all (\w+)\s+(?:a\s+|an\s+)?([\w ]+)", U + r"^is\s+(\w+)\s+an?\s+([\w ]+)"

    def parts(t: Column) -> Column:
        get = lambda i: F.when(t.rlike(first), F.regexp_extract(t, first, i)).when(t.rlike(second), F.regexp_extract(t, second, i))
        return F.struct(get(1).alias("lhs"), let(strip(get(2)), lambda r: F.when(r != "", predicate(r, loose))).alias("rhs"))

    return let(clean_question(q), parts)


def categorical(q: Column) -> Column:
    """struct(lhs, rhs) of 'do all X have/need (a) Y'; nulls if it doesn't parse."""
    p = U + r"^do all (\w+)\s+(?:have|need)\s+(?:a\s+|an\s+|the\s+)?(.+)"

    def parts(t: Column) -> Column:
        get = lambda i: F.when(t.rlike(p), F.regexp_extract(t, p, i))
        return F.struct(get(1).alias("lhs"), let(strip(get(2)), lambda r: F.when(r != "", r)).alias("rhs"))

    return let(clean_question(q), parts)


def _once(c: Column, old: str, new: str) -> Column:
    """The first occurrence replaced."""
    return F.regexp_replace(c, rf"(?s)^(.*?){old}", "$1" + new)


def hypothetical(q: Column, loose: bool = False) -> Column:
    """struct(lhs, rhs, negated) of 'if X, (opening) Y' or 'if X then Y'; nulls if it doesn't parse."""
    opening = r"(?s)^(?:" + "|".join(C.LOOSE_OPENINGS if loose else C.OPENINGS) + r") (.*)$"

    def opened(rest: Column) -> Column:
        if loose:  # characters, not words, are stripped here: results must agree with the variant
            bare = strip(F.regexp_replace(F.regexp_replace(rest, r"^[no ]+", ""), r"^[not ]+", ""))
            negated = rest.rlike(r"^(?:no |not )")
        else:
            bare = strip(_once(_once(_once(_once(rest, "no ", ""), "not ", ""), " no ", " "), " not ", " "))
            negated = rest.rlike(r"^(?:no |not )| (?:no|not) ")
        return F.struct(F.when(negated, bare).otherwise(rest).alias("rhs"), negated.alias("negated"))

    def late(x: Column) -> Column:
        more = F.lit(False) if loose else ~x["negated"] & x["rhs"].rlike(r" (?:no|not) ")
        return F.struct(F.when(more, strip(_once(_once(x["rhs"], " no ", " "), " not ", " "))).otherwise(x["rhs"]).alias("rhs"), (x["negated"] | more).alias("negated"))

    def consequence(c: Column) -> Column:
        plain = F.struct(c.alias("rhs"), F.lit(False).alias("negated"))
        return let(F.when(c.rlike(opening), let(strip(F.regexp_extract(c, opening, 1)), opened)).otherwise(plain), late)

    def halves(after: Column) -> Column:
        at = F.when(F.instr(after, "then") > 0, F.instr(after, "then")).when(F.instr(after, ",") > 0, F.instr(after, ","))
        width = F.when(F.instr(after, "then") > 0, F.lit(4)).otherwise(F.lit(1))
        lhs, rhs = strip(F.substring(after, F.lit(1), at - 1)), strip(F.substring(after, at + width, F.length(after)))
        return F.struct(lhs.alias("lhs"), let(rhs, consequence).alias("c"))

    def checked(x: Column) -> Column:
        ok = (x["lhs"] != "") & (x["c"]["rhs"] != "")
        return F.struct(F.when(ok, x["lhs"]).alias("lhs"), F.when(ok, x["c"]["rhs"]).alias("rhs"), F.coalesce(x["c"]["negated"], F.lit(False)).alias("negated"))

    after = lambda t: F.when(F.instr(t, "if") > 0, strip(F.substring(t, F.instr(t, "if") + 2, F.length(t))))
    return let(let(let(clean_question(q), after), halves), checked)


def _distinct(forms: list[Column]) -> Column:
    return F.array_remove(F.array_distinct(F.array(*forms)), "")


def consequence_forms(c: Column, loose: bool = False) -> Column:
    """All spellings under which a consequence may be in the knowledge base, each with its singular or plural twin."""
    def base(c: Column) -> Column:
        words = F.filter(F.split(c, U + r"\s+"), lambda w: w != "")
        drop = lambda *old: strip(reduce(lambda x, o: F.replace(x, F.lit(o), F.lit("")), old, c))
        forms = [c, F.replace(c, F.lit(" "), F.lit("_")), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), drop("do we need an ", "do we need "), drop("does it ", "is it ")]
        if not loose:
            forms.append(drop("there "))
        forms.append(F.array_join(F.filter(words, lambda w: ~w.isin(*C.STOP_WORDS)), "_"))
        return _distinct(forms)

    plural = lambda v: v.endswith("s") & ~v.endswith("ss") & ~v.endswith("us") & ~v.endswith("is")
    twin = lambda v: F.when(plural(v), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(F.concat(v, F.lit("s")))
    return let(let(strip(F.lower(c)), base), lambda forms: F.array_remove(F.array_union(forms, F.transform(forms, twin)), ""))


def condition_forms(c: Column, loose: bool = False) -> Column:
    """All spellings under which a condition may be in the knowledge base."""
    def forms(c: Column) -> Column:
        drop = lambda old: strip(F.replace(c, F.lit(old), F.lit("")))
        some = [c, F.replace(c, F.lit(" "), F.lit("_")), strip(F.regexp_replace(c, U + r"\b(?:is|are|the|it|there)\b", "")), drop("it is "), drop("there is ")]
        return _distinct(some if loose else [*some, drop("there are "), drop("if ")])

    return let(strip(F.lower(c)), forms)


def tidy_reply(raw: Column) -> Column:
    """A model's reply as yes, no, or its first 50 characters; null (no reply) is an error."""
    t = strip(F.lower(raw))
    head = F.substring(t, 1, 20)
    out = F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no").when(F.contains(head, F.lit("yes")), "yes").when(F.contains(head, F.lit("no")), "no").otherwise(F.substring(t, 1, 50))
    return F.coalesce(out, F.lit(C.ERROR_REPLY))


def yes_no(raw: Column) -> Column:
    """A reply as true, false or null if it is empty, an error or unclear."""
    t = strip(F.lower(raw))
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
    pos, neg = some(C.POSITIVE), some(C.NEGATIVE)
    decided = F.when(t.startswith("yes") | t.isin(*C.YES_EXACT), True).when(t.startswith("no") | t.isin(*C.NO_EXACT), False).when(pos & ~neg, True).when(neg & ~pos, False)
    return F.when((raw != "") & (raw != C.ERROR_REPLY), decided)


def question_type(q: Column) -> Column:
    """taxonomic, categorical, hypothetical or other, by patterns in this order."""
    t = strip(F.lower(q))
    has = lambda s: F.contains(t, F.lit(s))
    return (
        F.when(t.rlike(U + r"^are all \w+") | t.rlike(U + r"^is \w+ an? \w+"), "taxonomic")
        .when(t.rlike(U + r"^do all \w+ (have|need)"), "categorical")
        .when(has("if") & (has(",") | has("then") | has("does")), "hypothetical")
        .otherwise("other")
    )


def isa_fact(sentence: Column, least: int) -> Column:
    """struct(child, parent) of 'X is a Y.' with letters only and words of at least so many; nulls if it doesn't parse."""
    t = F.regexp_replace(strip(F.lower(sentence)), r"\.+$", "")
    p = U + r"^(\w+)\s+is\s+an?\s+(\w+)"
    a, b = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    ok = a.rlike(r"^\p{L}+$") & b.rlike(r"^\p{L}+$") & (F.length(a) >= least) & (F.length(b) >= least)
    return F.struct(F.when(ok, a).alias("child"), F.when(ok, b).alias("parent"))
