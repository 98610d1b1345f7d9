"""Matching postings to scoring rules, the score, and the reasons for it.

Rules are a table; ``functions/terms.py`` says what a row means. Up to
``MOST_COMPILED`` rules become column expressions, so matching and scoring need
no join and no shuffle at all. A larger table is joined on whole phrases; the
result is the same. Rules with conditions are always expressions, so there may
be ``MOST_COMPILED`` of them at most.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rolesift.functions import text as X

TEXT_FIELDS = ["title", "location", "description"]
FIELDS = [*TEXT_FIELDS, "years"]
KINDS = ["role", "location", "penalty"]
# Measured: about where the join overtakes one projection per rule.
MOST_COMPILED = 100
MOST_BROADCAST = 100_000
MOST_BROADCAST_BYTES = 64 << 20
MOST_YEARS_RULES = 1000
HITS = "array<struct<rule_id:string,kind:string,weight:bigint>>"


def _alternatives(text: Column) -> Column:
    """The normalised phrases between the bars; a leading "=" is kept."""

    def phrase(part: Column) -> Column:
        words = F.trim(X.normalised(part))
        return F.when(part.startswith("="), F.concat(F.lit("="), words)).otherwise(words)

    return F.transform(F.split(text, r"\|"), phrase)


def _clean(rules: DataFrame) -> DataFrame:
    """Rules with lists of fields and normalised phrases; a rule that cannot be
    applied is an error."""
    years = F.col("term").try_cast("int")
    fields = F.split("field", r"\|")
    on_years = F.array_contains(fields, "years")
    known = F.coalesce(
        F.col("kind").isin(KINDS)
        & F.forall(fields, lambda f: f.isin(FIELDS))
        & F.col("weight").isNotNull()
        & F.col("rule_id").isNotNull()
        & (~on_years | ((F.size(fields) == 1) & (years >= 0))),
        F.lit(False),
    )
    message = F.concat(F.lit("cannot apply rule "), F.coalesce("rule_id", F.lit("null")))

    def condition(name: str) -> Column:
        given = F.col(name) if name in rules.columns else F.lit(None).cast("string")
        return F.when(~on_years, _alternatives(given)).alias(name)

    return rules.select(
        F.when(known, F.col("rule_id")).otherwise(F.raise_error(message)).alias("rule_id"),
        "kind",
        fields.alias("fields"),
        F.when(on_years, F.array(years.cast("string")))
        .otherwise(_alternatives(F.col("term")))
        .alias("terms"),
        F.col("weight").cast("long").alias("weight"),
        condition("unless"),
        condition("requires"),
    )


def _check_ids(rules: int, ids: int) -> None:
    if ids < rules:
        raise ValueError("rule ids must be unique")


def few_rules(rules: DataFrame, most: int = MOST_COMPILED) -> list[Row] | None:
    """The rules as driver rows, or None if there are more than ``most``. At
    most ``most + 1`` rows are ever fetched."""
    rows = _clean(rules).limit(most + 1).collect()
    if len(rows) > most:
        return None
    _check_ids(len(rows), len({r.rule_id for r in rows}))
    return sorted(rows, key=lambda r: r.rule_id)


def _flagged(postings: DataFrame, rules: list[Row]) -> tuple[DataFrame, list[str]]:
    """One boolean column per rule."""
    inputs = {f"_{field}": X.lowered(F.col(field)) for field in TEXT_FIELDS}
    inputs["_years"] = X.years_required(F.col("description"))

    def flag(rule: Row) -> Column:
        if rule.fields == ["years"]:
            return F.coalesce(F.col("_years") >= int(rule.terms[0]), F.lit(False))
        conditions = (rule.terms, rule.unless, rule.requires)
        return reduce(or_, [X.rule_holds(F.col(f"_{f}"), *conditions) for f in rule.fields])

    flags = {f"_rule_{i}": flag(rule) for i, rule in enumerate(rules)}
    return postings.withColumns(inputs).withColumns(flags).drop(*inputs), list(flags)


def _compiled_score(rules: list[Row], flags: list[str]) -> Column:
    weights = {
        kind: [F.when(F.col(f), r.weight) for f, r in zip(flags, rules) if r.kind == kind]
        for kind in KINDS
    }
    none = F.lit(0).cast("long")
    best = [
        F.coalesce(F.greatest(*found, F.lit(None)), none)
        for found in (weights["role"], weights["location"])
        if found
    ]
    return reduce(add, [*best, *[F.coalesce(w, none) for w in weights["penalty"]]], none)


def _hit(rule: Row) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.weight).cast("long").alias("weight"),
    )


def score_postings(
    postings: DataFrame,
    rules: DataFrame,
    most_compiled: int = MOST_COMPILED,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """``postings`` plus ``score`` and ``matched_rules``: the result of
    ``match_rules``, ``score`` and ``explain_score`` together. With a rules
    table of usual size this is one projection over the input."""
    few = few_rules(rules, most_compiled)
    if few is None:
        return _scored_from_found(_with_found(postings, rules, most_broadcast))
    flagged, flags = _flagged(postings, few)
    reasons = [F.when(F.col(f), r.rule_id) for f, r in zip(flags, few)]
    return flagged.withColumns(
        {
            "score": _compiled_score(few, flags),
            "matched_rules": F.concat_ws(",", *reasons),
        }
    ).drop(*flags)


def match_rules(
    postings: DataFrame,
    rules: DataFrame,
    most_compiled: int = MOST_COMPILED,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """``posting_id, rule_id, kind, weight``: one row per posting and rule that
    holds for it, and one row of nulls for a posting without any."""
    few = few_rules(rules, most_compiled)
    if few is None:
        return (
            _with_found(postings, rules, most_broadcast)
            .select("posting_id", F.explode_outer("found").alias("hit"))
            .select("posting_id", "hit.rule_id", "hit.kind", "hit.weight")
        )
    flagged, flags = _flagged(postings, few)
    values = list(map(_hit, few))
    # The numbers of the rules that hold, or one empty text if none does. Made
    # of plain functions, so nothing leaves generated code.
    numbers = F.split(
        F.concat_ws(",", *[F.when(F.col(f), str(i)) for i, f in enumerate(flags, 1)]), ","
    )
    rule = F.try_element_at(F.array(*values).cast(HITS), F.col("number").try_cast("int"))
    return (
        flagged.select("posting_id", F.explode(numbers).alias("number"))
        .select("posting_id", rule.alias("hit"))
        .select("posting_id", "hit.rule_id", "hit.kind", "hit.weight")
    )


def _words(postings: DataFrame, thresholds: list[int]) -> DataFrame:
    """``posting_id, _content, field, words, pos, word``: every word of every
    text field with its place. "At least n years" becomes words as well: those
    of the rules' thresholds that the posting reaches."""
    words = {f: F.split(F.trim(X.normalised(F.col(f))), " ") for f in TEXT_FIELDS}
    reached = F.array(*map(F.lit, thresholds)).cast("array<int>")
    words["years"] = F.filter(
        reached, lambda n: F.coalesce(n <= F.col("_years"), F.lit(False))
    ).cast("array<string>")
    texts = F.array(
        *[F.struct(F.lit(f).alias("field"), w.alias("words")) for f, w in words.items()]
    )
    return (
        postings.withColumn("_years", X.years_required(F.col("description")))
        .select("posting_id", "_content", F.explode(texts).alias("text"))
        .select(
            "posting_id",
            "_content",
            "text.field",
            "text.words",
            F.posexplode("text.words").alias("pos", "word"),
        )
    )


def _content() -> Column:
    """128 bits that stand for the texts of a posting, which the rules read with
    null as empty. (A hash of nullable columns would skip the nulls.)"""
    texts = [F.coalesce(F.col(f), F.lit("")) for f in TEXT_FIELDS]
    return F.struct(
        F.xxhash64(F.lit(1), *texts).alias("a"), F.xxhash64(F.lit(2), *texts).alias("b")
    )


def _with_found(postings: DataFrame, rules: DataFrame, most_broadcast: int) -> DataFrame:
    """``postings`` plus ``found``, the set of rules that hold, for any number
    of rules: the phrases of each posting meet the rules in an equi-join on
    (field, term). Rows with the same id and texts are matched once."""
    names = postings.columns
    postings = postings.withColumn("_content", _content())
    cleaned = _clean(rules)
    plain = F.col("unless").isNull() & F.col("requires").isNull()
    conditional = cleaned.filter(~plain).limit(MOST_COMPILED + 1).collect()
    if len(conditional) > MOST_COMPILED:
        raise ValueError(f"more than {MOST_COMPILED} rules have conditions")
    ids = cleaned.agg(F.count("*").alias("n"), F.count_distinct("rule_id").alias("ids")).first()
    _check_ids(ids.n, ids.ids)
    rules = cleaned.filter(plain).select(
        "rule_id", "kind", "weight", "terms", F.explode("fields").alias("field")
    )
    rules = rules.select("rule_id", "kind", "weight", "field", F.explode("terms").alias("term"))
    length = F.size(F.split("term", " "))
    # One row: the thresholds of years, and the size of the table.
    facts = rules.agg(
        F.collect_set(F.when(F.col("field") == "years", F.col("term").cast("int"))).alias("years"),
        F.count("*").alias("n"),
        F.sum(F.octet_length("term") + F.octet_length("rule_id") + 64).alias("bytes"),
    ).first()
    if len(facts.years) > MOST_YEARS_RULES:
        raise ValueError(f"more than {MOST_YEARS_RULES} thresholds of years")
    rules = rules.filter(F.col("term") != "")
    # Phrases are only built where a rule's first word stands.
    starts = rules.select(
        "field", F.split("term", " ")[0].alias("word"), length.alias("n")
    ).distinct()
    if facts.n <= most_broadcast and (facts.bytes or 0) <= MOST_BROADCAST_BYTES:
        starts, rules = F.broadcast(starts), F.broadcast(rules)
    # Beyond that both are joined by key; a common word is a hot key of the
    # left side, which adaptive execution splits.
    placed = _words(postings, sorted(facts.years)).join(starts, ["field", "word"])
    held = placed.filter(F.col("pos") + F.col("n") <= F.size("words")).select(
        "posting_id",
        "_content",
        "field",
        F.array_join(F.slice("words", F.col("pos") + 1, F.col("n")), " ").alias("term"),
    )
    matches = held.join(rules, ["field", "term"])
    # A set: a phrase may stand in a text more than once. It is bounded by the
    # rules that hold, and combined before the shuffle.
    found = matches.groupBy("posting_id", "_content").agg(
        F.collect_set(F.struct("rule_id", "kind", "weight")).alias("found")
    )
    # Joined on a key of its own, so that the join has its own shuffle and
    # adaptive execution can split a posting that occurs very often.
    key = F.xxhash64("posting_id", "_content").alias("_key")
    joined = (
        postings.select("*", key)
        .alias("p")
        .join(
            found.select(
                F.col("posting_id").alias("_id"), F.col("_content").alias("_same"), "found", key
            ).alias("f"),
            (F.col("p._key") == F.col("f._key"))
            & F.col("p.posting_id").eqNullSafe(F.col("_id"))
            & (F.col("p._content") == F.col("_same")),
            "left",
        )
        .select(*[F.col(f"p.{c}") for c in names], "found")
    )
    if not conditional:
        return joined
    flagged, flags = _flagged(joined, conditional)
    none = F.array().cast(HITS)
    hits = F.array(*[F.when(F.col(f), _hit(r)) for f, r in zip(flags, conditional)])
    found = F.concat(F.coalesce("found", none), F.array_compact(hits).cast(HITS))
    return flagged.withColumn("found", F.when(F.size(found) > 0, found)).drop(*flags)


def _scored_from_found(df: DataFrame) -> DataFrame:
    def weights(kind: str) -> Column:
        of_kind = F.filter("found", lambda rule: rule["kind"] == kind)
        return F.transform(of_kind, lambda rule: rule["weight"])

    none = F.lit(0).cast("long")
    penalty = F.aggregate(weights("penalty"), none, lambda total, weight: total + weight)
    parts = [F.array_max(weights("role")), F.array_max(weights("location")), penalty]
    ids = F.array_sort(F.transform("found", lambda rule: rule["rule_id"]))
    return df.withColumns(
        {
            "score": reduce(add, [F.coalesce(p, none) for p in parts]),
            "matched_rules": F.coalesce(F.array_join(ids, ","), F.lit("")),
        }
    ).drop("found")


def score(matches: DataFrame) -> DataFrame:
    """``posting_id, score``: the best role plus the best location plus every
    penalty, in one aggregation. One posting per id: take ``latest`` first
    where ids repeat, or use ``score_postings``, which goes row by row."""
    weight = F.col("weight").cast("long")
    of_kind = {kind: F.when(F.col("kind") == kind, weight) for kind in KINDS}
    none = F.lit(0).cast("long")
    parts = [F.max(of_kind["role"]), F.max(of_kind["location"]), F.sum(of_kind["penalty"])]
    total = reduce(add, [F.coalesce(p, none) for p in parts])
    return matches.groupBy("posting_id").agg(total.alias("score"))


def explain_score(matches: DataFrame) -> DataFrame:
    """``posting_id, matched_rules``: the rule ids, sorted and comma-joined. A
    set, so its size is bounded by the rules table."""
    ids = F.sort_array(F.collect_set("rule_id"))
    return matches.groupBy("posting_id").agg(F.concat_ws(",", ids).alias("matched_rules"))
