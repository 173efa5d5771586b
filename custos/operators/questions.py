"""Question classification (T1), target extraction (T2) and evidence plans
as column expressions over a questions table - a narrow, shuffle-free select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed

# Java's \w and \b are ASCII unless (?U); Python's are Unicode.
_URN_RE = "(?U)" + fixed.URN_PATTERN
_NAME_RE = "(?U)" + fixed.NAME_PATTERN


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _hit(low: Column, keyword: str) -> Column:
    return (F.instr(low, keyword) > 0).cast("int")


def intent_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``ranked``: per-intent (score, -rule order, intent) structs sorted
    best first. Keyword hits are plain integer sums of ``instr`` tests (cheap,
    codegen-friendly); the ranking is computed once, in its own projection."""
    low = F.lower(F.col(text))
    scored = []
    for order, (intent, keywords, excludes, weight) in enumerate(fixed.INTENT_RULES):
        hits = sum((_hit(low, k) for k in keywords), F.lit(0))
        if excludes:
            excluded = sum((_hit(low, k) for k in excludes), F.lit(0)) > 0
            hits = F.when(excluded, F.lit(0)).otherwise(hits)
        scored.append(F.struct((hits * weight).alias("score"), F.lit(-order).alias("neg_order"),
                               F.lit(intent).alias("intent")))
    ranked = F.reverse(F.array_sort(F.filter(F.array(*scored), lambda s: s["score"] > 0)))
    return df.select("*", ranked.alias("ranked"))


def intent_columns(ranked: Column, text: Column) -> dict[str, Column]:
    """Intent, confidence and reason from the ranked scores of a (stripped) question."""
    best = F.try_element_at(ranked, F.lit(1))
    runner = F.coalesce(F.try_element_at(ranked, F.lit(2))["score"], F.lit(0))
    has = F.size(ranked) > 0
    blank = text.isNull()
    low = F.lower(text)
    # keywords of the winning intent that occur, in sorted order
    matched = None
    for intent, keywords, _excl, _w in fixed.INTENT_RULES:
        hits = F.filter(_lit_array(sorted(keywords)), lambda k: F.instr(low, k) > 0)
        matched = (F.when(best["intent"] == intent, hits) if matched is None
                   else matched.when(best["intent"] == intent, hits))
    intent = F.when(blank | ~has, F.lit("unknown")).otherwise(best["intent"])
    confident = F.when(blank | ~has, F.lit(False)).otherwise((best["score"] >= 2) & (best["score"] > runner))
    reason = (F.when(blank, F.lit("Empty question."))
              .when(~has, F.lit("No governance keywords matched."))
              .otherwise(F.concat(F.lit("Matched '"), F.array_join(matched, ", "),
                                  F.lit("' → "), best["intent"], F.lit("."))))
    return {"intent": intent, "confident": confident, "reason": reason}


def target_columns(text: Column) -> dict[str, Column]:
    """First URN in the question, else the first dotted / snake_case token whose
    head is not a stop word."""
    urn = F.nullif(F.regexp_extract(text, _URN_RE, 0), F.lit(""))
    cands = F.regexp_extract_all(F.lower(text), F.lit(_NAME_RE), 1)
    stop = _lit_array(fixed.NAME_STOPWORDS)
    ok = F.filter(cands, lambda c: ~F.array_contains(stop, F.substring_index(c, ".", 1))
                  & ((F.instr(c, "_") > 0) | (F.instr(c, ".") > 0)))
    name = F.when(urn.isNull(), F.try_element_at(ok, F.lit(1)))
    return {"target_urn": F.when(text.isNotNull(), urn), "target_name": F.when(text.isNotNull(), name)}


def plan_nodes(intent: Column, has_target: Column) -> Column:
    """Ordered node list for an intent; lineage before risk when a target is
    named; recommendation appended for the recommending intents."""
    base = None
    for k, nodes in fixed.INTENT_NODES.items():
        base = (F.when(intent == k, _lit_array(nodes)) if base is None
                else base.when(intent == k, _lit_array(nodes)))
    base = base.otherwise(_lit_array(fixed.INTENT_NODES["unknown"]))
    with_lineage = F.when(
        has_target & ~F.array_contains(base, "lineage") & F.array_contains(base, "risk"),
        F.array_insert(base, F.array_position(base, "risk").cast("int"), F.lit("lineage"))).otherwise(base)
    return F.when(intent.isin(*fixed.RECOMMEND_FOR) & ~F.array_contains(with_lineage, "recommendation"),
                  F.concat(with_lineage, F.array(F.lit("recommendation")))).otherwise(with_lineage)


def classify_questions(questions: DataFrame) -> DataFrame:
    """Intent, confident, reason, target, plan - three narrow projections."""
    q = questions.select("question_id", C.clean_text("question").alias("text"))
    q = intent_scores(q)
    ic = intent_columns(F.col("ranked"), F.col("text"))
    tc = target_columns(F.col("text"))
    q = q.select("question_id", "text", *[v.alias(k) for k, v in {**ic, **tc}.items()])
    has_target = F.col("target_urn").isNotNull() | F.col("target_name").isNotNull()
    return q.select("*", F.array_join(plan_nodes(F.col("intent"), has_target), ",").alias("plan"))


def question_intent(questions: DataFrame) -> DataFrame:
    return classify_questions(questions).select("question_id", "intent", "confident", "reason")


def question_target(questions: DataFrame) -> DataFrame:
    return classify_questions(questions).select("question_id", "target_urn", "target_name")


def question_plan(questions: DataFrame) -> DataFrame:
    return classify_questions(questions).select("question_id", "intent", "plan")
