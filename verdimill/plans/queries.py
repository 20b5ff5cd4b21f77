"""All queries of the engine: QUERIES by name, ORACLE with the same rows in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..engine import Engine, EngineConfig
from ..functions import dist, text
from ..operators import cache, calibrate, combine, compact, funnel, gate, heads, metrics, pick, rank, runs, validate, verdicts
from ..questions import Choice, Condition, Noul, QuestionSet, Template
from ..scorers import HashScorer, hash_answer, hash_answers, hash_weight, score
from .base import FLAGS, MATCHES, TRIAGE, answered, h, labelled, r9, sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _whole(text: str) -> str:
    """SQL whose counts are BIGINT, as Spark's are: DuckDB's count_if gives a wider integer."""
    out, at = [], 0
    while (i := text.find("count_if(", at)) >= 0:
        k, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        call = text[i:k]
        over = text[k:].startswith(" OVER")
        out += [text[at:i], call if over else f"({call})::BIGINT"]
        at = k
    return "".join([*out, text[at:]])


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = _whole(oracle)
        return f

    return add


# Verdicts


@query(sql("SELECT doc_id, relevant, relevant_verdict AS verdict, relevant - 0.6::DOUBLE AS nearness FROM c ORDER BY nearness DESC, doc_id LIMIT 10"))
def flag_top_n(spark, sf):
    df = verdicts.verdicts(answered(spark, sf, "relevant"), FLAGS, {}, ["relevant"])
    return verdicts.top_n(df, 10, FLAGS, {}, "doc_id").select("doc_id", F.col("relevant.noul").alias("relevant"), F.col("relevant_verdict").alias("verdict"), "nearness")


@query(sql("SELECT lang, relevant_verdict AS verdict, count(*) AS n FROM c GROUP BY ALL"))
def verdict_counts(spark, sf):
    df = verdicts.verdicts(answered(spark, sf, "relevant"), FLAGS, {}, ["relevant"])
    return df.groupBy("lang", F.col("relevant_verdict").alias("verdict")).agg(F.count("*").alias("n"))


_MARKS = "SELECT *, CASE WHEN bug >= 0.5 THEN 'matched' WHEN bug > 0.4 THEN 'near' ELSE 'unmatched' END AS queue_verdict, CASE WHEN score >= 3 THEN 'matched' ELSE 'unmatched' END AS impact_verdict FROM c"


@query(sql(f"SELECT doc_id, relevant_verdict, queue_verdict, impact_verdict, relevant >= 0.6 AS flagged, queue_verdict = 'matched' OR impact_verdict = 'matched' AS matched FROM ({_MARKS})"))
def verdicts_all(spark, sf):
    return verdicts.verdicts(answered(spark, sf), FLAGS, MATCHES, list(TRIAGE.questions)).select("doc_id", "relevant_verdict", "queue_verdict", "impact_verdict", "flagged", "matched")


@query(sql(f"SELECT CASE WHEN relevant >= 0.6 THEN 'flagged' WHEN queue_verdict = 'matched' OR impact_verdict = 'matched' THEN 'matched' ELSE 'rest' END AS kind, count(*) AS n FROM ({_MARKS}) GROUP BY kind"))
def report_counts(spark, sf):
    df = verdicts.verdicts(answered(spark, sf), FLAGS, MATCHES, list(TRIAGE.questions))
    return df.groupBy(F.when(F.col("flagged"), "flagged").when(F.col("matched"), "matched").otherwise("rest").alias("kind")).agg(F.count("*").alias("n"))


@query(sql("SELECT doc_id, greatest(bug - 0.5::DOUBLE, bug - 0.5::DOUBLE) AS nearness, greatest(bug, 0) AS strength FROM c ORDER BY nearness DESC, doc_id LIMIT 25"))
def match_top_n(spark, sf):
    df = verdicts.top_n(answered(spark, sf, "queue", "impact"), 25, {}, MATCHES, "doc_id")
    return df.select("doc_id", "nearness", verdicts.strength(MATCHES["queue"], F.col("queue")).alias("strength"))


# Distributions


@query(sql("SELECT doc_id, choice AS first_key, CASE WHEN choice = 'billing' THEN CASE WHEN bug >= other THEN 'bug' ELSE 'other' END WHEN choice = 'bug' THEN CASE WHEN billing >= other THEN 'billing' ELSE 'other' END ELSE CASE WHEN billing >= bug THEN 'billing' ELSE 'bug' END END AS second_key, round(top - mid, 9) AS margin FROM c"))
def choice_ranked_margin(spark, sf):
    r = dist.ranked(F.col("queue.probs"))
    return answered(spark, sf, "queue").select("doc_id", r[0]["key"].alias("first_key"), r[1]["key"].alias("second_key"), r9(dist.margin(F.col("queue.probs"))).alias("margin"))


@query(sql("SELECT doc_id, choice, top AS p FROM c"))
def choice_argmax(spark, sf):
    return answered(spark, sf, "queue").select("doc_id", "queue.choice", dist.top(F.col("queue.probs")).alias("p"))


_CERTAINTY = "least(1, greatest(0, 1 - (-billing * ln(billing) - bug * ln(bug) - other * ln(other)) / ln(3)))"


@query(sql(f"SELECT doc_id, round({_CERTAINTY}, 9) AS certainty FROM c"))
def entropy_measure(spark, sf):
    return answered(spark, sf, "queue").select("doc_id", r9(dist.certainty(F.col("queue.probs"))).alias("certainty"))


@query(
    sql(
        "SELECT doc_id, round(greatest(relevant, 1 - relevant), 9) AS noul_top, round(abs(2 * relevant - 1), 9) AS noul_margin, "
        "round(least(1, greatest(0, 1 - (-relevant * ln(relevant) - (1 - relevant) * ln(1 - relevant)) / ln(2))), 9) AS noul_entropy, "
        "round(0.5 + abs(relevant - 0.5), 9) AS noul_applicability, round(1 - relevant, 9) AS noul_prob_false, "
        f"round(top, 9) AS choice_top, round(top - mid, 9) AS choice_margin, round({_CERTAINTY}, 9) AS choice_entropy, "
        "round(greatest(0, least(1, (3 * top - 1) / 2)), 9) AS choice_confidence, round(bug, 9) AS choice_prob_bug, 'undefined' AS noul_confidence FROM c"
    )
)
def measures_all(spark, sf):
    def m(c, name, option=None):
        a = F.col(c)
        return dist.measure(a["type"], name, a["probs"], a["noul"], a["confidence"], option)

    value = lambda *a: r9(m(*a)["value"])
    return answered(spark, sf, "relevant", "queue").select(
        "doc_id",
        value("relevant", "top").alias("noul_top"),
        value("relevant", "margin").alias("noul_margin"),
        value("relevant", "entropy").alias("noul_entropy"),
        value("relevant", "applicability").alias("noul_applicability"),
        value("relevant", "prob", "false").alias("noul_prob_false"),
        value("queue", "top").alias("choice_top"),
        value("queue", "margin").alias("choice_margin"),
        value("queue", "entropy").alias("choice_entropy"),
        value("queue", "confidence").alias("choice_confidence"),
        value("queue", "prob", "bug").alias("choice_prob_bug"),
        m("relevant", "confidence")["problem"].alias("noul_confidence"),
    )


@query(sql("SELECT doc_id, CASE greatest(p0, p1, p2, p3, p4) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 ELSE 4 END::INTEGER AS level, round(score, 9) AS score, round(score / 4, 9) AS normalized FROM c"))
def score_level_normalized(spark, sf):
    a = F.col("impact")
    return answered(spark, sf, "impact").select("doc_id", dist.level(a["probs"]).alias("level"), r9(a["score"]).alias("score"), r9(dist.normalized(a["score"], 5)).alias("normalized"))


@query(sql("SELECT doc_id, round(bug ** 0.5 / (billing ** 0.5 + bug ** 0.5 + other ** 0.5), 9) AS p_bug FROM c"))
def temperature_scaled(spark, sf):
    return answered(spark, sf, "queue").select("doc_id", r9(dist.prob(dist.temperature(F.col("queue.probs"), 2.0), "bug")).alias("p_bug"))


# Validation

_BROKEN = "CASE doc_id % 8 WHEN 1 THEN 'not_finite' WHEN 2 THEN CASE WHEN top * 2 > 1.000001 THEN 'out_of_range' ELSE 'probability_sum' END WHEN 3 THEN 'missing_answer' WHEN 4 THEN 'choice_not_option' WHEN 5 THEN 'choice_not_argmax' WHEN 6 THEN 'type_mismatch' WHEN 7 THEN 'probability_keys' END"


def _broken(spark, sf):
    a, k = F.col("queue"), F.col("doc_id") % 8
    worst = F.reverse(dist.ranked(a["probs"]))[0]["key"]
    b = (
        F.when(k == 1, a.withField("confidence", F.lit(float("nan"))))
        .when(k == 2, a.withField("probs", F.transform(a["probs"], lambda e: F.struct(e["key"].alias("key"), (e["p"] * 2).alias("p")))))
        .when(k == 3, None)
        .when(k == 4, a.withField("choice", F.lit("refunds")))
        .when(k == 5, a.withField("choice", worst))
        .when(k == 6, F.col("relevant"))
        .when(k == 7, a.withField("probs", F.slice(a["probs"], 1, 2)))
        .otherwise(a)
    )
    return answered(spark, sf).withColumn("answer", b)


@query(sql(f"SELECT doc_id, {_BROKEN} AS reason, coalesce({_BROKEN} IN ('choice_not_argmax', 'probability_sum'), false) AS consistency FROM c"))
def validate_reasons(spark, sf):
    r = validate.reason(TRIAGE.questions["queue"], F.col("answer"))
    return _broken(spark, sf).select("doc_id", validate.name(r).alias("reason"), F.coalesce(validate.is_consistency(r), F.lit(False)).alias("consistency"))


@query(sql(f"SELECT doc_id, 'queue' AS question, {_BROKEN} AS reason, coalesce({_BROKEN} IN ('choice_not_argmax', 'probability_sum'), false) AS consistency FROM c UNION ALL SELECT doc_id, 'relevant', CASE WHEN doc_id % 5 = 0 THEN 'missing_answer' END, false FROM c UNION ALL SELECT doc_id, 'stray', 'unexpected_answer', false FROM c WHERE doc_id % 9 = 0"))
def validate_full_outer(spark, sf):
    df = _broken(spark, sf)
    rows = df.where("doc_id % 8 <> 3").select("doc_id", F.lit("queue").alias("question"), "answer")
    rows = rows.unionByName(df.where("doc_id % 5 <> 0").select("doc_id", F.lit("relevant").alias("question"), F.col("relevant").alias("answer")))
    rows = rows.unionByName(df.where("doc_id % 9 = 0").select("doc_id", F.lit("stray").alias("question"), F.col("queue").alias("answer")))
    # every document has at least one row, so the outer join sees each of them
    rows = rows.unionByName(df.where("doc_id % 8 = 3").select("doc_id", F.lit("queue").alias("question"), F.lit(None).cast(df.schema["answer"].dataType).alias("answer")))
    return validate.check_answers(rows, {k: TRIAGE.questions[k] for k in ("queue", "relevant")}, ["doc_id"])


# Gates


def _gated(spark, sf, rule):
    df = answered(spark, sf)
    a = {k: gate.gate_input(F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col(k)) if k == "queue" else F.col(k)) for k in TRIAGE.questions}
    out = gate.apply_rule(df, rule, a, "d")
    return out.select("doc_id", gate.outcome_name(F.col("d.outcome")).alias("outcome"), "d.rule", "d.weakest", r9(F.col("d.value")).alias("value"), "d.missing", F.size("d.readings").alias("n_readings"))


def _gate_sql(outcome, rule, weakest, value, missing="false", readings=1):
    return sql(f"SELECT doc_id, {outcome} AS outcome, {rule} AS rule, {weakest} AS weakest, round({value}, 9) AS value, {missing} AS missing, {readings} AS n_readings FROM (SELECT *, doc_id % 11 = 0 AS gone, greatest(0, least(1, (3 * top - 1) / 2)) AS conf, greatest(0, least(1, (5 * greatest(p0, p1, p2, p3, p4) - 1) / 4)) AS conf5, greatest(p0, p1, p2, p3, p4) AS top5 FROM c)")


_BANDS = gate.Bands("relevant", "noul", 0.7, 0.4, name="bands")


@query(_gate_sql("CASE WHEN relevant >= 0.7 THEN 'allow' WHEN relevant >= 0.4 THEN 'review' ELSE 'escalate' END", "'bands'", "'relevant'", "relevant"))
def gate_bands(spark, sf):
    return _gated(spark, sf, _BANDS)


@query(_gate_sql("CASE WHEN relevant <= 0.3 THEN 'allow' WHEN relevant <= 0.6 THEN 'review' ELSE 'escalate' END", "'bands'", "'relevant'", "relevant"))
def gate_bands_risky(spark, sf):
    return _gated(spark, sf, gate.Bands("relevant", "noul", 0.3, 0.6, gate.RISKY, name="bands"))


_ALL = "least(CASE WHEN gone THEN 2 ELSE top END, top5)"


@query(
    _gate_sql(
        f"CASE WHEN gone AND top5 >= 0.3 THEN 'review' WHEN {_ALL} >= 0.45 THEN 'allow' WHEN {_ALL} >= 0.3 THEN 'review' ELSE 'escalate' END",
        "'all'",
        "CASE WHEN gone AND top5 >= 0.3 THEN 'queue' WHEN gone OR top5 < top THEN 'impact' ELSE 'queue' END",
        f"CASE WHEN gone AND top5 >= 0.3 THEN NULL ELSE {_ALL} END",
        "gone AND top5 >= 0.3",
        2,
    )
)
def gate_all_of(spark, sf):
    return _gated(spark, sf, gate.AllOf(("queue", "impact"), "top", 0.45, 0.3, on_missing="review", name="all"))


@query(_gate_sql("CASE WHEN gone THEN 'escalate' WHEN least(conf, conf5) >= 0.1 THEN 'allow' ELSE 'review' END", "'floor'", "CASE WHEN gone THEN 'queue' WHEN conf5 < conf THEN 'impact' ELSE 'queue' END", "CASE WHEN gone THEN NULL ELSE least(conf, conf5) END", "gone", 2))
def gate_min_confidence(spark, sf):
    return _gated(spark, sf, gate.MinConfidence(("queue", "impact"), 0.1, below="review", name="floor"))


@query(_gate_sql("CASE WHEN gone THEN 'allow' WHEN top < 0.45 OR top - mid < 0.1 THEN 'review' ELSE 'allow' END", "'lead'", "'queue'", "CASE WHEN gone THEN NULL WHEN top < 0.45 THEN top ELSE top - mid END", "gone", 2))
def gate_margin(spark, sf):
    return _gated(spark, sf, gate.Margin("queue", 0.45, 0.1, below="review", on_missing="allow", name="lead"))


_ASYM = "CASE WHEN gone THEN 'escalate' WHEN top < 0.36 THEN 'review' WHEN choice = 'bug' THEN CASE WHEN top >= 0.6 THEN 'allow' WHEN top >= 0.4 THEN 'review' ELSE 'escalate' END WHEN choice = 'billing' THEN 'review' ELSE 'escalate' END"


@query(_gate_sql(_ASYM, "'by-option'", "'queue'", "CASE WHEN gone THEN NULL ELSE top END", "gone"))
def gate_asymmetric(spark, sf):
    return _gated(spark, sf, gate.Asymmetric("queue", "top", {"bug": gate.OptionBand(0.6, 0.4), "billing": gate.OptionBand(always="review")}, floor=0.36, below_floor="review", name="by-option"))


_SEV = "CASE {} WHEN 'allow' THEN 1 WHEN 'review' THEN 2 ELSE 3 END"
_B = "CASE WHEN relevant >= 0.7 THEN 'allow' WHEN relevant >= 0.4 THEN 'review' ELSE 'escalate' END"
_FIRST = f"({_SEV.format(f'({_B})')} >= {_SEV.format(f'({_ASYM})')})"


@query(_gate_sql(f"CASE WHEN {_FIRST} THEN {_B} ELSE {_ASYM} END", f"CASE WHEN {_FIRST} THEN 'both/bands' ELSE 'both/by-option' END", f"CASE WHEN {_FIRST} THEN 'relevant' ELSE 'queue' END", f"CASE WHEN {_FIRST} THEN relevant WHEN gone THEN NULL ELSE top END", f"NOT {_FIRST} AND gone", 2))
def gate_compose(spark, sf):
    asym = gate.Asymmetric("queue", "top", {"bug": gate.OptionBand(0.6, 0.4), "billing": gate.OptionBand(always="review")}, floor=0.36, below_floor="review", name="by-option")
    return _gated(spark, sf, gate.rule_from_json(gate.Compose((_BANDS, asym), name="both").to_json()))


# Parts

_PARTS = f"p AS (SELECT doc_id, i + 1 AS n, greatest(ceil(length(text) / 512.0), 1)::INTEGER AS of, substr(text, i * 512 + 1, 512) AS part FROM documents, unnest(range(greatest(ceil(length(text) / 512.0), 1)::BIGINT)) AS u(i)), a AS (SELECT *, length(part) AS size, {h('relevant', 'part')} AS noul FROM p)"


def _parts(spark, sf, key="relevant"):
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,512}"), F.lit(0))  # one pass over a text
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 0, pieces).otherwise(F.array(F.lit(""))).alias("pieces"))
    rows = docs.select("doc_id", F.size("pieces").alias("of"), F.posexplode("pieces").alias("pos", "part")).withColumn("n", F.col("pos") + 1)
    rows = rows.select("doc_id", "n", "of", F.lit("").alias("lines"), F.length("part").alias("size"), F.lit("complete").alias("status"), "part")
    return hash_answers(rows, {key: TRIAGE.questions[key]}, "part").withColumnRenamed(key, "answer").drop("part")


@query(f"WITH {_PARTS} SELECT doc_id, round(sum(CASE WHEN size > 0 THEN size ELSE 1 END * noul) / sum(CASE WHEN size > 0 THEN size ELSE 1 END), 9) AS noul FROM a GROUP BY doc_id")
def combine_parts(spark, sf):
    return combine.combine_answers(_parts(spark, sf), "doc_id", TRIAGE.questions["relevant"]).select("doc_id", r9(F.col("answer.noul")).alias("noul"))


@query(f"WITH {_PARTS} SELECT doc_id, noul, n::INTEGER AS where_part FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY noul DESC, n) = 1")
def combine_strongest(spark, sf):
    return combine.combine_answers(_parts(spark, sf), "doc_id", TRIAGE.questions["relevant"], FLAGS["relevant"]).select("doc_id", F.col("answer.noul").alias("noul"), "where_part")


_WQ = ", ".join(f"{h(f'queue|{o}', 'part')} AS w_{o}" for o in ("billing", "bug", "other"))


@query(
    f"WITH {_PARTS}, q AS (SELECT doc_id, CASE WHEN size > 0 THEN size ELSE 1 END AS w, {_WQ} FROM a), m AS (SELECT doc_id, "
    + ", ".join(f"round(sum(w * (w_{o} / (w_billing + w_bug + w_other))) / sum(w), 9) AS {o}" for o in ("billing", "bug", "other"))
    + " FROM q GROUP BY doc_id) SELECT doc_id, billing, bug, other FROM m"
)
def combine_choice(spark, sf):
    df = combine.combine_answers(_parts(spark, sf, "queue"), "doc_id", TRIAGE.questions["queue"])
    return df.select("doc_id", *(r9(dist.prob(F.col("answer.probs"), o)).alias(o) for o in ("billing", "bug", "other")))


@query(f"WITH {_PARTS}, s AS (SELECT *, (doc_id + n) % 13 = 0 AS bad, (doc_id + n) % 29 = 0 AS lost FROM a) SELECT doc_id, max(of)::INTEGER AS parts, CASE WHEN count_if(bad AND NOT lost) > 0 THEN 'failed' WHEN count_if(NOT lost) < max(of) THEN 'incomplete' ELSE 'complete' END AS status FROM s WHERE NOT lost GROUP BY doc_id")
def item_status(spark, sf):
    p = _parts(spark, sf).where("(doc_id + n) % 29 <> 0").withColumn("status", F.when((F.col("doc_id") + F.col("n")) % 13 == 0, "failed").otherwise("complete"))
    return combine.item_status(p, "doc_id")


# Ranking


@query(sql("SELECT doc_id, row_number() OVER (ORDER BY relevant DESC, source, doc_id) AS position, relevant FROM c"))
def rerank(spark, sf):
    df = rank.check_observations(answered(spark, sf, "relevant").select("doc_id", "source", F.col("relevant.noul").alias("relevant")), "relevant")
    return rank.rerank(df, "relevant", "source", "doc_id").select("doc_id", "position", "relevant")


_RANKED = "r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY relevant DESC, source, doc_id) AS position FROM c), u AS (SELECT *, sum(n_chars) OVER (ORDER BY position)::BIGINT AS used FROM r)"


def _ranked(spark, sf):
    df = answered(spark, sf, "relevant").select("doc_id", "source", "n_chars", F.col("relevant.noul").alias("relevant"))
    return rank.rerank(df, "relevant", "source", "doc_id")


@query(sql(f", {_RANKED} SELECT doc_id, position, used FROM u WHERE used <= 100000").replace(") , r AS", "), r AS"))
def rank_budget_prefix(spark, sf):
    return rank.select_under_budget(_ranked(spark, sf), "position", "n_chars", 100_000).select("doc_id", "position", "used")


@query(sql(f", {_RANKED} SELECT min(position) AS first_excluded FROM u WHERE used > 100000").replace(") , r AS", "), r AS"))
def rank_first_excluded(spark, sf):
    r = _ranked(spark, sf)
    return rank.first_excluded(r, rank.select_under_budget(r, "position", "n_chars", 100_000), "position")


_PAIRS = f"p AS (SELECT a.item_id AS first, b.item_id AS second, {h('pref', chr(39) + chr(39) + ' || a.item_id || ' + chr(39) + '|' + chr(39) + ' || b.item_id')} AS noul FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id)"


def _pairs(spark, sf):
    pairs = rank.all_pairs(table(spark, sf, "benchmark"), "item_id")
    return pairs.withColumn("noul", hash_weight("pref", F.concat_ws("|", "first", "second")))


@query(f"WITH {_PAIRS}, v AS (SELECT first AS i, noul AS p FROM p UNION ALL SELECT second, 1 - noul FROM p), s AS (SELECT i AS item_id, round(sum(p), 9) AS value, count(*) AS support FROM v GROUP BY i) SELECT *, row_number() OVER (ORDER BY value DESC, item_id) AS position FROM s")
def pairwise_sort(spark, sf):
    v = rank.pairwise_values(_pairs(spark, sf), "item_id").withColumn("value", r9(F.col("value"))).withColumn("key", F.lit(""))
    return rank.rerank(v, "value", "key", "item_id").select("item_id", "value", "support", "position")


@query(f"WITH {_PAIRS} SELECT first, second FROM p WHERE (first + second) % 17 = 0")
def pairwise_missing(spark, sf):
    swapped = F.col("first") % 2 == 0
    p = _pairs(spark, sf).where("(first + second) % 17 <> 0")
    p = p.select(F.when(swapped, F.col("second")).otherwise(F.col("first")).alias("first"), F.when(swapped, F.col("first")).otherwise(F.col("second")).alias("second"), "noul")
    return rank.missing_pairs(table(spark, sf, "benchmark"), "item_id", p)


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT CASE WHEN noul > 0.5 THEN first ELSE second END AS src, CASE WHEN noul > 0.5 THEN second ELSE first END AS dst FROM p WHERE noul <> 0.5), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT count_if(src = dst) > 0 AS has_cycle FROM r")
def preference_cycle(spark, sf):
    found = rank.has_cycle(rank.preference_edges(_pairs(spark, sf)))
    return spark.range(1).select(F.lit(found).alias("has_cycle"))


@query(sql("SELECT list_sort(list(DISTINCT 'm' || (doc_id % 3)) FILTER (doc_id % 3 <> 0))[1] AS first_model, count(DISTINCT doc_id % 3)::INTEGER - 1 AS n_models, true AS unknown_model FROM c"))
def model_provenance(spark, sf):
    df = answered(spark, sf, "relevant").select(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("m"), F.col("doc_id") % 3)).otherwise("").alias("model"), F.lit("relevant").alias("question_key"))
    return rank.provenance(df).select(F.col("models")[0].alias("first_model"), F.size("models").alias("n_models"), "unknown_model")


# Picking


_PICK = Choice("Which candidate fits?", (("alpha", None), ("beta", None), ("gamma", None), ("none", None)))
_PW = ", ".join(f"{h(f'pick|{k}')} AS w_{k}" for k in ("alpha", "beta", "gamma", "none"))
_PN = ", ".join(f"w_{k} / (w_alpha + w_beta + w_gamma + w_none) AS {k}_p" for k in ("alpha", "beta", "gamma", "none"))
_PL = "[" + ", ".join(f"{{'k': '{k}', 'p': {k}_p}}" for k in ("alpha", "beta", "gamma", "none")) + "]"


@query(f"WITH w AS (SELECT doc_id, {_PW} FROM documents), n AS (SELECT doc_id, {_PN} FROM w), e AS (SELECT doc_id, unnest({_PL}) AS e FROM n), r AS (SELECT doc_id, e.k AS k, e.p AS p, row_number() OVER (PARTITION BY doc_id ORDER BY e.p DESC, e.k) AS i FROM e), o AS (SELECT a.doc_id, a.k AS choice, a.p AS p, b.k AS runner_up, a.p - b.p AS margin FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.i = 1 AND b.i = 2) SELECT doc_id, choice, choice = 'none' AS abstained, round(p, 9) AS p, runner_up, round(margin, 9) AS margin, CASE choice WHEN 'alpha' THEN 'first' WHEN 'beta' THEN 'second' END AS candidate, CASE WHEN choice = 'gamma' THEN 'unknown candidate gamma' END AS error FROM o")
def pick_candidate(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", hash_answer("pick", _PICK, F.col("text")).alias("answer"))
    known = spark.createDataFrame([("alpha", "first"), ("beta", "second")], "key string, candidate string")
    out = pick.read(df, known).withColumn("r", pick.result(F.col("answer")))
    return out.select("doc_id", "r.choice", "r.abstained", r9(F.col("r.p")).alias("p"), "r.runner_up", r9(F.col("r.margin")).alias("margin"), "candidate", "error")


@query("SELECT n_regionkey, n_nationkey, n_name AS key, NULL::VARCHAR AS description FROM nation")
def pick_keys(spark, sf):
    return pick.keys_by_group(table(spark, sf, "nation"), "n_regionkey", "n_nationkey", "n_name")


# Heads

_HEADS = {"view": {"bounce": Noul("Will they leave?")}, "purchase": {"refund": Noul("Will it come back?"), "upsell": Noul("Would they buy more?")}, "click": {"bounce": Noul("Will they leave?")}, "signup": {}}


def _heads_rows():
    plan = heads.Plan(Choice.of("What happened?", dict.fromkeys(_HEADS)), _HEADS)
    return plan.attach(QuestionSet(), "event")


_HV = ", ".join(f"('{b}', '{lo}', '{q}')" for _, b, lo, q in _heads_rows())


@query(f"WITH br(branch, local, question) AS (VALUES {_HV}), j AS (SELECT event_id, event_type, br.*, {h('X', 'event_id').replace(chr(39) + 'X|' + chr(39), 'question || ' + chr(39) + '|' + chr(39))} AS p FROM events LEFT JOIN br ON event_type = branch) SELECT event_id, branch, local, p AS noul, CASE WHEN branch IS NULL THEN 'unknown selected option ' || event_type END AS error FROM j")
def heads_selected_branch(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("choice"))
    rows = spark.createDataFrame(_heads_rows(), heads.BRANCHES)
    asked = ev.join(F.broadcast(rows.select("question")))  # every event is asked the plan's questions
    p = F.conv(F.substring(F.md5(F.concat_ws("|", "question", "event_id").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    answers = asked.select("event_id", "question", p.alias("answer"))
    return heads.read(ev, answers, rows, ["event_id"]).select("event_id", "branch", "local", F.col("answer").alias("noul"), "error")


# Funnels

_URGENT = Noul("Is it urgent?")


def _stages():
    a = lambda k: F.col(k)["noul"]
    return [
        funnel.Stage("cheap", lambda df: df.withColumn("relevant", hash_answer("relevant", TRIAGE.questions["relevant"], F.col("text"))), a("relevant") >= 0.5),
        funnel.Stage("dear", lambda df: df.withColumn("urgent", hash_answer("urgent", _URGENT, F.col("text"))), a("urgent") >= 0.3, rank=a("urgent"), limit=50),
    ]


_FUNNEL = f"f AS (SELECT doc_id, {h('relevant')} AS r, {h('urgent')} AS u FROM documents), s AS (SELECT * FROM f WHERE r >= 0.5), k AS (SELECT *, row_number() OVER (ORDER BY u DESC, doc_id) AS i FROM s WHERE u >= 0.3)"


@query(f"WITH {_FUNNEL} SELECT doc_id, u AS urgent FROM k WHERE i <= 50")
def funnel_two_stage(spark, sf):
    alive, _ = funnel.run(table(spark, sf, "documents"), _stages(), "doc_id")
    return alive.select("doc_id", F.col("urgent.noul").alias("urgent"))


@query(f"WITH {_FUNNEL} SELECT 'cheap' AS stage, (SELECT count(*) FROM f) AS n_in, (SELECT count(*) FROM s) AS n_out, 0::BIGINT AS failed UNION ALL SELECT 'dear', (SELECT count(*) FROM s), (SELECT count(*) FROM k WHERE i <= 50), 0")
def funnel_report(spark, sf):
    docs = table(spark, sf, "documents")
    _, drops = funnel.run(docs, _stages(), "doc_id")
    return funnel.report(docs, drops, ["cheap", "dear"], "doc_id").drop("ordinal")


@query(f"WITH {_FUNNEL} SELECT stage, cause, count(*) AS n FROM (SELECT 'cheap' AS stage, 'keep' AS cause FROM f WHERE r < 0.5 UNION ALL SELECT 'dear', 'keep' FROM s WHERE u < 0.3 UNION ALL SELECT 'dear', 'limit' FROM k WHERE i > 50) GROUP BY ALL")
def funnel_drops(spark, sf):
    _, drops = funnel.run(table(spark, sf, "documents"), _stages(), "doc_id")
    return drops.groupBy("stage", "cause").agg(F.count("*").alias("n"))


# Compaction


def _segments(spark, sf):
    c = table(spark, sf, "conversations")
    size = F.length("text")
    return c.select("conv_id", "turn", size.alias("size"), F.ceil(size / 4).cast("int").alias("short_size"), F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(40))).alias("short"), (F.col("role") == "system").alias("pinned"), hash_weight("needed", F.col("text")).alias("needed"), hash_weight("verbatim", F.col("text")).alias("verbatim"), (F.col("turn") % 5 != 4).alias("scored"))


_SEGMENTS = f"s AS (SELECT conv_id, turn, length(text) AS size, ceil(length(text) / 4.0)::INTEGER AS small, turn % 2 = 0 AND length(text) > 0 AS has_short, role = 'system' AS pinned, {h('needed')} AS needed, {h('verbatim')} AS verbatim, turn % 5 <> 4 AS scored FROM conversations)"
_KEEPS = "NOT (o.scored AND o.has_short AND o.verbatim < 0.4) AND o.size <= r.left_"
_SHORTENS = "o.has_short AND o.small <= r.left_"


@query(
    f"WITH RECURSIVE {_SEGMENTS}, b AS (SELECT conv_id, 600 - coalesce(sum(size) FILTER (pinned), 0) AS left_ FROM s GROUP BY conv_id), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY scored, CASE WHEN scored THEN -needed ELSE 0 END, CASE WHEN scored THEN -turn ELSE turn END) AS i FROM s WHERE NOT pinned AND (NOT scored OR needed >= 0.15)), "
    "r AS (SELECT conv_id, 0::BIGINT AS i, left_::BIGINT AS left_, left_ < 0 AS over, NULL::BIGINT AS turn, NULL::VARCHAR AS action, NULL::VARCHAR AS cause FROM b UNION ALL "
    f"SELECT o.conv_id, o.i, (r.left_ - CASE WHEN r.over THEN 0 WHEN {_KEEPS} THEN o.size WHEN {_SHORTENS} THEN o.small ELSE 0 END)::BIGINT, r.over, o.turn, "
    f"CASE WHEN r.over THEN 'drop' WHEN {_KEEPS} THEN 'keep' WHEN {_SHORTENS} THEN 'short' ELSE 'drop' END, "
    f"CASE WHEN NOT r.over AND (({_KEEPS}) OR ({_SHORTENS})) THEN CASE WHEN o.scored THEN 'ranked' ELSE 'unscored' END ELSE 'budget' END "
    "FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1) "
    "SELECT conv_id, turn, action, cause FROM r WHERE i > 0 UNION ALL SELECT conv_id, turn, 'keep', 'pinned' FROM s WHERE pinned UNION ALL SELECT conv_id, turn, 'drop', 'floor' FROM s WHERE NOT pinned AND scored AND needed < 0.15"
)
def compact_select(spark, sf):
    return compact.select(_segments(spark, sf), "conv_id", "turn", compact.Rule(600, 0.15, 0.4))


@query(f"SELECT conv_id, sum(length(text))::BIGINT AS before, count(*) AS turns, count_if(role <> 'system' AND turn % 5 <> 4 AND {h('needed')} < 0.15) AS below_floor FROM conversations GROUP BY conv_id")
def compact_floor(spark, sf):
    s = _segments(spark, sf)
    d = compact.select(s, "conv_id", "turn", compact.Rule(10**9, 0.15, 0.4))
    t = compact.totals(s, d, "conv_id", "turn").select("conv_id", "before")
    n = d.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("cause") == "floor").alias("below_floor"))
    return t.join(n, "conv_id")


_OPENS = "(r.used > 0 AND r.used + s.n > 1500)"


@query(
    "WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), "
    "r AS (SELECT conv_id, turn, i, CASE WHEN n <= 1500 THEN 0 END AS batch, 0 AS cur, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used FROM s WHERE i = 1 UNION ALL "
    f"SELECT s.conv_id, s.turn, s.i, CASE WHEN s.n > 1500 THEN NULL WHEN {_OPENS} THEN r.cur + 1 ELSE r.cur END, CASE WHEN s.n <= 1500 AND {_OPENS} THEN r.cur + 1 ELSE r.cur END, "
    f"CASE WHEN s.n > 1500 THEN r.used WHEN {_OPENS} THEN s.n ELSE r.used + s.n END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1) SELECT conv_id, turn, batch::BIGINT AS batch FROM r"
)
def compact_packing(spark, sf):
    return compact.pack(_segments(spark, sf), "conv_id", "turn", "size", 1500)


# Calibration

_CASES = "k AS (SELECT c.doc_id, relevant AS value, quality <> 1 AS wrong, quality = 1 AS hit, lang FROM c JOIN labels USING (doc_id))"


def _cases(spark, sf):
    return labelled(spark, sf).select("doc_id", "lang", F.col("relevant.noul").alias("value"), (F.col("quality") != 1).alias("wrong"), F.col("relevant.noul").alias("p"), (F.col("quality") == 1).alias("hit"))


def _with(ctes: str, body: str) -> str:
    return sql(f", {ctes} {body}").replace(") , ", "), ", 1)


_SWEEP = _CASES + ", s AS (SELECT value AS cutoff, sum(count(*)) OVER w AS allowed, sum(count_if(wrong)) OVER w AS errors FROM k GROUP BY value WINDOW w AS (ORDER BY value DESC))"


@query(_with(_SWEEP, "SELECT cutoff, allowed::BIGINT AS allowed, errors::BIGINT AS errors, errors::DOUBLE / allowed::DOUBLE AS error_rate FROM s"))
def calibrate_sweep(spark, sf):
    return calibrate.sweep(_cases(spark, sf))


@query(_with(_SWEEP, "SELECT cutoff, allowed::BIGINT AS allowed, errors::BIGINT AS errors, errors::DOUBLE / allowed::DOUBLE AS error_rate FROM s WHERE allowed >= 5 AND errors::DOUBLE / allowed::DOUBLE <= 0.2 ORDER BY allowed DESC, cutoff DESC LIMIT 1"))
def calibrate_best(spark, sf):
    return calibrate.best(calibrate.sweep(_cases(spark, sf)), calibrate.Config(0.2, 5))


_ECE = _CASES + ", bins AS (SELECT least(trunc(value * 10)::INTEGER, 9) AS bin, count(*) AS n, round(abs(sum(value) - sum(hit::INTEGER)), 9) AS gap FROM k GROUP BY 1)"


@query(_with(_ECE, "SELECT bin, n, gap FROM bins"))
def ece_bins(spark, sf):
    return calibrate.ece_bins(_cases(spark, sf), "p", "hit", 10).withColumn("gap", r9(F.col("gap")))


@query(_with(_ECE, "SELECT (SELECT count(*) FROM k) AS count, count_if(value >= 0.5) AS allowed, count_if(value >= 0.5 AND wrong) AS errors, round(count_if(value >= 0.5) / count(*), 9) AS coverage, round(count_if(value >= 0.5 AND wrong) / count_if(value >= 0.5), 9) AS error_rate, round(avg((value - hit::INTEGER) ** 2), 9) AS brier, (SELECT round(sum(gap) / sum(n), 7) FROM bins) AS ece, round(avg((value ** 0.5 / (value ** 0.5 + (1 - value) ** 0.5) - hit::INTEGER) ** 2), 9) AS adjusted_brier, (SELECT round(sum(gap) / sum(n), 7) FROM (SELECT count(*) AS n, abs(sum(a) - sum(hit::INTEGER)) AS gap FROM (SELECT value ** 0.5 / (value ** 0.5 + (1 - value) ** 0.5) AS a, hit FROM k) GROUP BY least(trunc(a * 10)::INTEGER, 9))) AS adjusted_ece FROM k"))
def calibrate_metrics(spark, sf):
    m = calibrate.metrics(_cases(spark, sf), 0.5, calibrate.Config(0.5), 2.0)
    return m.withColumns({c: r9(F.col(c)) for c in ("coverage", "error_rate", "brier", "adjusted_brier")}).withColumns({c: F.round(c, 7) for c in ("ece", "adjusted_ece")})


_TEMP = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, round(avg(-ln(CASE WHEN hit THEN value ** (1 / {t}::DOUBLE) ELSE (1 - value) ** (1 / {t}::DOUBLE) END / (value ** (1 / {t}::DOUBLE) + (1 - value) ** (1 / {t}::DOUBLE)))), 7) AS loss FROM k" for t in ("0.5", "1.0", "2.0", "4.0"))


@query(_with(_CASES, _TEMP))
def temperature_fit(spark, sf):
    c = _cases(spark, sf).withColumns({"probs": dist.noul(F.col("p")), "label": F.when(F.col("hit"), "true").otherwise("false")})
    return calibrate.temperature_losses(c, (0.5, 2.0, 4.0)).withColumn("loss", F.round("loss", 7))


_HALVES = _CASES + ", f AS (SELECT * FROM k WHERE doc_id % 2 = 0), g AS (SELECT * FROM k WHERE doc_id % 2 = 1), fw AS (SELECT value AS cutoff, sum(count(*)) OVER z AS allowed, sum(count_if(wrong)) OVER z AS errors FROM f GROUP BY value WINDOW z AS (ORDER BY value DESC)), best AS (SELECT cutoff FROM fw WHERE errors::DOUBLE / allowed::DOUBLE <= 0.5 ORDER BY allowed DESC, cutoff DESC LIMIT 1), t AS (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, avg(-ln(CASE WHEN hit THEN value ** (1 / {t}::DOUBLE) ELSE (1 - value) ** (1 / {t}::DOUBLE) END / (value ** (1 / {t}::DOUBLE) + (1 - value) ** (1 / {t}::DOUBLE)))) AS loss FROM f" for t in ("0.5", "1.0", "2.0")) + ")"


@query(_with(_HALVES, "SELECT round(cutoff, 9) AS cutoff, (SELECT temperature FROM t ORDER BY loss, temperature LIMIT 1) AS temperature, (SELECT count(*) FROM g) AS count, (SELECT count(*) FROM g WHERE value >= cutoff) AS allowed, (SELECT count(*) FROM g WHERE value >= cutoff AND wrong) AS errors, (SELECT round(avg((value - hit::INTEGER) ** 2), 9) FROM g) AS brier FROM best"))
def calibrate_fit(spark, sf):
    c = _cases(spark, sf).withColumn("id", F.col("doc_id"))
    a = calibrate.fit(c.where("doc_id % 2 = 0"), c.where("doc_id % 2 = 1"), calibrate.Config(0.5, temperatures=(0.5, 2.0)), ["id", "hit"])
    m = a.baseline if a else {}
    row = [(round(a.cutoff, 9), float(a.temperature), m["count"], m["allowed"], m["errors"], round(m["brier"], 9))] if a else []
    return spark.createDataFrame(row, "cutoff double, temperature double, count long, allowed long, errors long, brier double")


# Scores against labels


@query(_with(_CASES, "SELECT lang, round(sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 9) AS auc FROM k a JOIN k b USING (lang) WHERE a.hit AND NOT b.hit GROUP BY lang"))
def auc_by_lang(spark, sf):
    df = _cases(spark, sf).withColumn("y", F.col("hit").cast("int"))
    return metrics.auc(df, "value", "y", ["lang"]).where("auc IS NOT NULL").select("lang", r9(F.col("auc")).alias("auc"))


_RATES = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count_if(hit AND value >= {t}::DOUBLE) / count_if(hit) AS tpr, count_if(NOT hit AND value >= {t}::DOUBLE) / count_if(NOT hit) AS fpr FROM k" for t in ("0.25", "0.5", "0.75"))


@query(_with(_CASES, _RATES))
def tpr_fpr_threshold(spark, sf):
    return metrics.rates(_cases(spark, sf).withColumn("y", F.col("hit").cast("int")), "value", "y", [0.25, 0.5, 0.75])


@query(_with(_CASES + ", t AS (SELECT round(i * 0.05, 2)::DOUBLE AS threshold FROM range(1, 20) AS u(i)), g AS (SELECT threshold, count_if(hit AND value >= threshold) / count_if(hit) AS tpr, count_if(NOT hit AND value >= threshold) / count_if(NOT hit) AS fpr FROM k JOIN t ON true GROUP BY threshold)", "SELECT threshold, tpr, fpr, tpr - fpr AS gain FROM g ORDER BY gain DESC, threshold LIMIT 1"))
def best_threshold(spark, sf):
    return metrics.best_threshold(_cases(spark, sf).withColumn("y", F.col("hit").cast("int")), "value", "y")


@query(sql("SELECT lang, round(corr(ra, rb), 9) AS spearman FROM (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY relevant) + (count(*) OVER (PARTITION BY lang, relevant) - 1) / 2 AS ra, rank() OVER (PARTITION BY lang ORDER BY bug) + (count(*) OVER (PARTITION BY lang, bug) - 1) / 2 AS rb FROM c) GROUP BY lang"))
def spearman_runs(spark, sf):
    df = answered(spark, sf, "relevant", "queue").select("lang", F.col("relevant.noul").alias("a"), dist.prob(F.col("queue.probs"), "bug").alias("b"))
    return metrics.spearman(df, "a", "b", ["lang"]).withColumn("spearman", r9(F.col("spearman")))


@query(sql("SELECT count(*) AS n, round(avg(abs(relevant - bug)), 9) AS mean_diff, round(max(abs(relevant - bug)), 9) AS max_diff, count_if(abs(relevant - bug) > 0.2) AS n_large FROM c"))
def run_difference(spark, sf):
    df = answered(spark, sf, "relevant", "queue").select(F.col("relevant.noul").alias("a"), dist.prob(F.col("queue.probs"), "bug").alias("b"))
    return metrics.run_difference(df, "a", "b").withColumns({c: r9(F.col(c)) for c in ("mean_diff", "max_diff")})


@query(sql("SELECT count(*) AS shared FROM ((SELECT doc_id FROM c ORDER BY relevant DESC, doc_id LIMIT 30) INTERSECT (SELECT doc_id FROM c ORDER BY bug DESC, doc_id LIMIT 30))"))
def shared_top(spark, sf):
    df = answered(spark, sf, "relevant", "queue").select("doc_id", F.col("relevant.noul").alias("a"), dist.prob(F.col("queue.probs"), "bug").alias("b"))
    return metrics.shared_top(df, "a", "b", "doc_id")


@query(sql("SELECT source, max_by(doc_id, (relevant, -doc_id)) AS doc_id, max(relevant) AS relevant FROM c GROUP BY source"))
def best_per_source(spark, sf):
    df = answered(spark, sf, "relevant").select("source", "doc_id", F.col("relevant.noul").alias("relevant"))
    return metrics.best_of(df, "source", F.struct("relevant", -F.col("doc_id")), ["doc_id", "relevant"])


@query("SELECT lang AS reason, count(*) AS n, string_agg(name, ', ' ORDER BY name) FILTER (r <= 3) AS first FROM (SELECT lang, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS name, row_number() OVER (PARTITION BY lang ORDER BY lpad(doc_id::VARCHAR, 9, '0')) AS r FROM documents) GROUP BY lang")
def skip_summary(spark, sf):
    df = table(spark, sf, "documents").select("lang", F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"))
    return metrics.skip_summary(df, "lang", "name").withColumnRenamed("lang", "reason")


# Cache and runs

_SRC = cache.Source("local", "", "hash-1")


def _frame(*xs: str) -> str:
    one = lambda x: f"unhex(lpad(to_hex(octet_length({x})), 16, '0')) || {x}"
    return " || ".join(one(x) for x in xs)


def _enc(x: str) -> str:
    return f"encode({x})"


_ITEM = f"unhex(sha256({_frame(_enc(chr(39) + 'item' + chr(39)), _enc('text'), _enc(chr(39) * 2), _enc(chr(39) * 2))}))"
_KEYSQL = f"substr(sha256({_frame(*(_enc(repr(x)) for x in ('answer', 'local', '', 'hash-1')), 'item', _enc(repr('relevant')), _enc(repr('q1')))}), 1, 32)"
_CACHE = f"i AS (SELECT doc_id, {_ITEM} AS item FROM documents), q AS (SELECT doc_id, {_KEYSQL} AS key FROM i), en AS (SELECT key, doc_id AS time_ns, doc_id % 7 AS segment_seq, 'a' || doc_id AS answer, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'v' || (doc_id % 2) END AS version FROM q WHERE doc_id % 3 <> 0), nw AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY key ORDER BY time_ns DESC, segment_seq DESC) = 1), lv AS (SELECT max_by(version, time_ns) AS latest FROM en WHERE version <> ''), us AS (SELECT nw.* FROM nw, lv WHERE version = '' OR version = latest)"


def _keyed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", cache.item_id(F.col("text")).alias("item"))
    q = docs.select("doc_id", cache.answer_key(_SRC, F.col("item"), F.lit("relevant"), F.lit("q1")).alias("key"))
    v = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("v"), F.col("doc_id") % 2))
    e = q.where("doc_id % 3 <> 0").select("key", F.concat(F.lit("a"), "doc_id").alias("answer"), F.col("doc_id").alias("time_ns"), (F.col("doc_id") % 7).alias("segment_seq"), v.alias("version"))
    return q, e


@query(f"WITH {_CACHE} SELECT doc_id, key FROM q")
def framed_key(spark, sf):
    return _keyed(spark, sf)[0]


@query(f"WITH {_CACHE} SELECT key, answer, version FROM nw")
def cache_newest(spark, sf):
    return cache.newest(_keyed(spark, sf)[1]).select("key", "answer", "version")


@query(f"WITH {_CACHE} SELECT q.doc_id, us.answer FROM q JOIN us USING (key)")
def cache_hits(spark, sf):
    return cache.hits(*_keyed(spark, sf)).select("doc_id", "answer")


@query(f"WITH {_CACHE} SELECT doc_id FROM q WHERE key NOT IN (SELECT key FROM us)")
def cache_to_ask(spark, sf):
    return cache.to_ask(*_keyed(spark, sf)).select("doc_id")


@query(f"WITH {_CACHE} SELECT doc_id FROM q WHERE key IN (SELECT key FROM nw) AND key NOT IN (SELECT key FROM us)")
def cache_stale(spark, sf):
    return cache.stale(*_keyed(spark, sf)).select("doc_id")


@query(sql("SELECT doc_id, 'complete' AS status, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 2 ELSE 0 END::BIGINT AS cached, relevant, choice FROM c"))
def cached_rerun(spark, sf):
    """Half of the documents are asked about first; a run over all of them asks only what no equal text has answered."""
    docs = table(spark, sf, "documents")
    no = lambda t: F.lit(None).cast(t)
    items = docs.select(F.col("doc_id").alias("item_index"), F.concat(F.lit("documents:"), "doc_id").alias("label"), F.lit("record").alias("unit"), F.lit("").alias("value"), F.col("text").alias("state"), no("array<struct<lines:string,size:int,state:string>>").alias("parts"), no("struct<content_type:string,path:string>").alias("media"), F.lit(False).alias("is_diff"), F.lit(False).alias("is_code"))
    engine = Engine(spark, EngineConfig(cache_dir=store.fresh_dir(spark, "answers")))
    t = Template("two", {k: TRIAGE.questions[k] for k in ("relevant", "queue")}, {"relevant": "yes >= 60%"})
    engine.run(t, items.where("item_index % 2 = 0"))
    return engine.run(t, items).items.select(F.col("item_index").alias("doc_id"), "status", "cached", F.col("relevant.noul").alias("relevant"), "queue.choice")


_RESULTS = 'x AS (SELECT doc_id AS "index", s AS attempt_seq, CASE WHEN (doc_id + s) % 3 = 0 THEN \'failed\' ELSE \'complete\' END AS status FROM documents, unnest([1, 2, 3]) AS u(s) WHERE s <= doc_id % 4), l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY "index" ORDER BY attempt_seq DESC) = 1)'


def _results(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("index"))
    r = docs.select("index", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt_seq")).where("attempt_seq <= index % 4")
    return docs, r.withColumn("status", F.when((F.col("index") + F.col("attempt_seq")) % 3 == 0, "failed").otherwise("complete"))


@query(f'WITH {_RESULTS} SELECT "index", attempt_seq, status FROM l')
def latest_result_per_index(spark, sf):
    return runs.latest(_results(spark, sf)[1])


@query(f'WITH {_RESULTS} SELECT doc_id AS "index" FROM documents WHERE doc_id NOT IN (SELECT "index" FROM l WHERE status = \'complete\')')
def resume_pending(spark, sf):
    return runs.pending(*_results(spark, sf))


@query(f"WITH {_RESULTS} SELECT (SELECT count(*) FROM documents) AS total, count_if(status = 'complete') AS complete, count_if(status = 'failed') AS failed, 'interrupted' AS status FROM l")
def run_counts(spark, sf):
    return runs.counts(*_results(spark, sf))


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'error' END AS error FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, error ORDER BY event_id) AS i FROM e) SELECT user_id, error, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE error IS NOT NULL GROUP BY user_id, error, i HAVING count(*) >= 2")
def error_streaks(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "error").alias("error"))
    return runs.error_streaks(e, "event_id", "error", ["user_id"], 2)


# Text and JSON


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field_lookup(spark, sf):
    return table(spark, sf, "events").select("event_id", text.lookup(F.col("props"), "k").alias("k"))


def _items(spark, sf, kind="lines", text=None, **options):
    """The documents as files, read as items: doc_id, pos and an item's columns."""
    from ..sources import files

    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("documents:"), "doc_id").alias("label"), F.lit(kind).alias("kind"), (F.col("text") if text is None else text).alias("text"), F.lit(None).cast("string").alias("path"))
    return files.make_items(rows, files.Options(**options)).withColumnRenamed("ordinal", "doc_id")


def _string(json_text):
    """What a JSON string stands for."""
    return F.from_json(F.concat(F.lit("["), json_text, F.lit("]")), "array<string>")[0]


@query("SELECT doc_id, 'documents:' || doc_id || ':' || i AS label, lines[i] AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i) WHERE regexp_matches(lines[i], '[^ \\t\\r\\f\\v]')")
def line_items(spark, sf):
    return _items(spark, sf, each="line", budget=1 << 30).select("doc_id", "label", _string(F.col("value")).alias("value"))


@query("WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM l WHERE regexp_matches(line, '[^ \\t\\r\\f\\v]')) SELECT doc_id, min(i)::INTEGER AS first_line, max(i)::INTEGER AS last_line, string_agg(line, chr(10) ORDER BY i) AS value FROM g GROUP BY doc_id, isle")
def paragraph_items(spark, sf):
    lines = F.split(F.get_json_object("state", "$.lines"), "-")
    return _items(spark, sf, each="paragraph").select("doc_id", lines[0].cast("int").alias("first_line"), lines[1].cast("int").alias("last_line"), _string(F.col("value")).alias("value"))


@query("SELECT doc_id, octet_length(encode(text)) + length(regexp_replace(text, '[^\"\\\\\\n\\r\\t]', '', 'g')) + 5 * length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f<>&]', '', 'g')) AS json_size, CASE WHEN length(text) > 20 THEN left(text, 19) || '…' ELSE text END AS short FROM documents")
def text_functions(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.json_size(t).cast("long").alias("json_size"), text.truncate(t, 20).alias("short"))


@query(sql("SELECT doc_id, round_even(relevant * 100, 0)::INTEGER || '%' AS percent, 'doc' || doc_id || '.txt' AS file, (doc_id + 1)::INTEGER AS line FROM c"))
def percent_and_location(spark, sf):
    loc = text.location(F.concat(F.lit("doc"), "doc_id", F.lit(".txt:"), F.col("doc_id") + 1))
    return answered(spark, sf, "relevant").select("doc_id", text.percent(F.col("relevant.noul")).alias("percent"), loc["file"].alias("file"), loc["line"].alias("line"))


# The scorer through Python, and a whole run


@query(sql("SELECT doc_id, relevant, choice, round(score, 9) AS score, 'hash-1' AS model FROM c"))
def score_in_python(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("state"))
    out = score(docs, TRIAGE.questions, HashScorer())
    a = F.col("answers")
    return out.select("doc_id", a["relevant"]["noul"].alias("relevant"), a["queue"]["choice"].alias("choice"), r9(a["impact"]["score"]).alias("score"), "model")


@query(sql("SELECT count(*) AS items, count_if(relevant >= 0.6) AS flagged, count_if(bug >= 0.5 OR score >= 3) AS matched, 0::BIGINT AS failed FROM c"))
def run_summary(spark, sf):
    df = verdicts.verdicts(answered(spark, sf), FLAGS, MATCHES, list(TRIAGE.questions))
    return df.agg(F.count("*").alias("items"), F.count_if("flagged").alias("flagged"), F.count_if("matched").alias("matched"), F.count_if(F.col("relevant").isNull()).alias("failed"))


@query("SELECT lang, count(*) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) GROUP BY lang")
def limit_in_order(spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").limit(100).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('sample|' || doc_id), doc_id LIMIT 100")
def sample_fixed_seed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat(F.lit("sample|"), "doc_id").cast("binary")), "doc_id").limit(100)


# Sources and sinks over the test tables


@query("SELECT doc_id, 'documents:' || doc_id || ':1' AS label, json_object('id', doc_id, 'lang', lang) AS state FROM documents")
def jsonl_records(spark, sf):
    """One JSON line for each document, read back as items by the same code that reads files."""
    return _items(spark, sf, "jsonl", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang"))).select("doc_id", "label", "state")


@query("SELECT doc_id, count(*) AS parts FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def lines_of_documents(spark, sf):
    return _items(spark, sf, each="line", budget=1 << 30).groupBy("doc_id").agg(F.count("*").alias("parts"))


@query("SELECT doc_id, length(replace(text, chr(10), '')) AS kept FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def split_parts(spark, sf):
    """Documents cut into parts of 1,024 JSON bytes: none is larger, and no character but line ends is lost."""
    from ..sources import split
    from ..sources.batches import flat_map

    docs = table(spark, sf, "documents").where("trim(BOTH ' \n' FROM text) <> ''")
    parts = flat_map(docs, ["doc_id"], ["text"], lambda t: [(len(x.replace("\n", "")), split.json_size(x)) for *_, x in split.split(t.split("\n"), 1024)], "kept int, size int")
    return parts.groupBy("doc_id").agg(F.sum("kept").alias("kept"), F.max("size").alias("size")).where("size <= 1024").drop("size")


_SECTIONS = "(SELECT doc_id, unnest(range(doc_id % 4 + 1)) AS i FROM documents)"


@query(f"SELECT doc_id, 'documents:' || doc_id || '#s' || i AS label, array_to_string(list_transform(range(i + 1), lambda k: 'S' || k), ' > ') AS path, 'text ' || doc_id || ' ' || i AS value FROM {_SECTIONS}")
def markdown_sections(spark, sf):
    """A Markdown file for each document, of nested sections, read as items."""
    n = (F.col("doc_id") % 4).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" S"), i, F.lit("\n\ntext "), F.col("doc_id"), F.lit(" "), i, F.lit("\n"))), "\n")
    return _items(spark, sf, "markdown", text, each="section").select("doc_id", "label", F.get_json_object("state", "$.section").alias("path"), _string(F.col("value")).alias("value"))


# The documents as source files, one function or more each; the language follows the id.
_PER = "unnest(range(doc_id % 3 + 1)) AS u(i)"


def _repeat(*parts):
    """Text for i = 0, 1, ... up to doc_id % 3."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat(*(i if p is None else F.lit(p) if isinstance(p, str) else p for p in parts))), "")


def _code(spark, sf):
    one = F.col("doc_id")
    k = one % 4
    python = _repeat("def f", None, "(a):\n    return a + ", one, "\n\n")
    go = F.concat(F.lit("package p\n\n"), _repeat("func F", None, "(a int) int {\n\treturn a\n}\n\n"))
    ts = _repeat("export function g", None, "(x: number): number {\n  return x;\n}\n\n")
    java = F.concat(F.lit("class D {\n"), _repeat("  int m", None, "(int x) {\n    return x;\n  }\n"), F.lit("}\n"))
    ext = F.when(k == 0, "py").when(k == 1, "go").when(k == 2, "ts").otherwise("java")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), one, F.lit("."), ext).alias("path"), F.when(k == 0, python).when(k == 1, go).when(k == 2, ts).otherwise(java).alias("text"))


@query(f"SELECT 'd' || doc_id || ['.py', '.go', '.ts', '.java'][doc_id % 4 + 1] AS path, ['f', 'F', 'g', 'D.m'][doc_id % 4 + 1] || i AS function, ([1, 3, 1, 2][doc_id % 4 + 1] + i * [3, 4, 4, 3][doc_id % 4 + 1])::INTEGER AS first_line, ([2, 5, 3, 4][doc_id % 4 + 1] + i * [3, 4, 4, 3][doc_id % 4 + 1])::INTEGER AS last_line FROM documents, {_PER}")
def functions_by_language(spark, sf):
    from ..sources import diff
    from ..sources.batches import flat_map

    rows = flat_map(_code(spark, sf), ["path"], ["path", "text"], diff.function_rows, diff.FUNCTION_ROWS)
    return rows.select("path", "function", F.col("start").alias("first_line"), F.col("end").alias("last_line"))


def _hunks(spark, sf):
    """A diff for each document whose file is Python: the last function returns something else."""
    from ..sources import diff

    i, path = (F.col("doc_id") % 3).cast("int"), F.concat(F.lit("d"), "doc_id", F.lit(".py"))
    at = 3 * i + 1
    text = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -"), at, F.lit(",2 +"), at, F.lit(",2 @@\n def f"), i, F.lit("(a):\n-    return a\n+    return a + "), "doc_id", F.lit("\n"))
    return diff.read_hunks(spark, table(spark, sf, "documents").where("doc_id % 4 = 0").select(text.alias("value")))


@query("SELECT 'd' || doc_id || '.py' AS name, (3 * (doc_id % 3) + 2)::INTEGER AS line, '    return a + ' || doc_id AS text FROM documents WHERE doc_id % 4 = 0")
def added_lines(spark, sf):
    from ..sources import diff

    return diff.added_lines(_hunks(spark, sf))


@query("SELECT 'd' || doc_id || '.py' AS name, 'f' || (doc_id % 3) AS function, (3 * (doc_id % 3) + 2)::INTEGER AS line FROM documents WHERE doc_id % 4 = 0")
def changed_functions(spark, sf):
    from ..sources import diff

    return diff.changed_functions(_hunks(spark, sf), _code(spark, sf).where("path LIKE '%.py'").select("path", "text"))


@query(sql("SELECT 'doc' || doc_id AS source, 'complete' AS status, CASE WHEN relevant >= 0.6 THEN 'true' ELSE 'false' END AS flagged, CASE WHEN bug >= 0.5 OR score >= 3 THEN 'true' ELSE 'false' END AS matched, choice AS queue, '' AS error FROM c"))
def csv_output(spark, sf):
    from .. import sinks

    df = verdicts.verdicts(answered(spark, sf), FLAGS, MATCHES, list(TRIAGE.questions))
    df = df.withColumns({"source": F.concat(F.lit("doc"), "doc_id"), "status": F.lit("complete"), "error": F.lit(None).cast("string")})
    return sinks.csv_cells(df, TRIAGE.questions).select("source", "status", "flagged", "matched", "queue", "error")


@query(sql("SELECT '::' || CASE WHEN relevant >= 0.6 THEN 'warning' ELSE 'notice' END || ' file=doc' || doc_id || '.txt,line=1' AS place, count(*) AS n FROM c WHERE relevant >= 0.6 OR bug >= 0.5 OR score >= 3 GROUP BY place"))
def annotation_places(spark, sf):
    from .. import sinks

    df = verdicts.verdicts(answered(spark, sf), FLAGS, MATCHES, list(TRIAGE.questions))
    df = df.withColumns({"source": F.concat(F.lit("doc"), "doc_id", F.lit(".txt:1")), "status": F.lit("complete"), "error": F.lit(None).cast("string")})
    return sinks.annotations(df, TRIAGE.questions).groupBy(F.regexp_extract("value", r"^(::\w+ file=[^:]*)::", 1).alias("place")).agg(F.count("*").alias("n"))


@query(sql("SELECT 'w' || (doc_id % 7) AS request_id, count_if(relevant >= 0.6) > 0 AS flagged, count(*) AS checked FROM c GROUP BY request_id"))
def sticky_marks(spark, sf):
    from ..streaming import collector

    v = answered(spark, sf, "relevant").select(F.concat(F.lit("w"), F.col("doc_id") % 7).alias("request_id"), F.col("doc_id").alias("seq"), (F.col("relevant.noul") >= 0.6).alias("flagged"), F.lit("x").alias("text"))
    m = collector.marks(v)
    return m.select("request_id", "flagged", F.size(F.split("texts", "; ")).cast("long").alias("checked"))


@query("SELECT user_id AS session, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def session_log(spark, sf):
    from ..streaming import collector

    j = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"))
    return collector.session_log(j, 5).select("session", F.col("at").alias("event_id"))


@query("SELECT event_id // 3 AS item, 3::INTEGER AS parts, CASE WHEN count_if(event_type = 'error') > 0 THEN 'failed' ELSE 'complete' END AS status FROM events GROUP BY item HAVING count(*) = 3")
def stream_part_collector(spark, sf):
    """events as a stream of parts, three to an item, collected in state."""
    from ..streaming import collector

    where = store.fresh_dir(spark, "stream")
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf)
    status = F.when(F.col("event_type") == "error", "failed").otherwise("complete")
    parts = stream.select(F.expr("event_id div 3").alias("item"), (F.col("event_id") % 3 + 1).cast("int").alias("n"), F.lit(3).alias("of"), F.lit(1).alias("size"), status.alias("status"), F.lit(0.5).alias("noul"))
    q = collector.collect_parts(parts).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(collector.COLLECTED).parquet(f"{where}/out").select("item", "parts", "status")


_CALLS = (
    "p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey % 25 = 0), "
    "o AS (SELECT s, l_orderkey AS o, min('p' || p) AS p FROM lineitem JOIN p ON l_partkey = p.p GROUP BY s, l_orderkey), "
    "c AS (SELECT s, o_custkey AS c, min(['o' || o, p]) AS op FROM o JOIN orders ON o_orderkey = o GROUP BY s, o_custkey)"
)


@query(f"WITH {_CALLS} SELECT 's' || s AS site, 'c' || c || '>' || op[1] || '>' || op[2] || '>s' || s AS path, 3::INTEGER AS length FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY ['c' || c, op[1], op[2]]) <= 3")
def call_paths(spark, sf):
    """Customers call orders, orders parts, parts suppliers: paths to every 25th supplier from customers."""
    from ..operators import paths

    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    node = lambda mark, c: F.concat(F.lit(mark), c)
    edges = l.select(node("p", "l_partkey").alias("caller"), node("s", "l_suppkey").alias("callee"))
    edges = edges.unionByName(l.select(node("o", "l_orderkey").alias("caller"), node("p", "l_partkey").alias("callee")))
    edges = edges.unionByName(o.select(node("c", "o_custkey").alias("caller"), node("o", "o_orderkey").alias("callee"))).distinct()
    sites = l.where("l_suppkey % 25 = 0").select(node("s", "l_suppkey").alias("site")).distinct().withColumn("node", F.col("site"))
    entries = o.select(node("c", "o_custkey").alias("node")).distinct()
    return paths.bounded_paths(edges, sites, entries, 3, 3).select("site", F.array_join("path", ">").alias("path"), "length")


@query(sql(f", {_RANKED} SELECT doc_id, position, round(position / (SELECT count(*) FROM r), 9) AS percentile FROM r JOIN labels USING (doc_id) WHERE toxic = 1").replace(") , r AS", "), r AS"))
def label_positions(spark, sf):
    found = rank.positions_of(_ranked(spark, sf), table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "position", ["doc_id"])
    return found.withColumn("percentile", r9(F.col("percentile")))


@query(sql("SELECT count(*) AS n, round(avg(abs(relevant - bug)), 9) AS mean_diff, round(max(abs(relevant - bug)), 9) AS max_diff, count_if(abs(relevant - bug) > 0.2) AS n_large FROM c WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0"))
def joined_runs(spark, sf):
    """Two runs that have some inputs in common."""
    df = answered(spark, sf, "relevant", "queue").select(F.col("doc_id").alias("input"), "source", F.col("relevant.noul").alias("p"), dist.prob(F.col("queue.probs"), "bug").alias("q"))
    both = metrics.join_runs(df.where("input % 3 <> 0"), df.where("input % 5 <> 0").select("input", "source", F.col("q").alias("p")), "p")
    d = metrics.run_difference(both, "a", "b")
    return d.withColumns({c: r9(F.col(c)) for c in ("mean_diff", "max_diff")})


@query(sql("SELECT lang || '/' || source || '/d.txt' AS path, 'M.f' || doc_id AS function, relevant, quality FROM c JOIN labels USING (doc_id)"))
def suffix_labels(spark, sf):
    """Labels name the end of a path and a bare function."""
    df = answered(spark, sf, "relevant")
    scored = df.select(F.concat_ws("/", "lang", "source", F.lit("d.txt")).alias("path"), F.concat(F.lit("M.f"), "doc_id").alias("function"), F.col("relevant.noul").alias("relevant"))
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    labels = labels.select(F.concat_ws("/", "source", F.lit("d.txt")).alias("suffix"), F.concat(F.lit("f"), "doc_id").alias("name"), "quality")
    return metrics.label_scores(scored, labels).select("path", "function", "relevant", "quality")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def relational_smoke(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))
