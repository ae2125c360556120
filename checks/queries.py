"""One query per operator, each over whole tables and whole texts, with flat result columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from checks import inputs, streams
from quietgate import fixed_values as v
from quietgate.functions.text import exploded, forms_of
from quietgate.operators import (
    audit, behavior, encoding, grounding, injection, moderation, pii, policy, rate_limit, redaction, topics, toxicity,
    validation,
)
from quietgate.plans import evidence, pairing, scan
from quietgate.sources import audit_sink, rules_json

C = F.col
LIMITS = behavior.Limits(seconds=7 * 86400, volume_threshold=20)
RATES = rate_limit.Settings({"normal": 5, "warning": 3, "restricted": 1}, 86400, slice_windows=4)
CUSTOM_RULES = [
    {"name": "double_the", "category": "custom", "pattern": r"\bthe\s+the\b"},
    {"name": "broken", "category": "custom", "pattern": r"(unclosed"},
    {"name": "ends_tion", "category": "custom", "pattern": r"\bth\w{2,4}tion\b"},
]
CUSTOM_PII = {
    "EMAIL": [{"pattern": r"\bat\s[a-z]{2,6}\b", "confidence": 0.4}],
    "TICKET": [{"pattern": r"\bthe\s[a-z]{3}\b"}],
}
FILE_POLICIES = {"policies": [
    {"name": "words", "action": "warn", "severity": "low", "rules": [
        {"rule_type": "keyword", "description": "has of or der", "keywords": ["of the", "der die"]},
        {"rule_type": "regex", "description": "long word", "pattern": r"\b[a-z]{18,}\b"}]},
    {"name": "defaults", "rules": [{"rule_type": "keyword", "description": "bomb", "keywords": ["Bomb"]}]},
    {"name": "off", "enabled": False, "rules": [{"rule_type": "keyword", "description": "never", "keywords": ["e"]}]},
]}
ALLOWED_TOPICS = ["python programming", "machine learning with the data", "thought leadership"]
BLOCKED_TOPICS = ["weapons manufacturing", "drug synthesis"]
FORMAT = {"type": "json", "required_fields": ["k", "name"], "max_length": 8, "min_length": 8, "pattern": r"[5-9]\d?\}",
          "must_not_contain": ["\"K\": 1", "42"]}


def topic_vectors(n: int = 4, size: int = 64) -> list[tuple[str, list[float]]]:
    """Topic vectors as parameters: topic i points along every n-th dimension."""
    return [(f"topic_{i}", [0.5 if d % n == i else -0.125 for d in range(size)]) for i in range(n)]


def joined(names: str | Column) -> Column:
    return F.array_join(names, "|")


def judge_reply(key: Column) -> Column:
    options = ['{"is_injection": true, "confidence": 0.9, "reason": "override"}', "no json",
               '{"is_injection": false, "confidence": 0.2}', None]
    out = F.lit(None).cast("string")
    for i, reply in enumerate(options):
        out = F.when(F.pmod(key, F.lit(4)) == i, F.lit(reply)).otherwise(out)
    return out


def toxicity_reply(key: Column) -> Column:
    return (F.when(F.pmod(key, F.lit(3)) == 0, F.lit('{"scores": {"violence": 0.25, "harassment": 0.75}, "flagged": ["harassment"]}'))
            .when(F.pmod(key, F.lit(3)) == 1, F.lit('{"scores": {"violence": 0.5}, "overall": 0.125}'))
            .otherwise(F.lit("sorry, no")))


def claim_reply(key: Column) -> Column:
    return (F.when(F.pmod(key, F.lit(3)) == 0, F.lit('{"is_supported": true, "confidence": 0.9, "supporting_text": "matching context"}'))
            .when(F.pmod(key, F.lit(3)) == 1, F.lit('{"is_supported": false}')).otherwise(F.lit("no answer")))


# --- sources and sinks ---

def src_texts(spark, d):
    return inputs.documents(spark, d).select("doc_id", F.char_length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def src_rules_json(spark, d):
    folder = streams.work_folder(spark)
    spark.createDataFrame([(json.dumps(FILE_POLICIES),)], "value string").coalesce(1).write.text(folder)
    rules = policy.policies_of(rules_json.read_rules(spark, folder))
    return _policy_result(policy.evaluate(inputs.texts(spark, d), rules))


def sink_audit(spark, d):
    texts = inputs.texts(spark, d)
    ruled = policy.evaluate(texts, policy.preset("moderate")).withColumn("scan_ms", F.char_length("text") / F.lit(1000.0)).withColumn(
        "ts", F.timestamp_seconds(C("doc_id")))
    log = audit.records(ruled.select(
        "ts", "doc_id", "source", C("policy.action").alias("action"), "text", C("policy.violations").alias("violations"), "scan_ms",
    ), "ts", "doc_id", "source", "action", "text", "violations", "scan_ms")
    folder = streams.work_folder(spark)
    audit_sink.append(log, folder)
    back = audit_sink.read(spark, folder)
    return back.select("correlation_id", "user_id", "action", "text_preview", C("violation_count").cast("bigint").alias("violation_count"),
                      joined(C("violations")["rule"]).alias("rules"), "scan_time_ms")


def src_events(spark, d):
    return inputs.behavior(spark, d).drop("ts")


# --- injection ---

def _hits(df, name):
    return df.select("doc_id", C(f"{name}.is_injection").alias("is_injection"), C(f"{name}.confidence").alias("confidence"),
                     joined(C(f"{name}.matched_patterns")).alias("patterns"))


def injection_patterns(spark, d):
    return _hits(injection.detect_patterns(inputs.texts(spark, d)), "injection")


def injection_custom_patterns(spark, d):
    rules = [*v.INJECTION_PATTERNS, *injection.usable_rules(spark, CUSTOM_RULES)[0]]
    return _hits(injection.detect_patterns(inputs.texts(spark, d), rules=rules), "injection")


def injection_category_counts(spark, d):
    return injection.category_counts(inputs.texts(spark, d))


def injection_structural(spark, d):
    return _hits(injection.detect_structural(inputs.texts(spark, d)), "structural")


def _items(df, items):
    return exploded(df, ["doc_id"], items, "pos", "i").select(
        "doc_id", C("pos").cast("bigint").alias("pos"), "i.original", "i.decoded", "i.encoding",
        C("i.start").cast("bigint").alias("start"), C("i.end").cast("bigint").alias("end"))


def decode_base64(spark, d):
    return _items(inputs.texts(spark, d).withColumn("items", encoding.base64_items(C("text"))), "items")


def decode_rot13(spark, d):
    return _items(inputs.texts(spark, d).withColumn("items", encoding.rot13_items(forms_of(C("text")))), "items")


def normalize_unicode(spark, d):
    return encoding.normalize(inputs.texts(spark, d)).select("doc_id", F.md5("normalized").alias("digest"))


def unicode_tricks(spark, d):
    found = encoding.unicode_findings(inputs.texts(spark, d))
    return found.select("doc_id", *(C(c).cast("bigint").alias(c) for c in ("homoglyphs", "invisibles", "right_to_left")),
                        "homoglyph_codes", "invisible_codes", joined("scripts").alias("scripts"),
                        F.size("findings").cast("bigint").alias("findings"))


def unicode_script_names(spark, d):
    found = encoding.unicode_findings(inputs.texts(spark, d))
    return found.select("doc_id", joined("findings").alias("findings"))


def decode_and_scan(spark, d):
    return _items(encoding.decode(inputs.texts(spark, d)), "decoded")


def injection_encoding(spark, d):
    return _hits(injection.detect_encoded(inputs.texts(spark, d)), "encoded")


def injection_detect(spark, d):
    found = injection.detect(inputs.texts(spark, d))
    return found.select(
        "doc_id", C("injection.is_injection").alias("is_injection"), C("injection.confidence").alias("confidence"),
        C("injection.method").alias("method"), joined(C("injection.matched_patterns")).alias("patterns"))


def injection_sensitivity_sweep(spark, d):
    return injection.sensitivity_sweep(inputs.texts(spark, d)).select("doc_id", "injection_low", "injection_medium", "injection_high")


def judge_merge(spark, d):
    found = injection.detect(inputs.texts(spark, d)).withColumn("reply", judge_reply(C("doc_id")))
    return injection.merge_judge(found, "reply").select(
        "doc_id", "judged.is_injection", "judged.confidence", "judged.method", "judged.reason")


# --- toxicity and content filter ---

def _scores(name):
    return [C(f"{name}.scores")[c].alias(c) for c in toxicity.CATEGORIES]


def toxicity_scores(spark, d):
    return toxicity.classify(inputs.texts(spark, d)).select("doc_id", *_scores("toxicity"))


def toxicity_flags(spark, d):
    found = toxicity.classify(inputs.texts(spark, d), threshold=0.6, category_thresholds={"harassment": 0.2, "violence": 0.9})
    return found.select("doc_id", "toxicity.overall_score", "toxicity.is_toxic", joined(C("toxicity.flagged_categories")).alias("flagged"))


def toxicity_judge_parse(spark, d):
    found = toxicity.classify(inputs.texts(spark, d)).withColumn("reply", toxicity_reply(C("doc_id")))
    return toxicity.prefer_reply(found, "reply").select(
        "doc_id", C("judged.scores")["violence"].alias("violence"), C("judged.scores")["harassment"].alias("harassment"),
        "judged.overall_score", "judged.is_toxic", joined(C("judged.flagged_categories")).alias("flagged"))


WORDS = ["damn", "crap", "shit", "the", "die"]


def profanity_spans(spark, d):
    found = moderation.profanity(inputs.texts(spark, d), words=WORDS)
    return exploded(found, ["doc_id"], "profanity", "pos", "p").select(
        "doc_id", C("pos").cast("bigint").alias("pos"), "p.matched_text", C("p.start").cast("bigint").alias("start"),
        C("p.end").cast("bigint").alias("end"))


def profanity_redact(spark, d):
    found = moderation.mask_profanity(inputs.texts(spark, d), words=WORDS)
    return found.select("doc_id", F.md5("filtered").alias("digest"), F.char_length("filtered").cast("bigint").alias("chars"))


def content_filter(spark, d):
    found = moderation.filter_content(inputs.texts(spark, d), policy=policy.preset("moderate")[2], threshold=0.35)
    return found.select(
        "doc_id", "filter.action", "filter.is_clean", F.md5("filter.filtered_text").alias("digest"),
        joined(C("filter.violations")["category"]).alias("categories"), joined(C("filter.violations")["matched_text"]).alias("matched"),
        joined(C("filter.violations")["severity"]).alias("severities"))


# --- personal data ---

def _entities(df):
    return pii.entity_table(df, ["doc_id"]).select(
        "doc_id", C("pos").cast("bigint").alias("pos"), "entity_type", "text", C("start").cast("bigint").alias("start"),
        C("end").cast("bigint").alias("end"), "confidence")


def pii_detect(spark, d):
    return _entities(pii.detect(inputs.texts(spark, d)))


def pii_names(spark, d):
    return _entities(pii.detect(inputs.texts(spark, d), entity_types=["NAME"]))


def pii_entity_filter(spark, d):
    return _entities(pii.detect(inputs.texts(spark, d), entity_types=pii.resolve_types(["SSN", "EMAIL", "nonsense"])))


def pii_custom_patterns(spark, d):
    return _entities(pii.detect(inputs.texts(spark, d), entity_types=["EMAIL", "TICKET"], custom_patterns=CUSTOM_PII))


def pii_by_type(spark, d):
    counted = pii.type_counts(pii.detect(inputs.texts(spark, d)), ["source"])
    return counted.select("source", "entity_type", C("entities").cast("bigint").alias("entities"), "texts")


def pii_grouped_entities(spark, d):
    grouped = pii.by_type(pii.detect(inputs.texts(spark, d)))
    return exploded(grouped, ["doc_id"], F.map_entries("by_type"), "pos", "e").select(
        "doc_id", C("e.key").alias("entity_type"), C("e.value").alias("found")).select(
        "doc_id", "entity_type", joined(C("found")["text"]).alias("found"))


def _redacted(strategy):
    def query(spark, d):
        return redaction.redact(inputs.texts(spark, d), strategy=strategy).select(
            "doc_id", F.size("entities").cast("bigint").alias("entities"), F.md5("redacted").alias("digest"))
    return query


def _given_spans(spark, d):
    """Spans from a table: the first and the last word of every document."""
    docs = inputs.documents(spark, d)
    size = F.char_length("text")
    one = lambda o, kind, start, end: F.struct(
        F.lit(o).cast("bigint").alias("ord"), F.lit(kind).alias("entity_type"),
        F.substring("text", start + 1, end - start).alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    first = F.least(F.lit(5), size)
    return docs.select("doc_id", F.explode(F.array(
        one(0, "HEAD", F.lit(0), first), one(1, "TAIL", F.greatest(size - 4, first), size),
    )).alias("s")).select("doc_id", "s.*").where(C("end") > C("start"))


def pii_redact_given(spark, d):
    redacted = redaction.redact_given(inputs.documents(spark, d), _given_spans(spark, d), "doc_id", strategy="placeholder")
    return redacted.select("doc_id", F.md5("redacted").alias("digest"))


def pii_redaction_map(spark, d):
    redacted = redaction.redact(inputs.texts(spark, d), strategy="placeholder")
    return redaction.mapping_table(redacted, "doc_id").withColumn("ord", C("ord").cast("bigint"))


def pii_reverse(spark, d):
    redacted = redaction.redact(inputs.texts(spark, d), strategy="placeholder", entity_types=["EMAIL", "IP_ADDRESS", "CREDIT_CARD"])
    mapping = redaction.mapping_table(redacted, "doc_id")
    restored = redaction.reverse(redacted.select("doc_id", "text", "redacted"), mapping, "doc_id")
    return restored.select("doc_id", F.md5("restored").alias("digest"), (C("restored") == C("text")).alias("same"))


def pii_reverse_placed(spark, d):
    """Hashed and anonymised texts restored from the places of their replacements."""
    redacted = pii.detect(inputs.texts(spark, d)).select("doc_id", "text", "entities")
    for strategy in ("hash", "anonymize"):
        redacted = redaction.redact_entities(redacted, "text", "entities", strategy, merge_overlaps=True, out=strategy)
    # Stored as redacted texts are, so that nothing is detected again for the places and for the second strategy.
    folder = streams.work_folder(spark)
    redacted.drop("entities").write.parquet(folder)
    stored, out = spark.read.schema(redacted.drop("entities").schema).parquet(folder), None
    for strategy in ("hash", "anonymize"):
        places = redaction.places_table(stored, "doc_id", f"{strategy}_spans")
        restored = redaction.reverse_placed(stored.select("doc_id", "text", strategy), places, "doc_id", text=strategy)
        found = restored.select("doc_id", F.lit(strategy).alias("strategy"), F.md5("restored").alias("digest"), (C("restored") == C("text")).alias("same"))
        out = found if out is None else out.unionByName(found)
    return out


# --- policies ---

def _policy_result(df):
    return df.select(
        "doc_id", "policy.passed", "policy.action", "policy.severity", joined(C("policy.violations")["rule"]).alias("rules"),
        joined(C("policy.violations")["matched_text"]).alias("matched"))


def _with_rules(*rules, **more):
    return [policy.Policy("p", tuple(rules), **more)]


def rule_regex(spark, d):
    rules = _with_rules(policy.Rule("regex", "ending", r"th\w+tion\b"), policy.Rule("regex", "card", r"\b\d{4}[-\s]?\d{4}"))
    return _policy_result(policy.evaluate(inputs.texts(spark, d), rules))


def rule_keyword(spark, d):
    rules = _with_rules(policy.Rule("keyword", "words", keywords=("Kill", "THE the", "that")))
    return _policy_result(policy.evaluate(inputs.texts(spark, d), rules))


def rule_threshold(spark, d):
    scored = toxicity.classify(inputs.texts(spark, d)).withColumn("score", C("toxicity.overall_score"))
    found = policy.evaluate(scored, _with_rules(policy.Rule("threshold", "score", threshold=0.35)), score="score")
    return found.select("doc_id", "policy.passed", F.get(C("policy.violations")["rule"], F.lit(0)).alias("rule"),
                        F.get(C("policy.violations")["matched_text"], F.lit(0)).alias("matched"))


def rule_custom(spark, d):
    rule = policy.Rule("custom", "long text", evaluate=lambda text, _: F.when(F.char_length(text) > 2000, F.substring(text, 1, 10)))
    return _policy_result(policy.evaluate(inputs.texts(spark, d), _with_rules(rule)))


def rule_custom_batch(spark, d):
    """A rule as a function over batches: the first word that a text repeats at once, in texts with a score."""
    def repeated(texts, scores):
        found = texts.str.extract(r"\b([a-z]{3,}) \1\b", expand=False)
        return found.where(scores > 0)

    scored = toxicity.classify(inputs.texts(spark, d)).withColumn("score", C("toxicity.overall_score"))
    rule = policy.Rule("custom", "repeated word", batch=repeated)
    return _policy_result(policy.evaluate(scored, _with_rules(rule), score="score"))


def policy_evaluate(spark, d):
    return _policy_result(policy.evaluate(inputs.texts(spark, d), policy.preset("moderate")))


def policy_presets(spark, d):
    levels = policy.level_comparison(inputs.texts(spark, d))
    return levels.select("doc_id", *(C(f"{level}_violations").cast("bigint").alias(f"{level}_violations") for level in v.PRESETS),
                         *(f"{level}_{what}" for level in v.PRESETS for what in ("action", "severity")))


def policy_listing(spark, d):
    """The listing together with the number of documents each policy hits."""
    found = policy.names_hit(inputs.texts(spark, d), [p for level in v.PRESETS for p in policy.preset(level)])
    hits = exploded(found, (), "hit", "pos", "name").groupBy("name").agg(F.count("*").alias("texts"))
    return policy.listing(spark).join(hits, "name", "left").select(
        "level", "name", "description", "action", "severity", "rule_count", F.coalesce("texts", F.lit(0)).alias("texts"))


def policy_set_edit(spark, d):
    rules = policy.without_policy(policy.preset("moderate"), "moderate_pii_protection")
    rules = policy.switched(rules, "moderate_topic_enforcement", False)
    rules = policy.with_policy(rules, policy.Policy("extra", (policy.Rule("keyword", "extra words", keywords=("skill", "that")),), "warn", "medium"))
    table = policy.rules_table(spark, rules)
    return _policy_result(policy.evaluate(inputs.texts(spark, d), policy.policies_of(table)))


# --- grounding and output checks ---

def extract_claims(spark, d):
    claims = exploded(inputs.texts(spark, d), ["doc_id"], grounding.claims_of(C("text")), "claim_no", "claim")
    return claims.select("doc_id", C("claim_no").cast("bigint").alias("claim_no"), "claim")


def _verified(spark, d):
    return evidence.verify_turns(inputs.answers(spark, d), inputs.turns(spark, d))


def verify_claims(spark, d):
    claims = grounding.claim_table(_verified(spark, d), ["conv_id", "turn"])
    return claims.select("conv_id", "turn", C("claim_no").cast("bigint").alias("claim_no"), "claim", "is_supported", "confidence")


def supporting_snippet(spark, d):
    claims = grounding.claim_table(_verified(spark, d), ["conv_id", "turn"])
    return claims.where("is_supported").select("conv_id", "turn", C("claim_no").cast("bigint").alias("claim_no"), "supporting_context")


def hallucination_score(spark, d):
    scored = grounding.score(_verified(spark, d))
    counts = ("total_claims", "supported_claims", "unsupported_claims")
    return scored.select("conv_id", "turn", *(C(f"hallucination.{c}").cast("bigint").alias(c) for c in counts),
                         "hallucination.hallucination_score", "hallucination.has_hallucinations")


def claim_judge_merge(spark, d):
    claims = grounding.claim_table(_verified(spark, d), ["conv_id", "turn"]).withColumn(
        "reply", claim_reply(C("conv_id") + C("claim_no")))
    merged = grounding.merge_judge(claims, "reply")
    return merged.select("conv_id", "turn", C("claim_no").cast("bigint").alias("claim_no"), "is_supported", "confidence", "supporting_context")


def check_relevance(spark, d):
    pairs = inputs.answers(spark, d).withColumn("relevance", validation.relevance_of(C("prompt"), C("output")))
    return pairs.select("conv_id", "turn", "relevance", F.size(validation.relevance_issues(C("relevance"))).cast("bigint").alias("issues"))


def check_safety(spark, d):
    checked = validation.validate(inputs.answers(spark, d), context=None, toxicity_threshold=0.35)
    issues = F.filter(C("validation.issues"), lambda i: i["issue_type"] == "unsafe")
    return checked.select("conv_id", "turn", joined(issues["description"]).alias("unsafe"), joined(issues["severity"]).alias("severities"))


def check_grounding(spark, d):
    rows = inputs.generations(spark, d).where(C("context").isNotNull() | C("known").isNotNull())
    grounded = rows.withColumn("g", validation.grounding_of(C("output"), C("context"), known=C("known")))
    return grounded.select("conv_id", "turn", C("g.sentences").cast("bigint").alias("sentences"), C("g.ungrounded").cast("bigint").alias("ungrounded"),
                           C("g.share").alias("share"), F.size(validation.grounding_issues(C("g"))).cast("bigint").alias("issues"))


def check_format(spark, d):
    props = inputs.table(spark, d, "events", "event_id", "props", "event_type")
    output = F.when(C("event_type") == "error", F.concat("props", F.lit(" x"))).when(C("event_type") == "view", F.lit("[1]")).otherwise(C("props"))
    issues = props.withColumn("issues", validation.format_issues(output, FORMAT))
    return issues.select("event_id", joined(C("issues")["description"]).alias("issues"), joined(C("issues")["severity"]).alias("severities"))


def output_validate(spark, d):
    checked = validation.validate(inputs.generations(spark, d), expected={"min_length": 120, "must_not_contain": ["bomb"]}, known="known")
    return checked.select("conv_id", "turn", "validation.is_valid", joined(C("validation.issues")["issue_type"]).alias("issues"),
                          joined(C("validation.issues")["severity"]).alias("severities"))


def _topics(mode):
    def query(spark, d):
        found = topics.check(inputs.texts(spark, d), allowed=ALLOWED_TOPICS, blocked=BLOCKED_TOPICS, mode=mode)
        return found.select("doc_id", "topic.is_on_topic", "topic.detected_topic", "topic.similarity_score",
                            "topic.closest_allowed_topic", joined(C("topic.matched_keywords")).alias("matched"))
    return query


def topic_semantic(spark, d):
    vectors = inputs.table(spark, d, "embeddings", "vec_id", "embedding")
    found = topics.semantic(vectors, "embedding", topic_vectors())
    return found.select("vec_id", "topic.is_on_topic", "topic.detected_topic", F.round("topic.similarity_score", 6).alias("score"),
                        "topic.closest_allowed_topic")


# --- whole scans ---

def _decision(df, name, key="doc_id"):
    found = C(f"{name}.violations")
    return [C(f"{name}.is_safe").alias("is_safe"), C(f"{name}.action").alias("action"), joined(found["rule"]).alias("rules"),
            joined(found["matched_text"]).alias("matched"), joined(found["severity"]).alias("severities"),
            F.md5(C(f"{name}.processed_text")).alias("digest")]


def scan_all(spark, d):
    found = scan.scan(inputs.texts(spark, d))
    return found.select("doc_id", *_decision(found, "scan"), "scan.injection_score", "scan.toxicity_score", "scan.injection_method",
                        joined(C("scan.flagged_categories")).alias("flagged"))


def guard_input(spark, d):
    found = scan.guard_input(inputs.texts(spark, d))
    return found.select("doc_id", *_decision(found, "guard"))


def guard_output(spark, d):
    found = scan.guard_output(inputs.generations(spark, d), known="known")
    return found.select("conv_id", "turn", *_decision(found, "guard"), C("guard.validation_issues").cast("bigint").alias("issues"))


def request_log_guard(spark, d):
    pages = inputs.table(spark, d, "pages", "page_id", "url", "html")
    log = pages.select(
        "page_id", F.concat(F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("/")).otherwise(F.lit("/api/")), F.regexp_extract("url", "//[^/]*/(.*)", 1)).alias("path"),
        F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT"))), (F.pmod("page_id", F.lit(5)) % 3 + 1).cast("int")).alias("method"),
        inputs.planted(C("html"), C("page_id")).alias("body"))
    found = scan.guard_requests(inputs.spread(log))
    return found.select("page_id", "guard.score", "guard.action", "guard.scanned")


def corpus_report(spark, d):
    report = scan.corpus_report(scan.scan(inputs.texts(spark, d)), ["source"])
    return report.select("source", "action", "texts", "mean_injection", "mean_toxicity")


def corpus_rules(spark, d):
    return scan.rule_report(scan.scan(inputs.texts(spark, d)), ["lang"])


# --- behaviour and limits ---

def user_history(spark, d):
    return behavior.history(inputs.behavior(spark, d), LIMITS).select("user_id", "event_id", "n", "n_injection", "n_toxic", "n_blocked")


def user_history_by_rows(spark, d):
    few = behavior.Limits(max_rows=12, seconds=7 * 86400)
    return behavior.history(inputs.behavior(spark, d), few).select("user_id", "event_id", "n", "n_injection", "n_toxic", "n_blocked")


def user_risk(spark, d):
    return behavior.with_risk(behavior.history(inputs.behavior(spark, d), LIMITS)).select("user_id", "event_id", "risk_score")


def user_risk_as_of(spark, d):
    return behavior.risk_as_of(inputs.behavior(spark, d), "2024-01-20 12:00:00", LIMITS).select("user_id", "n", "risk_score")


def _abuse(kind):
    def query(spark, d):
        found = behavior.detect_one(inputs.behavior(spark, d), kind, LIMITS)
        return found.select("user_id", "event_id", "abuse.abuse_type", "abuse.confidence", "abuse.action")
    return query


ABUSE_COLUMNS = ("user_id", "event_id", "n", "risk_score", "is_abusive", "abuse_type", "abuse_confidence", "recommended_action")


def abuse_detect(spark, d):
    return behavior.detect(inputs.behavior(spark, d), LIMITS).select(*ABUSE_COLUMNS)


def abuse_stream(spark, d):
    return streams.abuse(spark, d, LIMITS).select(C("user_id").cast("bigint").alias("user_id"), *ABUSE_COLUMNS[1:])


def abuse_stream_batches(spark, d):
    return streams.abuse_batches(spark, d, LIMITS).select(C("user_id").cast("bigint").alias("user_id"), *ABUSE_COLUMNS[1:])


def _limit_columns(df):
    return df.select(C("user_id").cast("bigint").alias("user_id"), "event_id", "allowed", C("remaining").cast("bigint").alias("remaining"),
                     C("limit").cast("bigint").alias("limit"), "tier", F.unix_micros(C("reset_time")).alias("reset_us"), "retry_after")


def rate_limit_checks(spark, d):
    return _limit_columns(rate_limit.check(inputs.limiter(spark, d), RATES))


def user_tier(spark, d):
    found = rate_limit.tiers(inputs.limiter(spark, d), RATES)
    return found.select("user_id", "event_id", "epoch", "warning_count", "block_count", "tier")


def rate_limit_stream(spark, d):
    return _limit_columns(streams.rate_limits(spark, d, RATES))


def rate_limit_stream_batches(spark, d):
    return _limit_columns(streams.rate_limit_batches(spark, d, RATES))


def scan_stream(spark, d):
    log = streams.scans(spark, d)
    return log.select("correlation_id", "action", C("violation_count").cast("bigint").alias("violation_count"),
                      joined(C("violations")["rule"]).alias("rules"))


# --- audit ---

def audit_stats(spark, d):
    return audit.stats(inputs.audit_log(spark, d))


def audit_tail(spark, d):
    return audit.tail(inputs.audit_log(spark, d)).select("correlation_id", "user_id", "action", "scan_time_ms")


def service_metrics(spark, d):
    return audit.metrics(inputs.audit_log(spark, d))


# --- pairing ---

def pair_turns(spark, d):
    return pairing.pair_turns(inputs.turns(spark, d))


def attach_context(spark, d):
    return pairing.attach_context(inputs.turns(spark, d), last=3).select("conv_id", "turn", "role", "context")


def attach_document(spark, d):
    docs = inputs.table(spark, d, "documents", "doc_id", "text")
    pairs = pairing.pair_turns(inputs.turns(spark, d))
    joined_ = pairing.attach_document(pairs, docs, "conv_id")
    return joined_.select("conv_id", "turn", F.md5("context").alias("context_digest"), validation.relevance_of(C("prompt"), C("output")).alias("relevance"))


QUERIES = {
    "src_texts": src_texts, "src_rules_json": src_rules_json, "sink_audit": sink_audit, "src_events": src_events,
    "injection_patterns": injection_patterns, "injection_custom_patterns": injection_custom_patterns,
    "injection_category_counts": injection_category_counts, "injection_structural": injection_structural,
    "decode_base64": decode_base64, "decode_rot13": decode_rot13, "normalize_unicode": normalize_unicode,
    "unicode_tricks": unicode_tricks, "unicode_script_names": unicode_script_names, "decode_and_scan": decode_and_scan,
    "injection_encoding": injection_encoding, "injection_detect": injection_detect,
    "injection_sensitivity_sweep": injection_sensitivity_sweep, "judge_merge": judge_merge,
    "toxicity_scores": toxicity_scores, "toxicity_flags": toxicity_flags, "toxicity_judge_parse": toxicity_judge_parse,
    "profanity_spans": profanity_spans, "profanity_redact": profanity_redact, "content_filter": content_filter,
    "pii_detect": pii_detect, "pii_names": pii_names, "pii_entity_filter": pii_entity_filter,
    "pii_custom_patterns": pii_custom_patterns, "pii_by_type": pii_by_type, "pii_grouped_entities": pii_grouped_entities,
    **{f"pii_redact_{s}": _redacted(s) for s in redaction.STRATEGIES},
    "pii_redact_given": pii_redact_given, "pii_redaction_map": pii_redaction_map, "pii_reverse": pii_reverse,
    "pii_reverse_placed": pii_reverse_placed,
    "rule_regex": rule_regex, "rule_keyword": rule_keyword, "rule_threshold": rule_threshold, "rule_custom": rule_custom,
    "rule_custom_batch": rule_custom_batch,
    "policy_evaluate": policy_evaluate, "policy_presets": policy_presets, "policy_listing": policy_listing,
    "policy_set_edit": policy_set_edit,
    "extract_claims": extract_claims, "verify_claims": verify_claims, "supporting_snippet": supporting_snippet,
    "hallucination_score": hallucination_score, "claim_judge_merge": claim_judge_merge, "check_relevance": check_relevance,
    "check_safety": check_safety, "check_grounding": check_grounding, "check_format": check_format,
    "output_validate": output_validate, "topic_check": _topics("permissive"), "topic_check_strict": _topics("strict"),
    "topic_semantic": topic_semantic,
    "scan": scan_all, "guard_input": guard_input, "guard_output": guard_output, "request_log_guard": request_log_guard,
    "corpus_report": corpus_report, "corpus_rules": corpus_rules,
    "user_history": user_history, "user_history_by_rows": user_history_by_rows, "user_risk": user_risk,
    "user_risk_as_of": user_risk_as_of,
    **{f"abuse_{short}": _abuse(kind) for short, kind in (
        ("repeated_injection", "repeated_injection"), ("volume", "volume_abuse"), ("escalation", "escalation"),
        ("jailbreak", "jailbreak_sequence"))},
    "abuse_detect": abuse_detect, "abuse_stream": abuse_stream,
    "abuse_stream_batches": abuse_stream_batches, "rate_limit_stream_batches": rate_limit_stream_batches, "rate_limit": rate_limit_checks, "user_tier": user_tier,
    "rate_limit_stream": rate_limit_stream, "scan_stream": scan_stream,
    "audit_stats": audit_stats, "audit_tail": audit_tail, "service_metrics": service_metrics,
    "pair_turns": pair_turns, "attach_context": attach_context, "attach_document": attach_document,
}
