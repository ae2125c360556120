"""The queries of ``checks.queries`` written again as SQL for DuckDB, from the same fixed values.

Written from the rules, not from the Spark code: spans by summing lengths, folds as recursive
queries, histories as self joins.  ``e0`` keeps literals DOUBLE, sums keep catalogue order.
"""

from __future__ import annotations

import codecs

from checks import queries as q
from checks.plants import planted_sql, sql_text as s
from quietgate import fixed_values as v
from quietgate.functions.text import WHITESPACE
from quietgate.operators.encoding import script_class, script_ranges

WS = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
DOCS = f"docs AS (SELECT doc_id, source, lang, {planted_sql('text', 'doc_id')} AS text FROM documents)"


def num(x: float) -> str:
    return f"{float(x)!r}e0"


def strip(x: str) -> str:
    return f"trim({x}, {s(WHITESPACE)})"


def matches(text: str, pattern: str, flags: str = "i-s") -> str:
    return f"regexp_matches({text}, {s(f'(?{flags}){pattern}')})"


def present(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}]::VARCHAR[], lambda x: x IS NOT NULL)"


def pipe(x: str) -> str:
    return f"array_to_string({x}, '|')"


def hits(text: str, rules, prefix: str = "", flags: str = "im-s") -> str:
    return present([f"CASE WHEN {matches(text, p, flags)} THEN {s(prefix + n)} END" for n, p in rules])


def stepped(n: str, base: float, step: float) -> str:
    return f"CASE WHEN {n} > 0 THEN least(1e0, {num(base)} + {n} * {num(step)}) ELSE 0e0 END"


INJECTION = [(n, p) for n, _, p in v.INJECTION_PATTERNS]
CUSTOM = INJECTION + [(r["name"], r["pattern"]) for r in q.CUSTOM_RULES if r["name"] != "broken"]
MARKERS = [(f"structural:{m}", m) for m in v.STRUCTURAL_MARKERS]


def spans(source: str, keys: str, text: str, pattern: str, ord_: int = 0) -> str:
    """Matches with offsets, from the text pieces around them."""
    p = s(pattern)
    return (
        f"SELECT {keys}, {ord_} AS ord, m[i] AS hit, i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start FROM (SELECT {keys}, "
        f"regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {source}), "
        "unnest(range(1, len(m) + 1)) u(i)")


# --- encoded content ---
HOMO, INV = "".join(v.HOMOGLYPHS), v.INVISIBLE
NORMALIZED = f"translate(text, {s(HOMO + INV)}, {s(''.join(v.HOMOGLYPHS.values()))})"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + LETTERS.upper()
BASE64 = (
    f"b64 AS (SELECT doc_id, 0 AS grp, i, hit AS original, decoded, 'base64' AS encoding, start, start + length(hit) AS \"end\" FROM ("
    f"SELECT *, try(decode(from_base64(hit || repeat('=', (4 - length(hit) % 4) % 4)))) AS decoded FROM ("
    f"{spans('docs', 'doc_id', 'text', v.BASE64_RUN)})) WHERE length(decoded) >= 4 AND "
    r"regexp_full_match(decoded, '[\p{L}\p{M}\p{N}\p{P}\p{S} ]*'))")
ROT = "(?i)" + v.ROT13_MARKER
ROT13 = (
    f"rot AS (SELECT doc_id, 1 AS grp, i, {strip('tail')} AS original, translate({strip('tail')}, '{ALPHABET}', "
    f"'{codecs.encode(ALPHABET, 'rot_13')}') AS decoded, 'rot13' AS encoding, start + length(hit) - length(tail) AS start, "
    f"start + length(hit) AS \"end\" FROM (SELECT *, regexp_extract(hit, {s(ROT)}, 1) AS tail FROM ({spans('docs', 'doc_id', 'text', ROT)})))")
DISGUISED = (
    f"uni AS (SELECT doc_id, 2 AS grp, 1 AS i, substr(text, 1, 100) AS original, substr({NORMALIZED}, 1, 100) AS decoded, "
    f"'unicode_normalization' AS encoding, 0::BIGINT AS start, 0::BIGINT AS \"end\" FROM docs WHERE {NORMALIZED} <> text)")
ITEMS = f"{DOCS}, {BASE64}, {ROT13}, {DISGUISED}, items AS (SELECT * FROM b64 UNION ALL SELECT * FROM rot UNION ALL SELECT * FROM uni)"
ENCODED = (
    f"{ITEMS}, enc AS (SELECT doc_id, count(*) AS n, flatten(list(found ORDER BY grp, i)) AS names FROM (SELECT doc_id, grp, i, "
    f"{hits('decoded', INJECTION, 'encoded:', 'i-s')} AS found FROM items) GROUP BY doc_id)")
LAYERS = (
    f"{ENCODED}, layers AS (SELECT d.doc_id, d.text, {hits('text', INJECTION)} AS p, {hits('text', MARKERS)} AS m, "
    f"coalesce(e.names, []::VARCHAR[]) AS e, coalesce(e.n, 0) AS n FROM docs d LEFT JOIN enc e USING (doc_id)), "
    f"conf AS (SELECT *, {stepped('len(p)', v.PATTERN_BASE, v.PATTERN_STEP)} AS c1, "
    f"{stepped('len(m)', v.STRUCTURAL_BASE, v.STRUCTURAL_STEP)} AS c2, "
    f"CASE WHEN len(e) > 0 THEN 0.7e0 WHEN n > 0 THEN 0.3e0 ELSE 0e0 END AS c3 FROM layers)")


def flagged(limit: float) -> str:
    x = num(limit)
    return f"((len(p) > 0 AND c1 >= {x}) OR (len(m) > 0 AND c2 >= {x}) OR (len(e) > 0 AND c3 >= {x}))"


INJECTED = (
    f"{LAYERS}, inj AS (SELECT doc_id, text, {flagged(0.5)} AS is_injection, greatest(c1, c2, c3) AS confidence, "
    "CASE WHEN greatest(c1, c2, c3) = 0 THEN NULL WHEN c1 >= greatest(c2, c3) THEN 'pattern_match' WHEN c2 >= c3 THEN "
    "'structural_analysis' ELSE 'encoding_detection' END AS method, list_concat(list_concat(p, m), e) AS names FROM conf)")

# --- toxicity ---


def score(text: str, weight: float, words, patterns) -> str:
    terms = [f"CASE WHEN contains(lower({text}), {s(w.lower())}) THEN 0.3e0 ELSE 0e0 END" for w in words]
    terms += [f"CASE WHEN {matches(text, p)} THEN 0.4e0 ELSE 0e0 END" for p in patterns]
    return f"least(1e0, ({' + '.join(['0e0', *terms])}) * {num(weight)})"


CATEGORIES = [c for c, *_ in v.TOXICITY]


def scores(text: str) -> str:
    return ", ".join(f"{score(text, *rest)} AS {c}" for c, *rest in v.TOXICITY)


OVERALL = f"greatest({', '.join(CATEGORIES)})"
TOX = f"tox AS (SELECT doc_id, text, {scores('text')} FROM docs)"


def over(limit: float, special: dict | None = None) -> str:
    return present([f"CASE WHEN {c} >= {num((special or {}).get(c, limit))} THEN '{c}' END" for c in CATEGORIES])


# --- policies ---


def matched(kind: str, value, text: str = "text") -> str:
    if kind == "whole words":  # RE2's \b knows ASCII only, so the neighbours are spelled out
        around = rf"(?i-s)(?:^|[^\p{{L}}\p{{N}}_])({value})(?:$|[^\p{{L}}\p{{N}}_])"
        return f"CASE WHEN regexp_matches({text}, {s(around)}) THEN regexp_extract({text}, {s(around)}, 1) END"
    if kind == "regex":
        return f"CASE WHEN {matches(text, value)} THEN regexp_extract({text}, {s('(?i-s)' + value)}) END"
    return "CASE " + " ".join(f"WHEN contains(lower({text}), {s(w.lower())}) THEN {s(w)}" for w in value) + " END"


def violations(policies, text: str = "text") -> str:
    items = [f"{{'rule': {s(d)}, 'hit': {matched(k, x, text)}, 'severity': {s(sev)}, 'action': {s(act)}}}"
             for _, _, act, sev, rules in policies for k, d, x in rules]
    return f"list_filter([{', '.join(items)}], lambda x: x.hit IS NOT NULL)"


def field(x: str, name: str) -> str:
    return f"list_transform({x}, lambda x: x.{name})"


def worst(x: str, name: str, ranked, default: str) -> str:
    out = s(default)
    for value in ranked:
        out = f"CASE WHEN list_contains({field(x, name)}, {s(value)}) THEN {s(value)} ELSE {out} END"
    return out


def policy_result(policies, source: str = "docs", ctes: str = DOCS) -> str:
    return (
        f"WITH {ctes}, r AS (SELECT doc_id, {violations(policies)} AS f FROM {source}) SELECT doc_id, len(f) = 0 AS passed, "
        f"{worst('f', 'action', v.ACTIONS, 'log')} AS action, {worst('f', 'severity', v.SEVERITIES, 'low')} AS severity, "
        f"{pipe(field('f', 'rule'))} AS rules, {pipe(field('f', 'hit'))} AS matched FROM r")


def simple(*rules, action: str = "block", severity: str = "high"):
    return [("p", "", action, severity, rules)]


FILE_RULES = [("words", "", "warn", "low", (("keyword", "has of or der", ("of the", "der die")),
                                            ("whole words", "long word", "[a-z]{18,}"))),
              ("defaults", "", "block", "high", (("keyword", "bomb", ("Bomb",)),))]
EDITED = [v.PRESETS["moderate"][0], v.PRESETS["moderate"][1],
          ("extra", "", "warn", "medium", (("keyword", "extra words", ("skill", "that")),))]

# --- personal data ---


def entity_ctes(picked, source: str = "docs", ctes: str = DOCS) -> str:
    """picked: (type, pattern, confidence, ignore case)"""
    parts = " UNION ALL ".join(
        f"SELECT *, '{t}' AS entity_type, {num(c)} AS confidence FROM ({spans(source, 'doc_id', 'text', ('(?i)' if i else '') + p, n)})"
        for n, (t, p, c, i) in enumerate(picked))
    return (
        f"{ctes}, raw AS ({parts}), ents AS (SELECT doc_id, ord, entity_type, hit, start, start + length(hit) AS stop, confidence FROM raw "
        "QUALIFY row_number() OVER (PARTITION BY doc_id, start, start + length(hit) ORDER BY ord) = 1)")


def entities(picked) -> str:
    return (
        f"WITH {entity_ctes(picked)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, ord) - 1 AS pos, "
        "entity_type, hit AS text, start, stop AS \"end\", confidence FROM ents")


NAMES = [("NAME", p, 0.65, False) for p in v.NAME_PATTERNS]
ALL_PII = [(t, p, c, True) for t, p, c in v.PII_PATTERNS] + NAMES


def only(*types):
    return [x for x in ALL_PII if x[0] in types]


CUSTOM_PICK = [*only("EMAIL"), ("EMAIL", q.CUSTOM_PII["EMAIL"][0]["pattern"], 0.4, True),
               ("TICKET", q.CUSTOM_PII["TICKET"][0]["pattern"], 0.8, True)]


def replacement(strategy: str) -> str:
    if strategy == "hash":
        return "'[HASH:' || substr(sha256(hit), 1, 12) || ']'"
    if strategy == "placeholder":
        return "'[' || entity_type || '_' || n || ']'"
    if strategy == "anonymize":
        return "CASE entity_type " + " ".join(
            f"WHEN '{t}' THEN [{', '.join(map(s, o))}][(n - 1) % {len(o)} + 1]" for t, o in v.STAND_INS.items()) + " END"
    return "'[REDACTED]'"


def redact_ctes(strategy: str, picked=None, given: str | None = None) -> str:
    base = given or entity_ctes(picked or ALL_PII)
    return (
        f"{base}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC, ord) AS k, "
        "row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start DESC, ord) AS n FROM ents), "
        f"repl AS (SELECT *, {replacement(strategy)} AS r FROM numbered), "
        "fold AS (SELECT doc_id, text, 0::BIGINT AS k FROM docs UNION ALL SELECT f.doc_id, substr(f.text, 1, r.start) || r.r || "
        "substr(f.text, r.stop + 1), r.k FROM fold f JOIN repl r ON r.doc_id = f.doc_id AND r.k = f.k + 1), "
        "done AS (SELECT doc_id, text AS redacted, k FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)")


def redacted(strategy: str) -> str:
    return f"WITH RECURSIVE {redact_ctes(strategy)} SELECT doc_id, k AS entities, md5(redacted) AS digest FROM done"


MAPPING = (
    "mapping AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) - 1 AS ord, r AS replacement, "
    "arg_max(hit, k) AS original FROM repl GROUP BY doc_id, r)")

# --- grounding ---
TURNS = (
    "near AS (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text, string_agg(text, chr(10)) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM conversations "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
GENS = f"{TURNS}, gens AS (SELECT conv_id, turn, prev_text AS prompt, {planted_sql('text', 'conv_id * 7 + turn')} AS output, context FROM near WHERE role = 'assistant' AND prev_role = 'user')"


def sentences(text: str) -> str:
    marked = f"regexp_replace({strip(text)}, {s(f'([.!?]){WS}+')}, '\\1' || chr(1), 'g')"
    return f"list_transform(string_split({marked}, chr(1)), lambda x: {strip('x')})"


def claims(text: str) -> str:
    filler = " OR ".join(f"starts_with(lower(x), {s(o)})" for o in v.FILLER_OPENINGS)
    return f"list_filter({sentences(text)}, lambda x: length(x) >= 10 AND NOT ends_with(x, '?') AND NOT ({filler}))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {s(WORD)})"


def without(x: str, stop) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains([{', '.join(map(s, stop))}], w))"


CLAIMS = (
    f"{GENS}, cl AS (SELECT conv_id, turn, i - 1 AS claim_no, c[i] AS claim, context, lower(context) AS ctx FROM (SELECT *, "
    f"{claims('output')} AS c FROM gens WHERE context IS NOT NULL), unnest(range(1, len(c) + 1)) u(i)), "
    f"wd AS (SELECT *, list_distinct({without(words('claim'), v.CLAIM_STOP_WORDS)}) AS w, CASE WHEN length(claim) >= 20 THEN "
    "list_transform(range(0, length(claim) - 19, 10), lambda i: lower(substr(claim, i + 1, 20))) ELSE []::VARCHAR[] END AS f FROM cl), "
    "sc AS (SELECT *, CASE WHEN len(w) > 0 THEN (len(list_filter(w, lambda x: contains(ctx, x)))::DOUBLE / len(w)) * 0.6e0 + "
    "(CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: contains(ctx, x)))::DOUBLE / len(f) ELSE 0e0 END) * 0.4e0 END AS score FROM wd), "
    "vd AS (SELECT *, score IS NULL OR score >= 0.4e0 AS is_supported, coalesce(score, 0.5e0) AS confidence FROM sc)")
WINDOWS = (
    f"win AS (SELECT conv_id, turn, claim_no, spot, len(list_filter({words('claim')}, lambda x: contains(substr(ctx, spot + 1, 200), x))) AS h "
    "FROM vd, unnest(range(0, greatest(1, length(context) - 200), 100)) u(spot) WHERE score >= 0.4e0), "
    "best AS (SELECT conv_id, turn, claim_no, spot FROM win WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, claim_no ORDER BY h DESC, spot) = 1), "
    f"sn AS (SELECT vd.*, CASE WHEN spot IS NOT NULL THEN {strip('substr(context, spot + 1, 200)')} END AS snippet FROM vd LEFT JOIN best USING (conv_id, turn, claim_no))")


def key_words(text: str, least: int, stop) -> str:
    long_enough = f"list_filter({words(text)}, lambda w: length(w) >= {least})"
    return f"list_distinct({without(long_enough, stop)})"


RELEVANCE = (
    f"rel AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) END AS relevance FROM "
    f"(SELECT *, {key_words('prompt', 3, v.RELEVANCE_STOP_WORDS)} AS a, {key_words('output', 3, v.RELEVANCE_STOP_WORDS)} AS b FROM gens))")
GROUNDING = (
    f"se AS (SELECT conv_id, turn, lower(context) AS ctx, unnest(list_filter({sentences('output')}, lambda x: length(x) >= 15)) AS sentence "
    f"FROM gens WHERE context IS NOT NULL), sw AS (SELECT *, {key_words('sentence', 4, v.GROUNDING_STOP_WORDS)} AS w FROM se), "
    "gr AS (SELECT g.conv_id, g.turn, count(w) AS sentences, count(*) FILTER (WHERE len(w) > 0 AND len(list_filter(w, lambda x: "
    "contains(ctx, x)))::DOUBLE / len(w) < 0.4e0) AS ungrounded FROM gens g LEFT JOIN sw USING (conv_id, turn) "
    "WHERE g.context IS NOT NULL GROUP BY 1, 2), gs AS (SELECT *, CASE WHEN sentences > 0 THEN ungrounded::DOUBLE / sentences ELSE 0e0 END AS share FROM gr)")


def unsafe(limit: float) -> str:
    items = [f"CASE WHEN {c} >= {num(limit)} THEN {{'kind': 'unsafe', 'text': 'Output contains potentially harmful content: {c}', "
             f"'severity': CASE WHEN {c} >= 0.9e0 THEN 'critical' WHEN {c} >= 0.7e0 THEN 'high' ELSE 'medium' END}} END" for c in CATEGORIES]
    none = "[]::STRUCT(kind VARCHAR, text VARCHAR, severity VARCHAR)[]"
    return f"CASE WHEN {OVERALL} >= {num(limit)} THEN list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) ELSE {none} END"


def issue(test: str, kind: str, text: str, severity: str) -> str:
    none = "[]::STRUCT(kind VARCHAR, text VARCHAR, severity VARCHAR)[]"
    return f"CASE WHEN {test} THEN [{{'kind': '{kind}', 'text': {text}, 'severity': '{severity}'}}] ELSE {none} END"


CHECKED = (
    f"{GENS}, {RELEVANCE}, {GROUNDING}, gt AS (SELECT rel.*, gs.share, {scores('output')} FROM rel LEFT JOIN gs USING (conv_id, turn)), "
    f"ck AS (SELECT *, list_concat(list_concat({issue('relevance < 0.3e0', 'irrelevant', s('Output may not be relevant to the prompt'), 'medium')}, "
    f"{unsafe(0.7)}), {issue('share > 0.5e0', 'ungrounded', s('Output contains claims not grounded in the provided context'), 'high')}) AS f FROM gt)")


def stem(word: str) -> str:
    return word[:4] if len(word) > 4 else word


def topic_words(topic: str) -> list[str]:
    return [w for w in topic.lower().split() if w not in v.TOPIC_STOP_WORDS and len(w) > 2]


def topic_hits(topic: str) -> str:
    return present([
        f"CASE WHEN len(list_filter(w, lambda x: starts_with(x, {s(stem(k))}) OR starts_with({s(k)}, "
        f"CASE WHEN length(x) > 4 THEN x[1:4] ELSE x END))) > 0 THEN {s(k)} END" for k in topic_words(topic)])


def topic_query(mode: str) -> str:
    a, b = q.ALLOWED_TOPICS, q.BLOCKED_TOPICS
    lists = ", ".join([f"{topic_hits(t)} AS a{i}" for i, t in enumerate(a)] + [f"{topic_hits(t)} AS b{i}" for i, t in enumerate(b)])
    share = lambda kind, i, t: f"len({kind}{i})::DOUBLE / {len(topic_words(t))}"
    blocked = "CASE " + " ".join(f"WHEN {share('b', i, t)} >= 0.3e0 THEN {i}" for i, t in enumerate(b)) + " END"
    best = f"greatest({', '.join(share('a', i, t) for i, t in enumerate(a))})"
    pick = "CASE " + " ".join(f"WHEN {share('a', i, t)} = {best} THEN {i}" for i, t in enumerate(a)) + " END"
    needed = 0.3 if mode == "strict" else 0.1
    names = f"[{', '.join(map(s, a))}]"
    return (
        f"WITH {DOCS}, tw AS (SELECT doc_id, {words('text')} AS w FROM docs), h AS (SELECT doc_id, {lists} FROM tw), "
        f"p AS (SELECT *, {blocked} AS bl, {best} AS best, {pick} AS pick FROM h) SELECT doc_id, bl IS NULL AND best >= {num(needed)} AS is_on_topic, "
        f"CASE WHEN bl IS NOT NULL THEN [{', '.join(map(s, b))}][bl + 1] WHEN best > 0 THEN {names}[pick + 1] END AS detected_topic, "
        f"CASE {' '.join(f'WHEN bl = {i} THEN {share(chr(98), i, t)}' for i, t in enumerate(b))} ELSE best END AS similarity_score, "
        f"CASE WHEN bl IS NULL AND best > 0 THEN {names}[pick + 1] END AS closest_allowed_topic, "
        f"CASE {' '.join(f'WHEN bl = {i} THEN {pipe(f'b{i}')}' for i in range(len(b)))} WHEN best > 0 THEN CASE pick "
        f"{' '.join(f'WHEN {i} THEN {pipe(f'a{i}')}' for i in range(len(a)))} END ELSE '' END AS matched FROM p")


# --- whole scans ---
NO_VIOLATION = "[]::STRUCT(\"rule\" VARCHAR, hit VARCHAR, severity VARCHAR, \"action\" VARCHAR)[]"


def scanned(ranked, policies=v.PRESETS["moderate"], ctes: str = "") -> str:
    action = "'allow'"
    for a in reversed(ranked):
        action = f"CASE WHEN list_contains({field('f', 'action')}, '{a}') THEN '{a}' ELSE {action} END"
    one = lambda rule, hit: f"[{{'rule': '{rule}', 'hit': {hit}, 'severity': 'high', 'action': 'block'}}]"
    return (
        f"{INJECTED}, {TOX}, al AS (SELECT i.*, {OVERALL} AS overall, {over(0.7)} AS flagged, {violations(policies, 'i.text')} AS v FROM inj i JOIN tox t USING (doc_id)), "
        f"fo AS (SELECT *, list_concat(list_concat(CASE WHEN is_injection THEN {one('prompt_injection', chr(110) + 'ullif(array_to_string(names[1:3], ' + s(', ') + '), ' + s('') + ')')} ELSE {NO_VIOLATION} END, "
        f"CASE WHEN overall >= 0.7e0 THEN {one('toxicity', 'array_to_string(flagged, ' + s(', ') + ')')} ELSE {NO_VIOLATION} END), v) AS f FROM al), "
        f"ac AS (SELECT *, {action} AS act FROM fo)")


DECISION = (
    f"act = 'allow' AS is_safe, act AS action, {pipe(field('f', 'rule'))} AS rules, {pipe(field('f', 'hit'))} AS matched, "
    f"{pipe(field('f', 'severity'))} AS severities, md5(CASE WHEN act = 'allow' THEN text END) AS digest")

# --- behaviour ---
EVENTS = (
    "ev AS (SELECT user_id, event_id, ts, concat_ws(' ', event_type, props) AS text, event_type = 'error' AS inj, event_type = 'signup' AS tox, "
    "event_type = 'error' AND value > 100 AS blk, least(value / 300, 1e0) AS conf FROM events)")


def histories(rows: int = 100) -> str:
    return (
        f"{EVENTS}, pairs AS (SELECT e.user_id, e.event_id, h.inj, h.tox, h.blk, h.conf, substr({strip('lower(h.text)')}, 1, 50) AS attempt, "
        "row_number() OVER (PARTITION BY e.user_id, e.event_id ORDER BY h.ts DESC, h.event_id DESC) AS back FROM ev e JOIN ev h ON "
        "h.user_id = e.user_id AND (h.ts < e.ts OR (h.ts = e.ts AND h.event_id <= e.event_id)) AND h.ts >= e.ts - INTERVAL 7 DAY "
        f"QUALIFY back <= {rows}), hist AS (SELECT user_id, event_id, count(*) AS n, count(*) FILTER (WHERE inj) AS n_injection, "
        "count(*) FILTER (WHERE tox) AS n_toxic, count(*) FILTER (WHERE blk) AS n_blocked, "
        "list(conf ORDER BY back DESC) FILTER (WHERE back <= 5 AND (inj OR tox)) AS levels, "
        "list(attempt) FILTER (WHERE back <= 10 AND inj) AS tried FROM pairs GROUP BY 1, 2)")


RISK = (
    "least((n_injection::DOUBLE / n) * 0.4e0 + (n_toxic::DOUBLE / n) * 0.3e0 + (n_blocked::DOUBLE / n) * 0.3e0, 1e0)")
RISING = "len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] > levels[i - 1]))::DOUBLE / (len(levels) - 1)"
VARIETY = "len(list_distinct(tried))::DOUBLE / len(tried)"


def counted(column: str, threshold: int, kind: str) -> tuple[str, str, str, str]:
    return (kind, f"{column} >= {threshold}", f"least({column}::DOUBLE / {2 * threshold}, 1e0)",
            f"CASE WHEN {column} >= {2 * threshold} THEN 'block' ELSE 'throttle' END")


ABUSE = {
    "jailbreak": ("jailbreak_sequence", f"len(tried) >= 3 AND {VARIETY} >= 0.5e0", VARIETY, "'block'"),
    "escalation": ("escalation", f"n >= 5 AND len(levels) >= 3 AND {RISING} >= 0.6e0", RISING, "'warn'"),
    "repeated_injection": counted("n_injection", 3, "repeated_injection"),
    "volume": counted("n", 20, "volume_abuse"),
}


def abuse(kind: str) -> str:
    name, test, confidence, action = ABUSE[kind]
    case = lambda x: f"CASE WHEN {test} THEN {x} END"
    return (f"WITH {histories()} SELECT user_id, event_id, {case(s(name))} AS abuse_type, {case(confidence)} AS confidence, "
            f"{case(action)} AS action FROM hist")


def first_abuse(column: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a[1]} THEN {s(a[0]) if column == 0 else a[column]}" for a in ABUSE.values()) + f" ELSE {default} END"


ABUSE_DETECT = (
    f"WITH {histories()}, j AS (SELECT *, {first_abuse(0, 'NULL')} AS abuse_type FROM hist) SELECT user_id, event_id, n, {RISK} AS risk_score, "
    f"abuse_type IS NOT NULL AS is_abusive, abuse_type, {first_abuse(2, '0e0')} AS abuse_confidence, {first_abuse(3, s('allow'))} AS recommended_action FROM j")

LIMITER = (
    "calls AS (SELECT user_id, event_id, ts, epoch_us(ts) AS tick, CASE WHEN event_type = 'error' AND value > 150 THEN 'block' WHEN event_type = 'error' "
    "THEN 'warning' WHEN event_type = 'signup' AND value > 120 THEN 'reset' ELSE 'check' END AS kind, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)")
TIER = "CASE WHEN b >= 1 THEN 'restricted' WHEN w >= 3 THEN 'warning' ELSE 'normal' END"
ALLOWANCE = "CASE {t} WHEN 'restricted' THEN 1 WHEN 'warning' THEN 3 ELSE 5 END"
DAY = 86_400_000_000
# One step per event: reset epoch, violation counts, window start and tokens.
RATE = (
    f"WITH RECURSIVE {LIMITER}, st AS ("
    "SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, '' AS kind, 0::BIGINT AS tick, 0::BIGINT AS w, 0::BIGINT AS b, NULL::BIGINT AS start, 0::BIGINT AS tokens, "
    "'normal' AS tier, false AS allowed FROM (SELECT DISTINCT user_id FROM calls) UNION ALL "
    "SELECT user_id, rn, event_id, kind, tick, w, b, CASE WHEN kind = 'reset' THEN NULL ELSE start2 END, "
    "CASE WHEN kind = 'check' THEN greatest(tokens2 - 1, 0) WHEN tier2 <> tier THEN " + ALLOWANCE.format(t="tier2") + " ELSE tokens2 END, tier2, kind = 'check' AND tokens2 > 0 FROM ("
    "SELECT *, CASE WHEN kind = 'check' AND tick - start1 >= " + str(DAY) + " THEN tick ELSE start1 END AS start2, CASE WHEN kind = 'check' AND tick - start1 >= " + str(DAY)
    + " THEN " + ALLOWANCE.format(t="tier") + " ELSE tokens1 END AS tokens2, " + TIER + " AS tier2 FROM ("
    "SELECT c.user_id, c.rn, c.event_id, c.kind, c.tick, CASE WHEN c.kind = 'reset' THEN 0 ELSE s.w + (c.kind = 'warning')::BIGINT END AS w, "
    "CASE WHEN c.kind = 'reset' THEN 0 ELSE s.b + (c.kind = 'block')::BIGINT END AS b, coalesce(s.start, c.tick) AS start1, "
    "CASE WHEN s.start IS NULL THEN 5 ELSE s.tokens END AS tokens1, s.tier FROM st s JOIN calls c ON c.user_id = s.user_id AND c.rn = s.rn + 1)))")
RATE_RESULT = (
    f"{RATE} SELECT user_id, event_id, allowed, CASE WHEN allowed THEN tokens ELSE 0 END AS remaining, ({ALLOWANCE.format(t='tier')})::BIGINT AS \"limit\", tier, "
    f"start + {DAY} AS reset_us, CASE WHEN NOT allowed THEN greatest(start + {DAY} - tick, 0) / 1e6 END AS retry_after FROM st WHERE kind = 'check'")
TIERS = (
    f"WITH {LIMITER}, ep AS (SELECT *, sum((kind = 'reset')::INT) OVER (PARTITION BY user_id ORDER BY rn)::BIGINT AS epoch FROM calls), "
    "ct AS (SELECT *, sum((kind = 'warning')::INT) OVER x::BIGINT AS w, sum((kind = 'block')::INT) OVER x::BIGINT AS b FROM ep "
    f"WINDOW x AS (PARTITION BY user_id, epoch ORDER BY rn)) SELECT user_id, event_id, epoch, w AS warning_count, b AS block_count, {TIER} AS tier FROM ct")

AUDIT = (
    "lg AS (SELECT ts, event_id AS correlation_id, user_id, CASE event_type WHEN 'error' THEN 'block' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'redact' "
    "ELSE 'allow' END AS action, value AS scan_time_ms FROM events)")


def profane(words_) -> str:
    """Whole words: the neighbours of a hit must not be word characters of any script (RE2 only knows ASCII ones)."""
    found = " UNION ALL ".join(f"({spans('low', 'doc_id', 'text', f'(?i){w}', n)})" for n, w in enumerate(words_))
    edge = r"regexp_matches(substr(text, {}, 1), '[\p{{L}}\p{{N}}_]')"
    return (f"SELECT r.* FROM ({found}) r JOIN low USING (doc_id) WHERE NOT (start > 0 AND {edge.format('start')}) "
            f"AND NOT {edge.format('start + length(hit) + 1')}")


PAIRED = "near.turn, prev_text AS prompt, text AS output FROM near WHERE role = 'assistant' AND prev_role = 'user'"
PROFANE_ALL = rf"(?i)\b(?:{'|'.join(v.PROFANITY)})\b"
PII_POLICY = v.PRESETS["moderate"][2]

ORACLES: dict[str, str] = {
    "src_texts": "SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents",
    "src_rules_json": policy_result(FILE_RULES),
    "sink_audit": (
        f"WITH {DOCS}, r AS (SELECT doc_id, source, text, {violations(v.PRESETS['moderate'])} AS f FROM docs) SELECT doc_id::VARCHAR AS correlation_id, "
        f"source AS user_id, {worst('f', 'action', v.ACTIONS, 'log')} AS action, substr(text, 1, 100) AS text_preview, len(f) AS violation_count, "
        f"{pipe(field('f', 'rule'))} AS rules, length(text) / 1000e0 AS scan_time_ms FROM r"),
    "src_events": (
        f"WITH {EVENTS} SELECT user_id, event_id, text, inj AS was_injection, tox AS was_toxic, blk AS was_blocked, conf AS confidence FROM ev"),
    "injection_patterns": (
        f"WITH {DOCS}, h AS (SELECT doc_id, {hits('text', INJECTION)} AS p FROM docs), c AS (SELECT *, {stepped('len(p)', 0.4, 0.15)} AS confidence FROM h) "
        f"SELECT doc_id, len(p) > 0 AND confidence >= 0.5e0 AS is_injection, confidence, {pipe('p')} AS patterns FROM c"),
    "injection_custom_patterns": (
        f"WITH {DOCS}, h AS (SELECT doc_id, {hits('text', CUSTOM)} AS p FROM docs), c AS (SELECT *, {stepped('len(p)', 0.4, 0.15)} AS confidence FROM h) "
        f"SELECT doc_id, len(p) > 0 AND confidence >= 0.5e0 AS is_injection, confidence, {pipe('p')} AS patterns FROM c"),
    "injection_category_counts": (
        f"WITH {DOCS}, h AS (SELECT doc_id, unnest({hits('text', [(c + '/' + n, p) for n, c, p in v.INJECTION_PATTERNS])}) AS x FROM docs) "
        "SELECT split_part(x, '/', 1) AS category, count(DISTINCT doc_id) AS texts, count(*) AS hits FROM h GROUP BY 1"),
    "injection_structural": (
        f"WITH {DOCS}, h AS (SELECT doc_id, {hits('text', MARKERS)} AS p FROM docs), c AS (SELECT *, {stepped('len(p)', 0.5, 0.2)} AS confidence FROM h) "
        f"SELECT doc_id, len(p) > 0 AND confidence >= 0.5e0 AS is_injection, confidence, {pipe('p')} AS patterns FROM c"),
    "decode_base64": f"WITH {DOCS}, {BASE64} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, original, decoded, encoding, start, \"end\" FROM b64",
    "decode_rot13": f"WITH {DOCS}, {ROT13} SELECT doc_id, i - 1 AS pos, original, decoded, encoding, start, \"end\" FROM rot",
    "normalize_unicode": f"WITH {DOCS} SELECT doc_id, md5({NORMALIZED}) AS digest FROM docs",
    "decode_and_scan": f"WITH {ITEMS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, i) - 1 AS pos, original, decoded, encoding, start, \"end\" FROM items",
    "injection_encoding": (
        f"WITH {LAYERS} SELECT doc_id, len(e) > 0 AND c3 >= 0.5e0 AS is_injection, c3 AS confidence, {pipe('e')} AS patterns FROM conf"),
    "injection_detect": f"WITH {INJECTED} SELECT doc_id, is_injection, confidence, method, {pipe('names')} AS patterns FROM inj",
    "injection_sensitivity_sweep": (
        f"WITH {LAYERS} SELECT doc_id, {flagged(0.8)} AS injection_low, {flagged(0.5)} AS injection_medium, {flagged(0.3)} AS injection_high FROM conf"),
    "judge_merge": (
        f"WITH {INJECTED}, r AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 0.9e0 WHEN 2 THEN 0.2e0 ELSE 0e0 END AS c, doc_id % 4 = 0 AS j FROM inj) "
        "SELECT doc_id, is_injection OR j AS is_injection, greatest(confidence, c) AS confidence, CASE WHEN c > confidence THEN 'llm_classification' "
        "ELSE method END AS method, CASE WHEN j THEN 'override' END AS reason FROM r"),
    "toxicity_scores": f"WITH {DOCS} SELECT doc_id, {scores('text')} FROM docs",
    "toxicity_flags": (
        f"WITH {DOCS}, {TOX} SELECT doc_id, {OVERALL} AS overall_score, {OVERALL} >= 0.6e0 AS is_toxic, "
        f"{pipe(over(0.6, {'harassment': 0.2, 'violence': 0.9}))} AS flagged FROM tox"),
    "toxicity_judge_parse": (
        f"WITH {DOCS}, {TOX} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.5e0 ELSE violence END AS violence, "
        "CASE doc_id % 3 WHEN 0 THEN 0.75e0 WHEN 1 THEN NULL ELSE harassment END AS harassment, "
        f"CASE doc_id % 3 WHEN 0 THEN 0.75e0 WHEN 1 THEN 0.125e0 ELSE {OVERALL} END AS overall_score, "
        f"CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE {OVERALL} >= 0.7e0 END AS is_toxic, "
        f"CASE doc_id % 3 WHEN 0 THEN 'harassment' WHEN 1 THEN '' ELSE {pipe(over(0.7))} END AS flagged FROM tox"),
    "profanity_spans": (
        f"WITH {DOCS}, low AS (SELECT doc_id, lower(text) AS text FROM docs), raw AS ({profane(q.WORDS)}) SELECT doc_id, "
        "row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) - 1 AS pos, hit AS matched_text, start, start + length(hit) AS \"end\" FROM raw"),
    "profanity_redact": (
        f"WITH {DOCS}, low AS (SELECT doc_id, lower(text) AS text FROM docs), pr AS (SELECT doc_id, start, start + length(hit) AS stop, "
        f"coalesce(lag(start + length(hit)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM ({profane(q.WORDS)})), "
        "pc AS (SELECT doc_id, string_agg(substr(text, since + 1, start - since) || '***', '' ORDER BY start) AS head, max(stop) AS stop FROM pr JOIN docs USING (doc_id) "
        "GROUP BY doc_id), m AS (SELECT doc_id, coalesce(head, '') || substr(text, coalesce(stop, 0) + 1) AS f FROM docs LEFT JOIN pc USING (doc_id)) "
        "SELECT doc_id, md5(f) AS digest, length(f) AS chars FROM m"),
    "content_filter": (
        f"WITH {DOCS}, low AS (SELECT doc_id, lower(text) AS text FROM docs), raw AS ({profane(v.PROFANITY)}), pr AS (SELECT doc_id, "
        "list({'category': 'profanity', 'hit': hit, 'severity': 'warning'} ORDER BY ord, i) AS f FROM raw GROUP BY doc_id), "
        f"{TOX}, fl AS (SELECT doc_id, text, list_concat(list_concat(CASE WHEN {OVERALL} >= 0.35e0 THEN list_filter(["
        + ", ".join(
            f"CASE WHEN {c} >= 0.35e0 THEN {{'category': '{c}', 'hit': '[toxicity:{c}=' || printf('%.2f', {c}) || ']', 'severity': CASE WHEN {c} >= 0.9e0 "
            f"THEN 'critical' WHEN {c} >= 0.7e0 THEN 'warning' ELSE 'info' END}} END" for c in CATEGORIES)
        + "], lambda x: x IS NOT NULL) ELSE [] END, "
        f"list_transform({violations([PII_POLICY])}, lambda x: {{'category': 'policy:' || x.rule, 'hit': x.hit, 'severity': 'warning'}})), coalesce(pr.f, [])) AS f "
        f"FROM tox LEFT JOIN pr USING (doc_id)), ac AS (SELECT *, {worst('f', 'severity', ('info', 'warning', 'critical'), 'none')} AS w FROM fl) "
        "SELECT doc_id, CASE w WHEN 'critical' THEN 'block' WHEN 'warning' THEN 'redact' WHEN 'info' THEN 'log' ELSE 'none' END AS action, len(f) = 0 AS is_clean, "
        f"md5(CASE WHEN w = 'warning' THEN regexp_replace(text, {s(PROFANE_ALL)}, '***', 'g') ELSE text END) AS digest, "
        f"{pipe(field('f', 'category'))} AS categories, {pipe(field('f', 'hit'))} AS matched, {pipe(field('f', 'severity'))} AS severities FROM ac"),
    "pii_detect": entities(ALL_PII),
    "pii_names": entities(NAMES),
    "pii_entity_filter": entities(only("EMAIL", "SSN")),
    "pii_custom_patterns": entities(CUSTOM_PICK),
    "pii_by_type": (
        f"WITH {entity_ctes(ALL_PII)} SELECT source, entity_type, count(*) AS entities, count(DISTINCT doc_id) AS texts FROM ents JOIN docs USING (doc_id) GROUP BY 1, 2"),
    "pii_grouped_entities": (
        f"WITH {entity_ctes(ALL_PII)} SELECT doc_id, entity_type, string_agg(hit, '|' ORDER BY start, ord) AS found FROM ents GROUP BY 1, 2"),
    **{f"pii_redact_{strategy}": redacted(strategy) for strategy in ("mask", "hash", "placeholder", "anonymize")},
    "pii_redact_given": (
        "WITH RECURSIVE " + redact_ctes("placeholder", given=(
            "docs AS (SELECT doc_id, text, length(text) AS n, least(5, length(text)) AS h FROM documents), ents AS (SELECT doc_id, 0 AS ord, 'HEAD' AS entity_type, "
            "substr(text, 1, h) AS hit, 0 AS start, h AS stop FROM docs WHERE h > 0 UNION ALL SELECT doc_id, 1, 'TAIL', substr(text, greatest(n - 4, h) + 1), "
            "greatest(n - 4, h), n FROM docs WHERE n > greatest(n - 4, h))")) + " SELECT doc_id, md5(redacted) AS digest FROM done"),
    "pii_redaction_map": f"WITH RECURSIVE {redact_ctes('placeholder')}, {MAPPING} SELECT doc_id, ord, replacement, original FROM mapping",
    "pii_reverse_placed": (
        f"WITH {DOCS} SELECT doc_id, unnest(['hash', 'anonymize']) AS strategy, md5(text) AS digest, true AS same FROM docs"),
    "pii_reverse": (
        f"WITH RECURSIVE {redact_ctes('placeholder', only('EMAIL', 'CREDIT_CARD', 'IP_ADDRESS'))}, {MAPPING}, back AS (SELECT doc_id, redacted AS text, 0::BIGINT AS k FROM done "
        "UNION ALL SELECT b.doc_id, replace(b.text, m.replacement, m.original), b.k + 1 FROM back b JOIN mapping m ON m.doc_id = b.doc_id AND m.ord = b.k), "
        "fin AS (SELECT * FROM back QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1) "
        "SELECT doc_id, md5(fin.text) AS digest, fin.text = docs.text AS same FROM fin JOIN docs USING (doc_id)"),
    "rule_regex": policy_result(simple(("regex", "ending", r"th\w+tion\b"), ("regex", "card", r"\b\d{4}[-\s]?\d{4}"))),
    "rule_keyword": policy_result(simple(("keyword", "words", ("Kill", "THE the", "that")))),
    "rule_threshold": (
        f"WITH {DOCS}, {TOX} SELECT doc_id, {OVERALL} < 0.35e0 AS passed, CASE WHEN {OVERALL} >= 0.35e0 THEN 'score' END AS rule, "
        f"CASE WHEN {OVERALL} >= 0.35e0 THEN 'score=' || CAST({OVERALL} AS VARCHAR) END AS matched FROM tox"),
    "rule_custom_batch": (
        f"WITH {DOCS}, {TOX}, rp AS (SELECT doc_id, {OVERALL} AS score FROM tox), w AS (SELECT doc_id, text, "
        r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS t FROM docs), "
        "h AS (SELECT doc_id, list_filter(list_transform(range(1, len(t) - 1), lambda i: CASE WHEN t[i] = t[i + 2] AND t[i + 1] = ' ' "
        "AND regexp_full_match(t[i], '[a-z]{3,}') THEN t[i] END), lambda x: x IS NOT NULL)[1] AS hit FROM w), "
        "j AS (SELECT doc_id, CASE WHEN score > 0 THEN hit END AS hit FROM h JOIN rp USING (doc_id)) "
        "SELECT doc_id, hit IS NULL AS passed, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'log' END AS action, "
        "CASE WHEN hit IS NOT NULL THEN 'high' ELSE 'low' END AS severity, CASE WHEN hit IS NOT NULL THEN 'repeated word' ELSE '' END AS rules, "
        "coalesce(hit, '') AS matched FROM j"),
    "rule_custom": (
        f"WITH {DOCS} SELECT doc_id, length(text) <= 2000 AS passed, CASE WHEN length(text) > 2000 THEN 'block' ELSE 'log' END AS action, "
        "CASE WHEN length(text) > 2000 THEN 'high' ELSE 'low' END AS severity, CASE WHEN length(text) > 2000 THEN 'long text' ELSE '' END AS rules, "
        "CASE WHEN length(text) > 2000 THEN substr(text, 1, 10) ELSE '' END AS matched FROM docs"),
    "policy_evaluate": policy_result(v.PRESETS["moderate"]),
    "policy_presets": (
        f"WITH {DOCS}, r AS (SELECT doc_id, {', '.join(f'{violations(p)} AS {level}' for level, p in v.PRESETS.items())} FROM docs) SELECT doc_id, "
        + ", ".join(f"len({level}) AS {level}_violations, {worst(level, 'action', v.ACTIONS, 'log')} AS {level}_action, "
                    f"{worst(level, 'severity', v.SEVERITIES, 'low')} AS {level}_severity" for level in v.PRESETS) + " FROM r"),
    "policy_listing": f"WITH {DOCS} " + " UNION ALL ".join(
        f"SELECT '{level}' AS level, '{n}' AS name, {s(d)} AS description, '{a}' AS action, '{sev}' AS severity, {len(rules)}::BIGINT AS rule_count, "
        f"(SELECT count(*) FROM docs WHERE len({violations([(n, d, a, sev, rules)])}) > 0) AS texts"
        for level, policies in v.PRESETS.items() for n, d, a, sev, rules in policies),
    "policy_set_edit": policy_result(EDITED),
    "extract_claims": f"WITH {DOCS}, c AS (SELECT doc_id, {claims('text')} AS c FROM docs) SELECT doc_id, i - 1 AS claim_no, c[i] AS claim FROM c, unnest(range(1, len(c) + 1)) u(i)",
    "verify_claims": f"WITH {CLAIMS} SELECT conv_id, turn, claim_no, claim, is_supported, confidence FROM vd",
    "supporting_snippet": f"WITH {CLAIMS}, {WINDOWS} SELECT conv_id, turn, claim_no, snippet AS supporting_context FROM sn WHERE is_supported",
    "hallucination_score": (
        f"WITH {CLAIMS}, t AS (SELECT conv_id, turn, count(claim) AS total_claims, count(claim) FILTER (WHERE is_supported) AS supported_claims, "
        "count(claim) FILTER (WHERE NOT is_supported) AS unsupported_claims FROM gens LEFT JOIN vd USING (conv_id, turn) WHERE gens.context IS NOT NULL GROUP BY 1, 2) "
        "SELECT *, CASE WHEN total_claims > 0 THEN unsupported_claims::DOUBLE / total_claims ELSE 0e0 END AS hallucination_score, "
        "unsupported_claims > 0 AS has_hallucinations FROM t"),
    "claim_judge_merge": (
        f"WITH {CLAIMS}, {WINDOWS} SELECT conv_id, turn, claim_no, CASE (conv_id + claim_no) % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE is_supported END AS is_supported, "
        "CASE (conv_id + claim_no) % 3 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0e0 ELSE confidence END AS confidence, "
        "CASE (conv_id + claim_no) % 3 WHEN 0 THEN 'matching context' WHEN 1 THEN NULL ELSE snippet END AS supporting_context FROM sn"),
    "check_relevance": f"WITH {GENS}, {RELEVANCE} SELECT conv_id, turn, relevance, (coalesce(relevance, 1e0) < 0.3e0)::BIGINT AS issues FROM rel",
    "check_safety": (
        f"WITH {GENS}, t AS (SELECT *, {scores('output')} FROM gens), u AS (SELECT *, {unsafe(0.35)} AS f FROM t) "
        f"SELECT conv_id, turn, {pipe(field('f', 'text'))} AS unsafe, {pipe(field('f', 'severity'))} AS severities FROM u"),
    "check_grounding": f"WITH {GENS}, {GROUNDING} SELECT conv_id, turn, sentences, ungrounded, share, (share > 0.5e0)::BIGINT AS issues FROM gs",
    "check_format": (
        "WITH o AS (SELECT event_id, CASE event_type WHEN 'error' THEN props || ' x' WHEN 'view' THEN '[1]' ELSE props END AS output FROM events), "
        "f AS (SELECT event_id, list_filter([CASE WHEN length(output) > 8 THEN {'d': 'Output exceeds max length (' || length(output) || ' > 8)', 's': 'low'} END, "
        "CASE WHEN length(output) < 8 THEN {'d': 'Output below min length (' || length(output) || ' < 8)', 's': 'low'} END, "
        "CASE WHEN NOT json_valid(output) THEN {'d': 'Output is not valid JSON', 's': 'medium'} END, "
        "CASE WHEN json_valid(output) AND try(json_type(output)) = 'OBJECT' AND len(list_filter(['k', 'name'], lambda x: NOT list_contains(try(json_keys(output)), x))) > 0 "
        "THEN {'d': 'Missing required fields: ' || array_to_string(list_filter(['k', 'name'], lambda x: NOT list_contains(try(json_keys(output)), x)), ', '), 's': 'medium'} END, "
        f"CASE WHEN NOT regexp_matches(output, {s(q.FORMAT['pattern'])}) THEN {{'d': {s('Output does not match expected pattern: ' + q.FORMAT['pattern'])}, 's': 'low'}} END, "
        + ", ".join(f"CASE WHEN contains(lower(output), {s(w.lower())}) THEN {{'d': {s(f'Output contains forbidden content: {chr(39)}{w}{chr(39)}')}, 's': 'medium'}} END"
                    for w in q.FORMAT["must_not_contain"])
        + f"], lambda x: x IS NOT NULL) AS f FROM o) SELECT event_id, {pipe(field('f', 'd'))} AS issues, {pipe(field('f', 's'))} AS severities FROM f"),
    "output_validate": (
        f"WITH {CHECKED}, fi AS (SELECT *, list_concat(f, list_concat({issue('length(output) < 120', 'format_violation', s(''), 'low')}, "
        f"{issue('contains(lower(output), ' + s('bomb') + ')', 'format_violation', s(''), 'medium')})) AS every FROM ck) SELECT conv_id, turn, "
        f"len(list_filter(every, lambda x: x.severity IN ('high', 'critical'))) = 0 AS is_valid, {pipe(field('every', 'kind'))} AS issues, {pipe(field('every', 'severity'))} AS severities FROM fi"),
    "topic_check": topic_query("permissive"),
    "topic_check_strict": topic_query("strict"),
    "topic_semantic": (
        "WITH tv AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', [{', '.join(map(num, x))}])" for i, (n, x) in enumerate(q.topic_vectors()))
        + ") t(i, name, vec)), dp AS (SELECT vec_id, i, name, (SELECT sum(embedding[k]::DOUBLE * vec[k]) FROM unnest(range(1, len(vec) + 1)) u(k)) AS sc FROM embeddings, tv), "
        "top AS (SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, i) = 1) SELECT vec_id, sc >= 0.5e0 AS is_on_topic, "
        "CASE WHEN sc >= 0.3e0 THEN name END AS detected_topic, round(sc, 6) AS score, name AS closest_allowed_topic FROM top"),
    "scan": (
        f"WITH {scanned(('block', 'redact', 'warn'))} SELECT doc_id, {DECISION}, confidence AS injection_score, overall AS toxicity_score, method AS injection_method, "
        f"{pipe('flagged')} AS flagged FROM ac"),
    "guard_input": f"WITH {scanned(('block', 'warn'))} SELECT doc_id, {DECISION} FROM ac",
    "guard_output": (
        f"WITH {CHECKED}, ac AS (SELECT *, CASE WHEN len(list_filter(f, lambda x: x.severity IN ('high', 'critical'))) > 0 THEN 'block' WHEN len(f) > 0 THEN 'warn' ELSE 'allow' END AS act FROM ck) "
        f"SELECT conv_id, turn, act <> 'block' AS is_safe, act AS action, {pipe(field('f', 'kind'))} AS rules, {pipe(field('f', 'text'))} AS matched, "
        f"{pipe(field('f', 'severity'))} AS severities, md5(CASE WHEN act <> 'block' THEN output END) AS digest, len(f) AS issues FROM ac"),
    "corpus_report": (
        f"WITH {scanned(('block', 'redact', 'warn'))} SELECT source, act AS action, count(*) AS texts, "
        "sum(CAST(confidence AS DECIMAL(18,9)))::DOUBLE / count(*) AS mean_injection, "
        "sum(CAST(overall AS DECIMAL(18,9)))::DOUBLE / count(*) AS mean_toxicity FROM ac JOIN (SELECT doc_id, source FROM docs) USING (doc_id) GROUP BY 1, 2"),
    "corpus_rules": (
        f"WITH {scanned(('block', 'redact', 'warn'))}, x AS (SELECT doc_id, unnest(f) AS y FROM ac) SELECT lang, y.rule AS rule, y.action AS action, count(*) AS violations "
        "FROM x JOIN (SELECT doc_id, lang FROM docs) USING (doc_id) GROUP BY 1, 2, 3"),
    "user_history": f"WITH {histories()} SELECT user_id, event_id, n, n_injection, n_toxic, n_blocked FROM hist",
    "user_history_by_rows": f"WITH {histories(12)} SELECT user_id, event_id, n, n_injection, n_toxic, n_blocked FROM hist",
    "user_risk": f"WITH {histories()} SELECT user_id, event_id, {RISK} AS risk_score FROM hist",
    "user_risk_as_of": (
        f"WITH {EVENTS}, pa AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM ev WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), "
        "h AS (SELECT user_id, count(*) FILTER (WHERE i) AS n, count(*) FILTER (WHERE i AND inj) AS n_injection, count(*) FILTER (WHERE i AND tox) AS n_toxic, "
        "count(*) FILTER (WHERE i AND blk) AS n_blocked FROM (SELECT *, ts >= TIMESTAMP '2024-01-13 12:00:00' AS i FROM pa WHERE back <= 100) GROUP BY 1) "
        f"SELECT user_id, n, CASE WHEN n > 0 THEN {RISK} ELSE 0e0 END AS risk_score FROM h"),
    **{f"abuse_{kind}": abuse(kind) for kind in ABUSE},
    "abuse_detect": ABUSE_DETECT,
    "abuse_stream": ABUSE_DETECT,
    "abuse_stream_batches": ABUSE_DETECT,
    "rate_limit_stream_batches": RATE_RESULT,
    "rate_limit": RATE_RESULT,
    "rate_limit_stream": RATE_RESULT,
    "user_tier": TIERS,
    "scan_stream": (
        f"WITH {scanned(('block', 'redact', 'warn'))} SELECT doc_id::VARCHAR AS correlation_id, act AS action, len(f) AS violation_count, {pipe(field('f', 'rule'))} AS rules FROM ac"),
    "audit_stats": (
        f"WITH {AUDIT} SELECT count(*) AS total, count(*) FILTER (WHERE action = 'block') AS blocks, count(*) FILTER (WHERE action = 'warn') AS warnings, "
        "count(*) FILTER (WHERE action = 'allow') AS allows FROM lg"),
    "audit_tail": f"WITH {AUDIT} SELECT correlation_id, user_id, action, scan_time_ms FROM lg ORDER BY ts DESC, correlation_id DESC LIMIT 100",
    "service_metrics": (
        f"WITH {AUDIT} SELECT count(*) AS total_requests, count(*) FILTER (WHERE action = 'block') AS total_blocked, count(*) FILTER (WHERE action = 'warn') AS total_warnings, "
        "(SELECT round(avg(scan_time_ms), 2) FROM (SELECT scan_time_ms FROM lg ORDER BY ts DESC, correlation_id DESC LIMIT 1000)) AS average_scan_time_ms FROM lg"),
    "pair_turns": f"WITH {TURNS} SELECT conv_id, {PAIRED}",
    "attach_context": (
        "SELECT conv_id, turn, role, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM conversations"),
    "attach_document": (
        f"WITH {TURNS}, gens AS (SELECT conv_id, {PAIRED}), {RELEVANCE} SELECT conv_id, turn, md5(d.text) AS context_digest, relevance FROM rel LEFT JOIN documents d ON d.doc_id = conv_id"),
}

# Counts of disguised characters, the scripts as classes of the same names.
_HOMO, _INV = f"[{HOMO}]", f"[{INV}]"


def _count(cls: str) -> str:
    return f"len(regexp_extract_all(text, {s(cls)}))"


def _codes(cls: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(text, {s(cls)})[1:5], lambda c: 'U+' || lpad(upper(to_base(unicode(c), 16)), 4, '0')), ', ')"


_SCRIPTS = present([
    f"CASE WHEN regexp_matches(text, {s(script_class(r + [(65, 90), (97, 122)] if word == 'LATIN' else r))}) THEN {s(word)} END"
    for word, r in script_ranges().items()])
_TRICKS = (
    f"WITH {DOCS}, c AS (SELECT doc_id, {_count(_HOMO)} AS homoglyphs, {_count(_INV)} AS invisibles, {_count(f'[{v.RIGHT_TO_LEFT}]')} AS right_to_left, {_codes(_HOMO)} AS homoglyph_codes, "
    f"{_codes(_INV)} AS invisible_codes, {_SCRIPTS} AS sc FROM docs) "
)
ORACLES["unicode_tricks"] = (
    _TRICKS + "SELECT doc_id, homoglyphs, invisibles, right_to_left, homoglyph_codes, invisible_codes, array_to_string(sc, '|') AS scripts, "
    "(homoglyphs > 0)::BIGINT + (invisibles > 0)::BIGINT + (len(sc) > 2)::BIGINT + (right_to_left > 0)::BIGINT AS findings FROM c")
ORACLES["unicode_script_names"] = (
    _TRICKS + "SELECT doc_id, concat_ws('|', CASE WHEN homoglyphs > 0 THEN 'Homoglyph characters detected: ' || homoglyphs || ' characters (' || homoglyph_codes || ')' END, "
    "CASE WHEN invisibles > 0 THEN 'Invisible characters detected: ' || invisibles || ' characters (' || invisible_codes || ')' END, "
    "CASE WHEN len(sc) > 2 THEN 'Mixed Unicode scripts detected: ' || array_to_string(sc, ', ') END, "
    "CASE WHEN right_to_left > 0 THEN 'Right-to-left override characters detected: ' || right_to_left END) AS findings FROM c")

# Requests of the page table: path and method from the key and the url, the body is the page.
_PAGES = (
    "docs AS (SELECT page_id AS doc_id, '' AS source, '' AS lang, CASE WHEN page_id % 3 = 0 THEN '/' ELSE '/api/' END || regexp_extract(url, '//[^/]*/(.*)', 1) AS path, "
    f"['GET', 'POST', 'PUT'][(page_id % 5) % 3 + 1] AS verb, {planted_sql('html', 'page_id')} AS text FROM pages)")
ORACLES["request_log_guard"] = (
    f"WITH {INJECTED.replace(DOCS, _PAGES)}, {TOX}, g AS (SELECT i.*, {OVERALL} AS overall, starts_with(path, '/api/') AND verb IN ('POST', 'PUT') AS scanned "
    "FROM inj i JOIN tox USING (doc_id) JOIN (SELECT doc_id, path, verb FROM docs) USING (doc_id)), "
    "r AS (SELECT *, scanned AND is_injection AS x, scanned AND overall >= 0.7e0 AS t FROM g) SELECT doc_id AS page_id, "
    "CASE WHEN t THEN least(CASE WHEN x THEN 1e0 - confidence ELSE 1e0 END, 1e0 - overall) WHEN x THEN 1e0 - confidence ELSE 1e0 END AS score, "
    "CASE WHEN x OR t THEN 'block' ELSE 'allow' END AS action, scanned FROM r")
