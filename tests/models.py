"""Plain Python counterparts used to check the Spark jobs on small inputs."""

import base64
import hashlib
import re

from quietgate import fixed_values as v


def injection_layers(text):
    """(pattern names, marker patterns, names per decoded item) of a text."""
    both = re.IGNORECASE | re.MULTILINE
    names = [n for n, _, p in v.INJECTION_PATTERNS if re.search(p, text, both)]
    markers = [m for m in v.STRUCTURAL_MARKERS if re.search(m, text, both)]
    encoded = [[n for n, _, p in v.INJECTION_PATTERNS if re.search(p, item, re.I)] for item in decoded(text)]
    return names, markers, encoded


def decoded(text):
    return [d for _, d, _, _ in base64_items(text)] + [d for d in rot13(text)] + disguised(text)


def base64_items(text):
    out = []
    for m in re.finditer(v.BASE64_RUN, text):
        run = m.group()
        try:
            plain = base64.b64decode(run + "=" * (-len(run) % 4), validate=True).decode("utf-8")
        except ValueError:
            continue
        if plain.isprintable() and len(plain) >= 4:
            out.append((run, plain, m.start(), m.end()))
    return out


def rot13(text):
    shift = lambda c: chr((ord(c.lower()) - 97 + 13) % 26 + (97 if c.islower() else 65)) if c.isalpha() else c
    return ["".join(map(shift, m.group(1).strip())) for m in re.finditer(v.ROT13_MARKER, text, re.I)]


def disguised(text):
    table = str.maketrans({**v.HOMOGLYPHS, **dict.fromkeys(v.INVISIBLE)})
    plain = text.translate(table)
    return [plain[:100]] if plain != text else []


def toxicity(text):
    out = {}
    for category, weight, words, patterns in v.TOXICITY:
        total = 0.0
        for w in words:
            total += 0.3 if w in text.lower() else 0.0
        for p in patterns:
            total += 0.4 if re.search(p, text, re.I) else 0.0
        out[category] = min(1.0, total * weight)
    return out


def entities(text):
    """(type, text, start, end) by position; the first pattern that finds a span keeps it."""
    rules = [(t, p, re.I) for t, p, _ in v.PII_PATTERNS] + [("NAME", p, 0) for p in v.NAME_PATTERNS]
    found = {}
    for kind, pattern, flags in rules:
        for m in re.finditer(pattern, text, flags):
            found.setdefault(m.span(), (kind, m.group(), *m.span()))
    return sorted(found.values(), key=lambda e: e[2])


def redacted(text, found, strategy):
    counts = {}
    for kind, hit, start, end in sorted(found, key=lambda e: -e[2]):
        n = counts[kind] = counts.get(kind, 0) + 1
        options = v.STAND_INS[kind]
        text = text[:start] + {
            "mask": v.MASK_TEXT, "hash": f"[HASH:{hashlib.sha256(hit.encode()).hexdigest()[:12]}]",
            "placeholder": f"[{kind}_{n}]", "anonymize": options[(n - 1) % len(options)]}[strategy] + text[end:]
    return text


def limiter(events, limits, window, warnings, blocks):
    """Decisions (event, allowed, remaining, tier, window start) of one user's ordered events (event, time, kind)."""
    out, state = [], None
    for event, at, kind in events:
        if kind == "reset":
            state = None
            continue
        state = state or {"tokens": limits["normal"], "start": at, "tier": "normal", "warning": 0, "block": 0}
        if kind == "check":
            if at - state["start"] >= window:
                state.update(tokens=limits[state["tier"]], start=at)
            allowed = state["tokens"] > 0
            state["tokens"] -= allowed
            out.append((event, allowed, state["tokens"], state["tier"], state["start"]))
            continue
        state[kind] += 1
        tier = "restricted" if state["block"] >= blocks else "warning" if state["warning"] >= warnings else "normal"
        if tier != state["tier"]:
            state.update(tier=tier, tokens=limits[tier])
    return out


def history(events, i, rows, seconds):
    """Events of one user (time, event, ...) that count at event ``i`` of the ordered list."""
    return [e for e in events[: i + 1][-rows:] if e[0] >= events[i][0] - seconds]
