"""Patterns, word lists, limits and formats that decide results.

Everything in this module is data.  The values have to stay exactly as they are for
results to agree with the documented behaviour; the logic that uses them lives in
``quietgate.operators``.
"""

# --- fixed values: prompt injection patterns (name, category, pattern) ---
INJECTION_PATTERNS = (
    ("ignore_previous", "direct_override", r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules|context)"),
    ("disregard_instructions", "direct_override", r"disregard\s+(all\s+)?(previous|prior|above|your)\s+(instructions|rules|guidelines)"),
    ("forget_instructions", "direct_override", r"forget\s+(all\s+)?(previous|prior|your)\s+(instructions|rules|context)"),
    ("override_instructions", "direct_override", r"override\s+(all\s+)?(previous|system|safety)\s+(instructions|rules|settings)"),
    ("new_instructions", "direct_override", r"(new|updated|revised)\s+instructions\s*[:=]"),
    ("do_not_follow", "direct_override", r"do\s+not\s+follow\s+(your|the|any)\s+(previous|original|initial)\s+instructions"),
    ("you_are_now", "role_manipulation", r"you\s+are\s+now\s+(a|an|the|DAN|evil|unrestricted|unfiltered)"),
    ("act_as", "role_manipulation", r"(act|behave|respond|pretend)\s+(as|like)\s+(a|an|the)?\s*(unrestricted|unfiltered|evil|DAN|jailbroken)"),
    ("dan_mode", "role_manipulation", r"(DAN|D\.A\.N|do\s+anything\s+now)\s+(mode|enabled|activated)"),
    ("roleplay_evil", "role_manipulation", r"(roleplay|role-play|role\s+play)\s+(as\s+)?(a\s+)?(villain|hacker|evil|malicious)"),
    ("developer_mode", "role_manipulation", r"(developer|dev|debug|maintenance|admin)\s+(mode|access)\s*(enabled|activated|on)?"),
    ("persona_switch", "role_manipulation", r"switch\s+(to|into)\s+(your\s+)?(alter\s+ego|evil\s+twin|unrestricted\s+mode)"),
    ("hypothetical_ai", "role_manipulation", r"(imagine|pretend|suppose)\s+you\s+(are|were)\s+an?\s+AI\s+(without|with\s+no)\s+(restrictions|filters|limitations)"),
    ("system_delimiter", "delimiter_injection", r"(```|---|\*\*\*|===)\s*(system|admin|root|prompt|instructions)\s*[:=\n]"),
    ("xml_system", "delimiter_injection", r"<\s*(system|admin|root|instruction|prompt)\s*>"),
    ("json_system", "delimiter_injection", r'["\']?(system|role|instruction)["\']?\s*[:=]\s*["\']'),
    ("markdown_header_system", "delimiter_injection", r"#+\s*(System|SYSTEM|Admin|ROOT)\s*(Prompt|Message|Instructions)"),
    ("hidden_instruction", "indirect_injection", r"(hidden|secret|embedded)\s+(instruction|command|directive|message)"),
    ("when_asked_respond", "indirect_injection", r"when\s+(asked|prompted|queried)\s+(about|for|regarding).*?(respond|reply|say|answer)\s+with"),
    ("if_anyone_asks", "indirect_injection", r"if\s+(anyone|someone|a\s+user)\s+asks.*?(tell|say|respond|reply)"),
    ("instruction_in_data", "indirect_injection", r"(IMPORTANT|NOTE|INSTRUCTION|ATTENTION)\s*[:=]\s*(ignore|override|forget|disregard)"),
    ("reveal_prompt", "prompt_extraction", r"(reveal|show|display|print|output|repeat)\s+(your\s+)?(system\s+)?(prompt|instructions|rules|guidelines)"),
    ("what_is_prompt", "prompt_extraction", r"what\s+(is|are)\s+your\s+(system\s+)?(prompt|instructions|rules|initial\s+instructions)"),
    ("beginning_of_conversation", "prompt_extraction", r"(repeat|output|print)\s+(everything|all)\s+(from\s+)?(the\s+)?(beginning|start)\s+(of\s+)?(the\s+)?(conversation|chat)"),
    ("copy_paste_prompt", "prompt_extraction", r"(copy|paste|type|write)\s+(out\s+)?(your\s+)?(entire\s+)?(system\s+)?(prompt|instructions|message)"),
    ("base64_instruction", "encoding_attack", r"(decode|interpret|execute|follow)\s+(this\s+)?(base64|encoded|encrypted)\s*([:=]|\s+instruction)"),
    ("rot13_instruction", "encoding_attack", r"(rot13|caesar|cipher)\s*[:=]"),
    ("token_smuggling", "token_manipulation", r"(\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|<\|system\|>|<\|user\|>|<\|assistant\|>)"),
    ("special_tokens", "token_manipulation", r"(<\|endoftext\|>|<\|pad\|>|<\|sep\|>|<s>|</s>|\[CLS\]|\[SEP\])"),
    ("spaced_ignore", "obfuscation", r"i\s*g\s*n\s*o\s*r\s*e\s+(p\s*r\s*e\s*v\s*i\s*o\s*u\s*s|a\s*l\s*l)"),
    ("leetspeak_ignore", "obfuscation", r"(1gn0r3|!gnore|ign0re)\s+(pr3v10us|prev!ous|all)"),
    ("unicode_bypass", "obfuscation", "[\u200b\u200c\u200d\u2060\ufeff]"),
)

# --- fixed values: structural markers ---
STRUCTURAL_MARKERS = (
    r"^\s*###?\s*(System|Assistant|User)\s*[:>]",
    r"^\s*(Human|AI|System|Assistant)\s*:",
    r"\[SYSTEM\]|\[ADMIN\]|\[ROOT\]|\[OVERRIDE\]",
    r"<\|system\|>|<\|assistant\|>|<\|user\|>",
    r"BEGIN\s+(SYSTEM|ADMIN|OVERRIDE)\s+(MESSAGE|INSTRUCTION|PROMPT)",
    r"END\s+OF\s+(USER\s+)?INPUT.*BEGIN\s+(SYSTEM|REAL|ACTUAL)\s+(INSTRUCTIONS|PROMPT)",
)

# --- fixed values: injection confidence and sensitivity levels ---
SENSITIVITY_THRESHOLDS = {"low": 0.8, "medium": 0.5, "high": 0.3}
DEFAULT_SENSITIVITY_THRESHOLD = 0.5
PATTERN_BASE, PATTERN_STEP = 0.4, 0.15
STRUCTURAL_BASE, STRUCTURAL_STEP = 0.5, 0.2
ENCODED_HIT, ENCODED_ONLY = 0.7, 0.3

# --- fixed values: encoded content ---
BASE64_RUN = r"[A-Za-z0-9+/]{16,}={0,2}"
ROT13_MARKER = r"(?:rot13|ROT13|rot-13)\s*[:=]\s*([A-Za-z\s]+)"
HOMOGLYPHS = {
    "\u0410": "A", "\u0412": "B", "\u0421": "C", "\u0415": "E", "\u041d": "H", "\u041a": "K", "\u041c": "M",
    "\u041e": "O", "\u0420": "P", "\u0422": "T", "\u0425": "X",
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x",
    "\uff21": "A", "\uff22": "B", "\uff23": "C",
    "\u2000": " ", "\u2001": " ", "\u2002": " ", "\u2003": " ", "\u00a0": " ",
}
INVISIBLE = (
    "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f\u202a\u202b\u202c\u2066\u2067\u2068\u2069"
)
RIGHT_TO_LEFT = "\u202e\u202b\u2067"

# --- fixed values: toxicity catalogue (category, weight, keywords, patterns) ---
KEYWORD_SCORE, REGEX_SCORE = 0.3, 0.4
TOXICITY_THRESHOLD = 0.7
TOXICITY = (
    ("hate_speech", 1.0,
     ("racial slur", "ethnic cleansing", "white supremacy", "master race", "subhuman", "inferior race",
      "go back to your country", "they're all criminals", "those people are animals"),
     (r"\b(hate|kill|exterminate|eliminate)\s+(all\s+)?(jews|muslims|christians|blacks|whites|asians|mexicans|immigrants|refugees)\b",
      r"\b(racial|ethnic)\s+(purity|superiority|inferiority)\b",
      r"\bdeath\s+to\s+(all\s+)?\w+\b")),
    ("harassment", 0.9,
     ("i'll find you", "you're worthless", "kill yourself", "nobody likes you", "you deserve to die", "dox you",
      "i know where you live", "swatting", "cyberbully"),
     ("\\bi['\u2019]?ll\\s+(find|hunt|track|get)\\s+(you|them|him|her)\\b",
      r"\byou\s+(should|deserve\s+to)\s+(die|suffer|be\s+hurt)\b",
      r"\b(dox|doxx|swat)\s+(you|them|him|her)\b",
      r"\b(stalk|harass|threaten|intimidate)\s+(you|them|him|her)\b")),
    ("sexual_content", 1.0,
     ("explicit sexual", "child exploitation", "csam", "sexual abuse", "non-consensual", "revenge porn",
      "sexual predator"),
     (r"\b(child|minor|underage)\s+(sex|porn|exploitation|abuse)\b",
      r"\b(sexual|indecent)\s+(assault|abuse|exploitation|harassment)\b",
      r"\b(revenge\s+porn|non-?consensual\s+(porn|sex|image))\b")),
    ("violence", 1.0,
     ("how to kill", "murder plan", "mass shooting", "bomb threat", "terrorist attack", "torture methods",
      "school shooting", "assassination"),
     (r"\b(how\s+to|plan\s+to|going\s+to)\s+(kill|murder|assassinate|attack)\b",
      r"\b(mass|school|church|mosque)\s+(shooting|attack|bombing)\b",
      r"\b(torture|mutilate|dismember)\s+(someone|a\s+person|them|him|her)\b",
      r"\b(bomb|explosive)\s+(threat|making|instructions|recipe)\b")),
    ("self_harm", 1.0,
     ("how to kill myself", "suicide methods", "painless death", "end my life", "cut myself", "self-mutilation",
      "pro-ana", "pro-mia"),
     (r"\b(how\s+to|ways\s+to|methods\s+to)\s+(kill\s+myself|commit\s+suicide|end\s+my\s+life)\b",
      r"\b(want\s+to|going\s+to)\s+(die|kill\s+myself|hurt\s+myself|end\s+it)\b",
      r"\b(self[- ]?harm|self[- ]?mutilat|cutting\s+myself)\b",
      r"\b(suicide\s+note|suicide\s+plan|suicide\s+method)\b")),
    ("dangerous_content", 0.9,
     ("how to make a bomb", "synthesize drugs", "make poison", "hack into", "steal identity", "counterfeit money",
      "biological weapon", "chemical weapon"),
     (r"\b(how\s+to|instructions?\s+for)\s+(make|build|create|synthesize)\s+(a\s+)?(bomb|explosive|weapon|poison|drug|meth)\b",
      r"\b(biological|chemical|nuclear)\s+(weapon|warfare|attack)\b",
      r"\b(hack|break)\s+into\s+(a\s+)?(bank|government|system|server|account)\b",
      r"\b(counterfeit|forge)\s+(money|currency|documents|identity)\b")),
)

# --- fixed values: profanity list and content filter bands ---
PROFANITY = ("fuck", "shit", "bitch", "asshole", "bastard", "damn", "crap", "dick", "piss")
PROFANITY_REPLACEMENT = "***"
BAND_TOP, BAND_MIDDLE = 0.9, 0.7

# --- fixed values: personal data patterns (type, pattern, confidence), in detection order ---
PII_PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    ("PHONE", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.85),
    ("PHONE", r"\b\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b", 0.80),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.95),
    ("SSN", r"\b\d{3}\s\d{2}\s\d{4}\b", 0.85),
    ("CREDIT_CARD", r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.90),
    ("CREDIT_CARD", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.90),
    ("CREDIT_CARD", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b", 0.90),
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.75),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.90),
    ("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.85),
    ("DATE_OF_BIRTH", r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", 0.70),
    ("DATE_OF_BIRTH", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b", 0.70),
    ("DATE_OF_BIRTH", r"(?:date\s+of\s+birth|DOB|born\s+on|birthday)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 0.90),
    ("ADDRESS", r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Lane|Ln|Road|Rd|Way|Place|Pl)\b\.?", 0.75),
    ("ADDRESS", r"\b\d{5}(?:-\d{4})?\b", 0.50),
)
NAME_PATTERNS = (
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Lord|Lady)\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
    r"(?:name\s+is|called|known\s+as|I\s+am|my\s+name)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})",
)
NAME_TYPE, NAME_CONFIDENCE, CUSTOM_PII_CONFIDENCE = "NAME", 0.65, 0.8
PII_TYPES = ("EMAIL", "PHONE", "SSN", "CREDIT_CARD", "ADDRESS", "NAME", "IP_ADDRESS", "DATE_OF_BIRTH")

# --- fixed values: redaction formats ---
MASK_TEXT = "[REDACTED]"
HASH_DIGITS = 12
ANONYMIZED = "[ANONYMIZED]"
STAND_INS = {
    "EMAIL": ("user@example.com", "contact@example.org", "info@example.net"),
    "PHONE": ("(555) 000-0001", "(555) 000-0002", "(555) 000-0003"),
    "SSN": ("000-00-0000", "000-00-0001", "000-00-0002"),
    "CREDIT_CARD": ("0000-0000-0000-0000", "0000-0000-0000-0001"),
    "IP_ADDRESS": ("0.0.0.0", "127.0.0.1"),
    "NAME": ("John Doe", "Jane Smith", "Alex Johnson"),
    "ADDRESS": ("123 Example Street", "456 Test Avenue"),
    "DATE_OF_BIRTH": ("01/01/2000", "01/01/1990"),
}

# --- fixed values: policy vocabulary, ranked from mild to severe ---
RULE_TYPES = ("regex", "keyword", "threshold", "custom")
ACTIONS = ("log", "warn", "redact", "block")
SEVERITIES = ("low", "medium", "high", "critical")
DEFAULT_LEVEL = "moderate"

# --- fixed values: preset policies (rule = type, description, pattern or keywords) ---
OVERRIDE_RULES = (
    ("regex", "Direct instruction override", r"ignore\s+(all\s+)?previous\s+instructions"),
    ("regex", "System prompt override attempt", r"(system\s*prompt|system\s*message)\s*[:=]"),
    ("regex", "Role manipulation attempt", r"you\s+are\s+now\s+(a|an|the|DAN|evil|unrestricted)"),
    ("keyword", "Known jailbreak terms", ("DAN mode", "jailbreak", "developer mode override")),
)
HARM_RULES = (
    ("keyword", "Weapons/explosives instructions", ("how to make a bomb", "build a weapon", "synthesize poison")),
    ("keyword", "Self-harm content", ("how to hurt yourself", "suicide methods")),
)
PERSONAL_DATA_RULES = (
    ("regex", "Social Security Number detected", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("regex", "Credit card number detected", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("regex", "Email address detected", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
)
TOPIC_RULES = (
    ("keyword", "Off-topic: political content", ("vote for", "election fraud", "political party")),
    ("keyword", "Off-topic: religious debate", ("my religion is better", "infidel", "heretic")),
)
# (policy, description, action, severity, rules)
PRESETS = {
    "strict": (
        ("strict_injection_prevention", "Block all suspected prompt injection attempts", "block", "critical",
         OVERRIDE_RULES + (
             ("regex", "Instruction-like language", r"(do not|don't|never)\s+(mention|say|reveal|tell)"),
             ("regex", "Delimiter abuse", r"(```|---|\*\*\*)\s*(system|admin|root|prompt)"),
             ("regex", "Encoded content suspicious pattern", r"[A-Za-z0-9+/]{20,}={0,2}"))),
        ("strict_harmful_content", "Block all harmful content with zero tolerance", "block", "critical",
         HARM_RULES + (("keyword", "Violence-related terms", ("kill", "murder", "attack plan")),)),
        ("strict_pii_protection", "Block any PII in inputs or outputs", "block", "critical",
         PERSONAL_DATA_RULES + (
             ("regex", "Phone number detected", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),)),
        ("strict_topic_enforcement", "Strict topic boundary enforcement", "block", "high", TOPIC_RULES),
    ),
    "moderate": (
        ("moderate_injection_prevention", "Block clear injection attempts, warn on borderline cases", "block", "high",
         OVERRIDE_RULES),
        ("moderate_harmful_content", "Block clearly harmful content", "block", "high", HARM_RULES),
        ("moderate_pii_protection", "Redact PII found in text", "redact", "medium", PERSONAL_DATA_RULES),
        ("moderate_topic_enforcement", "Warn on off-topic content", "warn", "low", TOPIC_RULES),
    ),
    "permissive": (
        ("permissive_injection_prevention", "Log injection attempts, block only obvious ones", "block", "high",
         (("regex", "Direct instruction override", r"ignore\s+all\s+previous\s+instructions"),)),
        ("permissive_harmful_content", "Log potentially harmful content", "log", "medium", HARM_RULES),
        ("permissive_pii_protection", "Log PII detection", "log", "low", PERSONAL_DATA_RULES),
    ),
}
CUSTOM_TEMPLATE = (
    "custom_policy", "Custom safety policy — modify rules as needed", "warn", "medium",
    (("keyword", "Custom keyword rule", ("REPLACE_WITH_YOUR_KEYWORDS",)),
     ("regex", "Custom regex rule", "REPLACE_WITH_YOUR_PATTERN"),
     ("threshold", "Custom threshold rule", 0.8)),
)

# --- fixed values: stop words of the text checks ---
CLAIM_STOP_WORDS = (
    "the a an is are was were be been have has had do does did will would could should may might shall can and or "
    "but in on at to for of with it this that these those not no"
).split()
RELEVANCE_STOP_WORDS = (
    "the and for are but not you all can had her was one our out has have been would could should will with this "
    "that from they were what when where which who how than into some them then these those your"
).split()
GROUNDING_STOP_WORDS = (
    "the and for are but not you all this that with from have been would could should will they were what when than"
).split()
TOPIC_STOP_WORDS = "the a an is are was were be been and or in on at to for of with about".split()
FILLER_OPENINGS = ("please", "note that", "in summary", "overall")

# --- fixed values: thresholds of the text checks ---
CLAIM_MIN_CHARS, CLAIM_SUPPORT, CLAIM_DEFAULT = 10, 0.4, 0.5
WORD_SHARE, FRAGMENT_SHARE = 0.6, 0.4
FRAGMENT_CHARS, FRAGMENT_STEP = 20, 10
SNIPPET_CHARS, SNIPPET_STEP = 200, 100
RELEVANCE_THRESHOLD, GROUNDING_THRESHOLD, UNGROUNDED_SHARE = 0.3, 0.4, 0.5
GROUNDING_MIN_CHARS = 15
TOPIC_HIT, TOPIC_PERMISSIVE, TOPIC_SEMANTIC = 0.3, 0.1, 0.5

# --- fixed values: behaviour and rate limits ---
HISTORY_ROWS, HISTORY_SECONDS = 100, 3600
INJECTION_REPEATS, VOLUME_LIMIT, ESCALATION_ROWS, ESCALATION_SHARE = 3, 50, 5, 0.6
JAILBREAK_ROWS, JAILBREAK_HITS, JAILBREAK_SHARE, JAILBREAK_CHARS = 10, 3, 0.5, 50
RISK_WEIGHTS = (0.4, 0.3, 0.3)
TIER_LIMITS = {"normal": 60, "warning": 20, "restricted": 5}
LIMIT_SECONDS, WARNINGS_TO_ESCALATE, BLOCKS_TO_ESCALATE = 60, 3, 1

# --- fixed values: audit log ---
AUDIT_PREVIEW, AUDIT_TAIL, METRIC_ROWS = 100, 100, 1000
PROTECTED_PREFIXES = ("/api/",)
SCANNED_METHODS = ("POST", "PUT", "PATCH")
