"""Fixed values of the detectors.

Every list below must hold exactly these entries for scores to come out right; the
regular expressions are in Python syntax and are turned into Spark patterns by
``wardspark.functions.text.spark_regex``.
"""

# --- fixed values: hallucination lexicons, matched as substrings of lower-cased text ---

UNCERTAINTY = [
    "i think", "maybe", "possibly", "might be", "could be",
    "i'm not sure", "uncertain", "probably", "perhaps",
    "i believe", "it seems", "apparently", "supposedly",
    "as far as i know", "to the best of my knowledge",
    "i'm not certain", "it might", "it could",
]

OVERCONFIDENCE = [
    "definitely", "absolutely", "certainly", "undoubtedly",
    "always", "never", "everyone knows", "it's obvious",
    "without a doubt", "100%", "guaranteed", "proven fact",
    "universally accepted", "indisputable",
]

FABRICATION = [
    "according to studies", "research shows", "experts say",
    "statistics show", "data indicates", "sources confirm",
    "scientists have found", "a study found", "recent research",
    "it has been proven", "evidence suggests", "reports indicate",
    "surveys show", "analysis reveals",
]

# Pairs of statements that contradict each other. The first one asks for a repeated
# word prefix, which is the same as a repeated first character.
CONTRADICTIONS = [
    r"is\s+(\w).*?is\s+not\s+\1",
    r"always.*?never|never.*?always",
    r"all\s+\w+.*?no\s+\w+|no\s+\w+.*?all\s+\w+",
]

# signal -> (hits that saturate it, weight); words saturate at 500 and count half.
HALLUCINATION_WEIGHTS = {
    "uncertainty": (4.0, 0.25),
    "overconfidence": (3.0, 0.25),
    "fabrication": (2.0, 0.35),
    "contradiction": (2.0, 0.10),
    "length": (500.0, 0.05),
}

# --- fixed values: personal data, category -> (pattern, ignore case) ---

PII_PATTERNS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", True),
    "phone_us": (r"\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", False),
    "phone_intl": (r"\b\+?[1-9]\d{1,14}\b", False),
    "ssn": (r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", False),
    "credit_card": (
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|"
        r"3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|"
        r"(?:2131|1800|35\d{3})\d{11})\b", False),
    "ip_address": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False),
    "date_of_birth": (
        r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])[-/](?:19|20)\d{2}\b|"
        r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b", False),
    "address": (
        r"\b\d{1,5}\s+\w+\s+(?:street|st|avenue|ave|road|rd|highway|hwy|square|sq|"
        r"trail|trl|drive|dr|court|ct|park|parkway|pkwy|circle|cir|boulevard|blvd|"
        r"lane|ln)\b", True),
    "zip_code": (r"\b\d{5}(?:-\d{4})?\b", False),
    "passport": (r"\b[A-Z]{1,2}[0-9]{6,9}\b", False),
    "drivers_license": (r"\b[A-Z]{1,2}\d{5,8}\b", False),
}

# --- fixed values: prompt injection, category -> (weight, patterns), case ignored ---

INJECTION_PATTERNS = {
    "role_manipulation": (0.9, [
        r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
        r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?)",
        r"forget\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?)",
        r"you\s+are\s+now\s+(a|an)\s+\w+",
        r"pretend\s+(you\s+are|to\s+be)",
        r"act\s+as\s+(if\s+you\s+are|a|an)",
        r"from\s+now\s+on\s+you\s+(will|are|must)",
        r"your\s+new\s+(role|persona|character)\s+is",
        r"switch\s+to\s+\w+\s+mode",
    ]),
    "extraction": (0.8, [
        r"(show|reveal|display|print|output)\s+(me\s+)?(your|the)\s+(system|initial|original)\s+(prompt|instructions?|rules?)",
        r"what\s+(are|is|were)\s+your\s+(system|initial|original)\s+(prompt|instructions?|rules?)",
        r"repeat\s+(the|your)\s+(system|initial|first)\s+(prompt|message|instructions?)",
        r"echo\s+(your|the)\s+(instructions?|prompt|rules?)",
        r"tell\s+me\s+your\s+(secret|hidden)\s+(instructions?|prompt)",
    ]),
    "delimiter": (0.7, [
        r"<\|.*?\|>",
        r"\[INST\]|\[\/INST\]",
        r"<<SYS>>|<</SYS>>",
        r"```system|```assistant|```user",
        r"###\s*(system|user|assistant|instruction)",
    ]),
    "jailbreak": (1.0, [
        r"\bDAN\b",
        r"jailbr[e]?ak",
        r"bypass\s+(safety|filter|restriction|guardrail)",
        r"developer\s+mode",
        r"sudo\s+mode",
        r"god\s+mode",
        r"unrestricted\s+mode",
        r"no\s+restrictions?",
        r"remove\s+(all\s+)?(restrictions?|filters?|safety)",
        r"disable\s+(safety|content\s+filter|moderation)",
    ]),
    "social_engineering": (0.5, [
        r"(please|pretty\s+please)\s+just\s+(this\s+once|help\s+me)",
        r"(it'?s|this\s+is)\s+(urgent|emergency|life\s+or\s+death)",
        r"(my\s+|the\s+)?boss\s+will\s+fire\s+me",
        r"i'?ll\s+be\s+(fired|in\s+trouble)",
        r"just\s+between\s+(us|you\s+and\s+me)",
        r"don'?t\s+tell\s+anyone",
        r"this\s+is\s+for\s+(research|educational|testing)\s+purposes?",
    ]),
}
