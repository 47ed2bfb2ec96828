"""Word lists, constants and patterns that results depend on."""

# BM25 and retrieval constants.
K1, B = 1.5, 0.75
FIELDS = {"title": 2.0, "section": 1.5, "content": 1.0}
TOP_K, FIELD_DEPTH = 30, 90
DENSE, SPARSE, EXPANDED = 0.75, 0.25, 0.1
SECTION_BOOST = 1.15
FEEDBACK_DOCS, FEEDBACK_TERMS, TERM_LENGTH = 3, 10, 3
NEIGHBOURS, MAX_ARTICLES, BODY_CHARS, PAGE_CHARS, PAGE_GAP = 2, 8, 6000, 8000, 0.1
REFUSE, CONFIDENT = 0.70, 0.80
PRIOR_BOOST, PRIOR_FULL, PRIOR_HALF_LIFE, PRIOR_ENTRIES = 1.12, 3, 30.0, 500
RERANKED = 20

# Words that say nothing about a document, in feedback expansion.
EXPANSION_STOPWORDS = (
    "the and for you your with that this from are can will has have had was were been being not but all any our out use used using when where how what which who why then than them they there"
    " here into onto its it's also more most some such only own same each other under over after before click select page see make want need should would"
).split()

# What makes a question lean on the one before it.
FOLLOW_UP_OPENERS = ["and", "what about", "how about", "also", "but", "or", "then", "plus", "what if", "and what", "and how", "ok and", "okay and", "same for", "and for", "and in", "and on", "what of"]
REFERENTIAL = "it its it's that this those these them they there same one ones above instead".split()
QUESTION_STOPWORDS = (
    "the a an and or but for in on at to of is are was were be do does did how what why when where who which can could should would will"
    " my me i you your we us about with from as if then than so not no yes get got make use"
).split()

# Whole utterances that ask nothing.
GREETINGS = ["hi", "hii", "hiya", "hello", "hey", "heya", "yo", "howdy", "good morning", "good afternoon", "good evening", "morning", "evening", "hi there", "hello there", "hey there", "anyone there", "you there", "are you there"]
THANKS = ["thanks", "thank you", "thankyou", "thx", "ty", "tysm", "cheers", "ta", "thanks a lot", "thanks so much", "thank you so much", "many thanks", "appreciate it", "much appreciated", "perfect thanks", "great thanks", "got it thanks", "that helped", "that helps", "brilliant", "perfect", "great", "nice", "awesome", "cool", "ok thanks", "okay thanks"]
FAREWELLS = ["bye", "goodbye", "bye bye", "see you", "see ya", "cya", "later", "good night", "goodnight", "night", "that's all", "thats all", "that is all", "nothing else", "no thanks", "im done", "i'm done", "all done"]
ACKNOWLEDGEMENTS = ["ok", "okay", "k", "kk", "sure", "right", "yeah", "yep", "yes", "no", "nope", "mhm", "uh huh", "i see", "makes sense", "understood", "noted", "fine"]
SMALL_TALK_WORDS = 4

# Parameters of URLs that only track, and parts of URLs that act or hold no text.
TRACKING = "gclid fbclid msclkid mc_cid mc_eid ref ref_src source _ga yclid".split()
ACTING_SEGMENTS = "logout signout signoff endsession destroysession unsubscribe deactivate revoke".split()
ACTING_PAIRS = "sessiondestroy sessionsdestroy accountdelete accountclose".split()
ACTIONS = "logout signout delete remove destroy reset unsubscribe".split()
BINARY = r"(?i)\.(pdf|zip|gz|tar|rar|7z|csv|tsv|xlsx?|docx?|pptx?|odt|ods|png|jpe?g|gif|svg|webp|ico|bmp|tiff?|mp[34]|m4[av]|mov|avi|wmv|webm|wav|ogg|woff2?|ttf|eot|exe|dmg|pkg|apk|bin|iso)(\?|#|$)"
ATTACHMENT = r"(?i)/(attachments?|downloads?|uploads?|files?)/[^/]*\d"

# Personal data by form, in the order in which they are replaced; {b} is a word boundary.
MASKS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    ("key", r"{b}(?:sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}){b}", "[api-key]"),
    ("card", r"{b}(?:[0-9][ -]?){13,19}{b}", "[card]"),
    ("ssn", r"{b}[0-9]{3}-[0-9]{2}-[0-9]{4}{b}", "[ssn]"),
    ("uuid", r"{b}[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}{b}", "[id]"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{3,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}{b}", "[phone]"),
    ("ip", r"{b}(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]){b}", "[ip]"),
]
EGRESS = ("email", "card", "ssn", "key")

# Titles that no starter question comes from.
NOISE_TITLES = r"(?i){b}(release notes?|changelog|what'?s new|coming soon|deprecat|web release|home|index|overview page|sitemap){b}"
MONTH_TITLES = r"(?i){b}(january|february|march|april|may|june|july|august|september|october|november|december){b}.*[0-9]{4}"

# What providers say about a failure, by what it means.
QUOTA_SAID = ["insufficient_quota", "insufficient quota", "exceeded your current quota", "billing", "credit balance is too low", "quota exceeded", "resource_exhausted", "plan and billing"]
MODEL_SAID = ["does not exist", "model_not_found", "unknown model", "is not found", "not_found_error", "invalid model"]
FILTER_SAID = ["content_filter", "content policy", "safety", "blocked", "prohibited_content"]
RATE_SAID = ["rate limit", "rate_limit", "too many requests", "overloaded", "slow down", "try again later"]
DOWN_SAID = ["internal server error", "internal error", "service unavailable", "bad gateway", "upstream"]
CONTEXT_SAID = ["context_length_exceeded", "maximum context length", "too many tokens", "prompt is too long", "request too large"]

# Verbs that titles of tasks begin with.
TASK_VERBS = (
    "add archive assign build configure connect create customise customize delete disable download edit enable export filter generate import install integrate invite"
    " manage migrate publish remove request reset rotate schedule send set share sync track troubleshoot update upload use view"
).split()

# The reply that a model is told to give when its context has no answer, and the rules it is given.
REFUSAL = "I don't have that in this index."
PROMPT_RULES = [
    "You answer questions using ONLY the CONTEXT below, which comes from a documentation site.",
    "Rules:",
    "- Use only facts present in the context. Do not use outside knowledge.",
    "- Cite the source of each claim inline as [n], matching the context numbers.",
    "- Preserve procedural structure: if the source lists numbered steps, answer in numbered steps.",
    "- Give the COMPLETE procedure. Include every step through to the end, not just the first few.",
    "- Do not summarise a procedure into prose. Steps stay steps.",
    "- If the context covers only part of what was asked, answer that part and say plainly which part is missing.",
    f'- If the answer is not in the context, reply exactly: "{REFUSAL}"',
]

# Fixed values: (kind, retryable, terminal, retried unasked, shown as, counts for the breaker).
ERROR_POLICIES = [
    ("auth_invalid", False, True, False, "banner", False), ("rate_limited", True, False, True, "banner", False), ("quota_exhausted", False, True, False, "banner", False), ("model_not_found", False, True, False, "banner", False),
    ("bad_request", False, True, False, "banner", False), ("content_filtered", False, True, False, "inline", False), ("provider_down", True, False, True, "banner", True), ("timeout", True, False, True, "banner", True),
    ("cancelled", False, True, False, "silent", False), ("network", True, False, False, "banner", True), ("empty_stream", True, False, False, "banner", True), ("stream_truncated", True, False, False, "inline", False),
    ("circuit_open", False, False, False, "banner", False), ("unknown", True, False, False, "banner", True),
]

#: A boundary between ASCII word characters and anything else, for Java; DuckDB's \b is the same.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    return pattern.replace("{b}", BOUNDARY)


def duck(pattern: str) -> str:
    return pattern.replace("{b}", r"\b")
