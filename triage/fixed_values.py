"""Values that results depend on.

Everything in this module is data: category names, word lists, lookup tables,
thresholds and formula constants. Operators take them as default arguments, so
each can be replaced by the caller.
"""

# --- Fixed values: category names, in declared order --------------------------

CATEGORIES = (
    "Billing",
    "Authentication",
    "Bug Report",
    "Feature Request",
    "Technical Setup",
)

# --- Fixed values: raw ticket columns ----------------------------------------

REQUIRED_COLUMNS = ("subject", "body", "queue", "type", "tag_1", "language")
OPTIONAL_COLUMNS = ("tag_2", "tag_3", "tag_4", "priority")
RULE_TEXT_COLUMNS = ("subject", "body", "tag_1", "tag_2", "tag_3", "tag_4")

# --- Fixed values: queue and tag lookups --------------------------------------

QUEUE_CATEGORY = {"Billing and Payments": "Billing"}

TAG_CATEGORY = {
    "billing": "Billing",
    "payment": "Billing",
    "refund": "Billing",
    "subscription": "Billing",
    "account": "Authentication",
    "login": "Authentication",
    "password": "Authentication",
    "access": "Authentication",
    "auth": "Authentication",
    "security": "Authentication",
    "bug": "Bug Report",
    "crash": "Bug Report",
    "error": "Bug Report",
    "outage": "Bug Report",
    "performance": "Bug Report",
    "feature": "Feature Request",
    "enhancement": "Feature Request",
    "integration": "Technical Setup",
    "setup": "Technical Setup",
    "installation": "Technical Setup",
    "configuration": "Technical Setup",
    "documentation": "Technical Setup",
    "onboarding": "Technical Setup",
    "api": "Technical Setup",
    "sdk": "Technical Setup",
}

# --- Fixed values: keywords per category, matched as substrings ---------------

BILLING_KEYWORDS = (
    "invoice", "invoicing", "billing", "bill",
    "charged", "charge", "charges", "double charge", "charged twice",
    "refund", "refunds", "refunded",
    "payment", "payments", "pay",
    "subscription", "subscribe", "renewal", "renew", "auto-renew",
    "pricing", "price", "cost", "quote",
    "credit card", "debit card", "payment method", "payment methods",
    "tax", "vat", "gst",
    "discount", "coupon", "promo code", "promo",
    "receipt", "receipts",
    "plan change", "upgrade plan", "downgrade plan", "change plan",
    "trial", "free trial",
    "money", "usd", "eur", "$", "€", "£",
    "billing cycle", "billing period",
    "overcharge", "overcharged", "undercharged",
)

AUTHENTICATION_KEYWORDS = (
    "login", "log in", "log-in", "logon", "sign in", "sign-in", "signin",
    "password", "passcode", "pin code",
    "two-factor", "2fa", "two factor", "two-factor authentication",
    "authentication", "auth code", "verification code", "otp",
    "reset my password", "reset password", "forgot password", "forgot my password",
    "can't access", "cannot access", "unable to access", "unable to log in",
    "unable to login", "cant log in", "cant login",
    "account locked", "account is locked", "account suspended",
    "session expired", "session timeout", "token expired", "access token",
    "single sign-on", "sso", "okta", "active directory",
    "mfa", "multi-factor",
    "wrong password", "incorrect password", "invalid credentials",
    "lost my password", "recover account", "account recovery",
)

BUG_REPORT_KEYWORDS = (
    "bug", "defect", "broken", "crash", "crashes", "crashed", "crashing",
    "freezes", "freezing", "hangs", "hanging", "hangup",
    "error message", "error code", "exception", "stack trace",
    "not working", "doesn't work", "does not work", "stopped working",
    "is broken", "got broken",
    "blank screen", "white screen", "black screen", "blue screen",
    "data loss", "data lost", "lost data",
    "corrupted", "corruption", "corrupt file",
    "500 error", "404", "http 500", "http 404", "http 503",
    "outage", "downtime", "service is down", "system is down",
    "can't open", "cannot open", "unable to open", "won't open",
    "keeps crashing", "keeps closing",
    "unresponsive", "not responding",
    "glitch", "glitching",
    "regression", "regressed",
)

FEATURE_REQUEST_KEYWORDS = (
    "feature request", "feature suggestion", "suggestion:",
    "could you add", "can you add", "would you add", "please add",
    "would be great if", "would love if", "wish there was",
    "wishlist", "roadmap", "enhancement",
    "support for", "add support for", "support the following",
    "integrate with", "integration with", "integrate ",
    "ability to", "option to",
    "is it possible to", "are there plans to",
    "dark mode", "light mode",
    "export to", "import from",
    "bulk ", "bulk-",
)

TECHNICAL_SETUP_KEYWORDS = (
    "how to", "how do i", "how can i", "how do you",
    "install", "installation", "installing",
    "setup", "set up", "set-up",
    "configure", "configuration", "configuring",
    "step by step", "instructions for",
    "tutorial", "guide", "walkthrough",
    "where do i", "where can i", "where should i",
    "onboarding", "getting started",
    "sdk", "api key", "api keys",
    "environment variable", "env var", ".env",
    "docker", "kubernetes", "k8s",
    "ci/cd", "pipeline",
    "integration guide",
)

# Rules are tried in this order; the first category with a hit wins.
KEYWORD_RULES = (
    ("Billing", BILLING_KEYWORDS),
    ("Authentication", AUTHENTICATION_KEYWORDS),
    ("Bug Report", BUG_REPORT_KEYWORDS),
    ("Feature Request", FEATURE_REQUEST_KEYWORDS),
    ("Technical Setup", TECHNICAL_SETUP_KEYWORDS),
)

# --- Fixed values: urgency phrases and their change to the compound score ------

URGENCY_PHRASES = (
    ("charged twice", -0.30),
    ("double charged", -0.30),
    ("double charge", -0.30),
    ("overcharged", -0.20),
    ("wrong charge", -0.20),
    ("unauthorized charge", -0.35),
    ("refund", -0.05),
    ("lost money", -0.25),
    ("unacceptable", -0.30),
    ("ridiculous", -0.25),
    ("outage", -0.20),
    ("down for hours", -0.25),
    ("completely down", -0.30),
    ("data loss", -0.35),
    ("data breach", -0.35),
    ("lost data", -0.30),
    ("lawsuit", -0.40),
    ("legal action", -0.40),
    ("cancel my subscription", -0.25),
    ("cancel my account", -0.25),
    ("switching to a competitor", -0.30),
    ("switching to competitor", -0.25),
    ("competitor", -0.10),
    ("urgent", -0.15),
    ("asap", -0.15),
    ("immediately", -0.15),
    ("right now", -0.10),
    ("furious", -0.30),
    ("infuriating", -0.25),
    ("horrible", -0.20),
    ("worst", -0.20),
    ("terrible", -0.20),
    ("garbage", -0.25),
    ("scam", -0.30),
    ("fraud", -0.35),
)

# --- Fixed values: sentiment labels and thresholds ------------------------------

SENTIMENTS = ("Positive", "Neutral", "Frustrated", "Angry")
URGENCY_DELTA_CAP = 0.60
POSITIVE_FROM = 0.20
FRUSTRATED_BELOW = -0.05
ANGRY_BELOW = -0.50
ANGRY_HITS = 2
ANGRY_NEG = 0.35
INTENSITY_PER_HIT = 0.10
INTENSITY_HIT_CAP = 0.30

# --- Fixed values: validation ---------------------------------------------------

PLANS = ("free", "pro", "enterprise")
DEFAULT_PLAN = "free"
MIN_TEXT_CHARS = 1
MAX_TEXT_CHARS = 8000

# --- Fixed values: priority formula ----------------------------------------------

PRIORITY_URGENCY = 40.0
PRIORITY_NEGATIVE = 30.0
PRIORITY_PLAN = 20.0
PRIORITY_CONFIDENCE = 10.0
P1_FROM = 70.0
P2_FROM = 40.0

# --- Fixed values: teams -----------------------------------------------------------

TEAM_OF_CATEGORY = {
    "Billing": "billing-team",
    "Authentication": "identity-team",
    "Bug Report": "engineering-team",
    "Feature Request": "product-team",
    "Technical Setup": "support-team",
}
DEFAULT_TEAM = "support-team"

# --- Fixed values: split, weights, features, evaluation ------------------------------

TEST_SIZE = "0.15"
VAL_SIZE = "0.15"
SEED = 42
WEIGHT_CAP = 4.0
EFFECTIVE_BETAS = (("eff_n_b999", 0.999), ("eff_n_b99", 0.99))
DRIFT_LIMIT = 0.01
WORD_NGRAMS = (1, 2)
CHAR_NGRAMS = (3, 5)
MIN_DF = 2
MAX_DF = 0.95
WORD_BLOCK_WEIGHT = 1.0
CHAR_BLOCK_WEIGHT = 0.5
C = 1.0
MAX_ITER = 1000
TOP_FEATURES = 15
TARGETS = (("accuracy", 0.88), ("macro_f1", 0.80))
SWEEP_THRESHOLDS = (
    0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95,
)
CONFIDENCE_BINS = 20
HISTOGRAM_BINS = 50

# Our own choice, the plan weights are stated nowhere: see the README.
PLAN_WEIGHTS = {"free": 0.0, "pro": 0.5, "enterprise": 1.0}

# pandas reads these cells as missing.
NA_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
