"""Word lists, thresholds and messages the scores depend on.

FIXED VALUES: everything in this module must equal the values of the system
we reproduce, entry for entry and in the same order, because the order decides
which entry is reported first and the order in which score increments are
added.  They are stated plainly; do not reorder or edit them.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Feature lexicons (email and URL feature extraction).

SUSPICIOUS_WORDS = (
    "urgent", "immediate", "action required", "verify", "suspended",
    "confirm", "update", "expired", "click here", "login", "password",
    "account", "bank", "security", "alert", "warning",
    "terminate", "limited time", "offer", "free", "winner", "prize",
    "congratulations", "inheritance", "million", "lottery", "wire",
    "transfer", "ssn", "social security", "credit card", "cvv",
)

THREAT_KEYWORDS = (
    "threat", "virus", "malware", "phishing", "scam", "fraud",
    "hack", "compromised", "breach", "infection", "trojan", "ransomware",
)

# 35 entries, ".bid" appears twice; the duplicate only matters for counting
# semantics, which never count TLDs, so lookups use it as listed.
SUSPICIOUS_TLDS = (
    ".xyz", ".top", ".club", ".work", ".date", ".bid", ".stream",
    ".download", ".tk", ".ml", ".ga", ".cf", ".gq", ".pw", ".cc",
    ".icu", ".click", ".link", ".website", ".site", ".online",
    ".space", ".tech", ".press", ".host", ".live", ".rocks", ".bar",
    ".cyou", ".men", ".win", ".bid", ".loan", ".review", ".trade",
)

URL_SHORTENERS = (
    "bit.ly", "goo.gl", "tinyurl.com", "ow.ly", "t.co", "is.gd",
    "buff.ly", "adf.ly", "bit.do", "short.link", "tiny.cc", "rb.gy",
    "cutt.ly", "shorturl.at", "rebrand.ly", "hyperurl.co", "shorte.st",
)

URGENCY_PATTERNS = (
    r"\b(urgent|immediately|asap|emergency|critical)\b",
    r"\b(act now|click here|verify now|confirm immediately)\b",
    r"\b(will expire|account suspended|terminate|deadline)\b",
    r"!!!+",
    r"\b([A-Z]{5,})\b",
)

FREE_MAIL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com")

TRACKING_PARAMS = ("utm_", "fbclid", "gclid", "ref=", "source=", "campaign=", "medium=")

FIRST_YEAR = 2020

URL_BRAND_KEYWORDS = (
    "paypal", "amazon", "microsoft", "apple", "google",
    "facebook", "netflix", "kraken", "coinbase", "binance",
)

URL_SUSPICIOUS_KEYWORDS = (
    "verify", "secure", "login", "signin", "account",
    "update", "confirm", "alert", "suspended", "unusual",
)

COMMON_TLDS = (".com", ".org", ".net", ".edu", ".gov")

# Looked up in the lower-cased URL; "I" and "O" therefore never hit and
# "vv" is listed (and counted) twice.
HOMOGRAPH_CHARS = ("0", "1", "l", "I", "O", "o", "rn", "vv", "vv")

TYPOSQUATS = ("paypa1", "g00gle", "amaz0n", "micr0soft", "faceb00k", "kraekken")

# Email headers are matched against these key prefixes / substrings.
SPF_KEY, DKIM_KEY, DMARC_WORD = "spf", "dkim", "dmarc"

# ---------------------------------------------------------------- FIXED VALUES
# URL rules.

# Brand -> look-alike patterns, in the order the brands are tried.
BRAND_PATTERNS = (
    ("Google", ("google", "g00gle", "go0gle", "googl", "gogle")),
    ("PayPal", ("paypal", "pay-pal", "paypa1", "paypai", "paypaI")),
    ("Microsoft", ("microsoft", "micros0ft", "microsfot", "micr0soft")),
    ("Apple", ("apple", "app1e", "aple", "appie")),
    ("Amazon", ("amazon", "amaz0n", "amzon", "amazzon")),
    ("Facebook", ("facebook", "faceb00k", "facebok", "facbook")),
    ("DataHub", ("datahub", "data-hub", "data_hub")),
    ("Dropbox", ("dropbox", "dropboox", "drop-box")),
    ("LinkedIn", ("linkedin", "linkedln", "linkdin")),
    ("Netflix", ("netflix", "netflx", "netflixx")),
    ("Kraken", ("kraken", "kraekken", "krakin", "krakken", "krakn")),
    ("MetaMask", ("metamask", "metamsk", "metamas", "metamaks", "metamak")),
    ("Coinbase", ("coinbase", "coinbass", "coinbas", "coinbaze")),
    ("Binance", ("binance", "binanc", "binans", "binancee")),
    ("Trust Wallet", ("trustwallet", "trust-wallet", "truste")),
    ("Ledger", ("ledger", "ledgr", "ledgar", "ledjer", "ledgher")),
    ("Robinhood", ("robinhood", "robinhod", "robinhoodd")),
    ("Godaddy", ("godaddy", "godaddysites", "godady", "go-daddy", "goddady")),
)

# Brand -> its own domains; a hit on any of them clears the impersonation.
BRAND_LEGIT_DOMAINS = {
    "Google": ("google.com", "google.co", "gmail.com", "googleapis.com"),
    "PayPal": ("paypal.com", "paypal.cn"),
    "Microsoft": ("microsoft.com", "live.com", "outlook.com", "office.com", "msn.com"),
    "Apple": ("apple.com", "icloud.com", "appleid.apple.com"),
    "Amazon": ("amazon.com", "amazon.co", "amazon.de", "amazon.fr", "amazon.co.uk"),
    "Facebook": ("facebook.com", "fb.com", "messenger.com", "instagram.com"),
    "DataHub": ("datahub.org", "datahub.io", "datahub.com"),
    "Dropbox": ("dropbox.com",),
    "LinkedIn": ("linkedin.com",),
    "Netflix": ("netflix.com",),
    "Kraken": ("kraken.com", "kraken.io"),
    "MetaMask": ("metamask.io", "metamask.com"),
    "Coinbase": ("coinbase.com", "coinbase.io"),
    "Binance": ("binance.com", "binance.us"),
    "Trust Wallet": ("trustwallet.com",),
    "Ledger": ("ledger.com", "ledgerwallet.com"),
    "Robinhood": ("robinhood.com",),
    "Godaddy": ("godaddy.com",),
}

FREE_HOSTING_SITES = (
    "godaddysites.com", "weebly.com", "wixsite.com", "pages.dev",
    "firebaseapp.com", "netlify.app", "vercel.app", "github.io",
    "gitlab.io", "herokuapp.com", "cloudfront.net",
)

FREE_HOSTING_BRANDS = (
    "kraken", "paypal", "metamask", "coinbase", "binance",
    "trust", "ledger", "robinhood", "amazon", "microsoft", "apple",
)

RULE_SHORTENERS = ("bit.ly", "tinyurl", "goo.gl", "ow.ly", "t.co")

SENSITIVE_KEYWORDS = ("login", "signin", "account", "payment", "bank", "paypal")

URL_WEIGHTS = {
    "brand": 0.55,
    "free_hosting_brand": 0.45,
    "long_subdomain": 0.15,
    "numeric_subdomain": 0.10,
    "pattern": 0.25,
    "no_https_sensitive": 0.25,
}

# risk_score >= threshold -> level, first match wins.
URL_LEVELS = ((0.70, "HIGH"), (0.45, "MEDIUM"), (0.20, "LOW"))
EMAIL_LEVELS = ((0.65, "HIGH"), (0.40, "MEDIUM"), (0.15, "LOW"))
DISPLAY_LEVELS = ((0.70, "HIGH RISK"), (0.45, "MEDIUM RISK"), (0.20, "LOW RISK"))
MAX_REASONS = 8

# ---------------------------------------------------------------- FIXED VALUES
# Email rules.

STRONG_INDICATORS = (
    "verify your account immediately", "confirm your identity now",
    "your account has been suspended", "click here to verify immediately",
    "update your payment information now", "your account will be permanently closed",
    "unusual activity detected on your account", "your account has been limited",
    "verify your identity to restore", "wire transfer", "western union", "money gram",
    "social security number", "ssn", "credit card number",
    "bank account details required", "dear winner", "you have won",
    "claim your prize now", "inheritance", "lottery winner",
)

# http:// links whose host path contains one of these TLDs followed by "/".
STRONG_URL_TLDS = ("tk", "ml", "ga", "cf", "gq", "xyz")

LEGITIMATE_ORGS = (
    "ieee", "acm", "springer", "elsevier", "wiley", "nature",
    "science", "arxiv", "researchgate", "google scholar", "orcid",
)

LEGITIMATE_SIGNATURES = (
    "ph.d", "phd", "professor", "assistant professor", "associate professor",
    "dr.", "doctor", "research scholar", "dean", "director",
    "national institute of technology", "university", "college",
    "assistant professor gr", "department of", "head of department",
    "ac.in", ".edu", ".ac.uk", ".edu.in",
    "ieee", "acm", "springer", "elsevier", "wiley", "nature",
)

LEGITIMATE_PHRASES = (
    "best regards", "sincerely", "thanks", "thank you",
    "looking forward", "appreciate", "warm regards",
    "kind regards", "yours sincerely", "yours faithfully",
    "not required", "as requested", "per our conversation",
    "ieee account", "your ieee account", "ieee services",
    "membership", "subscription", "publication", "journal",
)

LEGITIMATE_DOMAINS = (
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com",
    ".ac.in", ".edu", ".gov", ".org", ".mil",
    "nits.ac.in", "iit.ac.in", "bits-pilani.ac.in",
    "ieee.org", "ieee.com", "ieee.net", "ieeexplore.ieee.org",
    "emails.ieee.org", "em3009.ieee.org",
    "acm.org", "springer.com", "elsevier.com", "wiley.com",
    "nature.com", "science.org", "sciencedirect.com",
    "arxiv.org", "researchgate.net", "scholar.google.com",
    "orcid.org", "crossref.org", "scopus.com",
    "aaas.org", "aps.org", "acs.org", "ama-assn.org", "asm.org", "asme.org",
    "conf.com", "conference.org", "proceedings.com",
    "iitb.ac.in", "iitd.ac.in", "iitm.ac.in", "iitk.ac.in",
    "iitkgp.ac.in", "iitr.ac.in", "iitg.ac.in", "iith.ac.in",
    "nits.ac.in", "nitk.ac.in", "nitw.ac.in", "nitc.ac.in",
    "bits-pilani.ac.in", "iiit.ac.in", "isical.ac.in",
)

TITLE_WORDS = ("dr.", "professor", "ph.d", "phd", "ieee")
ACADEMIC_SENDER_DOMAINS = (".ac.in", ".edu", ".ac.uk", "ieee.org")
IEEE_WORD = "ieee"
SHORT_MAIL_CHARS = 500

# Brands named in the text, with the domain the sender should then use.
# "bank" and "chase" have no domain and never add to the score.
MAJOR_BRANDS = ("paypal", "amazon", "microsoft", "apple", "google", "bank", "chase")
MAJOR_BRAND_DOMAINS = {
    "paypal": "paypal.com",
    "amazon": "amazon.com",
    "microsoft": "microsoft.com",
    "apple": "apple.com",
    "google": "google.com",
}
FREE_SENDER_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com")

EMAIL_WEIGHTS = {
    "strong_indicator": 0.50,
    "suspicious_url_each": 0.35,
    "suspicious_url_cap": 0.55,
    "brand_from_free_mail": 0.40,
    "legitimate_score": 0.05,
    "headline_safe_below": 0.10,
}

# Ensemble weights (boosted trees, forest, text model) and blend factors.
ENSEMBLE_WEIGHTS = {"boosted": 0.4, "forest": 0.3, "text": 0.3}
BLEND = {
    "url_tabular_up": 1.1, "url_tabular_cap_if_legit": 0.2,
    "url_text_up": 0.9, "url_text_down": 0.85,
    "email_tabular_up": 1.1, "email_tabular_down": 0.4,
    "email_text_strong": 0.75, "email_text_up_strong": 0.95,
    "email_text_up_weak": 0.7, "email_text_down": 0.75,
}

# ---------------------------------------------------------------- FIXED VALUES
# Messages. "{}" marks where a value is filled in.

MSG = {
    "invalid_url": "Invalid URL provided",
    "url_error": "Error analyzing URL: {}",
    "parse_error": "the URL cannot be parsed",
    "brand": "🚨 Brand impersonation: pretending to be '{}'",
    "free_hosting_brand": "🚨 Suspicious {} lookalike on free hosting ({})",
    "long_subdomain": "⚠️ Suspicious long subdomain on free hosting",
    "numeric_subdomain": "⚠️ Numeric subdomain on free hosting",
    "ip": "IP address used instead of domain name",
    "subdomains": "Excessive subdomains ({})",
    "tld": "Suspicious TLD ({})",
    "at": "@ symbol in URL - possible credential theft",
    "shortener": "URL shortener ({}) - hides destination",
    "pattern_prefix": "⚠️ ",
    "no_https": "⚠️ No HTTPS encryption on login/payment page",
    "ml_phishing": "🤖 ML Model: PHISHING detected ({} confidence)",
    "text_phishing": "🤖 BERT Model: PHISHING detected ({} confidence)",
    "text_legit": "✅ BERT Model: Legitimate ({} confidence)",
    "legit_org": "Legitimate communication from {}",
    "legit_academic": "Academic institution email with professional signature",
    "legit_domain": "Legitimate email domain with professional closing",
    "legit_signature": "Professional signature and closing detected",
    "legit_short": "Short professional communication",
    "legit_ieee": "IEEE official communication",
    "legit_fallback": "IEEE or legitimate organization communication",
    "legit_prefix": "✅ ",
    "strong": "🚨 Strong phishing indicators detected",
    "suspicious_urls": "🚨 {} suspicious URL(s) found",
    "brand_free_mail": "⚠️ Claims to be from {} but uses {}",
    "head_safe": "✅ Email appears legitimate",
    "head_high": "🔴 HIGH RISK: Multiple phishing indicators detected",
    "head_medium": "🟠 MEDIUM RISK: Some suspicious elements detected",
}

RECOMMENDATIONS = {
    "HIGH": (
        "🚨 DO NOT click any links in this message",
        "🚨 DO NOT reply or provide any information",
        "Report this as phishing to your IT team",
        "Delete this message immediately",
        "If you already clicked a link, change your passwords now",
    ),
    "MEDIUM": (
        "⚠️ Exercise caution with this message",
        "⚠️ Verify the sender through another channel",
        "⚠️ Hover over links before clicking",
        "Consider reporting as suspicious",
    ),
    "LOW": (
        "ℹ️ Minor concerns detected",
        "ℹ️ Still verify unexpected requests",
        "ℹ️ Be cautious with any links",
    ),
    "SAFE": (
        "✅ This message appears safe",
        "✅ Continue normal security practices",
    ),
}

# Characters stripped from the right of a URL found in free text, and the
# minimum length (exclusive) of a kept URL.
URL_RSTRIP_CHARS = ".,;:!?)>"
URL_MIN_LEN_EXCLUSIVE = 10

# ---------------------------------------------------------------- FIXED VALUES
# Training-data preparation.

LABEL_COLUMN_NAMES = ("label", "type", "class", "category")
URL_COLUMN_NAMES = ("url", "link", "website", "domain")
EMAIL_BODY_SUBSTRINGS = ("body", "content", "message")
EMAIL_LABEL_VARIANTS = ("is_phishing", "phishing", "malicious", "spam", "class", "type")
RAW_URL_NAME_SUBSTRINGS = ("url", "link", "website")
RAW_LABEL_NAME_SUBSTRINGS = ("label", "class", "type")
FEATURE_EXCLUDE_PATTERNS = (
    "label", "url", "link", "domain", "timestamp", "date",
    "id", "index", "row_num", "source", "file",
)
ALT_FEATURE_EXCLUDE_PATTERNS = (
    "url", "type", "label", "domain", "date_inspection", "unnamed", "index", "id",
)
LEAK_NAME_KEYWORDS = (
    "score", "result", "detected", "prediction", "is_",
    "flag", "verdict", "classification", "threat", "risk",
)
EMAIL_LEAK_PATTERNS = (
    "x_spam_score", "spf_result", "dkim_result", "dmarc_result",
    "spam_score", "phishing_score", "x_spam", "is_spam", "is_phishing",
)

URL_BENIGN_LABELS = ("benign", "legitimate", "safe", "good", "0", "normal")
URL_MALICIOUS_LABELS = ("phishing", "malware", "defacement", "malicious", "spam", "fraud", "1")
EMAIL_PHISHING_LABELS = ("phishing", "fraud", "spam", "1", "true", "yes", "malicious", "phish", "bad")
EMAIL_LEGIT_LABELS = ("legitimate", "safe", "ham", "0", "false", "no", "benign", "good")
RAW_URL_PHISHING_LABELS = ("phishing", "fraud", "malicious", "1", "true", "yes")

DEFAULT_SENDER = "unknown@example.com"
SPLIT_SEED = 42
TEST_FRACTION = 0.2

# Metrics shown when no metrics file is present.
DEFAULT_METRICS = (
    ("xgboost_url", 0.9668, 0.9838, 0.9179, 0.9498),
    ("random_forest_url", 0.9595, 0.9745, 0.9055, 0.9387),
    ("xgboost_email", 0.8671, 0.8795, 0.8905, 0.8849),
    ("random_forest_email", 0.8600, 0.8718, 0.8863, 0.8790),
)

# Model hyper-parameters of the reference setup.
BOOSTED_PARAMS = {"n_estimators": 200, "max_depth": 8, "learning_rate": 0.05,
                  "subsample": 0.8, "colsample_bytree": 0.8, "random_state": 42}
FOREST_PARAMS = {"n_estimators": 200, "max_depth": 12, "min_samples_split": 5,
                 "min_samples_leaf": 2, "random_state": 42, "class_weight": "balanced"}

# FIXED VALUES: English stop words of the term features (T18), the words of two
# letters and more of Spark ML's default list.
STOP_WORDS = tuple("""
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
can will just don should now cannot could ought would
""".split())
