"""Ordered feature names (one manifest shared by training and scoring).

FIXED VALUES: names and order must equal the system we reproduce.
"""

EMAIL_FEATURES = (
    "total_length",
    "num_caps",
    "num_digits",
    "num_special_chars",
    "num_urls",
    "num_emails",
    "num_ips",
    "num_links",
    "num_attachments",
    "suspicious_words_count",
    "urgency_score",
    "threat_score",
    "sender_reputation",
    "has_spf",
    "has_dkim",
    "has_dmarc",
    "spf_result_match",
    "html_ratio",
    "text_html_ratio",
    "avg_word_length",
    "unique_word_ratio",
)

URL_FEATURES = (
    "url_length",
    "num_dots",
    "num_hyphens",
    "num_at_symbols",
    "num_question_marks",
    "num_percent",
    "num_equals",
    "num_slashes",
    "has_https",
    "has_suspicious_tld",
    "has_ip_address",
    "has_shortening_service",
    "num_subdomains",
    "url_entropy",
    "has_port",
    "has_authentication",
    "path_length",
    "query_length",
    "digit_url_ratio",
    "special_char_ratio",
    "num_redirects",
    "has_tracking",
    "has_current_year",
    "has_any_year",
    "path_depth",
    "digit_ratio_host",
    "hyphens_in_host",
    "brand_keyword_count",
    "suspicious_keyword_count",
    "has_uppercase",
    "num_query_params",
    "is_common_tld",
    "has_at_symbol",
    "has_double_dot",
    "has_encoding",
    "encoding_count",
    "has_excessive_subdomains",
    "homograph_score",
    "has_typosquatting",
    "url_complexity",
)

URL_EXTRA_FEATURES = ("total_urls_in_email", "suspicious_url_count")

# 21 email + 40 averaged URL features prefixed "url_" + 2 counts.
ALL_FEATURES = EMAIL_FEATURES + tuple(f"url_{n}" for n in URL_FEATURES) + URL_EXTRA_FEATURES

# Features that are ratios/means (DOUBLE); the rest are integer counts or flags.
URL_DOUBLE_FEATURES = frozenset({
    "url_entropy", "digit_url_ratio", "special_char_ratio", "digit_ratio_host",
    "homograph_score", "url_complexity",
})
EMAIL_DOUBLE_FEATURES = frozenset({
    "suspicious_words_count", "urgency_score", "threat_score", "sender_reputation",
    "spf_result_match", "html_ratio", "text_html_ratio", "avg_word_length",
    "unique_word_ratio",
})
