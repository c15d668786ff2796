"""Column names, node and edge types, and the fixed lists the operators use."""

from __future__ import annotations

ID = "TransactionID"
TIME = "TransactionDT"
AMOUNT = "TransactionAmt"
TARGET = "isFraud"
CARD = "card1"
PRODUCT = "ProductCD"
ADDR = ("addr1", "addr2")
EMAIL = "P_emaildomain"
EMAIL_TO = "R_emaildomain"
EMAILS = (EMAIL, EMAIL_TO)
DEVICE = ("DeviceType", "DeviceInfo")

HOUR = 3600
DAY = 86400
WEEK = 7 * DAY

# Output columns of the temporal and amount feature view.
TEMPORAL_FEATURES = (
    "feat_hour_sin", "feat_hour_cos", "feat_dow_sin", "feat_dow_cos", "feat_hour", "feat_dow",
    "feat_is_weekend", "feat_is_night", "feat_is_business_hours",
    "feat_seconds_since_last_txn", "feat_seconds_since_last_card_txn",
    "feat_seconds_since_first_card_txn",
    "feat_txn_count_1h", "feat_txn_count_24h", "feat_txn_count_7d",
    "feat_card_txn_count_1h", "feat_card_txn_count_24h",
    "feat_velocity_1h", "feat_velocity_24h", "feat_velocity_7d",
    "feat_interarrival_mean_card", "feat_interarrival_std_card", "feat_interarrival_last_card",
)
AMOUNT_FEATURES = (
    "feat_amt_log1p", "feat_amt_cents", "feat_amt_zscore", "feat_amt_percentile",
    "feat_amt_cum_1h", "feat_amt_cum_24h", "feat_amt_cum_7d", "feat_amt_card_cum",
    "feat_amt_vs_card_mean", "feat_amt_vs_card_max", "feat_amt_ratio_to_card_min",
    "feat_amt_ratio_to_card_max", "feat_amt_above_p95", "feat_amt_below_p05",
    "feat_amt_acceleration", "feat_amt_jerk",
)

# Output columns of the entity and identity feature view.
CARD_STATS = (
    "mean_amt", "median_amt", "std_amt", "max_amt", "count", "fraud_rate",
    "unique_addr", "unique_emails", "unique_devices", "unique_products", "days_active", "txn_freq",
)
EMAIL_STATS = ("mean_amt", "median_amt", "std_amt", "count", "fraud_rate",
               "unique_cards", "unique_addrs")
ADDR_STATS = ("mean_amt", "median_amt", "std_amt", "count", "fraud_rate", "n_cards")
DEVICE_STATS = ("mean_amt", "median_amt", "std_amt", "count", "fraud_rate", "n_cards")
CARD_FAMILY_FEATURES = ("feat_c1_mean_card", "feat_c13_mean_card", "feat_c14_mean_card",
                        "feat_m_flag_mean_card", "feat_c_total_per_txn")
IDENTITY_FEATURES = (
    "feat_id_01_bin_risk", "feat_id_02_bin_risk",
    "feat_device_is_windows", "feat_device_is_ios", "feat_device_is_android",
    "feat_device_is_mobile", "feat_is_proxy_heuristic", "feat_email_mismatch",
    "feat_high_risk_tld", "feat_suspicious_hour", "feat_identity_missing",
    "feat_new_device_for_card", "feat_multi_card_on_device",
    "feat_v_feature_zscore_max", "feat_v_feature_zscore_mean", "feat_amt_outlier_flag",
)
ENTITY_FEATURES = (
    tuple(f"feat_card_{s}" for s in CARD_STATS)
    + tuple(f"feat_email_{s}" for s in EMAIL_STATS)
    + tuple(f"feat_addr_{s}" for s in ADDR_STATS)
    + tuple(f"feat_device_{s}" for s in DEVICE_STATS)
    + CARD_FAMILY_FEATURES
    + IDENTITY_FEATURES
)

# Output columns of the graph feature view.
GRAPH_FEATURES = (
    "feat_gr_tx_degree", "feat_gr_card_degree", "feat_gr_addr_degree", "feat_gr_email_degree",
    "feat_gr_device_degree", "feat_gr_ip_degree",
    "feat_gr_card_pagerank", "feat_gr_addr_pagerank", "feat_gr_email_pagerank",
    "feat_gr_device_pagerank", "feat_gr_ip_pagerank",
    "feat_gr_card_betweenness", "feat_gr_addr_betweenness", "feat_gr_email_betweenness",
    "feat_gr_device_betweenness", "feat_gr_card_closeness", "feat_gr_addr_closeness",
    "feat_gr_component_size",
    "feat_gr_nbr_fraud_card_1h", "feat_gr_nbr_fraud_addr_1h", "feat_gr_nbr_fraud_email_1h",
    "feat_gr_nbr_fraud_device_1h", "feat_gr_nbr_fraud_card_2h", "feat_gr_nbr_fraud_addr_2h",
    "feat_gr_ring_member", "feat_gr_ring_size",
    "feat_gr_avg_nbr_deg_card", "feat_gr_avg_nbr_deg_addr",
)

# Graph node types, edge types and node feature widths.
NODE_TYPES = ("transaction", "card", "address", "email", "device", "ip_address", "merchant")
TX_EDGES = (
    ("uses_card", "card"), ("from_address", "address"), ("from_email", "email"),
    ("from_device", "device"), ("from_ip", "ip_address"), ("at_merchant", "merchant"),
)
CARD_EDGES = ("shared_address", "shared_device")
NODE_DIMS = {"transaction": 50, "card": 8, "address": 4, "email": 3, "device": 4,
             "ip_address": 6, "merchant": 10}

# Domain lists.
HIGH_RISK_TLDS = ("ru", "cn", "xyz", "top", "click", "pw", "info")
NODE_RISK_TLDS = ("ru", "cn", "xyz", "top", "click")
FREE_EMAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
    "mail.com", "protonmail.com", "live.com", "msn.com", "me.com", "yandex.ru",
)
DISPOSABLE_MARKERS = ("temp", "mailinator", "10min", "guerrilla")
