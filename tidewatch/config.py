"""Taxonomy, thresholds and manifest: plain values, no behaviour."""

from __future__ import annotations

BENIGN = "BENIGN"

# The 15 raw labels of the flow corpus and their classes.
LABEL_MAP: dict[str, str] = {
    "Benign": "BENIGN",
    "Bot": "Botnet",
    "DDoS": "DDoS",
    "DoS GoldenEye": "DoS",
    "DoS Hulk": "DoS",
    "DoS Slowhttptest": "DoS",
    "DoS slowloris": "DoS",
    "FTP-Patator": "BruteForce",
    "Heartbleed": "DoS",
    "Infiltration": "Infiltration",
    "PortScan": "PortScan",
    "SSH-Patator": "BruteForce",
    "Web Attack - Brute Force": "WebAttack",
    "Web Attack - XSS": "WebAttack",
    "Web Attack - Sql Injection": "WebAttack",
}

# Class name to integer id.
CLASS_IDS: dict[str, int] = {
    "BENIGN": 0,
    "DoS": 1,
    "DDoS": 2,
    "PortScan": 3,
    "BruteForce": 4,
    "Botnet": 5,
    "WebAttack": 6,
    "Infiltration": 7,
}
CLASSES: list[str] = sorted(CLASS_IDS, key=CLASS_IDS.get)

# The eight corpus files, in reading order.
MANIFEST: list[str] = [
    "Benign-Monday-no-metadata.parquet",
    "Botnet-Friday-no-metadata.parquet",
    "Bruteforce-Tuesday-no-metadata.parquet",
    "DDoS-Friday-no-metadata.parquet",
    "DoS-Wednesday-no-metadata.parquet",
    "Infiltration-Thursday-no-metadata.parquet",
    "Portscan-Friday-no-metadata.parquet",
    "WebAttacks-Thursday-no-metadata.parquet",
]

# Header spellings of the CSV release and the names used here.
HEADER_ALIASES: dict[str, str] = {
    "Total Length of Fwd Packets": "Fwd Packets Length Total",
    "Total Length of Bwd Packets": "Bwd Packets Length Total",
    "Min Packet Length": "Packet Length Min",
    "Max Packet Length": "Packet Length Max",
    "Average Packet Size": "Avg Packet Size",
    "Init_Win_bytes_forward": "Init Fwd Win Bytes",
    "Init_Win_bytes_backward": "Init Bwd Win Bytes",
    "act_data_pkt_fwd": "Fwd Act Data Packets",
    "min_seg_size_forward": "Fwd Seg Size Min",
    "Fwd Header Length.1": "Fwd Header Length",
    "CWE Flag Count": "CWE Flag Count",
    "Flow ID": "Flow ID",
}

# Export columns that are never features.
IDENTIFIER_COLUMNS: list[str] = [
    "Flow ID", "Source IP", "Src IP", "Source Port", "Src Port",
    "Destination IP", "Dst IP", "Destination Port", "Dst Port", "Timestamp",
    "SimillarHTTP", "Unnamed: 0", "source_file", "label_raw", "label_class", "label_int",
]
LABEL_CANDIDATES: list[str] = ["Label", "label", "LABEL", "label_class"]
META_COLUMNS: list[str] = ["label_raw", "label_class", "source_file"]

# Context columns of the flow log and what stands in when absent.
CONTEXT_DEFAULTS: dict[str, object] = {
    "src_ip": "10.0.0.0",
    "dst_ip": "10.0.0.1",
    "dst_port": 0,
    "protocol_name": "TCP",
}
PROTOCOL_NAMES: dict[int, str] = {0: "HOPOPT", 6: "TCP", 17: "UDP"}

# Relative weights of the attack classes in a mixed draw.
ATTACK_MIX: dict[str, float] = {
    "DoS": 0.30,
    "DDoS": 0.26,
    "PortScan": 0.18,
    "BruteForce": 0.13,
    "WebAttack": 0.08,
    "Botnet": 0.04,
    "Infiltration": 0.01,
}

# Half-open confidence bins; the last one closes above 1.
CONFIDENCE_BINS: list[tuple[float, float]] = [
    (0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0001),
]

SEED = 42
TEST_FRACTION = 0.20
CORRELATION_THRESHOLD = 0.95
MAX_MISSING_FRACTION = 0.25
MINORITY_SUPPORT = 500

THREAT_HIGH = 0.20
THREAT_MEDIUM = 0.05

MIN_F1_GAIN = 0.001
MAX_MEAN_FNR = 0.10
MAX_CLASS_FNR = 0.30

DRIFT_SHARE = 0.20
DRIFT_PVALUE = 0.05
DRIFT_DISTANCE = 0.10
DRIFT_SMALL_SAMPLE = 1000
REFERENCE_ROWS = 50_000

MAX_RETURNED_ROWS = 20_000
MAX_EXPLAINED_ROWS = 20_000
