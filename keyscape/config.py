"""Thresholds, weights and limits. Results depend on them."""

# --- scan ------------------------------------------------------------------
SAMPLE_HOSTS = 3
TERRAIN_EVIDENCE_TOP_N = 20
BETWEENNESS_PIVOTS = 256

# --- evidence levels, weakest first ---------------------------------------
PORT_ONLY = "port-only"
RESPONDER_CONFIRMED = "responder-confirmed"
PROTOCOL_CONFIRMED = "protocol-confirmed"
RESPONDED_STATES = ["SF", "S1", "S2", "S3", "RSTO", "RSTR"]
PLACEHOLDER_PROTOCOLS = ["", "-", "unknown"]

# --- temporal classes ------------------------------------------------------
TEMPORAL_SPARSE_MAX = 10
TEMPORAL_DOMINANT = 0.80
TEMPORAL_WEEKEND = 0.20
TEMPORAL_CONSTANT_HOURS = 20
BUSINESS_HOURS = (8, 18)
NIGHT_BAND = [20, 21, 22, 23, 0, 1, 2, 3, 4, 5]
NIGHT_WINDOW = 3

# --- roles -----------------------------------------------------------------
ROLE_UNKNOWN = "Unknown"
ROLE_MIN_CLIENTS = {
    "DomainController": 5,
    "DNSServer": 5,
    "DHCPServer": 2,
    "FileServer": 3,
    "Database": 2,
    "WebServer": 5,
    "Printer": 1,
    "Camera": 1,
    "MailServer": 2,
    "NetworkGear": 1,
}
JUMP_MAX_IN = 3
JUMP_MIN_OUT = 5
JUMP_CONFIDENCE = 0.8
CORE_ROLES = ["DomainController", "DNSServer", "DHCPServer", "NetworkGear"]
SERVICE_ROLES = ["FileServer", "Database", "WebServer", "JumpBox", "MailServer"]

# --- scoring ---------------------------------------------------------------
WEIGHT_DEPENDENTS = 0.40
WEIGHT_PAGERANK = 0.25
WEIGHT_BETWEENNESS = 0.20
WEIGHT_SPREAD = 0.15
PAGERANK_DAMPING = 0.85
PAGERANK_TOLERANCE = 1e-6
AUTH_WEIGHT = 3.0

# --- layer 2 ---------------------------------------------------------------
GATEWAY_MIN_IPS = 10

# --- drift -----------------------------------------------------------------
DRIFT_RANK_DELTA = 5
DRIFT_TOP_N = 20

# --- mission ---------------------------------------------------------------
MISSION_MAX_DEPTH = 3

# --- briefing map ----------------------------------------------------------
GROUP_PREFIX = 24
SPARSE_GROUP_MIN_HOSTS = 2
MAP_MIN_CONNS = 5
CLIENT_AGG_MAX_COMPOSITE = 0.15
MAP_TARGET_ELEMENTS = 60
MAP_ALL_PRIVATE_CAP = 1500
MAP_SEGMENT_TOP_HOSTS = 5
MAP_SEGMENT_MAX_GROUPS = 64

# --- evidence pack ---------------------------------------------------------
PACK_MAX_NODES = 100
PACK_MAX_EDGES = 500
