"""Fixed values that results depend on, stated once and in source order.

The first group is the configuration of the original pipeline (excluded events, grids,
thresholds, decile cut-offs).  The second group maps
those roles onto the driver test tables (FIXTURES.md), where the original
string values do not occur.
"""

# ---------------------------------------------------------------- fixed values
# Decision events excluded from the as-of limit lookup.
EXCLUDED_DECISION_EVENTS = ["Lending Application Denied"]
# Open-ended date used for "no ATO date".
FAR_FUTURE_DATE = "2099-12-31"
# Model search grids.
MODEL_GRID = {"iterations": [50, 80], "learning_rate": [0.01, 0.05, 0.06],
              "depth": [5, 6, 8], "l2_leaf_reg": [10, 20]}
SEED_GRID = {"iterations": [50, 100], "learning_rate": [0.01, 0.05],
             "depth": [5, 6, 8], "l2_leaf_reg": [10, 20]}
CORR_THRESHOLD = 0.7
IV_THRESHOLD = 0.01
IV_BINS = 10
TEST_SHARE = 0.2
# Score cut-offs, labels d10 (lowest) ... d1 (highest).
DECILE_LABELS = ["d10", "d9", "d8", "d7", "d6", "d5", "d4", "d3", "d2", "d1"]
CUTS_OVERALL = [0.097, 0.133, 0.173, 0.211, 0.250, 0.296, 0.344, 0.403, 0.480]
CUTS_SMALL_PAYMENT = [0.124, 0.170, 0.215, 0.257, 0.309, 0.362, 0.428, 0.498, 0.600]
CUTS_LARGE_PAYMENT = [0.044, 0.060, 0.075, 0.090, 0.109, 0.137, 0.184, 0.262, 0.434]
PROFILE_PERCENTILES = [0.01, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.8, 0.9,
                       0.95, 0.99, 1.0]

# ------------------------------------------------- test-table stand-ins (FIXTURES.md)
FX_DEPOSIT_INCLUDE = ["%RING%"]
FX_DEPOSIT_EXCLUDE = ["%BLUE%", "%sm_ll%"]
FX_CARD_MEDIUM = "A"
FX_DEPOSIT_MEDIUM = "N"
FX_LOAN_CATEGORY = "STANDARD"
FX_RECURRING_CATEGORIES = ["PROMO", "ECONOMY"]
FX_RESERVE_STATUS = "F"
FX_INVOICE_STATUSES = ["F", "O", "P"]
FX_USAGE_STATUSES = ["F", "O"]
FX_LANGUAGE_FLAGS = {"is_english_user": "1", "is_spanish_user": "2", "is_african_user": "3"}
FX_SIGNALS = {"is_k_key": "\"k\"", "is_nine": "9", "is_k_five": "k__ 5"}
FX_RISKY_SCORE = 0.6
FX_LIMIT_OVERRIDES = {7: 4200.0}
FX_LOGIN_CUTOFF = "2024-01-20"
FX_LABEL_FROM = "1996-01-01"
FX_LABEL_TO = "1999-01-01"
FX_LABEL_ENTITY_PRICE = 300000
FX_BUSINESS_TYPE_ORDER = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}
FX_PAYMENT_SEGMENT = 250000.0
FX_PROFILE_AS_OF = "2024-01-15 12:00:00"
FX_PART_INCLUDE = ["%ring%", "%GEAR%", "cold %", "%anvil", "%w_dget%", "hot%plate", "%l%rg%bolt%", "red%"]
FX_PART_EXCLUDE = ["%small%", "old%gear%", "%bl_e rod%", "%new%pl%te%", "%gizmo%"]
FX_PART_SIGNALS = ["gear", "cold", "anvil", "new", "widget", "hot", "red", "rod", "old", "bolt", "large", "plate",
                   "blue", "ring", "gizmo", "small"]
