"""Constants, formats and wording that results must carry exactly.

Everything in this module is data.  The rules that use it live in the operator
modules.
"""

# --- vendor formats -------------------------------------------------------

# Composite sample id: compound, plate number, well, replicate number.
SAMPLE_ID_PATTERN = r"^LO-(CMPD\d{5})-P(\d+)-([A-H]\d{2})-R(\d+)$"
SAMPLE_GROUP_PATTERN = r"^LO-(CMPD\d+)"

# Vendor timestamp text such as 20260912 04:09:15.558; more fraction digits
# are accepted and cut to milliseconds.
VENDOR_TS_PATTERN = r"^(\d{4})(\d{2})(\d{2}) (\d{2}):(\d{2}):(\d{2})\.(\d{1,3})\d{0,3}$"
VENDOR_TS_FORMAT = "yyyyMMdd HH:mm:ss.SSS"

# Decimal or exponent number text; a bare suffix such as 1.5f is not a number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

READING_PAGE_SIZE = 200
OBSERVATION_PAGE_SIZE = 500

# --- quality gate ---------------------------------------------------------

MAX_RESULT_VALUE = 100000.0
NULL_COMPOUND = "null_compound_id"
NULL_ASSAY = "null_assay_name"
NULL_ACQUIRED = "null_acquired_ts"
NULL_VALUE = "null_result_value"
NONPOSITIVE_VALUE = "nonpositive_result_value"
VALUE_TOO_HIGH = "out_of_range_high"

STRUCTURE_PREFIX = "SYNTH-INCHIKEY-"
STRUCTURE_DIGITS = 20

# --- threshold reference --------------------------------------------------

LOW, HIGH = "low", "high"

# assay, direction of concern, threshold, unit, rationale, synthetic
THRESHOLD_ROWS = (
    ("hERG_IC50", LOW, 1.0, "uM",
     "IC50 below threshold indicates cardiac hERG channel liability", True),
    ("CYP3A4_IC50", LOW, 1.0, "uM",
     "Low IC50 indicates strong CYP3A4 inhibition and DDI risk", True),
    ("KINETIC_SOL", LOW, 10.0, "uM",
     "Low kinetic solubility indicates formulation and exposure risk", True),
    ("CACO2_PAPP", LOW, 1.0, "1e-6cm/s",
     "Low apparent permeability indicates poor absorption", True),
    ("LOGD_7_4", HIGH, 5.0, "",
     "High logD indicates excessive lipophilicity", True),
)

# --- wording of the flag reason -------------------------------------------

REASON_NO_REFERENCE = "OK: no synthetic reference threshold defined for assay {assay}"
REASON_BREACH = (
    "FLAGGED: {assay} reading {value} {unit} breaches synthetic {direction}-concern "
    "threshold {threshold} {threshold_unit} (margin {margin}). "
    "Compound prior mean {mean} over {n} historical readings."
)
REASON_WITHIN = (
    "OK: {assay} reading {value} {unit} within synthetic {direction}-concern "
    "threshold {threshold} {threshold_unit} (margin {margin})."
)

# --- clinical correlation -------------------------------------------------

ADVERSE = "adverse_reaction"
LAB_RESULT = "lab_result"

NO_MAPPING = "no_mapping"
CHECKED = "checked_no_correlation"
CORRELATED = "correlated"

DETAIL_NO_MAPPING = "no crosswalk mapping (or unresolved identifier) for this compound"
DETAIL_CORRELATED = "mapped to {drug} — adverse_reaction signal: {terms}"
DETAIL_CHECKED = "mapped to {drug} — checked clinical data, no adverse_reaction found"

SUMMARY_CORRELATED = "adverse_reaction signal present in clinical data"
SUMMARY_CHECKED = "clinical data checked, no adverse_reaction signal"
SUMMARY_NO_MAPPING = "no clinical mapping available for this compound"

# compound, drug code, source of the mapping, confidence
CROSSWALK_ROWS = (
    ("CMPD00012", "DRG-0012", "synthetic 1:1 by design", 1.0),
    ("CMPD00004", "DRG-0004", "synthetic 1:1 by design", 1.0),
    ("CMPD00008", "DRG-0008", "synthetic 1:1 by design", 1.0),
    ("CMPD00001", "DRG-0001", "synthetic 1:1 by design", 1.0),
    ("CMPD00006", "DRG-0777", "ambiguous multi-map (synthetic)", 0.5),
    ("CMPD00007", "DRG-0777", "ambiguous multi-map (synthetic)", 0.5),
    ("CMPD00014", None, "unresolved - no clinical identifier", 0.0),
)

# --- access policy --------------------------------------------------------

CLINICAL_GROUP = "clinical_pis"
REDACTED_VALUE = "REDACTED — clinical detail (clinical_pis only)"
ANON_PREFIX = "anon-"
ANON_DIGITS = 10

# --- review queue ---------------------------------------------------------

OPEN, RESOLVED, CLEARED = "open", "resolved", "cleared"

FALSE_POSITIVE = "false_positive"
CONFIRMED = "confirmed_concern"
ESCALATED = "escalated_for_confirmatory_assay"
RESOLUTION_REASONS = (FALSE_POSITIVE, CONFIRMED, ESCALATED)

# --- drift ----------------------------------------------------------------

DRIFT, DRIFT_OK, DRIFT_INSUFFICIENT = "drift", "ok", "insufficient"
DRIFT_TOLERANCE = 0.20
DRIFT_MIN_RESOLVED = 3
TASK_ID = "tr-{assay}-{day}"
TASK_ACTION = (
    "Review {assay} deterministic threshold: {fp}/{n} recent flags were resolved as "
    "false positives (FPR {rate} > {tolerance})."
)

# --- advisory reply -------------------------------------------------------

ADVISORY_ACTIONS = (
    "deprioritize",
    "escalate for confirmatory assay",
    "monitor next cycle",
    "proceed",
)
REPLY_ACTION = "ACTION: "
REPLY_RATIONALE = "RATIONALE: "
