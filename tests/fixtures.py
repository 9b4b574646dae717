"""Small readings with known answers.

Fixed values: the 14 flagged readings with their margins and the prior means of
their pairs (two readings each), in the expected queue order.
"""

from datetime import datetime

from sigreview.schemas import OBSERVATION, READING
from sigreview.sources.tables import crosswalk_table, threshold_table

AS_OF = datetime(2026, 9, 14, 9, 0, 0)

# compound, assay, value, margin, prior mean of the pair
FLAGGED = (
    ("CMPD00014", "KINETIC_SOL", 4.51, -5.49, 7.763),
    ("CMPD00012", "hERG_IC50", 0.259, -0.741, 0.264),
    ("CMPD00012", "hERG_IC50", 0.269, -0.731, 0.264),
    ("CMPD00012", "CYP3A4_IC50", 0.421, -0.579, 1.7405),
    ("CMPD00004", "CYP3A4_IC50", 0.709, -0.291, 1.171),
    ("CMPD00004", "hERG_IC50", 0.717, -0.283, 1.181),
    ("CMPD00024", "hERG_IC50", 0.795, -0.205, 0.8915),
    ("CMPD00007", "CYP3A4_IC50", 0.796, -0.204, 9.397),
    ("CMPD00008", "hERG_IC50", 0.844, -0.156, 1.1455),
    ("CMPD00006", "hERG_IC50", 0.846, -0.154, 8.8585),
    ("CMPD00024", "hERG_IC50", 0.988, -0.012, 0.8915),
    ("CMPD00003", "LOGD_7_4", 5.332, 0.332, 4.9575),
    ("CMPD00004", "LOGD_7_4", 5.348, 0.348, 4.587),
    ("CMPD00008", "LOGD_7_4", 5.37, 0.37, 3.582),
)
UNITS = {"KINETIC_SOL": "uM", "hERG_IC50": "uM", "CYP3A4_IC50": "uM", "LOGD_7_4": "", "CACO2_PAPP": "1e-6cm/s"}

# patient, drug, type, value: enough rows for each state
OBSERVED = (
    ("pt-1", "DRG-0012", "adverse_reaction", "qt_prolongation"),
    ("pt-2", "DRG-0012", "adverse_reaction", "cardiac_arrhythmia"),
    ("pt-2", "DRG-0012", "lab_result", "normal"),
    ("pt-3", "DRG-0004", "lab_result", "normal"),
    ("pt-4", "DRG-0008", "lab_result", "normal"),
    ("pt-4", "DRG-0001", "lab_result", "normal"),
    ("pt-5", "DRG-0777", "adverse_reaction", "mild_rash"),
    ("pt-5", "DRG-0777", "lab_result", "normal"),
)


def reading_rows():
    """Flagged readings, the unflagged partner of each pair, and quiet readings."""
    pairs = {}
    for compound, assay, value, _, mean in FLAGGED:
        pairs.setdefault((compound, assay), (mean, []))[1].append(value)
    values = []
    for (compound, assay), (mean, known) in pairs.items():
        values += [(compound, assay, v) for v in known]
        if len(known) == 1:
            values.append((compound, assay, round(2 * mean - known[0], 4)))
    values += [("CMPD00001", "hERG_IC50", 5.0), ("CMPD00001", "CACO2_PAPP", 1.0), ("CMPD00001", "OTHER", 3.0)]
    rows = []
    for i, (compound, assay, value) in enumerate(values):
        sample = f"LO-{compound}-P{1 + i % 6}-A{1 + i % 12:02d}-R{1 + i}"
        rows.append((
            sample, compound, f"P{1 + i % 6}", f"A{1 + i % 12:02d}", 1 + i, assay, value, UNITS.get(assay),
            datetime(2026, 9, 10, 8, i), "proto", "op-1000", f"guid-{i}", "PASS",
        ))
    return rows


def readings(spark):
    return spark.createDataFrame(reading_rows(), READING)


def observations(spark):
    rows = [(p, drug, kind, value, datetime(2026, 6, 1 + i)) for i, (p, drug, kind, value) in enumerate(OBSERVED)]
    return spark.createDataFrame(rows, OBSERVATION)


def reference(spark):
    return threshold_table(spark)


def crosswalk(spark):
    return crosswalk_table(spark)
