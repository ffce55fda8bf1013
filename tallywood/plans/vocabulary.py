"""Vocabularies that extraction and the detectors take as parameters, and a small one to begin with.

A deployment brings its own tables of this form; none of the operators names a concept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Concept, unit, absolute and relative limit, window in days, surface forms.
LABORATORY = (
    ("hemoglobin", "g/dL", 1.0, 0.10, 2, ("hemoglobin", "haemoglobin", "hb", "hgb")),
    ("mcv", "fL", 3.0, 0.05, 2, ("mcv", "mean corpuscular volume")),
    ("mch", "pg", 2.0, 0.08, 2, ("mch", "mean corpuscular hemoglobin")),
    ("rdw", "%", 1.5, 0.10, 2, ("rdw", "red cell distribution width")),
    ("wbc", "10*9/L", 2.0, 0.30, 2, ("wbc", "white blood cells", "tlc")),
    ("platelets", "10*9/L", 50.0, 0.25, 2, ("platelets", "platelet", "plt")),
    ("ferritin", "ng/mL", 10.0, 0.30, 2, ("ferritin",)),
    ("creatinine", "mg/dL", 0.3, 0.25, 2, ("creatinine",)),
    ("glucose", "mg/dL", 30.0, 0.30, 2, ("glucose",)),
)
#: Concept, value class, is it positive, phrases.
STATUS = (
    ("acute_infarct", "ABSENT", False, ("no acute infarct", "no evidence of acute infarct")),
    ("acute_infarct", "PRESENT", True, ("acute infarct",)),
    ("rhythm", "SINUS", None, ("sinus rhythm",)),
    ("rhythm", "FIBRILLATION", True, ("atrial fibrillation",)),
    ("mutation_status", "ABSENT", False, ("mutation not detected", "wild type")),
    ("mutation_status", "PRESENT", True, ("mutation detected",)),
)
#: Claim type, phrases, concepts one of which must be located, look-back in days, direction (concept, op, threshold), polarity that supports it.
CLAIM_RULES = (
    ("IRON_DEFICIENCY", ("iron deficiency confirmed", "iron deficiency anaemia"), ("ferritin",), 180, (("ferritin", "lt", 30.0),), None),
    ("ANEMIA_STABLE", ("hb stable", "hemoglobin stable"), ("hemoglobin",), 90, (), None),
    ("NO_ACUTE_FINDING", ("no acute intracranial",), ("acute_infarct",), 30, (), False),
)
#: Expression, label, kind of the cited document; expression and label of follow-ups, and days until and kind of what is expected.
REFERENCES = ((r"ct report", "CT report", "IMAGING_REPORT"), (r"mri report", "MRI report", "IMAGING_REPORT"), (r"iron studies", "iron studies", "LAB_REPORT"))
FOLLOW_UPS = ((r"repeat cbc in \w+ weeks", "Repeat CBC"), (r"review in \w+ weeks", "Review visit"))
EXPECTED = (("Repeat CBC", 42, "LAB_REPORT"), ("Review visit", 42, "FOLLOWUP"))
#: Cue phrases and hints in file names of document classes.
DOCUMENT_CUES = {
    "DISCHARGE_SUMMARY": ("discharge summary", "discharge date"),
    "MEDICATION_LIST": ("medication list", "current medications", "medications at discharge"),
    "PRESCRIPTION": ("rx", "prescription"),
    "LAB_REPORT": ("complete blood count", "laboratory summary", "iron studies", "cumulative laboratory", "reference", "verified by"),
    "REFERRAL": ("referral", "dear colleague", "thank you for seeing"),
    "FOLLOWUP": ("follow-up note", "follow up note", "interval history"),
    "CONSULTATION": ("consultation note", "consultation date", "examination:"),
    "PATHOLOGY_REPORT": ("histopathology", "biopsy report"),
}
FILE_HINTS = {
    "LAB_REPORT": ("cbc", "lab", "ferritin", "laboratory"), "PRESCRIPTION": ("prescription", "rx"), "CONSULTATION": ("consultation",), "DISCHARGE_SUMMARY": ("discharge",),
    "MEDICATION_LIST": ("medication_list", "medication list", "med_list"), "REFERRAL": ("referral",), "FOLLOWUP": ("followup", "follow_up", "follow-up"),
}


@dataclass
class Vocabulary:
    concepts: tuple = LABORATORY
    status: tuple = STATUS
    claim_rules: tuple = CLAIM_RULES
    references: tuple = REFERENCES
    follow_ups: tuple = FOLLOW_UPS
    expected: tuple = EXPECTED
    anchored: tuple = ()
    drugs: dict = field(default_factory=lambda: {"ferrous sulphate": "ferrous sulfate"})

    def synonyms(self, spark: SparkSession) -> DataFrame:
        """surface, concept. A surface that two concepts claim is dropped, not arbitrated."""
        rows = {}
        for concept, *_, surfaces in self.concepts:
            for surface in surfaces:
                rows.setdefault(surface, set()).add(concept)
        return spark.createDataFrame([(s, min(c)) for s, c in rows.items() if len(c) == 1], "surface string, concept string")

    def units(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c[0], c[1]) for c in self.concepts], "concept string, wanted string")

    def rules(self, spark: SparkSession) -> DataFrame:
        """concept, abs_limit, rel_limit, window_days of numeric and status concepts."""
        status = sorted({s[0] for s in self.status})
        return spark.createDataFrame([(c[0], c[2], c[3], c[4]) for c in self.concepts] + [(s, None, None, 2) for s in status], "concept string, abs_limit double, rel_limit double, window_days int")

    def polarity(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([s[:3] for s in self.status], "concept string, value_key string, positive boolean")

    def requirements(self, spark: SparkSession) -> DataFrame:
        """claim_type, concept, op, threshold, lookback_days of numeric evidence; without a direction any value supports."""
        rows = []
        for kind, _, concepts, days, directions, polarity in self.claim_rules:
            ways = {c: (op, t) for c, op, t in directions}
            rows += [(kind, c, *ways.get(c, ("any", None)), days) for c in concepts if polarity is None]
        return spark.createDataFrame(rows, "claim_type string, concept string, op string, threshold double, lookback_days int")

    def status_requirements(self, spark: SparkSession) -> DataFrame:
        rows = [(kind, c, days, wants) for kind, _, concepts, days, _, wants in self.claim_rules if wants is not None for c in concepts]
        return spark.createDataFrame(rows, "claim_type string, concept string, lookback_days int, wants boolean")

    @property
    def claim_patterns(self) -> list[tuple[str, str]]:
        return [(rule[0], phrase) for rule in self.claim_rules for phrase in rule[1]]

    @property
    def phrases(self) -> list[tuple[str, str, str, bool | None]]:
        return [(phrase, concept, key, positive) for concept, key, positive, phrases in self.status for phrase in phrases]

    def expectations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.expected), "label string, interval_days int, kind string")
