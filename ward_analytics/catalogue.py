"""Vital signs, score bands, assessment texts, cause lists, report texts."""

from __future__ import annotations

from typing import NamedTuple


class Vital(NamedTuple):
    name: str
    label: str
    low: float
    high: float
    description: str

    @property
    def unit(self) -> str:
        return self.label[self.label.rindex("(") + 1 : -1]


class GapBands(NamedTuple):
    """Closed bands ``(low, high, score)``; a value in no band, or null, takes ``fallback``."""

    bands: tuple[tuple[float | None, float, int], ...]
    fallback: int


class LadderStep(NamedTuple):
    """Applies up to and including ``upper``; the last step has no upper bound."""

    upper: float | None
    score: int
    problem: str | None


class Cause(NamedTuple):
    """A cause and when it is listed: ``needs`` names findings, ``terms`` words of the profile."""

    text: str
    needs: str | None = None
    terms: tuple[str, ...] = ()


class CauseRule(NamedTuple):
    """Causes for values above ``split`` and for the others."""

    split: float | None
    above: tuple[Cause, ...]
    otherwise: tuple[Cause, ...]


# The five vital signs in catalogue order.
VITAL_CATALOGUE = (
    Vital(
        "heart_rate", "Heart Rate (bpm)", 60.0, 100.0,
        "Tracks how fast the heart is beating — a key sign of stress, infection, or heart problems.",
    ),
    Vital(
        "respiratory_rate", "Resp Rate (/min)", 12.0, 20.0,
        "Breaths per minute — rises with lung issues, pain, anxiety, or low oxygen.",
    ),
    Vital(
        "spo2", "SpO₂ (%)", 95.0, 100.0,
        "Blood oxygen saturation — lower values may indicate breathing or circulation problems.",
    ),
    Vital(
        "systolic_bp", "Systolic BP (mmHg)", 90.0, 140.0,
        "Top number of blood pressure — reflects circulation and fluid status.",
    ),
    Vital(
        "temperature", "Temperature (°C)", 36.1, 38.0,
        "Body temperature — elevation often suggests infection or inflammation.",
    ),
)
VITALS = tuple(v.name for v in VITAL_CATALOGUE)
RISES_WHEN_WORSE = ("heart_rate", "respiratory_rate", "temperature")

# Early-warning bands of the score job. The gaps between them are meant.
SCORE_BANDS = {
    "heart_rate": GapBands(
        ((None, 40, 3), (41, 50, 1), (51, 90, 0), (91, 110, 1), (111, 130, 2)), 3
    ),
    "respiratory_rate": GapBands(((None, 8, 3), (9, 11, 1), (12, 20, 0), (21, 24, 2)), 3),
    "spo2": GapBands(((None, 91, 3), (92, 93, 2), (94, 95, 1)), 0),
    "systolic_bp": GapBands(((None, 90, 3), (91, 100, 2), (101, 110, 1), (111, 219, 0)), 3),
    "temperature": GapBands(((None, 35.0, 3), (35.1, 36.0, 1), (36.1, 38.0, 0), (38.1, 39.0, 1)), 2),
}

# Highest total score of a risk level; above the last one the risk is HIGH.
RISK_BOUNDS = ((4, "LOW"), (6, "MEDIUM"))
TOP_RISK = "HIGH"
REVIEW_RISKS = ("HIGH", "MEDIUM")

# Assessment ladders (temperature in °C) with their problem texts.
ASSESS_LADDERS = {
    "heart_rate": (
        LadderStep(40, 3, "Severe bradycardia — heart rate critically low"),
        LadderStep(50, 1, "Bradycardia — heart rate below normal"),
        LadderStep(90, 0, None),
        LadderStep(110, 1, "Mild tachycardia — heart rate elevated"),
        LadderStep(130, 2, "Tachycardia — heart rate significantly elevated"),
        LadderStep(None, 3, "Severe tachycardia — heart rate critically high"),
    ),
    "respiratory_rate": (
        LadderStep(8, 3, "Bradypnea — breathing critically slow"),
        LadderStep(11, 1, "Low respiratory rate — below normal"),
        LadderStep(20, 0, None),
        LadderStep(24, 2, "Tachypnea — breathing too fast"),
        LadderStep(None, 3, "Severe tachypnea — respiratory rate critically high"),
    ),
    "spo2": (
        LadderStep(91, 3, "Hypoxemia — oxygen saturation critically low"),
        LadderStep(93, 2, "Low SpO₂ — oxygen saturation significantly reduced"),
        LadderStep(95, 1, "Mild hypoxemia — oxygen saturation below normal"),
        LadderStep(None, 0, None),
    ),
    "systolic_bp": (
        LadderStep(90, 3, "Hypotension — systolic BP critically low"),
        LadderStep(100, 2, "Low blood pressure — systolic BP significantly reduced"),
        LadderStep(110, 1, "Mild hypotension — systolic BP below normal"),
        LadderStep(219, 0, None),
        LadderStep(None, 3, "Hypertensive crisis — systolic BP critically high"),
    ),
    "temperature": (
        LadderStep(35.0, 3, "Hypothermia — body temperature critically low"),
        LadderStep(36.0, 1, "Low temperature — below normal range"),
        LadderStep(38.0, 0, None),
        LadderStep(39.0, 1, "Fever — body temperature elevated"),
        LadderStep(None, 2, "High fever — body temperature significantly elevated"),
    ),
}
SEVERITIES = ("normal", "warning", "critical")
TREND_STEP = 0.5
MULTI_SYSTEM = 3
SHOWN_CAUSES = 3

# Likely causes in listing order.
CAUSE_RULES = {
    "heart_rate": CauseRule(
        90.0,
        (
            Cause("infection or sepsis", needs="fever_or_multi"),
            Cause("pain or anxiety"),
            Cause("dehydration"),
            Cause("heart failure decompensation", terms=("heart failure", "cabg", "coronary")),
            Cause("respiratory distress", terms=("copd", "asthma")),
        ),
        (
            Cause("beta-blocker effect", terms=("carvedilol", "beta")),
            Cause("medication effect"),
            Cause("heart block"),
            Cause("hypothermia"),
        ),
    ),
    "respiratory_rate": CauseRule(
        20.0,
        (
            Cause("pneumonia or chest infection", needs="has_fever"),
            Cause("COPD exacerbation", terms=("copd", "asthma")),
            Cause("bronchospasm", terms=("copd", "asthma")),
            Cause("anxiety"),
            Cause("pain"),
            Cause("metabolic acidosis"),
            Cause("hypoxia-driven breathing", needs="has_hypoxia"),
        ),
        (Cause("sedation"), Cause("neurological injury"), Cause("respiratory fatigue")),
    ),
    "spo2": CauseRule(
        None,
        (),
        (
            Cause("infection", needs="has_fever"),
            Cause("COPD exacerbation", terms=("copd", "asthma")),
            Cause("mucus plugging", terms=("copd", "asthma")),
            Cause("pneumonia", terms=("smok", "pneumonia")),
            Cause("pneumonia"),
            Cause("fluid in lungs"),
            Cause("atelectasis"),
        ),
    ),
    "systolic_bp": CauseRule(
        110.0,
        (
            Cause("severe pain"),
            Cause("hypertensive emergency"),
            Cause("medication non-adherence"),
        ),
        (
            Cause("diuretic effect", terms=("furosemide", "diuretic")),
            Cause("septic shock", needs="fever_and_multi"),
            Cause("dehydration"),
            Cause("blood loss"),
            Cause("medication effect"),
            Cause("heart failure decompensation", terms=("heart failure",)),
        ),
    ),
    "temperature": CauseRule(
        38.0,
        (
            Cause("infection"),
            Cause("viral illness (e.g. cold or flu)"),
            Cause("sepsis"),
            Cause("respiratory infection", terms=("pneumonia", "copd", "smok")),
        ),
        (Cause("exposure to cold"), Cause("hypothermia"), Cause("sepsis with shock")),
    ),
}

# Texts of the reports.
DASH = "—"
PROBLEM_SEPARATOR = " — "
CAUSES_PREFIX = "Likely causes: "
FACTORS_HEADING = "Likely contributing factors:"
BULLET = "  • "
TREND_NOTES = {"worsening": " and getting worse", "improving": " but improving"}
NO_PROBLEMS_TEXT = "No active problems — all vitals within normal range."
NO_DATA_TEXT = "No data"
NORMAL_TEXT = "Within normal range"
NO_VITALS_TEXT = "No vitals recorded in the last {hours} hours."
PROMPT_VITALS = ". Their vitals over the last {hours} hours:\n"
VITALS_TABLE_HEAD = (
    "Time | HR | RR | SpO2 | SBP | Temp(°C) | NEWS2 | Risk",
    "-----|----|----|------|-----|----------|-------|-----",
)
NONE_DOCUMENTED = "none documented"
PROMPT_BACKGROUND = "Patient background: "
PROMPT_YEARS, PROMPT_NO_AGE, PROMPT_NO_SEX = " years old", "age unknown", "unknown"
PROMPT_SCORE = "\nCurrent NEWS2 score: "
PROMPT_NO_RISK = "UNKNOWN"
PROMPT_ROLE = "You are a clinical decision support AI helping ICU doctors. "
PROMPT_QUESTION = (
    "In 2-3 sentences, explain what might be happening clinically "
    "and what the doctor should check first."
)
EMPTY_LABELS = {
    "home_address": "No home address on file.",
    "occupation": "No occupation on file.",
    "allergies": "No known drug allergies (NKDA)",
    "past_medical_conditions": "No documented past medical conditions.",
    "medical_history": "No additional medical history documented.",
    "current_medications": "No current medications on file.",
}
NO_SCORE_TEXT = "no score in Postgres"
