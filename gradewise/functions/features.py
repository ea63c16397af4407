"""Derived-feature formulas as Spark column expressions.

Each feature set is one ``withColumns`` projection; shared terms
(ActivityCount, AcademicEngagementScore) are reused as expressions and
codegen's subexpression elimination computes them once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 12 base columns of the feature-engineering scenarios
# (student table without the GPA leak column), in the reference order.
BASE_COLUMNS = [
    "Age", "Gender", "Ethnicity", "ParentalEducation", "StudyTimeWeekly", "Absences",
    "Tutoring", "ParentalSupport", "Extracurricular", "Sports", "Music", "Volunteering",
]


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def activity_count() -> Column:
    return _c("Extracurricular") + _c("Sports") + _c("Music") + _c("Volunteering")


def engagement() -> Column:
    return _c("StudyTimeWeekly") + 2.0 * _c("Tutoring") + _c("ParentalSupport") - 0.6 * _c("Absences")


def support_activity() -> Column:
    return _c("ParentalSupport") * (activity_count() + 1.0)


# Derived feature names and formulas (F1..F17).
FORMULAS: dict[str, Callable[[], Column]] = {
    "StudyTimePerAbsence": lambda: _c("StudyTimeWeekly") / (_c("Absences") + 1.0),
    "SupportTutoringInteraction": lambda: _c("ParentalSupport") * _c("Tutoring"),
    "AcademicEngagementScore": engagement,
    "ActivityCount": activity_count,
    "SupportActivityInteraction": support_activity,
    "AbsenceRateLog": lambda: F.log1p(_c("Absences")),
    "StudyTimeSquared": lambda: _c("StudyTimeWeekly") * _c("StudyTimeWeekly"),
    "AbsencesSquared": lambda: _c("Absences") * _c("Absences"),
    "TutoringPerSupport": lambda: _c("Tutoring") / (_c("ParentalSupport") + 1.0),
    "StudySupportProduct": lambda: _c("StudyTimeWeekly") * (_c("ParentalSupport") + 1.0),
    "ActivityWeightedSupport": lambda: activity_count() * (_c("ParentalSupport") + 1.0),
    "EngagementPerActivity": lambda: engagement() / (activity_count() + 1.0),
    "AbsencePressure": lambda: _c("Absences") / (_c("StudyTimeWeekly") + 1.0),
    "SupportMinusAbsences": lambda: _c("ParentalSupport") - 0.3 * _c("Absences"),
    "TutoringAbsenceInteraction": lambda: _c("Tutoring") * _c("Absences"),
    "StudyActivityBalance": lambda: _c("StudyTimeWeekly") / (activity_count() + 1.0),
    "CommitmentComposite": lambda: 0.5 * engagement() + 0.3 * support_activity() - 0.2 * _c("Absences"),
}

# Which derived features each feature set adds to the base.
FEATURE_SETS: dict[str, list[str]] = {
    "v1": [
        "StudyTimePerAbsence", "SupportTutoringInteraction", "AcademicEngagementScore",
        "ActivityCount", "SupportActivityInteraction",
    ],
    "v4": [
        "StudyTimePerAbsence", "SupportTutoringInteraction", "AcademicEngagementScore",
        "ActivityCount", "SupportActivityInteraction", "AbsenceRateLog", "StudySupportProduct",
        "AbsencePressure", "TutoringAbsenceInteraction", "StudyActivityBalance",
        "SupportMinusAbsences", "CommitmentComposite",
    ],
    "v2_ext": list(FORMULAS),
}


def derived(names: list[str]) -> dict[str, Column]:
    return {n: FORMULAS[n]() for n in names}
