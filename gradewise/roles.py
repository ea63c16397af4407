"""Column-role declarations shared by every operator.

A scenario of the reference (with / without the leaking GPA column, derived
feature sets) is a different ``Roles`` value over the same DataFrame, never a
different copy of the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    key: str
    label: str
    continuous: tuple[str, ...]
    categorical: tuple[str, ...]
    ordered: tuple[str, ...] = field(default_factory=tuple)

    @property
    def features(self) -> list[str]:
        return [*self.continuous, *self.categorical]

    def without(self, *cols: str) -> "Roles":
        return replace(
            self,
            continuous=tuple(c for c in self.continuous if c not in cols),
            categorical=tuple(c for c in self.categorical if c not in cols),
            ordered=tuple(c for c in self.ordered if c not in cols),
        )


# Column roles of the student table (continuous block first,
# then the int-coded categoricals; the two ordered categoricals).
STUDENT_ROLES = Roles(
    key="row_key",
    label="GradeClass",
    continuous=("Age", "StudyTimeWeekly", "Absences", "GPA"),
    categorical=(
        "Gender",
        "Ethnicity",
        "ParentalEducation",
        "Tutoring",
        "ParentalSupport",
        "Extracurricular",
        "Sports",
        "Music",
        "Volunteering",
    ),
    ordered=("ParentalEducation", "ParentalSupport"),
)

# "sin GPA" scenario: GPA leaks the label and is dropped.
NO_GPA_ROLES = STUDENT_ROLES.without("GPA")
