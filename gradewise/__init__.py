"""gradewise: tabular-classification preparation, encoding, resampling,
modelling and evaluation expressed as Spark DataFrame jobs.

Every operator takes a DataFrame plus a :class:`~gradewise.roles.Roles`
declaration and returns a DataFrame; fitted operators return small lookup
DataFrames that are joined back (broadcast only behind a size check).
"""

from gradewise.roles import Roles, STUDENT_ROLES, NO_GPA_ROLES  # noqa: F401

__all__ = ["Roles", "STUDENT_ROLES", "NO_GPA_ROLES"]
