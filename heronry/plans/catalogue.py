"""Every named query of the core and the SQL it is checked against."""

from heronry.plans import context, evaluation, pipeline, relational, retrieval, sessions, texts  # noqa: F401
from heronry.plans.registry import QUERIES, SQL  # noqa: F401
