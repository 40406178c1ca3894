"""User-level plans: the full partition-and-vote selection run and its report."""

from votesel.plans.pipeline import SelectionResult, select_features  # noqa: F401
