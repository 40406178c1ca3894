"""votesel: partition-and-vote feature selection expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
