"""Features, binning, metrics and scorecards for credit-risk style data as Spark jobs."""
