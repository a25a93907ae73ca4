"""cohortlens: learning-analytics tables, audits, rates, reports and models on Spark."""
