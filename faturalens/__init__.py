"""Revenue analytics and report-text validation on Spark DataFrames."""
