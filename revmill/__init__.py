"""Review-corpus curation, split building and grouped evaluation on Spark."""
