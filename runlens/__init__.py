"""runlens: DataFrame operators over coding-agent evaluation data and training-data corpora."""
