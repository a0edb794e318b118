"""Column functions: normalising, tokenising, stemming, cleaning and the variable-length integer code."""
