"""Split, model fit, scoring and explanation."""
