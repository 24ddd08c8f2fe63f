"""Site-survey analytics on Spark: clean, match, locate, and work out where a watched species is."""
