"""Query catalogue: each module maps query names to callables and, where SQL can say it, to oracle SQL."""
