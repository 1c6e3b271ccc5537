"""All queries by name: (function of session and folder, SQL twin or None)."""

from gaugewatch.plans import cleaning, lifecycle, profiles, retrievals, verdicts

QUERIES = {**cleaning.QUERIES, **profiles.QUERIES, **retrievals.QUERIES, **verdicts.QUERIES, **lifecycle.QUERIES}
