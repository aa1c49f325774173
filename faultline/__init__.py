"""Change impact, input drift and catalog health as Spark DataFrame jobs.

Every entry point takes DataFrames and returns DataFrames, and handles many
changes, models or assets in one job.  The rule kept throughout: missing
evidence never reads as proof of safety.
"""
