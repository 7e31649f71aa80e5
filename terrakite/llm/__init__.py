"""Operators for language- and learning-oriented pipelines.  Nothing else in terrakite imports this."""
