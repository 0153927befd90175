"""Relational operators, learners, profiles and metadata checks."""
