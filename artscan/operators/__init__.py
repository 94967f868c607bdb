"""Operators on tables: detectors, rules, correlation, verdicts, findings."""
