"""Counting text under published and alternative rules, grading it against constraints, and reporting, on Spark."""
