"""Operators on DataFrames: candidates, evidence, scoring, graphs, linking, refinement, evaluation."""
