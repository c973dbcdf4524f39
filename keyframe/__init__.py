"""Evaluation and keyframe analytics on DataFrames."""
