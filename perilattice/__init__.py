"""Trajectory analytics for periodic systems on Spark."""
