"""Trajectory and corpus analytics as plain DataFrame -> DataFrame functions."""
