"""Observation stores."""
