"""Cleaning under approval: proposals that change nothing, and an apply that keeps what was there."""
