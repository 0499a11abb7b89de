"""Relational operators: cohorts, hourly grids, windows, imputation, features, slots, snapshots, events, serving."""
