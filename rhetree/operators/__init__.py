"""Operators on pairs, weights, predictions, folds, graphs and texts."""
