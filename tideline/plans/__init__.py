"""Whole runs: train, predict, backtest."""
