"""Multi-step jobs: matrix assembly, models, backtests, tuning, reads."""
