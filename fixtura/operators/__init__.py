"""Relational operators over contests, rosters, quotes and forecasts."""
