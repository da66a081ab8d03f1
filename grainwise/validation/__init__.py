"""Checks of a table against its contract: passed + failed + not_checked = rows."""
