"""Carriers (benchmark tables derived from the test tables) and the query catalogue."""
