"""DataFrame operators of the match-tracking engine."""
