"""Named metrics, saved SQL and the registered queries."""
