"""Query plans over the given tables: fixtures derived from them and the
registered queries."""
