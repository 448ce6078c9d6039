"""Plans of the engine: bridge tables, registered queries, sessions."""
