"""Plan helpers: sessions, shared storage and the query registry."""
