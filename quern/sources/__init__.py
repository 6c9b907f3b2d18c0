"""sources of quern."""
