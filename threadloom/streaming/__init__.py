"""The document store and its continuous queries."""
