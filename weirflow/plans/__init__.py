"""Query registries: each module holds a QUERIES and an ORACLES dictionary."""
