"""Fixture derivations, the query catalog, SQL oracles and end-to-end flows."""
