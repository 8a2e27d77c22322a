"""Part of courtspark."""
