"""Part of okrug."""
