"""Part of lekhya."""
