"""Sources: landed raw payloads, the driver's tables as payload fixtures, the
post store (scan side) and file exports (sink side)."""
