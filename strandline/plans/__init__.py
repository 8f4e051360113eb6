"""Ready queries over the driver's tables."""
