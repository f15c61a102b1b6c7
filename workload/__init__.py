"""Queries over the driver's tables, bound to the operators' input schemas."""
