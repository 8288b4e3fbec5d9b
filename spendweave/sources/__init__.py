"""Readers for billing exports, IaC state, cost pages, PR exports and documents; table sinks."""
