"""Decoders of captured bytes, without Spark."""
