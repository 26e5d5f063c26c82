"""Labelled point-year panels on Spark."""
