"""Readers and writers. Paths are whatever Spark reads; nothing is opened on the driver."""
