"""Packet-capture analytics and corpus preparation expressed as Spark plans."""
