"""spanweave: event-time alignment and keyed dataflows as Spark plans."""

__version__ = "0.1.0"
