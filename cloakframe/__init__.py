"""Find, mask, sanitize, pseudonymize, redact, fingerprint and encrypt data with Spark."""

__version__ = "0.1.0"
