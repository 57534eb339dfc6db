"""Part of leaseweave."""
