"""The streaming front: jobs in, events out."""
