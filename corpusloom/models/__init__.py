"""Subword models: encoding, lattices and training."""
