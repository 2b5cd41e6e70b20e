"""Streaming of seqlab."""
