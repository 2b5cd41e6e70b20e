"""Operators of seqlab."""
