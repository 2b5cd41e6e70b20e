"""Sources of seqlab."""
