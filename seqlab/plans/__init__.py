"""Plans of seqlab."""
