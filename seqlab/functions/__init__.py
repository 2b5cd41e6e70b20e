"""Functions of seqlab."""
