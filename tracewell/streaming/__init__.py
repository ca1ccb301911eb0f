"""Empty on purpose: no operator that this engine offers works on a stream."""
