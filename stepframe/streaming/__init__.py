"""The step loop driven by a stream."""
