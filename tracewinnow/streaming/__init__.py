"""The sampler as a stateful stream."""
