"""Data-parallel training: small numpy kernels inside Spark tasks."""
