"""The reference's entry points, put together from operators."""
