"""Text kernels that are state machines: transcoding, maths, papers, forms."""
