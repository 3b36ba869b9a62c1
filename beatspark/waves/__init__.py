"""Waveform kernels (NumPy, one chunk or beat at a time) and the Spark jobs that run them."""
