"""Time stepping, and evaluation of frames as they arrive."""
