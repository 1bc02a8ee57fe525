"""Kernels over one sheet's pixels: NumPy on a gray raster (height x width, 0 = ink, 255 = paper), a sheet per row."""
