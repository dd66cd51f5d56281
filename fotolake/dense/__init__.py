"""Numpy kernels on float arrays (h, w) or (h, w, 3), and their application to tables of tiles."""
