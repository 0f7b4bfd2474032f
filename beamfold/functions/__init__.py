"""Column functions (Catalyst expressions) and the Arrow kernels behind the few that need numpy."""
