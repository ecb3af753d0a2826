"""Column expressions: grid arithmetic, rotation, packing, normalisation, geodesy."""
