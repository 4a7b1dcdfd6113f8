"""Plans made of named stages."""
