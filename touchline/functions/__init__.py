"""Column functions: boxes, projections, homographies, labels."""
