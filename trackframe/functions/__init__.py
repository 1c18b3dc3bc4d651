"""Column functions: geometry, vectors, boxes, text, noise schedules."""
