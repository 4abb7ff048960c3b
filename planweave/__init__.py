"""Corpora of 2-D line drawings as Spark tables: segments, walls, box models, rooms and jobs."""
