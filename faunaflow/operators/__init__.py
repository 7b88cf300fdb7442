"""Operators on fixes, trajectories, events, grids and graphs: DataFrame in, DataFrame out."""
