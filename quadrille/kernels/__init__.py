"""Iterative geometry in numpy, run on Arrow batches where no closed form exists."""
