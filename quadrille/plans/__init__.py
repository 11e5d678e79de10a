"""Registered queries: geometry expressed as plans over tables."""
