"""Operators for preparing training text at cluster scale.

Nothing outside this package imports it; the driver entry adds its queries
only when it is present.
"""
