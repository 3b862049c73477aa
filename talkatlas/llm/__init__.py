"""Operators for preparing large-scale language-model training data.

Nothing else in the package imports this subpackage.
"""
