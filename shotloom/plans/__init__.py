"""Multi-stage plans over the operators, with pluggable models."""
